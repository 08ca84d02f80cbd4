"""Moving-object and geospatial event analytics as Spark DataFrame operators."""
