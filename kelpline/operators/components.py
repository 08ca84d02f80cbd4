"""Connected components of an edge table, for single-linkage clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.plans.checkpoints import checkpointed


def _lowest(pairs: DataFrame) -> DataFrame:
    """(u, v, m): pairs with the least of u and all v that it is paired with.  Grouped, not windowed: a hub's
    pairs are combined before the shuffle, and the join back may split it."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("k")).drop("k")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node that has an edge; component is the least node.

    Alternates two steps until nothing changes: each node ties its larger neighbours to the least
    neighbour, then its smaller neighbours and itself.  The rounds grow with the logarithm of the
    longest path.  Nulls and loops are dropped; raises if ``most_rounds`` don't do.
    """
    pairs = edges.select(F.least(src, dst).alias("v"), F.greatest(src, dst).alias("u")).where("u is not null and v is not null and u <> v").distinct()
    seen = None
    for _ in range(most_rounds):
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = _lowest(large)
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        pairs = checkpointed(small.where("u <> v").distinct())
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            roots = pairs.select(F.col("v").alias("u"), "v").distinct()
            return pairs.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
    raise RuntimeError(f"components haven't settled in {most_rounds} rounds")
