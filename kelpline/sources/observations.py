"""Observations projected from the events table, by arithmetic that any SQL engine repeats exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.geo import epoch_ms, geohash
from kelpline.sources.dims import watchboxes

DAY = 86_400_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _whole(x: Column, by: int) -> Column:
    return F.floor(x / F.lit(by)).cast("long")


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fix an event: ships and aircraft by user in one of ten boxes, a third of them wandering out of theirs;
    quakes and fire pixels by event.  The boxes are a fixed list of ten rows."""
    e = events(spark, sf_dir).select("event_id", epoch_ms("ts").alias("ts_ms"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    u = F.col("user_id") % 8
    e = e.withColumns({
        "domain": F.when(u <= 2, 2).when(u <= 5, 1).when(u == 6, 4).otherwise(5),
        "bx": (_whole(F.col("user_id"), 8) % 10).cast("int"), "s": F.when(F.col("user_id") % 3 == 0, F.lit(1.6)).otherwise(F.lit(0.25)),
    })
    b = watchboxes(spark).select(F.col("box_id").alias("b_id"), "min_lat", "min_lon", "max_lat", "max_lon")
    e = e.join(F.broadcast(b), F.col("bx") == F.col("b_id"))
    i, user, k, d = F.col("event_id"), F.col("user_id"), F.col("k"), F.col("domain")
    at = lambda lo, hi, a, c, m: F.col(lo) + (F.col(hi) - F.col(lo)) * ((i * a + user * c) % m) / F.lit(float(m)) * F.col("s")
    lat, lon = at("min_lat", "max_lat", 7919, 104729, 10007), at("min_lon", "max_lon", 6007, 15485863, 10009)
    own = F.when(d <= 2, user).otherwise(i).cast("string")
    name = F.when(d == 2, "sea:").when(d == 1, "air:").when(d == 4, "geo:").otherwise("thermal:")
    air = F.when(k <= 40, 2).otherwise(0) + F.when(user % 11 == 0, 32).otherwise(0) + F.when((F.col("event_type") == "signup") & (k < 10), 64).otherwise(0)
    sea_kind = F.element_at(F.array(*map(F.lit, ("crude oil tanker", "cargo", "pilot", "fishing", "bulk carrier"))), (user % 5 + 1).cast("int"))
    air_kind = F.element_at(F.array(*map(F.lit, ("jet", "B738", "turboprop"))), (user % 3 + 1).cast("int"))
    out = e.select(
        i.alias("obs_id"), "ts_ms", d.cast("int").alias("domain"), F.concat(name, own).alias("entity_id"), lat.alias("lat"), lon.alias("lon"),
        F.when(d == 1, 3000.0 + k * 100).when(d == 4, -(k % 12) * 1000.0).alias("alt_m"),
        ((F.floor("value") % 25 + 0.5) * F.when(d == 1, 18.0).otherwise(1.0)).alias("sog_kt"), ((i * 53) % 360).cast("double").alias("cog_deg"),
        F.when(d == 1, air).otherwise(0).alias("flags"), F.when(d == 2, sea_kind).when(d == 1, air_kind).alias("kind"), F.concat(F.lit("E"), user.cast("string")).alias("label"),
        F.when(d == 1, F.when(k == 7, "7700").when(k == 8, "7600").when(k == 9, "7500")).alias("squawk"),
        F.when(d == 4, 2.0 + F.col("value") / 50).alias("mag"), F.when(d == 4, (k % 12).cast("double")).alias("depth_km"), F.when(d == 5, F.col("value")).alias("frp"),
        F.when(d == 1, 1).when(d == 2, 3).when(d == 4, 5).otherwise(6).alias("source_id"), _whole(i, 100).alias("provenance_id"), "user_id", "event_type",
    )
    return out.withColumn("geohash5", geohash("lat", "lon", 5))


def burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense tracks of 50 fixes a minute apart: aircraft on circles or straight lines, and pairs of ships that meet.
    ``seed`` is the event, ``step`` the fix's number, ``now_ms`` the last one's time."""
    s = sparse(spark, sf_dir)
    steps = F.explode(F.sequence(F.lit(0), F.lit(49))).alias("step")
    i, turn = F.col("step"), F.radians(F.col("step") * 18.0)
    air = s.where("domain = 1 and event_type in ('view', 'error')").select("*", steps)
    circle = F.col("event_type") == "view"
    air = air.select(
        F.col("obs_id").alias("seed"), "step", (F.col("ts_ms") + i * 60000).alias("ts_ms"), (F.col("ts_ms") + 49 * 60000).alias("now_ms"), F.col("domain"),
        F.concat(F.lit("air:"), F.col("obs_id").cast("string")).alias("entity_id"),
        (F.col("lat") + F.when(circle, F.sin(turn) * 0.37).otherwise(i * 0.11)).alias("lat"),
        (F.col("lon") + F.when(circle, F.cos(turn) * 0.37 / F.cos(F.radians("lat"))).otherwise(0.0)).alias("lon"),
        F.lit(9144.0).alias("alt_m"), F.lit(420.0).alias("sog_kt"), "cog_deg", "flags", "kind", F.lit("").alias("label"),
    )
    hulls = F.explode(F.sequence(F.lit(0), F.lit(1))).alias("hull")
    sea = s.where("domain = 2 and event_type = 'purchase'").select("*", steps).select("*", hulls)
    h, near = F.col("hull"), F.when(i < 20, (20 - i) * 0.003 * (1 - 2 * F.col("hull"))).otherwise(0.0)
    name = F.concat(F.col("obs_id").cast("string"), F.lit("-"), h.cast("string"))
    sea = sea.select(
        F.col("obs_id").alias("seed"), "step", (F.col("ts_ms") + i * 60000).alias("ts_ms"), (F.col("ts_ms") + 49 * 60000).alias("now_ms"), F.col("domain"),
        F.concat(F.lit("sea:"), name).alias("entity_id"), (F.col("lat") + h * 0.0018 + near).alias("lat"), "lon", F.lit(None).cast("double").alias("alt_m"),
        F.when(i < 20, 10.0).otherwise(0.3).alias("sog_kt"), "cog_deg", "flags", "kind", F.concat(F.lit("E"), name).alias("label"),
    )
    both = air.unionByName(sea).withColumn("obs_id", F.col("seed") * 100 + F.col("step"))
    return both.withColumn("geohash5", geohash("lat", "lon", 5))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every hundred events: what a poll of a source brought."""
    e = events(spark, sf_dir).withColumn("id", _whole(F.col("event_id"), 100))
    lines = F.array_sort(F.collect_list(F.concat(F.format_string("%012d", "event_id"), F.lit(":"), "props")))
    out = e.groupBy("id").agg(F.min(epoch_ms("ts")).alias("fetched_ms"), F.array_join(lines, "\n").alias("payload"), F.count(F.lit(1)).alias("record_count"))
    return out.withColumns({"source_id": (F.col("id") % 7 + 1).cast("int"), "http_status": F.when(F.col("id") % 13 == 0, 500).otherwise(200)})
