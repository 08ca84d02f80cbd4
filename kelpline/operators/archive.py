"""The observation archive: writing, thinning, retention, and counters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.functions.geo import geohash, quantize
from kelpline.plans.checkpoints import checkpointed, delete_folder


def write_observations(obs: DataFrame, path: str) -> None:
    """Appends to Parquet by date and domain, each file sorted by entity and time."""
    day = F.to_date(F.timestamp_millis("ts_ms"))
    out = obs.withColumns({"date": day, "geohash5": geohash("lat", "lon", 5), "source_id": F.coalesce("source_id", F.lit(0))})
    out.repartition("date", "domain").sortWithinPartitions("date", "domain", "entity_id", "ts_ms").write.mode("append").partitionBy("date", "domain").parquet(path)


def stamp_provenance(obs: DataFrame, log: DataFrame) -> DataFrame:
    """Only rows of payloads that were fetched well (2xx) and not empty, stamped with their source."""
    good = log.where(F.col("http_status").between(200, 299) & (F.col("record_count") > 0)).select(F.col("id").alias("provenance_id"), F.col("source_id").alias("stamped_source"))
    return obs.join(good, "provenance_id")


def thinned(obs: DataFrame, now_ms: int, raw_h: int = 12, track_h: int = 168, bucket_min: int = 30) -> DataFrame:
    """All rows of the last ``raw_h`` hours; before that the newest of each entity and bucket; none before ``track_h``."""
    raw, horizon = now_ms - raw_h * 3_600_000, now_ms - track_h * 3_600_000
    w = Window.partitionBy("entity_id", "bucket").orderBy(F.col("ts_ms").desc(), F.col("obs_id").desc())
    old = obs.where((F.col("ts_ms") < raw) & (F.col("ts_ms") >= horizon)).withColumn("bucket", quantize("ts_ms", bucket_min * 60_000))
    old = old.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "bucket")
    return obs.where(F.col("ts_ms") >= raw).unionByName(old)


def retention_counts(obs: DataFrame, now_ms: int, raw_h: int = 12, track_h: int = 168, bucket_min: int = 30) -> DataFrame:
    """(kept, thinned, purged) rows, without writing anything."""
    raw, horizon = now_ms - raw_h * 3_600_000, now_ms - track_h * 3_600_000
    t = F.col("ts_ms")
    kept = thinned(obs, now_ms, raw_h, track_h, bucket_min).agg(F.count(F.lit(1)).alias("kept"))
    all_ = obs.agg(F.count_if(t < horizon).alias("purged"), F.count_if((t >= horizon) & (t < raw)).alias("old"), F.count_if(t >= raw).alias("raw"))
    return all_.join(kept, F.lit(True)).select("kept", (F.col("old") + F.col("raw") - F.col("kept")).alias("thinned"), "purged")


def apply_retention(spark: SparkSession, path: str, entities: DataFrame, now_ms: int, raw_h: int = 12, track_h: int = 168, bucket_min: int = 30) -> DataFrame:
    """Thins and purges an archive that ``write_observations`` wrote, and returns the entities that were heard within
    ``track_h``.  Days that are raw stay as they are; those that change are written anew, and a day's domain of which nothing
    stays loses its folder.  A run that is repeated finds nothing more to do.
    """
    raw, horizon = now_ms - raw_h * 3_600_000, now_ms - track_h * 3_600_000
    date = lambda ms: F.to_date(F.timestamp_millis(F.lit(ms)))
    obs = spark.read.parquet(path)
    past = obs.where((F.col("date") >= date(horizon)) & (F.col("date") <= date(raw)))
    # Kept before it is written back, as its source is what it replaces.
    kept = checkpointed(thinned(past, now_ms, raw_h, track_h, bucket_min))
    parts = lambda df: {(r.date, r.domain) for r in df.select("date", "domain").distinct().collect()}
    before, left = parts(obs.where(F.col("date") <= date(raw))), parts(kept)  # as many as there are days and domains
    how = {"partitionOverwriteMode": "dynamic"}
    kept.repartition("date", "domain").sortWithinPartitions("date", "domain", "entity_id", "ts_ms").write.mode("overwrite").options(**how).partitionBy("date", "domain").parquet(path)
    for day, domain in before - left:
        delete_folder(spark, f"{path}/date={day}/domain={domain}")
    return live_within(entities, now_ms, track_h)


def live_within(entities: DataFrame, now_ms: int, track_h: int = 168) -> DataFrame:
    """Entities that aren't stale: heard within ``track_h``."""
    return entities.where(F.col("last_seen") >= now_ms - track_h * 3_600_000)


def trim_to_rows(obs: DataFrame, max_rows: int) -> DataFrame:
    """Whole days, from the newest back, while they fit: (day, n, kept).  Windows run over one row a day."""
    days = obs.groupBy(quantize("ts_ms", 86_400_000).alias("day_ms")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.col("day_ms").desc()))
    return days.withColumn("kept", total <= max_rows)


def trimmed(obs: DataFrame, max_rows: int) -> DataFrame:
    """The rows of the days that ``trim_to_rows`` keeps."""
    days = trim_to_rows(obs, max_rows).where("kept").select(F.col("day_ms").alias("kept_day"))
    return obs.join(days, quantize("ts_ms", 86_400_000) == F.col("kept_day"), "left_semi")


def trim_storage(spark: SparkSession, folder: str, max_bytes: int, spare: int = 1) -> list[int]:
    """Frees an archive laid out by ``day_ms=...`` down to ``max_bytes``, oldest days first, and returns the days that went.

    Sizes are those of files, as the file system tells them; no row is read.  The newest ``spare`` days always stay, as ticks write
    to them.  A day's folder is first renamed to where readers don't look, so that none meets a half of it, and an append that comes
    meanwhile makes a new one, which the next trim sees."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = storage_by_day(spark, folder)
    total, gone = sum(size.values()), []
    for day in sorted(size)[: max(0, len(size) - spare)]:
        if total <= max_bytes:
            break
        aside = path(f"{folder}/_trimmed/{uuid.uuid4().hex}")
        fs.mkdirs(aside.getParent())
        if fs.rename(path(f"{folder}/day_ms={day}"), aside):
            fs.delete(aside, True)
            total -= size[day]
            gone.append(day)
    return gone


def storage_by_day(spark: SparkSession, folder: str) -> dict[int, int]:
    """Bytes of each day's files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/day_ms=*")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {int(x.getPath().getName().split("=")[1]): fs.getContentSummary(x.getPath()).getLength() for x in fs.globStatus(path) or ()}


def archive_stats(obs: DataFrame, *keys: str) -> DataFrame:
    aggs = (F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("oldest"), F.max("ts_ms").alias("newest"), F.count_distinct("entity_id").alias("entities"))
    return obs.groupBy(*keys).agg(*aggs)


def ingest_health(log: DataFrame) -> DataFrame:
    """One row a source: attempts, successes, failures since the last success, records and bytes, seconds to wait."""
    ok = F.col("http_status").between(200, 299)
    # Grouped, not windowed: sums combine before the shuffle, and no payload is in it.
    at = F.struct("fetched_ms", "id")
    rows = log.select("source_id", "fetched_ms", "id", "record_count", ok.alias("ok"), F.octet_length("payload").cast("long").alias("size"))
    last = rows.where("ok").groupBy("source_id").agg(F.max(at).alias("last_ok")).withColumnRenamed("source_id", "s")
    sums = rows.groupBy("source_id").agg(
        F.max("fetched_ms").alias("last_attempt"), F.max(F.when(F.col("ok"), F.col("fetched_ms"))).alias("last_success"), F.count(F.lit(1)).alias("attempts"),
        F.count_if("ok").alias("successes"), F.sum(F.when(F.col("ok"), F.col("record_count")).otherwise(0)).alias("records"), F.sum("size").alias("bytes"),
    )
    late = rows.join(last, F.col("source_id") == F.col("s"), "left").where(F.col("last_ok").isNull() | (at > F.col("last_ok")))
    streak = late.groupBy(F.col("source_id").alias("s")).agg(F.count(F.lit(1)).alias("streak"))
    out = sums.join(streak, F.col("source_id") == F.col("s"), "left").drop("s").withColumn("streak", F.coalesce("streak", F.lit(0)))
    wait = F.when(F.col("streak") > 0, F.least(F.lit(300.0), F.pow(F.lit(2.0), F.least(F.lit(8), F.col("streak"))))).otherwise(0.0)
    return out.withColumn("backoff_s", wait.cast("long"))
