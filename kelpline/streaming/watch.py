"""Ticks that keep what outlives a batch: last fixes, open gaps, what is usual, and incidents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kelpline.functions.codes import AIR, SEA
from kelpline.functions.geo import hour_of_week, quantize
from kelpline.operators import engine, fusion
from kelpline.operators.components import connected_components
from kelpline.operators.detectors import CAPS, HOUR, baseline_samples, gaps
from kelpline.operators.state import LAST, after_known, last_known
from kelpline.plans.checkpoints import checkpointed
from kelpline.streaming.jobs import DAY_MS
from kelpline.streaming.kept import KeptTable

GAP = "entity_id string, went_dark_ms long, domain int, lat double, lon double, sog_kt double, cog_deg double, box_key string, state string, back_ms long, obs_id long, verdict string, score double"
MEMBER = "day_ms long, id long, rule string, severity int, ts_start long, ts_end long, lat double, lon double, hash string, watchbox string, cluster long, since long"
GROUP = "cluster long, first_ms long, last_ms long"
INCIDENT = "cluster long, members long, n_domains long, domains array<int>, ts_start long, ts_end long, lat double, lon double, detection_ids array<long>, lead string, watchbox string, severity int, radius_km long, title string, narrative string, hash string"
WINDOW_MS = 90 * 60_000


def columns(schema: str) -> list[str]:
    return StructType.fromDDL(schema).names


class Kept:
    """The tables of one watch, below one folder.

    ``last``: each entity's last fix.  ``gaps``: silences, open or closed.  ``pending``: counts of hours that aren't over.  ``usual``:
    count, mean and squares of each cell and season.  ``clock``: up to when hours are folded.  ``members``: detections with the name
    of their group.  ``groups``: extent in time of groups of two and more.  ``incidents``: groups that pass the gates.
    """

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = 16):
        table = lambda name, keys, schema, part=None: KeptTable(spark, f"{folder}/{name}", keys, schema, part, compact_every)
        self.last = table("last", ("entity_id",), LAST)
        self.gaps = table("gaps", ("entity_id", "went_dark_ms"), GAP)
        self.pending = table("pending", ("cell", "sample_ms"), "cell string, sample_ms long, n long")
        self.usual = table("usual", ("cell", "season"), "cell string, season int, samples long, mean double, m2 double")
        self.clock = table("clock", ("name",), "name string, at_ms long")
        self.members = table("members", ("day_ms", "id", "hash"), MEMBER, "day_ms")
        self.groups = table("groups", ("cluster",), GROUP)
        self.incidents = table("incidents", ("cluster",), INCIDENT)


# ---- gaps


def closed_gaps(batch: DataFrame, known: DataFrame, boxes: DataFrame) -> DataFrame:
    """Gaps that a batch's fixes close, whenever they began."""
    g = gaps(batch, boxes, known=known)
    return g.select("entity_id", F.col("prev_ts_ms").alias("went_dark_ms"), "domain", F.col("prev_lat").alias("lat"), F.col("prev_lon").alias("lon"), F.col("prev_sog_kt").alias("sog_kt"), F.col("prev_cog_deg").alias("cog_deg"), "box_key", F.lit("closed").alias("state"), F.col("ts_ms").alias("back_ms"), "obs_id", F.col("v.verdict").alias("verdict"), F.col("v.score").cast("double").alias("score"))


def keep_gaps(kept: Kept, batch: DataFrame, opened: DataFrame | None, boxes: DataFrame, epoch: int) -> None:
    """Closes, opens and withdraws gaps, and moves last fixes on.

    A gap opens when the scan finds an entity silent, and closes with its next fix.  One that was opened although a fix from before
    its threshold was still on its way is withdrawn when that comes."""
    known = kept.last.before(epoch)
    batch = batch.where(F.col("domain").isin(SEA, AIR))
    moved = after_known(batch, known)
    closed = checkpointed(closed_gaps(batch, known, boxes))
    heard = moved.where("not known_").groupBy("entity_id").agg(F.min("ts_ms").alias("heard_ms"))
    over = kept.gaps.before(epoch).where("state = 'open'").join(heard, "entity_id").join(closed.select("entity_id", "went_dark_ms"), ["entity_id", "went_dark_ms"], "left_anti")
    changed = closed.unionByName(over.withColumn("state", F.lit("withdrawn")).drop("heard_ms"))
    if opened is not None:
        changed = changed.unionByName(opened.withColumnRenamed("went_dark_at", "went_dark_ms").withColumn("state", F.lit("open")), allowMissingColumns=True)
    kept.gaps.write(changed.select(*columns(GAP)), epoch)
    kept.last.write(last_known(moved), epoch)


# ---- what is usual


def usual(kept: Kept, epoch: int, least: int = 8) -> DataFrame:
    """The baseline as earlier ticks have folded it."""
    u = kept.usual.before(epoch).where(F.col("samples") >= least)
    return u.withColumn("sd", F.sqrt(F.col("m2") / (F.col("samples") - 1)))


def fold_usual(kept: Kept, batch: DataFrame, now_ms: int, epoch: int, precision: int, every_ms: int, season: Callable) -> None:
    """Adds the counts of hours that are over to moments by cell and season; those of the others wait.  Fixes of an hour that has
    been folded come too late for it."""
    done = (kept.clock.before(epoch).agg(F.max("at_ms")).first()[0]) or -(1 << 62)
    upto = now_ms // every_ms * every_ms  # hours that begin before this are over
    fresh = baseline_samples(batch, precision, every_ms).where(F.col("sample_ms") >= done)
    open_ = kept.pending.before(epoch)
    counts = checkpointed(open_.unionByName(fresh).groupBy("cell", "sample_ms").agg(F.sum("n").alias("n")))
    over = F.col("sample_ms") < max(upto, done)
    kept.pending.write(counts.withColumn("gone", over), epoch)
    n, x = F.col("samples"), F.col("n")
    new = counts.where(over).withColumn("season", season(F.col("sample_ms")).cast("int")).groupBy("cell", "season").agg(F.count(F.lit(1)).alias("samples"), F.avg("n").alias("mean"), (F.var_pop("n") * F.count(F.lit(1))).alias("m2"))
    old = kept.usual.before(epoch).select("cell", "season", F.col("samples").alias("n"), F.col("mean").alias("was"), F.col("m2").alias("m2_was"))
    both = new.join(old, ["cell", "season"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "was": F.coalesce("was", F.lit(0.0)), "m2_was": F.coalesce("m2_was", F.lit(0.0))})
    step = F.col("mean") - F.col("was")
    merged = both.select("cell", "season", (n + x).alias("samples"), (F.col("was") + step * n / (n + x)).alias("mean"), (F.col("m2") + F.col("m2_was") + step * step * n * x / (n + x)).alias("m2"))
    kept.usual.write(merged, epoch)
    kept.clock.write(kept.clock.spark.createDataFrame([("usual", max(upto, done))], "name string, at_ms long"), epoch)


# ---- incidents


def fold_incidents(kept: Kept, new: DataFrame, epoch: int, radius_m: float = 150_000, window_ms: int = WINDOW_MS, min_severity: int = 55, number: Callable[[DataFrame], DataFrame] = engine.numbered) -> None:
    """Lets new detections join, extend and merge stored groups, or start some; a group keeps the name that it was given first, and of
    groups that merge the oldest one's.

    Only detections within the window of the new ones are looked at for links, and only groups that a new one touches are read whole
    and scored anew.  The groups are those of one clustering over all that was ever found.  ``number`` gives detections their ``id``;
    those that share one, which have to begin at one time, belong to one group wherever they lie."""
    n = number(new).select("id", "rule", "severity", "ts_start", F.coalesce("ts_end", "ts_start").alias("ts_end"), "lat", "lon", "hash", F.get_json_object("evidence", "$.watchbox").alias("watchbox"))
    n = checkpointed(n.withColumn("day_ms", quantize("ts_start", DAY_MS)))
    span = n.agg(F.min("ts_start").alias("a"), F.max("ts_start").alias("b")).first()
    if span["a"] is None:
        return
    members = kept.members.before(epoch)
    day = lambda ms: ms // DAY_MS * DAY_MS
    a, b = span["a"] - window_ms, span["b"] + window_ms
    near = checkpointed(members.where(F.col("day_ms").between(day(a), day(b)) & F.col("ts_start").between(a, b)))
    place = ("id", "lat", "lon", "ts_start")
    local = fusion.clusters(near.select(*place).unionByName(n.select(*place)), radius_m, window_ms)
    # Groups and new detections that share a local cluster are one; the nodes are the groups' names and the new ids.
    node = checkpointed(near.select("id", F.col("cluster").alias("node"), "since").unionByName(n.select("id", F.col("id").alias("node"), F.lit(epoch).cast("long").alias("since"))))
    tied = local.join(node, "id").select("cluster", "node").distinct()
    hubs = tied.groupBy("cluster").agg(F.min("node").alias("hub"))
    parts = checkpointed(connected_components(checkpointed(tied.join(hubs, "cluster").where("node <> hub").select("hub", "node")), "hub", "node"))
    # A new detection may join a group that is named by the id it shares, without another node beside.
    alone = tied.select("node").distinct().join(n.select(F.col("id").alias("node")), "node", "left_semi").join(parts, "node", "left_anti")
    parts = parts.unionByName(alone.select("node", F.col("node").alias("component")))
    aged = parts.join(node.groupBy("node").agg(F.min("since").alias("since")), "node")
    names = aged.groupBy("component").agg(F.min_by("node", F.struct("since", "node")).alias("name"), F.min("since").alias("name_since"))
    named = checkpointed(aged.join(names, "component").select("node", "since", "name", "name_since"))
    fresh = n.join(named.select(F.col("node").alias("id"), "name", "name_since"), "id", "left")
    fresh = fresh.select("*", F.coalesce("name", "id").alias("cluster"), F.coalesce("name_since", F.lit(epoch)).cast("long").alias("since"))
    # Of stored groups that are touched all members are read, from the days that they cover.
    touched = named.where(F.col("since") < epoch).select(F.col("node").alias("cluster"), "name", "name_since")
    reach = kept.groups.before(epoch).join(touched, "cluster", "left_semi").agg(F.min("first_ms"), F.max("last_ms")).first()
    low, high = min(a, reach[0] if reach[0] is not None else a), max(b, reach[1] if reach[1] is not None else b)
    stored = members.where(F.col("day_ms").between(day(low), day(high))).join(touched, "cluster")
    moved = stored.where("cluster <> name").select(*[c for c in columns(MEMBER) if c not in ("cluster", "since")], F.col("name").alias("cluster"), F.col("name_since").alias("since"))
    stayed = stored.where("cluster = name").select(*columns(MEMBER))
    changed = checkpointed(fresh.select(*columns(MEMBER)).unionByName(moved))
    kept.members.write(changed, epoch)
    old_names = touched.where("cluster <> name").select("cluster")
    whole = checkpointed(changed.unionByName(stayed).join(named.select(F.col("name").alias("cluster")).distinct(), "cluster", "left_semi"))
    extent = whole.groupBy("cluster").agg(F.min("ts_start").alias("first_ms"), F.max("ts_start").alias("last_ms"))
    gone = old_names.withColumn("gone", F.lit(True))
    kept.groups.write(extent.withColumn("gone", F.lit(False)).unionByName(gone, allowMissingColumns=True), epoch)
    found = fusion.incidents_of_clusters(whole.select(*fusion.MEMBER_FIELDS, "cluster"), min_severity)
    kept.incidents.write(found.select(*columns(INCIDENT)).withColumn("gone", F.lit(False)).unionByName(gone, allowMissingColumns=True), epoch)


# ---- the tick


@dataclass
class Watch:
    """What a watch does each tick.  ``every_ms`` is the stretch whose counts are one sample of what is usual, ``number`` what gives
    detections their ids."""

    boxes: DataFrame
    folder: str
    tick_ms: int = 30_000
    precision: int = 4
    every_ms: int = HOUR
    season: Callable | None = hour_of_week
    rules: dict | None = None
    caps: dict | None = None
    least: int = 8
    look_back_ms: int = 6 * HOUR
    min_severity: int = 55
    compact_every: int = 16
    told: list | None = None
    fuse: bool = True
    number: Callable[[DataFrame], DataFrame] = engine.numbered


def archive_between(spark: SparkSession, folder: str, schema: StructType, first_ms: int, last_ms: int, epoch: int) -> DataFrame:
    """Archived fixes of the days from one time to another, as ticks up to ``epoch`` wrote them: only those days' folders are listed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    days = [f"{folder}/day_ms={d}" for d in range(first_ms // DAY_MS * DAY_MS, last_ms + 1, DAY_MS)]
    there = [d for d in days if fs.exists(path(d))]
    if not there:
        return spark.createDataFrame([], schema)
    whole = StructType([*schema.fields]).add("day_ms", "long").add("epoch", "long")
    return spark.read.schema(whole).option("basePath", folder).parquet(*there).where(F.col("epoch") <= epoch).where(F.col("ts_ms").between(first_ms, last_ms)).select(*schema.names)


def watch_tick(w: Watch) -> Callable[[DataFrame, int], None]:
    """One tick over a batch: archive it, run the rules over it and what is kept, append what is new, and move on what is kept.

    Everything is written under the tick's number and read from before it, so a tick that is run again, after a restart or by a
    driver that failed half-way, finds and writes the same."""

    def tick(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.drop("ts").persist()
        span = rows.agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b")).first()
        if span["a"] is None:
            rows.unpersist()
            return
        kept = Kept(spark, w.folder, w.compact_every)
        dated = rows.withColumns({"day_ms": quantize("ts_ms", DAY_MS), "epoch": F.lit(epoch).cast("long")})
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day_ms", "epoch").parquet(f"{w.folder}/archive")
        lately = archive_between(spark, f"{w.folder}/archive", rows.schema, span["a"] - w.look_back_ms, span["b"], epoch)
        base = usual(kept, epoch, w.least)
        open_ = kept.gaps.before(epoch).where("state = 'open'")
        c = engine.Context(rows, w.boxes, w.tick_ms, lately, base if w.season else base.drop("season"), precision=w.precision, season=w.season, known=kept.last.before(epoch), open_gaps=open_, now_ms=span["b"])
        run = engine.run_engine(c, None, w.rules, w.caps or CAPS)
        # What was known is looked for only where new findings can lie.
        found = checkpointed(run.new)
        ends = found.agg(F.min("ts_start").alias("a"), F.max("ts_start").alias("b")).first()
        if epoch and ends["a"] is not None and (before := found_before(spark, f"{w.folder}/found", found.schema, epoch)) is not None:
            found = found.join(before.where(F.col("ts_start").between(ends["a"], ends["b"])).select("dedup_key"), "dedup_key", "left_anti").select(*found.columns)
        found = checkpointed(found)
        found.write.mode("overwrite").parquet(f"{w.folder}/found/epoch={epoch}")
        keep_gaps(kept, rows, run.opened, w.boxes, epoch)
        if w.season is not None:
            fold_usual(kept, rows, span["b"], epoch, w.precision, w.every_ms, w.season)
        if w.fuse:
            fold_incidents(kept, found, epoch, min_severity=w.min_severity, number=w.number)
        if w.told is not None:
            w.told.append((epoch, run.errors))
        rows.unpersist()

    return tick


def found_before(spark: SparkSession, folder: str, schema: StructType, epoch: int) -> DataFrame | None:
    """What ticks before ``epoch`` found."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/epoch=*/_SUCCESS")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    paths = [f"{folder}/epoch={e}" for e in sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in there or ()) if e < epoch]
    return spark.read.schema(schema).parquet(*paths) if paths else None
