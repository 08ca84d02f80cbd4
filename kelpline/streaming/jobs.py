"""Streaming forms of the operators, over a landing folder of observation files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kelpline.functions.codes import AIR, ON_GROUND, SEA, has
from kelpline.functions.geo import geohash, hour_of_week, quantize
from kelpline.operators import engine
from kelpline.operators.detectors import CAPS, baseline, baseline_samples, voids
from kelpline.operators.provenance import route_events

GAP = "entity_id string, went_dark_ms long, back_ms long, obs_id long, lat0 double, lon0 double, sog0 double, cog0 double, lat1 double, lon1 double, open boolean"


def observations(spark: SparkSession, folder: str, schema, files_a_batch: int = 64) -> DataFrame:
    """A stream of observation files; ``ts`` is event time.  Nothing pending is dropped: a batch takes some files."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return s.withColumn("ts", F.timestamp_millis("ts_ms"))


class GapMachine(StatefulProcessor):
    """Keeps each entity's last fix; opens a gap by an event-time timer and closes it with the next fix.

    Rows of a batch are put in order first, as no timer fires between them: a silence inside a batch is closed by the
    fix itself, and the timer tells only of one that lasts.  A late fix never moves the last one back.
    """

    def __init__(self, threshold_ms: int):
        self.threshold_ms = threshold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts_ms long, lat double, lon double, sog double, cog double, open boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fixes = pd.concat(list(rows)).sort_values(["ts_ms", "obs_id"])
        last = self.last.get() if self.last.exists() else None
        out = []
        for f in fixes.itertuples():
            if last is not None and f.ts_ms < last[0]:
                continue
            if last is not None and f.ts_ms - last[0] >= self.threshold_ms:
                out.append((key[0], last[0], int(f.ts_ms), int(f.obs_id), last[1], last[2], last[3], last[4], f.lat, f.lon, False))
            last = (int(f.ts_ms), f.lat, f.lon, f.sog_kt, f.cog_deg, False)
        self.last.update(last)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(last[0] + self.threshold_ms)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in GAP.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get() if self.last.exists() else None
        if last is not None and not last[5]:
            self.last.update((*last[:5], True))
            yield pd.DataFrame([(key[0], last[0], None, None, last[1], last[2], last[3], last[4], None, None, True)], columns=[c.split()[0] for c in GAP.split(", ")]).astype({"back_ms": "Int64", "obs_id": "Int64"})

    def close(self) -> None:
        pass


def gap_stream(obs: DataFrame, threshold_s: int = 3600, lateness: str = "1 hour") -> DataFrame:
    """Opened and closed gaps of ships and aircraft.  Needs the RocksDB state store."""
    moving = obs.where(F.col("domain").isin(SEA, AIR)).select("ts", "entity_id", "ts_ms", "obs_id", "lat", "lon", "sog_kt", "cog_deg")
    return moving.withWatermark("ts", lateness).groupBy("entity_id").transformWithStateInPandas(GapMachine(threshold_s * 1000), GAP, "Append", "EventTime")


def cell_counts(obs: DataFrame, precision: int = 4, every: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(start_ms, cell, n, c_lat, c_lon) of airborne fixes, once a window is over.  Empty cells have no row: see void_tick."""
    air = obs.where((F.col("domain") == AIR) & ~has("flags", ON_GROUND)).withWatermark("ts", lateness)
    w = air.groupBy(F.window("ts", every), geohash("lat", "lon", precision).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"))
    return w.select(F.unix_millis("window.start").alias("start_ms"), "cell", "n", "c_lat", "c_lon")


def void_tick(base: DataFrame, boxes: DataFrame, found: str, season: Callable | None = hour_of_week) -> Callable[[DataFrame, int], None]:
    """One tick over windows that are over (see cell_counts): for each of them, the cells of the baseline that hold too little,
    those without a row too.  A batch that is run again writes its own folder again."""

    def tick(batch: DataFrame, epoch: int) -> None:
        rows = batch.persist()
        at = rows.select(F.col("start_ms").alias("tick_ms")).distinct()
        cells = base.where("mean >= 8")
        if season is None:
            grid = cells.join(F.broadcast(at.agg(F.collect_set("tick_ms").alias("at"))), F.lit(True)).select("cell", "samples", "mean", "sd", F.explode("at").alias("tick_ms"))
        else:
            grid = cells.join(at.withColumn("season", season(F.col("tick_ms"))), "season")
        live = rows.select("cell", F.col("start_ms").alias("tick_ms"), F.col("n").alias("observed"), "c_lat", "c_lon")
        voids(live, grid, boxes).write.mode("overwrite").parquet(f"{found}/epoch={epoch}")
        rows.unpersist()

    return tick


def latest_positions(obs: DataFrame) -> DataFrame:
    """Newest fix an entity by event time, however rows arrive; for update or complete mode."""
    return obs.groupBy("entity_id").agg(F.max("ts_ms").alias("last_seen"), F.max_by(F.struct("lat", "lon", "flags", "obs_id"), F.struct("ts_ms", -F.col("obs_id"))).alias("o")).select("entity_id", "last_seen", "o.*")


def once_by_key(detections: DataFrame, lateness: str = "1 hour", key: str = "dedup_key") -> DataFrame:
    """Each finding once, as long as repeats come within the watermark."""
    return detections.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def changed_positions(obs: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """The delta gate as a stream: an entity's row when its fix moves on, at most once a fix."""
    return obs.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["entity_id", "ts_ms"])


CHANGE = "entity_id string, change string, ts_ms long, lat double, lon double, sent_ms long"


class DeltaGate(StatefulProcessor):
    """Sends an entity's fix when it moves on; sends it again when nothing was sent for ``resend_ms``, as long as it was heard
    within ``live_ms``; then tells once that it is gone.  Times of sending are those of the clock."""

    def __init__(self, resend_ms: int, live_ms: int):
        self.resend_ms, self.live_ms = resend_ms, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts_ms long, lat double, lon double, heard_ms long, sent_ms long")

    def _row(self, key, change: str, last) -> pd.DataFrame:
        return pd.DataFrame([(key[0], change, last[0], last[1], last[2], last[4])], columns=[c.split()[0] for c in CHANGE.split(", ")])

    def _wake(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        f = max((r for p in rows for r in p.itertuples()), key=lambda r: (r.ts_ms, -r.obs_id))
        last = self.last.get() if self.last.exists() else None
        if last is not None and f.ts_ms <= last[0]:
            self.last.update((*last[:3], now, last[4]))
            if now - last[4] < self.resend_ms:
                return
            change, last = "resent", (*last[:3], now, now)
        else:
            change, last = "new" if last is None else "changed", (int(f.ts_ms), float(f.lat), float(f.lon), now, now)
        self.last.update(last)
        self._wake(now + self.resend_ms)
        yield self._row(key, change, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        if not self.last.exists():
            return
        last = self.last.get()
        if now - last[3] > self.live_ms:
            self.last.clear()
            yield self._row(key, "gone", (*last[:4], now))
            return
        last = (*last[:4], now)
        self.last.update(last)
        self._wake(now + self.resend_ms)
        yield self._row(key, "resent", last)

    def close(self) -> None:
        pass


def delta_gate(obs: DataFrame, resend_s: int = 20, live_s: int = 2700) -> DataFrame:
    """Changes to send: new, changed, resent and gone entities.  Needs the RocksDB state store."""
    fixes = obs.select("entity_id", "ts_ms", "obs_id", "lat", "lon")
    return fixes.groupBy("entity_id").transformWithStateInPandas(DeltaGate(resend_s * 1000, live_s * 1000), CHANGE, "Append", "ProcessingTime")


ARRIVAL = "ts_ms long, obs_id long, lat double, lon double, heard_ms long"
ARRIVAL_COLUMNS = [c.split()[0] for c in ARRIVAL.split(", ")]


def gate_steps(last: tuple | None, arrivals: list[tuple], upto_ms: int, resend_ms: int, live_ms: int) -> tuple[list[tuple], tuple | None]:
    """What a gate sends until ``upto_ms``, for arrivals (ts_ms, lat, lon, heard_ms), one an instant, in order of their instants, and
    the state that is left: (ts_ms, lat, lon, heard_ms, sent_ms) or None.  At one instant an arrival comes before a resend."""
    out = []

    def wake_until(end: int, last: tuple | None) -> tuple | None:
        while last is not None and (now := last[4] + resend_ms) <= end:
            if now - last[3] > live_ms:
                out.append(("gone", *last[:3], now))
                return None
            last = (*last[:4], now)
            out.append(("resent", *last[:3], now))
        return last

    for ts, lat, lon, heard in arrivals:
        last = wake_until(heard - 1, last)
        if last is not None and ts <= last[0]:
            last = (*last[:3], heard, last[4])
        else:
            out.append(("new" if last is None else "changed", ts, lat, lon, heard))
            last = (ts, lat, lon, heard, heard)
    return out, wake_until(upto_ms, last)


class ClockedGate(StatefulProcessor):
    """The delta gate by the clock of arrivals: its watermark is the time.  Arrivals wait until that has passed them, and all that
    was due by then, resends between two arrivals too, is told in order; so a batch may cover any stretch of time."""

    def __init__(self, resend_ms: int, live_ms: int):
        self.resend_ms, self.live_ms = resend_ms, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts_ms long, lat double, lon double, heard_ms long, sent_ms long")
        self.waiting = handle.getListState("waiting", ARRIVAL)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))[ARRIVAL_COLUMNS]
        self.waiting.appendList([(int(a), int(b), float(c), float(d), int(e)) for a, b, c, d, e in new.itertuples(index=False)])
        self.handle.registerTimer(int(new["heard_ms"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get(), key=lambda a: (a[4], a[0], -a[1]))
        due, rest = [a for a in waiting if a[4] <= now], [a for a in waiting if a[4] > now]
        one = {a[4]: (a[0], a[2], a[3], a[4]) for a in due}  # of one instant the newest fix
        out, last = gate_steps(self.last.get() if self.last.exists() else None, list(one.values()), now, self.resend_ms, self.live_ms)
        if due:
            self.waiting.put([tuple(a) for a in rest]) if rest else self.waiting.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if last is None:
            self.last.clear()
        else:
            self.last.update(last)
            self.handle.registerTimer(last[4] + self.resend_ms)
        if rest:
            self.handle.registerTimer(rest[0][4])
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=[c.split()[0] for c in CHANGE.split(", ")])

    def close(self) -> None:
        pass


def clocked_gate(obs: DataFrame, resend_s: int = 20, live_s: int = 2700, heard: str = "ts", lateness: str = "10 seconds") -> DataFrame:
    """Changes to send, by the clock of the timestamp column ``heard``, that of arrival.  Needs the RocksDB state store."""
    fixes = obs.withColumn("heard", F.col(heard)).withColumn("heard_ms", F.unix_millis("heard")).select("heard", "entity_id", *ARRIVAL_COLUMNS)
    return fixes.withWatermark("heard", lateness).groupBy("entity_id").transformWithStateInPandas(ClockedGate(resend_s * 1000, live_s * 1000), CHANGE, "Append", "EventTime")


def run_ticks(obs: DataFrame, tick: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Hands each micro-batch to ``tick(batch, epoch)``; without ``every`` it takes what has landed and ends."""
    w = obs.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def earlier(spark: SparkSession, folder: str, epoch: int) -> DataFrame | None:
    """What ticks before this one wrote to a folder, or None; what a first try of this one wrote doesn't count."""
    try:
        return spark.read.parquet(folder).where(F.col("epoch") < epoch)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def detect_tick(boxes: DataFrame, archive: str, found: str, samples: str | None = None, tick_ms: int = 30_000, precision: int = 4, rules: dict | None = None, told: list | None = None, caps: dict[str, int] = CAPS) -> Callable[[DataFrame, int], None]:
    """One tick: append the batch to the archive, run all rules over it and the archive's last hours, append what no earlier tick
    has found, and then learn what is usual.

    The archive is read by day, so rules that look back see the days of the batch and the one before.  With ``samples``, the
    first batch of each clock hour adds its counts there, and what earlier ticks have learnt is the baseline.  A batch that is
    run again writes its own folders again, and finds the same.  ``told`` gets (epoch, errors by rule).  ``caps`` is what
    the breaker leaves of a rule in a ``tick_ms``.
    """

    def tick(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.drop("ts").withColumn("day_ms", quantize("ts_ms", DAY_MS)).persist()
        rows.write.mode("overwrite").partitionBy("day_ms").parquet(f"{archive}/epoch={epoch}")
        span = rows.agg(F.min("day_ms").alias("a"), F.max("day_ms").alias("b")).first()
        if span["a"] is None:
            rows.unpersist()
            return
        lately = spark.read.schema(rows.schema).option("basePath", archive).parquet(f"{archive}/epoch=*").where(F.col("day_ms").between(span["a"] - DAY_MS, span["b"]) & (F.col("epoch") <= epoch))
        learnt = earlier(spark, samples, epoch) if samples else None
        base = None if learnt is None else baseline(learnt.withColumn("season", hour_of_week("sample_ms")), "season")
        c = engine.Context(rows.drop("day_ms"), boxes, tick_ms, lately.drop("day_ms", "epoch"), base, precision=precision)
        known = earlier(spark, found, epoch)
        run = engine.run_engine(c, None if known is None else known.select("dedup_key"), rules, caps)
        run.new.write.mode("overwrite").parquet(f"{found}/epoch={epoch}")
        if told is not None:
            told.append((epoch, run.errors))
        if samples:
            new = baseline_samples(rows, precision)
            if learnt is not None:
                new = new.join(learnt.select("sample_ms").distinct(), "sample_ms", "left_anti")
            new.write.mode("overwrite").parquet(f"{samples}/epoch={epoch}")
        rows.unpersist()

    return tick


DAY_MS = 86_400_000


def found_stream(spark: SparkSession, found: str) -> DataFrame:
    """Detections as ticks find them, from the folder that they write."""
    schema = spark.read.parquet(found).schema
    return spark.readStream.schema(schema).parquet(found)


def push_tick(subscriptions: DataFrame, out: str) -> Callable[[DataFrame, int], None]:
    """One tick over new detections: (client_id, id) to tell, id being the dedup_key."""

    def tick(batch: DataFrame, epoch: int) -> None:
        told = route_events(batch.withColumn("id", F.col("dedup_key")), subscriptions)
        told.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return tick
