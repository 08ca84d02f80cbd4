"""Silences as a stream: opened by event time, closed by the next fix, with the thresholds of places.

``silences`` is a stream with a state for each entity, which tells of a silence when its timer fires, at some hundredths of a second of
work for each entity that a batch brings; ``silence_tick`` finds the same by joins and windows over whole batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kelpline.functions.codes import AIR, ON_GROUND, SEA
from kelpline.operators.detectors import fallen_silent, gaps, judged
from kelpline.operators.state import LAST, LAST_FIELDS, after_known, last_known
from kelpline.streaming.kept import KeptTable

FIX = "ts_ms long, obs_id long, lat double, lon double, sog_kt double, cog_deg double, flags int, domain int, kind string"
FIX_COLUMNS = [c.split()[0] for c in FIX.split(", ")]
SILENCE = "entity_id string, state string, domain int, kind string, prev_ts_ms long, prev_obs_id long, prev_lat double, prev_lon double, prev_sog_kt double, prev_cog_deg double, box_key string, ts_ms long, obs_id long, lat double, lon double"
SILENCE_COLUMNS = [c.split()[0] for c in SILENCE.split(", ")]
#: Boxes that a processor holds; it is sent to each task.
MOST_PLACES = 10_000


def fixes(rows: pd.DataFrame) -> list[tuple]:
    """Fixes as a state store takes them; whole numbers that are missing in some rows come as floats."""
    whole, real = lambda v: None if pd.isna(v) else int(v), lambda v: None if pd.isna(v) else float(v)
    kinds = [whole, whole, real, real, real, real, whole, whole, lambda v: None if pd.isna(v) else str(v)]
    return [tuple(f(v) for f, v in zip(kinds, r, strict=True)) for r in rows[FIX_COLUMNS].itertuples(index=False)]


class Places:
    """Boxes as arrays, in order of their ids; the first that holds a place counts."""

    def __init__(self, rows: list, default_s: int):
        self.keys, self.default_ms = [r["box_key"] for r in rows], default_s * 1000
        self.limits = np.array([[r["min_lat"], r["max_lat"], r["min_lon"], r["max_lon"]] for r in rows], float).reshape(-1, 4)
        self.silent_ms = [(default_s if r["dark_threshold_s"] is None else r["dark_threshold_s"]) * 1000 for r in rows]

    def least_ms(self) -> int:
        return max(300_000, min([self.default_ms, *self.silent_ms]))

    def at(self, lat: float, lon: float) -> tuple[str | None, int]:
        """The key of the box and the silence that counts there."""
        b = self.limits
        held = np.flatnonzero((b[:, 0] <= lat) & (lat <= b[:, 1]) & (b[:, 2] <= lon) & (lon <= b[:, 3]))
        return (self.keys[held[0]], self.silent_ms[held[0]]) if len(held) else (None, self.default_ms)


def at_rest(domain: int, sog_kt: float | None, flags: float | None) -> bool:
    """Moored or landed: such a one may fall silent."""
    slow = sog_kt is None or np.isnan(sog_kt) or sog_kt < 0.4
    return slow if domain == SEA else bool(int(0 if flags is None or np.isnan(flags) else flags) & ON_GROUND)


class SilenceMachine(StatefulProcessor):
    """Keeps an entity's last fix and the fixes that the watermark hasn't passed yet.

    Fixes wait until the watermark has passed them and are then taken in order, so those that come late, but within the lateness,
    change nothing.  A timer stands at the earliest waiting fix, and one at the last fix plus the silence that its place allows:
    when the watermark passes that and no fix came, the silence is opened.  The next fix closes it."""

    def __init__(self, places: Places):
        self.places = places

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"{FIX}, open boolean")
        self.waiting = handle.getListState("waiting", FIX)

    def _wake(self, *at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        for t in set(at):
            self.handle.registerTimer(int(t))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))
        self.waiting.appendList(fixes(new))
        self.handle.registerTimer(int(new["ts_ms"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = pd.DataFrame(list(self.waiting.get()), columns=FIX_COLUMNS)
        due = waiting[waiting["ts_ms"] <= passed].sort_values(["ts_ms", "obs_id"])
        rest = waiting[waiting["ts_ms"] > passed]
        last = self.last.get() if self.last.exists() else None
        out = []
        if len(due):
            self.waiting.put(fixes(rest)) if len(rest) else self.waiting.clear()
            line = due if last is None else pd.concat([pd.DataFrame([last[:-1]], columns=FIX_COLUMNS), due])
            line = line.reset_index(drop=True)
            line[["sog_kt", "cog_deg", "flags"]] = line[["sog_kt", "cog_deg", "flags"]].astype(float).ffill()
            steps = np.diff(line["ts_ms"].to_numpy())
            for i in np.flatnonzero(steps >= self.places.least_ms()):  # the few that can be silences
                a, b = line.iloc[i], line.iloc[i + 1]
                box, silent_ms = self.places.at(a["lat"], a["lon"])
                if steps[i] >= silent_ms and not at_rest(a["domain"], a["sog_kt"], a["flags"]):
                    out.append(self._row(key[0], "closed", a, box, b))
            last = (*fixes(line.iloc[-1:])[0], False)
        wake = [int(rest["ts_ms"].min())] if len(rest) else []
        if last is not None:
            f = dict(zip([*FIX_COLUMNS, "open"], last, strict=True))
            box, silent_ms = self.places.at(f["lat"], f["lon"])
            if not f["open"] and not at_rest(f["domain"], f["sog_kt"], f["flags"]):
                if f["ts_ms"] + silent_ms <= passed:
                    out.append(self._row(key[0], "open", f, box, None))
                    last = (*last[:-1], True)
                else:
                    wake.append(f["ts_ms"] + silent_ms)
            self.last.update(last)
        self._wake(*wake)
        if out:
            yield pd.DataFrame(out, columns=SILENCE_COLUMNS).astype({"ts_ms": "Int64", "obs_id": "Int64", "lat": "Float64", "lon": "Float64"})

    def _row(self, entity: str, state: str, a, box: str | None, b) -> tuple:
        back = (None, None, None, None) if b is None else (int(b["ts_ms"]), int(b["obs_id"]), float(b["lat"]), float(b["lon"]))
        kind = (a if b is None else b)["kind"]
        return (entity, state, int(a["domain"]), kind, int(a["ts_ms"]), int(a["obs_id"]), float(a["lat"]), float(a["lon"]), a["sog_kt"], a["cog_deg"], box, *back)

    def close(self) -> None:
        pass


def silences(obs: DataFrame, boxes: DataFrame, default_s: int = 3600, lateness: str = "1 hour") -> DataFrame:
    """Opened and closed silences of ships and aircraft, closed ones with their verdict ``v``; needs the RocksDB state store.

    ``boxes`` is the list of places, read once: at most ``MOST_PLACES`` go to each task."""
    rows = boxes.orderBy("box_id").limit(MOST_PLACES + 1).collect()
    if len(rows) > MOST_PLACES:
        raise ValueError(f"more than {MOST_PLACES} boxes")
    moving = obs.where(F.col("domain").isin(SEA, AIR)).select("ts", "entity_id", *FIX_COLUMNS)
    out = moving.withWatermark("ts", lateness).groupBy("entity_id").transformWithStateInPandas(SilenceMachine(Places(rows, default_s)), SILENCE, "Append", "EventTime")
    return judged(out.withColumn("dt_ms", F.col("ts_ms") - F.col("prev_ts_ms")))


def _waiting(spark: SparkSession, folder: str, epoch: int) -> DataFrame:
    """The fixes that the newest finished tick before ``epoch`` left waiting."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/epoch=*/_SUCCESS")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    before = max((e for e in (int(x.getPath().getParent().getName().split("=")[1]) for x in there or ()) if e < epoch), default=None)
    schema = f"entity_id string, {FIX}"
    return spark.createDataFrame([], schema) if before is None else spark.read.schema(schema).parquet(f"{folder}/epoch={before}")


def silence_tick(boxes: DataFrame, folder: str, found: str, default_s: int = 3600, lateness_ms: int = 3_600_000, compact_every: int = 16) -> Callable[[DataFrame, int], None]:
    """One tick: what ``silences`` tells of a batch, appended to ``found`` as the tick's number.

    Time is the newest fix so far less the lateness.  Fixes behind it wait; those that it has passed are taken in order behind each
    entity's last one, and who has been silent for too long by then is told as open, once.  Fixes from before the time that the
    tick before had are too late.  All is written under the tick's number and read from before it, as a watch does."""

    def tick(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        kept = lambda name, keys, schema: KeptTable(spark, f"{folder}/{name}", keys, schema, None, compact_every)
        last, opened, clock = kept("last", ("entity_id",), f"{LAST}, kind string"), kept("opened", ("entity_id",), "entity_id string, went_dark_ms long"), kept("clock", ("name",), "name string, at_ms long")
        fresh = batch.where(F.col("domain").isin(SEA, AIR)).select("entity_id", *FIX_COLUMNS).persist()
        was, newest = clock.before(epoch).agg(F.max("at_ms")).first()[0], fresh.agg(F.max("ts_ms")).first()[0]
        if newest is None:
            fresh.unpersist()
            return
        now = newest if was is None else max(newest, was)
        clock.write(spark.createDataFrame([("heard", now)], "name string, at_ms long"), epoch)
        here = _waiting(spark, f"{folder}/waiting", epoch).unionByName(fresh if was is None else fresh.where(F.col("ts_ms") > was - lateness_ms))
        passed = F.col("ts_ms") <= now - lateness_ms
        here.where(~passed).write.mode("overwrite").parquet(f"{folder}/waiting/epoch={epoch}")
        due, known = here.where(passed), last.before(epoch)
        moved = after_known(due, known)
        kinds = moved.where("not known_").groupBy("entity_id").agg(F.max_by("kind", F.struct("ts_ms", "obs_id")).alias("kind"))
        last.write(last_known(moved).join(kinds, "entity_id"), epoch)
        over = gaps(due, boxes, default_s, known).withColumn("state", F.lit("closed")).select(*SILENCE_COLUMNS, "v")
        ends = last.before(epoch + 1)
        silent = fallen_silent(ends, now - lateness_ms, boxes, None, default_s).select("entity_id", F.col("went_dark_at").alias("went_dark_ms"), "box_key")
        new = silent.join(opened.before(epoch), ["entity_id", "went_dark_ms"], "left_anti")
        opened.write(new.select("entity_id", "went_dark_ms"), epoch)
        prev = [F.col(c).alias(f"prev_{c}") for c in LAST_FIELDS if c not in ("entity_id", "domain", "flags")]
        begun = new.join(ends.select("entity_id", "domain", "kind", *prev), "entity_id").withColumn("state", F.lit("open"))
        over.unionByName(begun.drop("went_dark_ms"), allowMissingColumns=True).write.mode("overwrite").parquet(f"{found}/epoch={epoch}")
        fresh.unpersist()

    return tick
