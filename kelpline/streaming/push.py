"""Findings for clients whose subscriptions change while both stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kelpline.operators.provenance import SALTS

ITEM = "at_ms long, client_id string, of_cell string, active boolean, id long"
ITEM_COLUMNS = [c.split()[0] for c in ITEM.split(", ")]
TOLD = "client_id string, id long, at_ms long"


class PushMachine(StatefulProcessor):
    """Of one cell (and part of its clients): who has subscribed to what, and what the watermark hasn't passed yet.

    Changes and findings wait until it has, and are then taken in order of time, changes first of one instant; so each finding goes
    to those whose subscription held at its time, whichever file either came in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.who = handle.getMapState("who", "client_id string, of_cell string", "at_ms long")
        self.waiting = handle.getListState("waiting", ITEM)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))[ITEM_COLUMNS]
        # Numbers that are missing in some rows come as floats.
        self.waiting.appendList([(int(at), None, None, None, int(i)) if pd.isna(who) else (int(at), who, cell, bool(on), None) for at, who, cell, on, i in new.itertuples(index=False)])
        self.handle.registerTimer(int(new["at_ms"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1] is None, r[4] or 0, bool(r[3])))
        due, rest = [r for r in waiting if r[0] <= passed], [r for r in waiting if r[0] > passed]
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        members = {tuple(k) for k in self.who.keys()} if due else set()
        now, out = set(members), []
        for at, client, cell, active, finding in due:
            if client is None:
                out += [(c, finding, at) for c in sorted({c for c, _ in now})]
            else:
                (now.add if active else now.discard)((client, cell))
        for k in members - now:
            self.who.removeKey(k)
        for k in now - members:
            self.who.updateValue(k, (passed,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if rest:
            self.handle.registerTimer(rest[0][0])
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TOLD.split(", ")])

    def close(self) -> None:
        pass


def pushed(findings: DataFrame, changes: DataFrame, lateness: str = "10 minutes", to_all: int = 70) -> DataFrame:
    """(client_id, id, at_ms): each finding (id, severity, geohash5, ts) for every client that at its time had subscribed to a cell that
    its own begins with, and a grave one for all that had any.  ``changes`` has (client_id, cell, active, ts).

    A client may be told once for each of its cells.  Clients of a cell are dealt over ``SALTS`` parts, each of which gets the cell's
    findings, so the cell that all have is many tasks' work.  Needs the RocksDB state store."""
    part = F.pmod(F.xxhash64("client_id"), F.lit(SALTS)).cast("int")
    c = changes.select("ts", F.explode(F.array(F.col("cell"), F.lit(""))).alias("key_cell"), part.alias("part"), F.unix_millis("ts").alias("at_ms"), "client_id", F.col("cell").alias("of_cell"), "active")
    first, last = F.when(F.col("severity") < to_all, 1).otherwise(0), F.when(F.col("severity") < to_all, F.length("geohash5")).otherwise(0)
    keys = F.explode(F.transform(F.sequence(first, last), lambda n: F.substring("geohash5", F.lit(1), n)))
    f = findings.select("ts", keys.alias("key_cell"), F.unix_millis("ts").alias("at_ms"), "id").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = c.unionByName(f, allowMissingColumns=True).withWatermark("ts", lateness)
    return both.groupBy("key_cell", "part").transformWithStateInPandas(PushMachine(), TOLD, "Append", "EventTime")
