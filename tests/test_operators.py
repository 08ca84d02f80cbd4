"""Clustering, baselines, chains, sinks and streams on small inputs, against brute force or their batch twins."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kelpline.operators import archive, detectors, fusion, provenance, state
from kelpline.operators.components import connected_components
from kelpline.sources import dims
from kelpline.sources import observations as ob
from kelpline.streaming import jobs

R = 6371008.8


def far(a, b):
    (x, y), (u, v) = [tuple(map(math.radians, p)) for p in (a, b)]
    return 2 * R * math.asin(min(1, math.sqrt(math.sin((u - x) / 2) ** 2 + math.cos(x) * math.cos(u) * math.sin((v - y) / 2) ** 2)))


def points(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, lat double, lon double, ts_start long")


def sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster, set()).add(r.id)
    return sorted(map(sorted, out.values()))


def test_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice([rng.uniform(-90, 90), 89.5 + rng.random() / 2, -89.9]), rng.choice([rng.uniform(-180, 180), 179.9, -179.9]), rng.randrange(0, 10_000_000)) for _ in range(300)]
    got = {(r.a, r.b) for r in fusion.spacetime_pairs(points(spark, rows), 300_000, 2_000_000).collect()}
    want = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and abs(a[2] - b[2]) <= 2_000_000 and far(a[:2], b[:2]) <= 300_000}
    assert got == want


@pytest.mark.parametrize(("rows", "radius", "want"), [
    ([(27.0, 56.0, 0), (27.2, 56.3, 12 * 60_000), (27.1, 56.1, 35 * 60_000)], 150_000, [[0, 1, 2]]),
    ([(27.0, 56.0, 0), (27.0, 56.0, 400 * 60_000)], 150_000, []), ([(27.0, 56.0, 0), (27.0, 62.0, 0)], 150_000, []),
    ([(10.0, 0.0, 0), (11.0, 0.0, 0), (12.0, 0.0, 0)], 130_000, [[0, 1, 2]]), ([(10.0, 0.0, 0)], 1000, []),
])
def test_clusters(spark, rows, radius, want):
    assert sets(fusion.clusters(points(spark, rows), radius)) == want


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def incident(spark, rules):
    rows = [(i, r, s, i * 60_000, None, 26.5, 56.4, "h%d" % i, None) for i, (r, s) in enumerate(rules)]
    return fusion.confluence(spark.createDataFrame(rows, "id long, rule string, severity int, ts_start long, ts_end long, lat double, lon double, hash string, evidence string"), min_severity=0).collect()


def test_confluence_scores(spark):
    assert incident(spark, [("DARK_VESSEL", 90), ("DARK_VESSEL", 90)]) == []
    two = incident(spark, [("DARK_VESSEL", 60), ("GNSS_BLOOM", 60)])[0]
    three = incident(spark, [("DARK_VESSEL", 60), ("GNSS_BLOOM", 60), ("SEISMIC_SHALLOW", 30)])[0]
    assert three.severity >= two.severity and two.lead == "DARK_VESSEL" and two.narrative.startswith("T+0m DARK_VESSEL 60")
    most = incident(spark, [(r, 100) for r in ("GNSS_BLOOM", "DARK_VESSEL", "THERMAL_ANOMALY", "SEISMIC_SHALLOW") * 3])[0]
    assert most.severity == 100 and most.radius_km == 1


def test_merge_and_sink(spark, small):
    found = detectors.thermal_anomaly(ob.sparse(spark, small), dims.watchboxes(spark)).persist()
    assert detectors.append_new(found.unionByName(found)).count() == found.count()
    assert detectors.append_new(found, found).count() == 0
    a = spark.createDataFrame([("h", 5, 50, [1], 1), ("i", 1, 1, [9], 1)], "hash string, ts_end long, severity int, detection_ids array<long>, updated_ms long")
    b = spark.createDataFrame([("h", 3, 60, [1, 2], 2)], a.schema)
    got = {r.hash: (r.ts_end, r.severity, r.detection_ids) for r in fusion.merge_incidents(a, b).collect()}
    assert got == {"h": (5, 60, [1, 2]), "i": (1, 1, [9])}
    with pytest.raises(ValueError, match="rule odd lacks"):
        detectors.run_detectors(ob.sparse(spark, small), dims.watchboxes(spark), {"odd": lambda o, b: o})


def test_hash_ignores_the_order_of_entities(spark):
    df = spark.createDataFrame([(1.0, 2.0, ["a", "b"], 4200), (1.0, 2.0, ["b", "a"], 4200), (1.0, 2.0, ["a", "b"], 4201)], "lat double, lon double, ids array<string>, gap int")
    h = [r.hash for r in detectors.finish(df, "X", F.lit(1), F.lit(5), F.lit(None), F.col("ids"), F.lit("t"), {"gap": F.col("gap")}).select("hash").collect()]
    assert h[0] == h[1] != h[2]


def test_merged_baselines_equal_one(spark):
    rows = [("c", float(x)) for x in (3, 8, 1, 9, 4, 4, 7)]
    s = spark.createDataFrame(rows, "cell string, n double")
    a, b, whole = (detectors.baseline(spark.createDataFrame(x, s.schema), least=1) for x in (rows[:3], rows[3:], rows))
    m, w = detectors.merge_baselines(a, b).first(), whole.first()
    assert m.samples == w.samples and math.isclose(m.mean, w.mean) and math.isclose(m.sd, w.sd)


def test_chain_breaks_where_it_was_edited(spark):
    log = spark.createDataFrame([(1, i, f"p{i}") for i in range(4)], "source_id int, id long, payload string")
    chain = provenance.build_chain(log)
    assert provenance.verify_chain(chain).first().broken_at is None
    edited = chain.withColumn("payload_sha", F.when(F.col("id") == 2, F.sha2(F.lit("x"), 256)).otherwise(F.col("payload_sha")))
    assert tuple(provenance.verify_chain(edited).first()) == (1, 4, 2, "payload")
    assert provenance.verify_chain(chain.where("id >= 2")).first().broken_at is None
    more = provenance.build_chain(spark.createDataFrame([(1, 4, "p4")], log.schema), chain.where("id = 3").select("source_id", "chain_sha"))
    assert provenance.verify_chain(chain.unionByName(more)).first().broken_at is None


def test_archive_round_trip(spark, small, tmp_path):
    o = ob.sparse(spark, small)
    archive.write_observations(o, str(tmp_path / "a"))
    back = spark.read.parquet(str(tmp_path / "a"))
    assert back.count() == o.count() and {"date", "domain"} <= set(back.columns)
    assert state.current_state(o.limit(0)).count() == 0 and archive.ingest_health(ob.fetch_log(spark, small).limit(0)).count() == 0


def landed(spark, small, tmp_path, parts=4):
    o = ob.sparse(spark, small).persist()
    for i in range(parts):
        o.where(F.col("obs_id") % parts == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return o, jobs.observations(spark, str(tmp_path / "in"), o.schema)


def drain(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return q


def test_stream_positions_equal_batch(spark, small, tmp_path):
    o, s = landed(spark, small, tmp_path)
    drain(jobs.latest_positions(s), "positions", tmp_path, "complete")
    want = {r.entity_id: (r.last_seen, r.lat) for r in state.current_state(o).collect()}
    assert {r.entity_id: (r.last_seen, r.lat) for r in spark.table("positions").collect()} == want


def test_stream_gaps_equal_batch(spark, small, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        o = ob.sparse(spark, small).persist()
        o.coalesce(1).write.parquet(str(tmp_path / "in"))
        drain(jobs.gap_stream(jobs.observations(spark, str(tmp_path / "in"), o.schema), 3600), "gaps", tmp_path)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    want = {(r.entity_id, r.prev_ts_ms, r.obs_id) for r in state.deltas(o.where("domain in (1, 2)")).where("dt_ms >= 3600000").collect()}
    assert {(r.entity_id, r.went_dark_ms, r.obs_id) for r in spark.table("gaps").where("not open").collect()} == want


def test_stream_ticks_and_once(spark, small, tmp_path):
    o, s = landed(spark, small, tmp_path, 1)
    q = jobs.run_ticks(s, jobs.detect_tick(dims.watchboxes(spark), str(tmp_path / "arch"), str(tmp_path / "found")), str(tmp_path / "cp"))
    q.awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "found"))
    want = detectors.run_detectors(o, dims.watchboxes(spark))
    assert {r.hash for r in got.collect()} == {r.hash for r in want.collect()} and spark.read.parquet(str(tmp_path / "arch")).count() == o.count()
    drain(jobs.changed_positions(s.unionByName(s)), "changed", tmp_path)
    assert spark.table("changed").count() == o.select("entity_id", "ts_ms").distinct().count()


def test_stream_windows_equal_batch(spark, small, tmp_path):
    o, s = landed(spark, small, tmp_path, 1)
    drain(jobs.cell_counts(s, 4, "1 hour"), "cells", tmp_path)
    batch = {(r.sample_ms, r.cell): r.n for r in detectors.baseline_samples(o, 4).collect()}
    got = {(r.start_ms, r.cell): r.n for r in spark.table("cells").collect()}
    assert got and all(batch[k] == n for k, n in got.items()) and len(got) >= len(batch) - 5


def test_clusters_equal_single_linkage_in_dense_theatres(spark, monkeypatch):
    import math
    import random

    from kelpline.operators import fusion

    rng = random.Random(4)
    pts = [(i, *((rng.gauss(20, 0.6), rng.gauss(50, 0.6)) if i % 3 else (rng.uniform(-85, 85), rng.uniform(-180, 180))), rng.randrange(0, 8 * 3_600_000)) for i in range(700)]
    pts += [(1000 + i, 10.0, 170 + 0.9 * i if 170 + 0.9 * i < 180 else 170 + 0.9 * i - 360, i * 60_000) for i in range(25)]

    def far(a, b):
        x, y, dl = math.radians(a[1]), math.radians(b[1]), math.radians(b[2] - a[2])
        return 2 * 6371008.8 * math.asin(min(1, math.sqrt(math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(dl / 2) ** 2)))

    parent = {p[0]: p[0] for p in pts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(pts):
        for b in pts[:i]:
            if abs(a[3] - b[3]) <= 5_400_000 and far(a, b) <= 150_000:
                x, y = sorted((find(a[0]), find(b[0])))
                parent[y] = x
    want = {i: find(i) for i in parent}
    alone = {i for i in want if list(want.values()).count(want[i]) == 1}
    df = spark.createDataFrame(pts, "id long, lat double, lon double, ts_start long")
    for few in (100_000, 0):
        monkeypatch.setattr(fusion, "FEW_PAIRS", few)
        got = {r.id: r.cluster for r in fusion.clusters(df).collect()}
        assert got == {i: c for i, c in want.items() if i not in alone}


def test_a_failing_rule_takes_no_other_with_it(spark, small):
    from kelpline.operators import engine

    o, boxes = ob.sparse(spark, small), dims.watchboxes(spark)

    def late(c):
        return engine.RULES["SEISMIC_SHALLOW"](c).withColumn("severity", F.raise_error(F.lit("broken at run time")).cast("int"))

    def planless(c):
        return c.batch.select("no_such_column")

    rules = {"THERMAL_ANOMALY": engine.RULES["THERMAL_ANOMALY"], "LATE": late, "PLAN": planless, "SHAPE": lambda c: c.batch, "AIRSPACE_VOID": engine.RULES["AIRSPACE_VOID"]}
    run = engine.run_engine(engine.Context(o, boxes, 86_400_000), rules=rules)
    assert set(run.errors) == {"LATE", "PLAN", "SHAPE"} and {r.rule for r in run.found.select("rule").distinct().collect()} == {"THERMAL_ANOMALY"}
    again = engine.run_engine(engine.Context(o, boxes, 86_400_000), existing=run.new.select("dedup_key"), rules={"THERMAL_ANOMALY": rules["THERMAL_ANOMALY"]})
    assert run.new.count() > 0 and again.new.count() == 0


def test_names_of_vessels_that_work_alongside_others(spark):
    from kelpline.functions.codes import EXCLUDED_KIND, EXCLUDED_NAME

    out = ["PILOT BOAT 4", "Pilot Ems", "RESCUE ONE", "SAR 22", "TUG ARGO", "F/V NORTHERN STAR", "fv sea breeze", "KBV 181", "R/V POLAR", "RV Celtic", "VG 12", "FN-401", "HV 7", "GG 203", "R3-1", "SVITZER MARKEN", "FAIRPLAY 30", "MULTRASALVOR 3", "Harbour Ferry", "ISLAND FERRY 2", "Strong tug of war", "THE PILOT"]
    keep = ["EVER CALM", "MSC LINA", "TUGELA", "SARONIC GULF", "OCEAN STAR", "NORDIC HAWK", "VGA TRADER", "FNLANDIA", "STENA BULK", "RIO GRANDE", "HVIDE SANDE", "GGK ONE", "OLYMPIC", "FERRYMAN"]
    df = spark.createDataFrame([(n,) for n in out + keep], "name string")
    assert {r.name for r in df.where(F.col("name").rlike(EXCLUDED_NAME)).collect()} == set(out)
    kinds = spark.createDataFrame([(k,) for k in ("Pilot vessel", "tug", "Fishing", "Search and rescue", "dredger", "Law enforcement", "cargo", "crude oil tanker", "bulk carrier", "container ship")], "kind string")
    assert {r.kind for r in kinds.where(~F.col("kind").rlike(EXCLUDED_KIND)).collect()} == {"cargo", "crude oil tanker", "bulk carrier", "container ship"}


def test_chains_verify_over_stretches(spark):
    log = spark.createDataFrame([(s, i * 7 + s, f"p{i}") for s in (1, 2, 3) for i in range(40)], "source_id int, id long, payload string")
    chain = provenance.build_chain(log).persist()
    broken = chain.withColumn("prev_sha", F.when((F.col("source_id") == 2) & (F.col("id") == 21 * 7 + 2), F.lit("x")).otherwise(F.col("prev_sha")))
    broken = broken.withColumn("payload_sha", F.when((F.col("source_id") == 3) & (F.col("id") == 5 * 7 + 3), F.lit("y")).otherwise(F.col("payload_sha")))
    for per in (1, 30, 10**6):
        got = {r.source_id: (r.links, r.broken_at, r.reason) for r in provenance.verify_chain(broken, per).collect()}
        assert got == {1: (40, None, None), 2: (40, 21, "link"), 3: (40, 5, "payload")}


def test_delta_gate_resends_and_removes():
    """The gate's rows for calls as the stream makes them, with a clock of our own."""
    import pandas as pd

    class Held:
        value, timers = None, []

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

        def clear(self):
            self.value = None

        def getValueState(self, *_):  # noqa: N802
            return self

        def listTimers(self):  # noqa: N802
            return [(t,) for t in self.timers]

        def deleteTimer(self, t):  # noqa: N802
            self.timers = [x for x in self.timers if x != t]

        def registerTimer(self, t):  # noqa: N802
            self.timers = [*self.timers, t]

    class Clock:
        def __init__(self, now):
            self.now = now

        def getCurrentProcessingTimeInMs(self):  # noqa: N802
            return self.now

    held, gate = Held(), jobs.DeltaGate(20_000, 60_000)
    gate.init(held)
    fix = lambda ts: [pd.DataFrame([("e", ts, 1, 1.0, 2.0)], columns=["entity_id", "ts_ms", "obs_id", "lat", "lon"])]
    said = lambda rows: [(x.change[0], int(x.ts_ms[0])) for x in rows]
    assert said(gate.handleInputRows(("e",), fix(5), Clock(1_000))) == [("new", 5)] and held.timers == [21_000]
    assert said(gate.handleInputRows(("e",), fix(5), Clock(2_000))) == [] and said(gate.handleInputRows(("e",), fix(9), Clock(3_000))) == [("changed", 9)]
    assert said(gate.handleExpiredTimer(("e",), Clock(23_000), None)) == [("resent", 9)] and held.timers == [43_000]
    assert said(gate.handleInputRows(("e",), fix(9), Clock(50_000))) == [("resent", 9)]
    assert said(gate.handleExpiredTimer(("e",), Clock(111_000), None)) == [("gone", 9)] and not held.exists()


def test_void_ticks_and_pushes(spark, small, tmp_path):
    o = ob.sparse(spark, small).where("domain = 1").drop("user_id", "event_type")
    o.write.parquet(str(tmp_path / "in"))
    boxes, day = dims.watchboxes(spark), 86_400_000
    usual = detectors.baseline_samples(o, 1, day).groupBy("cell").agg(F.lit(9).cast("long").alias("samples"), F.lit(40.0).alias("mean"), F.lit(1.0).alias("sd"))
    q = jobs.run_ticks(jobs.cell_counts(jobs.observations(spark, str(tmp_path / "in"), o.schema), 1, "1 day", "1 hour"), jobs.void_tick(usual, boxes, str(tmp_path / "void"), None), str(tmp_path / "cp"))
    q.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "void"))
    counts = detectors.baseline_samples(o, 1, day).collect()
    last = o.agg(F.max("ts_ms")).first()[0]
    over = {r.sample_ms for r in counts if r.sample_ms + day <= last - 3_600_000}
    n = {(r.cell, r.sample_ms): r.n for r in counts}
    want = {(c, t) for t in over for c in {r.cell for r in counts} if n.get((c, t), 0) <= 16}
    assert {(r.c, r.ts_start) for r in found.select(F.get_json_object("evidence", "$.cell").alias("c"), "ts_start").collect()} == want and any(k not in n for k in want)
    subs = spark.createDataFrame([("a", "t"), ("b", "zzz")], "client_id string, cell string")
    jobs.run_ticks(jobs.found_stream(spark, str(tmp_path / "void")), jobs.push_tick(subs, str(tmp_path / "told")), str(tmp_path / "cp2")).awaitTermination()
    told = spark.read.parquet(str(tmp_path / "told"))
    grave = found.where("severity >= 70").count()
    assert told.where("client_id = 'b'").count() == grave and told.where("client_id = 'a'").count() == found.where("severity >= 70 or geohash5 like 't%'").count()


def test_a_long_list_of_boxes_is_an_index(spark, monkeypatch):
    """The first box by id, whatever the boxes' sizes, from the index as from the list; points on edges and outside too."""
    import random

    rng = random.Random(8)
    rows = []
    for i in range(400):
        h, w = (10 ** rng.uniform(-4, 1.5) for _ in range(2))
        a, b = rng.uniform(-90, 90 - h), rng.uniform(-180, 180 - w)
        rows.append((i, f"k{i}", None, i, a, b, a + h, b + w))
    rows += [(400, "world", None, 1, -90.0, -180.0, 90.0, 180.0), (401, "point", None, 1, 5.0, 5.0, 5.0, 5.0), (402, "none", None, 1, 9.0, 9.0, 8.0, 8.0)]
    rng.shuffle(rows)
    boxes = spark.createDataFrame(rows, "box_id int, box_key string, box_label string, dark_threshold_s int, min_lat double, min_lon double, max_lat double, max_lon double")
    pts = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(1500)] + [(r[j], r[k]) for r in rows for j in (4, 6) for k in (5, 7)] + [(None, 1.0), (95.0, 0.0), (5.0, 5.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "i int, lat double, lon double")
    first = lambda: {r.i: r.box_key for r in state.first_watchbox(points, boxes).collect()}
    every = lambda: sorted((r.i, r.box_id) for r in state.all_watchboxes(points, boxes).select("i", "box_id").collect())
    want, all_of = first(), every()
    monkeypatch.setattr(state, "MOST_BOXES", 10)
    assert first() == want and every() == all_of and len(want) == len(pts) and len(set(want.values())) > 150
    plan = state.first_watchbox(points, boxes)._jdf.queryExecution().toString()
    assert "boxes_" not in plan
    most = state.box_cover(boxes).selectExpr("level", "x", "y", "size(some) + int(whole is not null) n").agg(F.sum("n")).first()[0]
    assert most <= 25 * len(rows)


def test_rules_that_fail_in_any_way_are_told(spark, small):
    from kelpline.operators import engine

    def wrong(c):
        return None + 1

    def worker(c):
        bad = F.udf(lambda x: 1 // 0, "int")
        return engine.RULES["SEISMIC_SHALLOW"](c).withColumn("severity", bad("severity"))

    o = ob.sparse(spark, small)
    rules = {"WRONG": wrong, "WORKER": worker, "SQUAWK_EMERGENCY": engine.RULES["SQUAWK_EMERGENCY"]}
    run = engine.run_engine(engine.Context(o, dims.watchboxes(spark), 86_400_000, now_ms=1_705_320_000_000), rules=rules)
    assert set(run.errors) == {"WRONG", "WORKER"} and "TypeError" in run.errors["WRONG"] and run.found.count() > 0 and run.opened is not None
