"""Ticks with kept tables against one batch over everything."""

import pytest
from pyspark.sql import functions as F

from kelpline.functions.geo import quantize
from kelpline.operators import detectors, engine, fusion, state
from kelpline.sources import dims
from kelpline.sources import observations as ob
from kelpline.streaming import jobs, watch
from kelpline.streaming.kept import KeptTable

DAY, NOW = 86_400_000, 1_705_320_000_000
MANY = {k: 10**6 for k in detectors.CAPS}


def test_a_kept_table_is_what_its_ticks_wrote(spark, tmp_path):
    t = KeptTable(spark, str(tmp_path / "t"), ("k",), "k int, v string, d int", "d", compact_every=3)
    t.keys = ["k", "d"]
    want: dict = {}
    for epoch in range(10):
        rows = [((epoch + i) % 7, f"{epoch}-{i}", ((epoch + i) % 7) % 2, i == 2) for i in range(3)]
        seen = {r.k: r.v for r in t.before(epoch).collect()}
        assert seen == want
        for k, v, _, gone in rows:
            want.pop(k, None)
            if not gone:
                want[k] = v
        for _ in range(2):  # a tick that is run again
            t.write(spark.createDataFrame(rows, "k int, v string, d int, gone boolean"), epoch)
    assert {r.k: r.v for r in t.before(99).collect()} == want and len(t._epochs("base")) == 2 and min(t._epochs("change")) >= 3
    assert "PartitionFilters: [isnotnull(d" in t.before(99).where("d = 1")._jdf.queryExecution().toString()
    # A folder without its mark was never finished.
    (tmp_path / "t" / "change=9" / "_SUCCESS").unlink()
    assert {r.k: r.v for r in t.before(99).collect()} != want


@pytest.fixture(scope="module")
def fixes(spark, small):
    """Sparse fixes, dense tracks under names of their own, and hulls that are silent for days."""
    a = ob.sparse(spark, small).drop("user_id", "event_type", "geohash5")
    b = ob.burst(spark, small).drop("seed", "step", "now_ms", "geohash5")
    b = b.withColumns({"obs_id": F.col("obs_id") + 10**9, "entity_id": F.concat(F.lit("b"), "entity_id")})
    quiet = F.col("entity_id").rlike("^(sea|air):[1-4]$") & F.col("ts_ms").between(NOW - 8 * DAY, NOW + 8 * DAY)
    return b.unionByName(a, allowMissingColumns=True).select(*a.columns).where(~quiet).persist()


def drain(spark, fixes, folder, days, **how):
    """Lands files of some days each and runs ticks over them; the last tick again under its own number."""
    fixes.withColumn("part", F.floor(F.col("ts_ms") / F.lit(days * DAY))).repartition("part").sortWithinPartitions("part").createOrReplaceTempView("landing")
    parts = [r.part for r in spark.sql("select distinct part from landing order by part").collect()]
    for p in parts:
        spark.sql(f"select * from landing where part = {p}").drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    told = []
    w = watch.Watch(dims.watchboxes(spark), f"{folder}/kept", told=told, **how)
    tick, last = watch.watch_tick(w), []

    def twice(batch, epoch):
        tick(batch, epoch)
        if epoch == len(parts) - 1:
            tick(batch, epoch)
        last.append(epoch)

    jobs.run_ticks(jobs.observations(spark, f"{folder}/in", fixes.schema, 1), twice, f"{folder}/at").awaitTermination()
    assert len(last) == len(parts) > 2 and not any(errors for _, errors in told), told
    return watch.Kept(spark, f"{folder}/kept", how.get("compact_every", 16)), spark.read.parquet(f"{folder}/kept/found")


def keys(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_ticks_find_what_one_batch_finds(spark, fixes, tmp_path):
    boxes = dims.watchboxes(spark)
    how = {"tick_ms": DAY, "precision": 2, "season": None, "caps": MANY, "min_severity": 30, "look_back_ms": DAY}
    kept, found = drain(spark, fixes, str(tmp_path), 11, compact_every=2, **how)
    rules = {k: v for k, v in engine.RULES.items() if k != "AIRSPACE_VOID"}
    one = engine.run_engine(engine.Context(fixes, boxes, DAY, precision=2, season=None), rules=rules, caps=MANY)
    assert keys(found, "dedup_key", "severity") == keys(one.new, "dedup_key", "severity")
    assert {r.rule for r in found.select("rule").distinct().collect()} >= {"SPOOF_DISCONTINUITY", "DARK_VESSEL", "THERMAL_ANOMALY", "SEISMIC_SHALLOW", "SQUAWK_EMERGENCY", "RENDEZVOUS", "LOITER"}
    # Incidents: the same groups, each under a name that one of its members gave it.
    whole = fusion.confluence(engine.numbered(one.new), min_severity=30)
    fields = ("severity", "members", "n_domains", "ts_start", "ts_end", "radius_km", "lead", "hash", "title", "narrative", "detection_ids")
    inc = kept.incidents.before(10**6).persist()
    assert keys(inc, *fields) == keys(whole, *fields) and inc.count() > 0
    assert inc.where(~F.array_contains("detection_ids", F.col("cluster"))).count() == 0
    # Gaps: closed ones are those of the batch, however long; open ones those of the last scan.
    now = fixes.agg(F.max("ts_ms")).first()[0]
    table = kept.gaps.before(10**6)
    g = detectors.gaps(fixes, boxes).select("entity_id", F.col("prev_ts_ms").alias("went_dark_ms"), "obs_id", F.col("v.verdict").alias("verdict"))
    assert keys(table.where("state = 'closed'"), "entity_id", "went_dark_ms", "obs_id", "verdict") == keys(g, "entity_id", "went_dark_ms", "obs_id", "verdict")
    silent = detectors.fallen_silent(state.last_known(fixes), now, boxes)
    assert keys(table.where("state = 'open'"), "entity_id", "went_dark_ms") == keys(silent, "entity_id", "went_dark_at")
    assert table.where("state = 'closed' and back_ms - went_dark_ms > 15 * 86400000").count() > 0


def test_names_stay_when_groups_grow_and_merge(spark, tmp_path):
    kept = watch.Kept(spark, str(tmp_path), 2)
    hour = 3_600_000

    def det(key, rule, h, lon=0.0):
        return (rule, 80, int(h * hour), None, 10.0, lon, "", [key], "t", "{}", "open", f"h{key}", key)

    schema = "rule string, severity int, ts_start long, ts_end long, lat double, lon double, geohash5 string, entity_ids array<string>, title string, evidence string, state string, hash string, dedup_key string"
    number = {r.hash: r.id for r in engine.numbered(spark.createDataFrame([(f"h{k}",) for k in "abcdefg"], "hash string")).collect()}
    seen = lambda e: {r.cluster: set(r.detection_ids) for r in kept.incidents.before(e).collect()}
    ids = lambda s: {number[f"h{k}"] for k in s}
    fold = lambda e, *rows: watch.fold_incidents(kept, spark.createDataFrame(list(rows), schema), e, min_severity=30)
    fold(0, det("a", "THERMAL_ANOMALY", 20.0), det("b", "SEISMIC_SHALLOW", 21.0))
    fold(1, det("c", "THERMAL_ANOMALY", 25.0), det("d", "SQUAWK_EMERGENCY", 26.0), det("g", "LOITER", 26.0, 90.0))
    first, second = sorted(seen(2), key=lambda n: n not in ids("ab"))
    assert seen(2) == {first: ids("ab"), second: ids("cd")} and first in ids("ab") and second in ids("cd")
    fold(2, det("e", "LOITER", 22.4))  # across midnight, only the first group is near
    assert seen(3) == {first: ids("abe"), second: ids("cd")}
    for _ in range(2):
        fold(3, det("f", "LOITER", 23.8))  # between e and c: one group, under the older name
        assert seen(4) == {first: ids("abcdef")}
    groups = {r.cluster: (r.first_ms, r.last_ms) for r in kept.groups.before(4).collect()}
    assert groups == {first: (20 * hour, 26 * hour)}


def test_gaps_open_close_and_are_withdrawn(spark, tmp_path):
    kept, boxes = watch.Kept(spark, str(tmp_path), 2), dims.watchboxes(spark).limit(0)
    schema = "entity_id string, ts_ms long, obs_id long, domain int, lat double, lon double, sog_kt double, cog_deg double, flags int, kind string"
    hour = 3_600_000

    def fix(e, h, i, sog=10.0, domain=2, flags=0):
        return (e, int(h * hour), i, domain, 1.0, float(i), sog, 0.0, flags, "cargo")

    def go(epoch, now_h, *rows):
        batch = spark.createDataFrame(list(rows), schema)
        c = engine.Context(batch, boxes, known=kept.last.before(epoch), open_gaps=kept.gaps.before(epoch).where("state = 'open'"), now_ms=int(now_h * hour))
        watch.keep_gaps(kept, batch, engine._silent(c, {}), boxes, epoch)
        return {(r.entity_id, r.went_dark_ms // hour): r.state for r in kept.gaps.before(epoch + 1).collect()}

    # Moored and landed ones fall silent without a gap; flags and speed are the last that were told.
    assert go(0, 3, fix("a", 1, 1), fix("m", 1, 2, 0.1), fix("p", 1, 3, 300.0, 1, 64), fix("late", 1, 4), fix("late", 1.5, 5, None)) == {("a", 1): "open", ("late", 1): "open"}
    # A fix that comes late, but behind the last known one and under the threshold, withdraws; one before it does nothing.
    assert go(1, 4, fix("late", 2, 6), fix("a", 0.5, 7)) == {("a", 1): "open", ("late", 1): "withdrawn", ("late", 2): "open"}
    # Days later: closed by the next fix, once.
    for _ in range(2):
        assert go(2, 101, fix("a", 100, 8), fix("a", 100.5, 9)) == {("a", 1): "closed", ("late", 1): "withdrawn", ("late", 2): "open"}
    assert go(3, 200, fix("m", 200, 10)) == {("a", 1): "closed", ("a", 100): "open", ("late", 1): "withdrawn", ("late", 2): "open"}
    assert kept.last.before(4).where("entity_id = 'late'").first().sog_kt == 10.0


def test_folded_moments_equal_one_pass(spark, fixes, tmp_path):
    kept = watch.Kept(spark, str(tmp_path), 3)
    air = fixes.where("domain = 1")
    season = lambda ms: F.floor(ms / F.lit(DAY)).cast("int") % 3
    ends = [r[0] for r in air.select(quantize("ts_ms", 7 * DAY)).distinct().collect()]
    for epoch, a in enumerate(sorted(ends)):
        batch = air.where(F.col("ts_ms").between(a + DAY // 3, a + 7 * DAY + DAY // 3 - 1) | ((F.col("ts_ms") < a + DAY // 3) if epoch == 0 else F.lit(False)))
        for _ in range(1 + (epoch == 1)):
            if now := batch.agg(F.max("ts_ms")).first()[0]:
                watch.fold_usual(kept, batch, now, epoch, 2, DAY, season)
    upto = kept.clock.before(99).first().at_ms
    samples = detectors.baseline_samples(air, 2, DAY).where(F.col("sample_ms") < upto).withColumn("season", season(F.col("sample_ms")))
    want = {(r.cell, r.season): (r.samples, r.mean, r.sd or 0.0) for r in detectors.baseline(samples, "season", least=2).collect()}
    got = {(r.cell, r.season): (r.samples, r.mean, r.sd or 0.0) for r in watch.usual(kept, 99, 2).collect()}
    assert want and set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_gate_steps_by_a_clock():
    steps = lambda last, arrivals, upto: jobs.gate_steps(last, arrivals, upto, 20, 60)
    out, last = steps(None, [(5, 1.0, 2.0, 100), (9, 1.0, 2.0, 130), (7, 0.0, 0.0, 145)], 160)
    assert [(r[0], r[1], r[4]) for r in out] == [("new", 5, 100), ("resent", 5, 120), ("changed", 9, 130), ("resent", 9, 150)] and last == (9, 1.0, 2.0, 145, 150)
    # A stretch in one piece or in many.
    whole, end = steps(last, [], 400)
    assert [(r[0], r[4]) for r in whole] == [("resent", 170), ("resent", 190), ("gone", 210)] and end is None
    parts, state = [], last
    for t in range(160, 401, 7):
        more, state = steps(state, [], t)
        parts += more
    assert parts == whole and state is None
    assert [r[0] for r in steps(None, [(3, 0.0, 0.0, 500)], 500)[0]] == ["new"]


def test_places_and_rest():
    from kelpline.streaming.silence import Places, at_rest

    p = Places([{"box_key": "a", "min_lat": 0, "max_lat": 2, "min_lon": 0, "max_lon": 2, "dark_threshold_s": 600}, {"box_key": "b", "min_lat": 1, "max_lat": 3, "min_lon": 1, "max_lon": 3, "dark_threshold_s": None}], 3600)
    assert p.at(1.5, 1.5) == ("a", 600_000) and p.at(2.5, 2.5) == ("b", 3_600_000) and p.at(9, 9) == (None, 3_600_000) and p.least_ms() == 600_000
    assert at_rest(2, None, 0) and at_rest(2, 0.3, 0) and not at_rest(2, 0.4, 0) and at_rest(1, 300.0, 64) and not at_rest(1, 0.0, None)


def test_chains_go_on_and_forks_are_refused(spark, tmp_path):
    from kelpline.operators.provenance import build_chain
    from kelpline.streaming.chains import ForkedChain, KeptChain

    schema = "source_id int, id long, payload string"
    log = spark.createDataFrame([(s, i, f"{s}-{i}") for i in range(12) for s in (1, 2)], schema)
    kept = KeptChain(spark, str(tmp_path), 2)
    before = kept.heads.before(0).select("source_id", "chain_sha")
    kept.append(log.where("id < 5"), 0, before)
    mine = kept.heads.before(1).select("source_id", "chain_sha").collect()
    mine = spark.createDataFrame(mine, "source_id int, chain_sha string")
    kept.append(log.where("id between 3 and 8"), 1, mine)  # some come again
    with pytest.raises(ForkedChain, match="moved"):
        kept.append(log.where("id > 8"), 2, mine)
    with pytest.raises(ForkedChain, match="payload"):
        kept.append(spark.createDataFrame([(2, 8, "other"), (2, 9, "2-9")], schema), 2)
    for _ in range(2):
        kept.append(log.where("id > 8"), 2)
    fields = ("source_id", "id", "payload_sha", "prev_sha", "chain_sha")
    assert keys(kept.links(), *fields) == keys(build_chain(log), *fields)


def test_trims_free_the_oldest_days(spark, tmp_path):
    from kelpline.operators import archive

    folder = str(tmp_path / "a")
    spark.range(5000).selectExpr("id", f"(id % 5) * {DAY} as day_ms").repartition("day_ms").write.partitionBy("day_ms").parquet(folder)
    size = archive.storage_by_day(spark, folder)
    assert archive.trim_storage(spark, folder, sum(size.values())) == []
    assert archive.trim_storage(spark, folder, sum(size.values()) - 1) == [0]
    assert archive.trim_storage(spark, folder, 0) == [DAY, 2 * DAY, 3 * DAY] and spark.read.parquet(folder).count() == 1000
    assert archive.trim_storage(spark, str(tmp_path / "none"), 0) == []
