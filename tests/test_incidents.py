"""Incidents and their members where they are many, and where detections share an id."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from kelpline.operators import provenance
from kelpline.plans import queries, registry
from kelpline.streaming import watch
from tests.compare import agree, duck

MANY = 20_000


def one_incident(spark):
    """(incident, id): an incident that all of many detections belong to, and one of two."""
    all_ = spark.range(MANY).select(F.lit("all").alias("incident"), "id")
    return all_.unionByName(spark.createDataFrame([("two", -1), ("two", -2)], "incident string, id long"))


def test_case_files_of_one_large_incident_grow_with_its_members(spark):
    """A list of siblings beside each detection would hold 400 million ids here."""
    det = spark.range(-3, MANY).select("id", F.lit(0).cast("long").alias("ts_start"), F.array(F.concat(F.lit("sea:"), F.col("id"))).alias("entity_ids"), F.array(F.lit(1).cast("long")).alias("provenance_ids"))
    gaps = spark.createDataFrame([], "id long, domain int, kind string, dt_ms long, prev_lat double, prev_lon double, prev_sog_kt double, prev_cog_deg double")
    obs = spark.createDataFrame([], "entity_id string, ts_ms long, obs_id long, lat double, lon double")
    chain = spark.createDataFrame([], "id long, source_id int, payload_sha string")
    c = provenance.full_case_files(det, gaps, obs, chain, one_incident(spark), 6)
    assert not [f.name for f in c.schema.fields if f.dataType.simpleString() == "array<bigint>" and f.name != "provenance_ids"]
    got = {(r.incident, r.n_siblings): r["count"] for r in c.groupBy("incident", "n_siblings").count().collect()}
    assert got == {("all", MANY - 1): MANY, ("two", 1): 2, (None, None): 1}


def test_bundles_of_one_large_incident_grow_with_its_members(spark):
    det = spark.range(-3, MANY).select(
        "id", F.lit("THERMAL_ANOMALY").alias("rule"), F.lit(50).alias("severity"), F.lit(0).cast("long").alias("ts_start"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"),
        F.array(F.concat(F.lit("thermal:"), F.col("id"))).alias("entity_ids"), F.lit("{}").alias("evidence"),
    )
    methods = spark.createDataFrame([("THERMAL_ANOMALY", "m", "l")], "rule string, method string, limitation string")
    tracks = spark.createDataFrame([], "id long, entity_id string, fixes long")
    sources = spark.createDataFrame([], "id long, source_key string, provenance_id long, payload_sha string")
    b = provenance.evidence_bundles(det, methods, tracks, sources, members=provenance.siblings(one_incident(spark)))
    j = lambda p: F.get_json_object("bundle", p)
    got = {(r.i, r.n): (r.c, r.most) for r in b.groupBy(j("$.incident").alias("i"), j("$.n_siblings").alias("n")).agg(F.count(F.lit(1)).alias("c"), F.max(F.length("bundle")).alias("most")).collect()}
    assert {k: v[0] for k, v in got.items()} == {("all", str(MANY - 1)): MANY, ("two", "1"): 2, (None, None): 1}
    assert max(v[1] for v in got.values()) < 500


def write_events(spark, folder, rows):
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(f"{folder}/all")
    (part,) = [f for f in os.listdir(f"{folder}/all") if f.startswith("part-")]
    os.symlink(f"{folder}/all/{part}", f"{folder}/events.parquet")


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Hours in which aircraft signal emergencies from several cells, so that detections share an id, beside quakes and hot spots."""
    folder = str(tmp_path_factory.mktemp("crowded"))
    start = datetime.datetime(2024, 1, 10)
    kinds = [(3, 7), (7, 1), (4, 7), (6, 3), (5, 8)]  # users and k: three aircraft, a fire pixel, a quake
    rows = []
    for i in range(150):
        user, k = kinds[i % len(kinds)]
        rows.append((i * 37, start + datetime.timedelta(minutes=i * 5 + (i // 50) * 600), user, "view", 120.0, f'{{"k": {k}}}'))
    write_events(spark, folder, rows)
    ids = queries._simple(spark, folder).groupBy("id").count()
    assert ids.where("count > 1").count() > 2
    return folder


def agrees(spark, folder, name):
    agree(registry.queries()[name](spark, folder), duck(folder), registry.oracle_sql()[name])


def test_links_of_detections_that_share_an_id(spark, crowded):
    agrees(spark, crowded, "incident_links")


def test_siblings_of_detections_that_share_an_id(spark, crowded):
    agrees(spark, crowded, "incident_siblings")


def test_ranks_of_incidents_whose_detections_share_an_id(spark, crowded):
    agrees(spark, crowded, "incidents_ranked")


def test_ticks_append_more_than_the_breaker_would_leave(spark, tmp_path):
    """More grave quakes, hot spots and emergencies in a day than the caps of their rules."""
    users = {3: 9, 6: 0, 7: 0}  # and k: an aircraft that squawks 7500, a shallow quake, a fire pixel
    write_events(spark, str(tmp_path), [(i, datetime.datetime(2024, 1, 10) + datetime.timedelta(minutes=i * 7), u, "view", 100_000.0, f'{{"k": {users[u]}}}') for i in range(180) for u in [list(users)[i % 3]]])
    agrees(spark, str(tmp_path), "stream_runs")


def test_ticks_fuse_detections_that_share_an_id(spark, crowded):
    agrees(spark, crowded, "stream_incidents")


def test_groups_of_a_shared_id_grow_from_tick_to_tick(spark, tmp_path):
    """Detections 5 are two, far apart and told one after the other; whoever lies near one of them belongs to both."""
    kept = watch.Kept(spark, str(tmp_path), 2)
    schema = "rule string, severity int, ts_start long, ts_end long, lat double, lon double, entity_ids array<string>, evidence string, hash string"
    number = lambda x: x.withColumn("id", F.substring("hash", 1, 1).cast("long"))
    det = lambda key, rule, lon: (rule, 80, 0, None, 10.0, lon, [key], "{}", key)
    fold = lambda e, *rows: watch.fold_incidents(kept, spark.createDataFrame(list(rows), schema), e, min_severity=30, number=number)
    seen = lambda e: {r.cluster: r.detection_ids for r in kept.incidents.before(e).collect()}
    fold(0, det("5a", "SQUAWK_EMERGENCY", 0.0))
    fold(1, det("5b", "SQUAWK_EMERGENCY", 40.0))
    assert seen(2) == {}
    fold(2, det("7a", "THERMAL_ANOMALY", 40.0))
    assert seen(3) == {5: [5, 5, 7]}
    fold(3, det("5c", "SQUAWK_EMERGENCY", 80.0))
    assert seen(4) == {5: [5, 5, 5, 7]}
    fold(4, det("6a", "SEISMIC_SHALLOW", 120.0), det("8a", "THERMAL_ANOMALY", 120.0))
    fold(5, det("6b", "SEISMIC_SHALLOW", 80.0))
    assert seen(6) == {5: [5, 5, 5, 6, 6, 7, 8]}
