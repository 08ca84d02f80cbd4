"""Normalisers on small payloads that touch each rule."""

import json

from kelpline.functions.codes import EMERGENCY, GNSS_DEGRADED, MILITARY, ON_GROUND
from kelpline.sources import normalisers as nz


def raw(spark, *payloads):
    rows = [(p if isinstance(p, str) else json.dumps(p), 5_000, i) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "payload string, fetched_ms long, provenance_id long")


def test_adsb(spark):
    ac = [
        {"hex": " ABC1 ", "lat": 1.0, "lon": 2.0, "alt_baro": "ground", "seen_pos": 20, "flight": "F1 ", "dbFlags": 1, "squawk": "7700"},
        {"hex": "abc2", "lat": 1.0, "lon": 2.0, "alt_baro": 1000, "nic": 3, "emergency": "none", "t": "B738"},
        {"hex": "abc3", "lat": None, "lon": 2.0}, {"lat": 1.0, "lon": 2.0}, {"hex": "abc4", "lat": 1.0, "lon": 2.0, "alt_geom": 10, "emergency": "minfuel", "seen_pos": 70},
    ]
    got = {r.entity_id: r for r in nz.normalize_adsb(raw(spark, {"now": 1_700_000_000, "ac": ac}, {"aircraft": []}, "broken")).collect()}
    assert set(got) == {"air:abc1", "air:abc2", "air:abc4"}
    a, b, c = got["air:abc1"], got["air:abc2"], got["air:abc4"]
    assert a.ts_ms == 1_699_999_980_000 and a.flags == ON_GROUND | MILITARY | EMERGENCY and a.conf == 180 and a.alt_m is None and a.props["label"] == "F1"
    assert abs(b.alt_m - 304.8) < 1e-9 and b.flags == GNSS_DEGRADED and b.conf == 240 and "emergency" not in b.props and b.props["kind"] == "B738"
    assert c.flags == EMERGENCY and c.conf == 110 and c.props["emergency"] == "minfuel"


def test_opensky(spark):
    s = ["abc1", "CALL ", "X", 1, 100, 2.0, 1.0, 300.0, True, 51.4444, 90.0, None, None, 310.0, "7600"]
    r = nz.normalize_opensky(raw(spark, {"time": 7, "states": [s, ["abc2", None, None, None, None, None, 1.0]]})).collect()
    assert len(r) == 1 and r[0].ts_ms == 100_000 and abs(r[0].sog_kt - 100) < 1e-6 and r[0].alt_m == 310.0 and r[0].flags == ON_GROUND | EMERGENCY and r[0].props["label"] == "CALL"


def test_quakes_and_articles(spark):
    f = [{"id": "q1", "properties": {"mag": 4.5, "time": 9}, "geometry": {"coordinates": [2.0, 1.0, 5.0]}}, {"id": "q2", "properties": {}, "geometry": {"coordinates": []}}]
    r = nz.normalize_quakes(raw(spark, {"features": f})).collect()
    assert len(r) == 1 and (r[0].entity_id, r[0].lat, r[0].lon, r[0].alt_m, r[0].ts_ms) == ("geo:q1", 1.0, 2.0, -5000.0, 9) and r[0].props["kind"] == "earthquake"
    a = nz.normalize_articles(raw(spark, {"articles": [{"url": "u", "title": "t", "domain": "d", "seendate": "20240102T030405Z"}, {"title": "no url"}]})).collect()
    assert len(a) == 1 and a[0].ts_ms == 1_704_164_645_000


def test_firms(spark):
    csv = "longitude,latitude,acq_date,acq_time,frp,confidence,bright_ti4,daynight\n2.5,1.5,2024-01-02,304,x,h,300,D\nbad,1,2024-01-02,0,1,n,1,N\n3.0,2.0,2024-01-02,0005,7.25,n,310.5,N\n"
    r = sorted(nz.normalize_firms(raw(spark, csv, "<html>latitude</html>", "nothing")).collect(), key=lambda x: x.lat)
    assert [x.entity_id for x in r] == ["thermal:1.5000,2.5000,2024-01-020304", "thermal:2.0000,3.0000,2024-01-020005"]
    assert r[0].ts_ms == 1_704_164_640_000 and r[0].conf == 240 and r[0].props["frp"] == "0.0" and r[1].conf == 170 and r[1].props["frp"] == "7.25"


def test_elements(spark, tmp_path):
    (tmp_path / "a.tle").write_text("SAT A\n1 00005U\n2 00005\nBAD\n1 00006U\nx 00006\nSAT B\r\n1 25544U\r\n2 25544\r\n")
    df = nz.read_tle(spark, str(tmp_path), "g")
    assert sorted((r.norad_id, r.name) for r in df.collect()) == [(5, "SAT A"), (25544, "SAT B")]
    both = df.selectExpr("*", "1 AS at").unionByName(df.selectExpr("*", "2 AS at").replace("SAT A", "NEW", "name"))
    assert {r.norad_id: r.name for r in nz.latest_by(both, "norad_id", "at").collect()} == {5: "NEW", 25544: "SAT B"}
    assert nz.purge_group(df, "g").count() == 0


def test_ais_and_cameras(spark):
    pos = spark.createDataFrame([(1, 10, 1.0, 2.0, 102.3, 360.0, 1), (1, 30, 1.0, 2.0, 5.0, 90.0, 1), (1, 40, 91.0, 181.0, 1.0, 1.0, 1)], "mmsi long, ts_ms long, lat double, lon double, sog double, cog double, provenance_id long")
    stat = spark.createDataFrame([(1, 20, "SHIP", "tanker")], "mmsi long, ts_ms long, name string, ship_type string")
    r = sorted(nz.normalize_ais(pos, stat).collect(), key=lambda x: x.ts_ms)
    assert len(r) == 2 and r[0].sog_kt is None and r[0].cog_deg is None and r[0].props["label"] == "1" and r[1].props["kind"] == "tanker" and r[1].sog_kt == 5.0
    cams = [{"id": "c", "commonName": "JamCam A40", "lat": 1.0, "lon": 2.0, "additionalProperties": [{"key": "x", "value": "y"}, {"key": "videoUrl", "value": "http://v/1.mp4"}]}, {"id": "d", "commonName": "n", "lat": 1.0, "lon": 1.0, "additionalProperties": []}]
    r = nz.normalize_cameras(raw(spark, json.dumps(cams))).collect()
    assert [(x.id, x.label, x.image) for x in r] == [("tfl:c", "A40", "http://v/1.jpg")]
