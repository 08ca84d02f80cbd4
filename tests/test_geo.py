"""Geodesy, cells and kinematics against hand-picked cases and plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from kelpline.functions import codes, geo, kinematics

POINTS = [(26.5, 56.4), (-33.9, 151.2), (64.1, -21.9), (0.0, 0.0), (89.9, 179.9), (90.0, 180.0), (-90.0, -180.0)]


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def by_halves(lat, lon, n):
    out, box, on, v, k = "", [-90.0, 90.0, -180.0, 180.0], True, 0, 0
    while len(out) < n:
        lo, hi, x = (2, 3, lon) if on else (0, 1, lat)
        mid = (box[lo] + box[hi]) / 2
        up = x >= mid
        box[lo if up else hi] = mid
        v, k, on = v * 2 + up, k + 1, not on
        if k == 5:
            out, v, k = out + geo.BASE32[v], 0, 0
    return out


def test_cells_hold_their_points(spark):
    df = spark.createDataFrame(POINTS, "lat double, lon double")
    for p in (1, 3, 5, 7):
        for r in df.withColumn("h", geo.geohash("lat", "lon", p)).withColumn("b", geo.geohash_bounds("h")).collect():
            assert r.h == by_halves(r.lat, r.lon, p)
            assert r.b.min_lat <= r.lat <= r.b.max_lat and r.b.min_lon <= r.lon <= r.b.max_lon
    assert one(spark, b=geo.geohash_bounds(F.lit("a1"))).b is None
    assert one(spark, h=geo.geohash(F.lit(None).cast("double"), F.lit(1.0))).h is None


def test_destination_undoes_distance_and_bearing(spark):
    cases = [(lat, lon, b, m) for lat, lon in POINTS[:4] + [(60.0, 170.0)] for b, m in ((0.0, 1000.0), (97.0, 50_000.0), (250.0, 900_000.0))]
    df = spark.createDataFrame(cases, "lat double, lon double, b double, m double").withColumn("t", geo.destination("lat", "lon", "b", "m"))
    for r in df.withColumn("back", geo.haversine_m("lat", "lon", "t.lat", "t.lon")).withColumn("br", geo.bearing_deg("lat", "lon", "t.lat", "t.lon")).collect():
        assert math.isclose(r.back, r.m, rel_tol=1e-6)
        assert min(abs(r.br - r.b), 360 - abs(r.br - r.b)) < 1e-6
        assert -180 <= r.t.lon <= 180
    assert one(spark, d=geo.haversine_m(F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0))).d is None


def test_small_helpers(spark):
    r = one(
        spark, a=geo.js_round(F.lit(-2.5)), b=geo.angle_delta(F.lit(350.0), F.lit(10.0)), c=geo.angle_delta(F.lit(0.0), F.lit(180.0)), d=geo.fmt_duration(F.lit(7500)), e=geo.fmt_duration(F.lit(80)),
        f=geo.fmt_duration(F.lit(600), short=False), g=geo.fmt_nm(F.lit(1852.0)), h=geo.hour_of_week(F.lit(0)), i=geo.describe_place(F.lit("bab_el"), F.lit(1.0), F.lit(2.0)), j=geo.describe_place(F.lit(None).cast("string"), F.lit(-12.34), F.lit(45.0)),
        k=codes.kind_code(F.lit("Tanker")), m=codes.kind_code(F.lit(None).cast("string")), n=codes.severity_band(F.lit(60)), o=geo.precision_for_bounds(F.lit(-90.0), F.lit(-180.0), F.lit(90.0), F.lit(180.0)),
    )
    assert (r.a, r.b, abs(r.c), r.d, r.e, r.f, r.g, r.h) == (-2, 20.0, 180.0, "2h 5m", "80s", "10 min", "1.0 nm", 96)
    assert r.i == "bab el" and r.j.startswith("12.3S 45.0E (") and (r.k, r.m, r.n) == (1, 0, "middle") and 1 <= r.o <= 6
    assert codes.domain_codes("sea, nonsense") == [2] and codes.domain_codes(None) == [1, 2]


def test_cells_for_bounds_cover_the_box(spark):
    got = one(spark, c=geo.cells_for_bounds(F.lit(25.2), F.lit(54.2), F.lit(27.4), F.lit(57.6), 4)).c
    assert len(got) == len(set(got)) and {by_halves(a, b, 4) for a in (25.2, 26.0, 27.4) for b in (54.2, 56.0, 57.6)} <= set(got)
    assert len(one(spark, c=geo.cells_for_bounds(F.lit(25.2), F.lit(54.2), F.lit(27.4), F.lit(57.6), 4, cap=5)).c) == 5


def test_viewport_crosses_the_antimeridian(spark):
    df = spark.createDataFrame([(0.0, 179.0), (0.0, -179.0), (0.0, 0.0)], "lat double, lon double")
    assert df.where(geo.in_viewport("lat", "lon", -10, 170, 10, 190)).count() == 2
    assert df.where(geo.in_viewport("lat", "lon", -10, -300, 10, 300)).count() == 3


FIX = (26.5, 56.4, 11.0, 120.0)


@pytest.mark.parametrize(("kind", "domain", "sog", "hours", "nm", "bearing", "verdict"), [
    ("tanker", 2, 11.0, 4, 44, 126, "CONSISTENT"), ("tanker", 2, 11.0, 4, 300, 120, "IMPOSSIBLE_TRANSIT"),
    ("tanker", 2, 11.0, 4, 30, 290, "COURSE_DISCONTINUITY"), ("jet", 1, 450.0, 0.5, 20, 120, "IMPLAUSIBLE_LOITER"),
])
def test_verdicts(spark, kind, domain, sog, hours, nm, bearing, verdict):
    lat, lon, _, cog = FIX
    to = geo.destination(F.lit(lat), F.lit(lon), F.lit(float(bearing)), F.lit(nm * 1852.0))
    v = kinematics.evaluate_reacquisition(F.lit(lat), F.lit(lon), F.lit(sog), F.lit(cog), to["lat"], to["lon"], F.lit(hours * 3600.0), kinematics.profile_for(F.lit(domain), F.lit(kind)))
    r = one(spark, v=v).v
    assert r.verdict == verdict
    if verdict == "CONSISTENT":
        assert r.score == 0
    if verdict == "IMPOSSIBLE_TRANSIT":
        assert r.score > 80 and r.implied_kt > 70
    if verdict == "COURSE_DISCONTINUITY":
        assert r.range_excess_m == 0


def test_reachable_sets_grow_and_close(spark):
    p = kinematics.profile_for(F.lit(2), F.lit("tanker"))
    sets = [one(spark, r=kinematics.reachable_set(F.lit(11.0), F.lit(120.0), F.lit(h * 3600.0), p)).r for h in (1 / 6, 4, 12)]
    assert not sets[0].omni and sets[2].omni and sets[0].half_deg < sets[1].half_deg and sets[0].r_max_m < sets[1].r_max_m
    assert one(spark, r=kinematics.reachable_set(F.lit(11.0), F.lit(None).cast("double"), F.lit(60.0), p)).r.omni
    for sog, hours in ((11.0, 1.0), (11.0, 12.0)):
        ring = one(spark, g=kinematics.reachable_polygon(F.lit(26.5), F.lit(56.4), kinematics.reachable_set(F.lit(sog), F.lit(120.0), F.lit(hours * 3600), p), 12)).g
        assert ring[0] == ring[-1]
    e = one(spark, e=kinematics.extrapolate(F.lit(26.5), F.lit(56.4), F.lit(11.0), F.lit(120.0), F.lit(3600)), s=kinematics.extrapolate(F.lit(26.5), F.lit(56.4), F.lit(0.0), F.lit(120.0), F.lit(3600)))
    far = one(spark, d=geo.haversine_m(F.lit(26.5), F.lit(56.4), F.lit(e.e.lat), F.lit(e.e.lon))).d
    assert abs(far - 11 * 1852) < 2 and (e.s.lat, e.s.lon) == (26.5, 56.4)
