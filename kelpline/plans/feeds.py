"""Registered queries over raw feeds: payload texts are written from observations and read by the normalisers, whose drop and
sentinel rules some of the rows touch; the SQL says from the observations what must come out."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.functions.geo import KT_TO_MS
from kelpline.plans.checkpoints import shared_folder
from kelpline.plans.oracle import OBS
from kelpline.sources import normalisers as nz
from kelpline.sources import observations as ob


def _payloads(rows: DataFrame, body) -> DataFrame:
    """One payload for each hundred events: (payload, fetched_ms, provenance_id); ``body`` makes the text of an ``items`` array
    and of ``fetched_ms``."""
    one = rows.groupBy("provenance_id").agg(F.max("ts_ms").alias("fetched_ms"), F.array_sort(F.collect_list(F.struct("obs_id", "item"))).alias("sorted"))
    one = one.withColumn("items", F.transform("sorted", lambda x: x["item"]))
    return one.select(body.alias("payload"), "fetched_ms", "provenance_id")


def _flag(bit: int):
    return F.col("flags").bitwiseAND(bit) != 0


def feed_aircraft(s, d):
    o = ob.sparse(s, d).where("domain = 1")
    alt = F.when(_flag(64), "ground").otherwise((F.col("alt_m") / nz.FOOT_M).cast("string"))
    item = F.struct(
        F.concat(F.lit(" A"), F.col("user_id").cast("string"), F.lit(" ")).alias("hex"), F.when(F.col("obs_id") % 17 != 0, F.col("lat")).alias("lat"), "lon", alt.alias("alt_baro"), F.col("sog_kt").alias("gs"), F.col("cog_deg").alias("track"),
        F.when(_flag(32), 1).otherwise(0).alias("dbFlags"), "squawk", F.when(_flag(2), 3).otherwise(8).alias("nic"), (F.col("obs_id") % 90).cast("double").alias("seen_pos"), F.col("label").alias("flight"), F.col("kind").alias("t"),
    )
    raw = _payloads(o.withColumn("item", item), F.to_json(F.struct(F.floor(F.col("fetched_ms") / F.lit(1000)).alias("now"), F.col("items").alias("ac"))))
    n = nz.normalize_adsb(raw)
    return n.select("provenance_id", "entity_id", "ts_ms", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("alt_m", 3).alias("alt_m"), "sog_kt", "cog_deg", "flags", "conf", n.props["label"].alias("label"), n.props["kind"].alias("kind"), n.props["squawk"].alias("squawk"))


def feed_states(s, d):
    o = ob.sparse(s, d).where("domain = 1")
    t = lambda c: F.col(c).cast("string")
    cells = {0: F.concat(F.lit("B"), t("user_id")), 1: F.col("label"), 4: F.floor(F.col("ts_ms") / F.lit(1000)).cast("string"), 5: F.when(F.col("obs_id") % 13 != 0, t("lon")), 6: t("lat"), 7: t("alt_m"), 8: F.when(_flag(64), "true").otherwise("false"), 9: (F.col("sog_kt") * KT_TO_MS).cast("string"), 10: t("cog_deg"), 14: F.col("squawk")}
    item = F.array(*[cells.get(i, F.lit(None)).cast("string") for i in range(17)])
    raw = _payloads(o.withColumn("item", item), F.to_json(F.struct(F.lit(7).alias("time"), F.col("items").alias("states"))))
    n = nz.normalize_opensky(raw)
    return n.select("entity_id", "ts_ms", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "alt_m", F.round("sog_kt", 6).alias("sog_kt"), "flags", "conf", n.props["label"].alias("label"))


def feed_quakes(s, d):
    o = ob.sparse(s, d).where("domain = 4")
    where = F.when(F.col("obs_id") % 11 != 0, F.array("lon", "lat", "depth_km")).otherwise(F.array().cast("array<double>"))
    item = F.struct(F.concat(F.lit("q"), F.col("obs_id").cast("string")).alias("id"), F.struct("mag", F.when(F.col("obs_id") % 5 != 0, F.col("ts_ms")).alias("time")).alias("properties"), F.struct(where.alias("coordinates")).alias("geometry"))
    n = nz.normalize_quakes(_payloads(o.withColumn("item", item), F.to_json(F.struct(F.col("items").alias("features")))))
    return n.select("entity_id", "ts_ms", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "alt_m", "conf", n.props["kind"].alias("kind"), F.round(n.props["mag"].cast("double"), 6).alias("mag"), n.props["depthKm"].cast("double").alias("depth_km"))


def feed_fires(s, d):
    o = ob.sparse(s, d).where("domain = 5").withColumn("ts", F.timestamp_millis("ts_ms"))
    t = lambda c: F.col(c).cast("string")
    frp = F.when(F.col("obs_id") % 9 == 0, "x").otherwise(t("frp"))
    hhmm = F.regexp_replace(F.date_format("ts", "HHmm"), "^0+(?=.)", "")
    item = F.concat_ws(",", t("lon"), F.when(F.col("obs_id") % 12 == 0, "bad").otherwise(t("lat")), F.date_format("ts", "yyyy-MM-dd"), hhmm, frp, F.element_at(F.array(*map(F.lit, "hnl")), (F.col("obs_id") % 3 + 1).cast("int")), F.lit("300.5"), F.lit("D"))
    head = F.when(F.col("provenance_id") % 10 == 3, "<html>latitude").otherwise("longitude,latitude,acq_date,acq_time,frp,confidence,bright_ti4,daynight")
    n = nz.normalize_firms(_payloads(o.withColumn("item", item), F.concat_ws("\n", head, F.array_join("items", "\n"))))
    return n.select("ts_ms", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "conf", F.round(n.props["frp"].cast("double"), 6).alias("frp"), n.props["dayNight"].alias("day_night"))


def feed_ships(s, d):
    o = ob.sparse(s, d).where("domain = 2")
    static = o.where("event_type = 'signup'").select(F.col("user_id").alias("mmsi"), "ts_ms", F.concat(F.lit("N"), F.col("obs_id").cast("string")).alias("name"), F.col("kind").alias("ship_type"))
    odd = lambda k, v, c: F.when(F.col("obs_id") % k == 0, v).otherwise(F.col(c))
    pos = o.select(F.col("user_id").alias("mmsi"), "ts_ms", odd(29, 91.0, "lat").alias("lat"), odd(31, 181.0, "lon").alias("lon"), odd(19, 102.3, "sog_kt").alias("sog"), odd(23, 360.0, "cog_deg").alias("cog"), "provenance_id")
    n = nz.normalize_ais(pos, static)
    return n.select("entity_id", "ts_ms", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "sog_kt", "cog_deg", n.props["label"].alias("label"), n.props["kind"].alias("kind"))


def feed_articles(s, d):
    o = ob.sparse(s, d).where("event_type = 'view'").withColumn("ts", F.timestamp_millis("ts_ms"))
    item = F.struct(F.when(F.col("obs_id") % 7 != 0, F.concat(F.lit("http://n/"), F.col("obs_id").cast("string"))).alias("url"), F.col("label").alias("title"), F.lit("n").alias("domain"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"))
    return nz.normalize_articles(_payloads(o.withColumn("item", item), F.to_json(F.struct(F.col("items").alias("articles"))))).select("ts_ms", "url", "title", "domain", "provenance_id")


def feed_cameras(s, d):
    o = ob.sparse(s, d).where("event_type = 'purchase'")
    i = F.col("obs_id").cast("string")
    prop = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    some = F.when(F.col("obs_id") % 3 == 0, F.array(prop("x", i), prop("videoUrl", F.concat(i, F.lit(".mp4"))))).when(F.col("obs_id") % 3 == 1, F.array(prop("imageUrl", F.concat(i, F.lit(".png"))), prop("videoUrl", i))).otherwise(F.array(prop("x", i)))
    item = F.struct(i.alias("id"), F.concat(F.lit("JamCam  "), F.col("label")).alias("commonName"), "lat", "lon", some.alias("additionalProperties"))
    n = nz.normalize_cameras(_payloads(o.withColumn("item", item), F.to_json("items")))
    return n.select("id", "label", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "image")


def feed_elements(s, d):
    """Element files in the shared folder, of which the newest set of each target is kept and one group purged."""
    e = ob.events(s, d)
    norad = F.lpad((F.col("user_id") % 1000).cast("string"), 5, "0")
    second = F.when(F.col("event_id") % 11 == 0, "x ").otherwise("2 ")
    three = F.concat(F.format_string("SAT %09d", "event_id"), F.lit("\n1 "), norad, F.lit("U\n"), second, norad)
    folder = os.path.join(shared_folder(s), f"elements-{uuid.uuid4().hex}")
    for k, group in enumerate(("even", "odd")):
        e.where(F.col("user_id") % 2 == k).select(three.alias("value")).write.text(f"{folder}/{group}")
    both = nz.read_tle(s, f"{folder}/even", "even").unionByName(nz.read_tle(s, f"{folder}/odd", "odd"))
    newest = nz.latest_by(both.withColumn("at", F.col("name")), "norad_id", "at")
    return newest.unionByName(nz.purge_group(newest, "odd").withColumn("grp", F.lit("left"))).select("norad_id", "name", "line1", "grp")


QUERIES = {f.__name__: f for f in (feed_aircraft, feed_states, feed_quakes, feed_fires, feed_ships, feed_articles, feed_cameras, feed_elements)}

_AT = "round(lat,6) AS lat, round(lon,6) AS lon"
ORACLE = {
    "feed_aircraft": f"""WITH {OBS}, n AS (SELECT *, max(ts_ms) OVER (PARTITION BY provenance_id)//1000*1000 AS now FROM obs WHERE domain=1) SELECT provenance_id, 'air:a'||user_id AS entity_id, now-obs_id%90*1000 AS ts_ms, {_AT}, CASE WHEN (flags&64)=0 THEN round(alt_m,3) END AS alt_m, sog_kt, cog_deg,
  (flags&98)|(CASE WHEN squawk IS NOT NULL THEN 1 ELSE 0 END) AS flags, CASE WHEN obs_id%90<15 THEN 240 WHEN obs_id%90<60 THEN 180 ELSE 110 END AS conf, label, kind, squawk FROM n WHERE obs_id%17<>0""",
    "feed_states": f"WITH {OBS} SELECT 'air:b'||user_id AS entity_id, ts_ms//1000*1000 AS ts_ms, {_AT}, alt_m, round(sog_kt,6) AS sog_kt, (flags&64)|(CASE WHEN squawk IS NOT NULL THEN 1 ELSE 0 END) AS flags, 200 AS conf, label FROM obs WHERE domain=1 AND obs_id%13<>0",
    "feed_quakes": f"WITH {OBS}, n AS (SELECT *, max(ts_ms) OVER (PARTITION BY provenance_id) AS fetched FROM obs WHERE domain=4) SELECT 'geo:q'||obs_id AS entity_id, CASE WHEN obs_id%5<>0 THEN ts_ms ELSE fetched END AS ts_ms, {_AT}, depth_km*-1000 AS alt_m, 250 AS conf, 'earthquake' AS kind, round(mag,6) AS mag, depth_km FROM n WHERE obs_id%11<>0",
    "feed_fires": f"WITH {OBS} SELECT ts_ms//60000*60000 AS ts_ms, {_AT}, CASE obs_id%3 WHEN 0 THEN 240 WHEN 1 THEN 170 ELSE 110 END AS conf, CASE WHEN obs_id%9=0 THEN 0e0 ELSE round(frp,6) END AS frp, 'D' AS day_night FROM obs WHERE domain=5 AND obs_id%12<>0 AND provenance_id%10<>3",
    "feed_ships": f"""WITH {OBS}, st AS (SELECT user_id, ts_ms, 'N'||obs_id AS name, kind AS ship FROM obs WHERE domain=2 AND event_type='signup'), p AS (SELECT * FROM obs WHERE domain=2 AND obs_id%29<>0 AND obs_id%31<>0)
SELECT 'sea:'||p.user_id AS entity_id, p.ts_ms, {_AT}, CASE WHEN obs_id%19<>0 THEN sog_kt END AS sog_kt, CASE WHEN obs_id%23<>0 THEN cog_deg END AS cog_deg, coalesce(name, p.user_id::VARCHAR) AS label, ship AS kind FROM p ASOF LEFT JOIN st ON st.user_id=p.user_id AND p.ts_ms>=st.ts_ms""",
    "feed_articles": f"WITH {OBS} SELECT ts_ms//1000*1000 AS ts_ms, 'http://n/'||obs_id AS url, label AS title, 'n' AS domain, provenance_id FROM obs WHERE event_type='view' AND obs_id%7<>0",
    "feed_cameras": f"WITH {OBS} SELECT 'tfl:'||obs_id AS id, label, {_AT}, obs_id||(CASE obs_id%3 WHEN 0 THEN '.jpg' ELSE '.png' END) AS image FROM obs WHERE event_type='purchase' AND obs_id%3<2",
    "feed_elements": "WITH n AS (SELECT user_id%1000 AS norad_id, max(event_id) AS e, user_id%2 AS k FROM events WHERE event_id%11<>0 GROUP BY ALL), z AS (SELECT norad_id::INT AS norad_id, printf('SAT %09d', e) AS name, printf('1 %05dU', norad_id) AS line1, k FROM n) SELECT norad_id, name, line1, CASE k WHEN 0 THEN 'even' ELSE 'odd' END AS grp FROM z UNION ALL SELECT norad_id, name, line1, 'left' FROM z WHERE k=0",
}
