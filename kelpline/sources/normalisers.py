"""Normalisers: raw payload text to observations.  Each takes rows of (payload, fetched_ms, provenance_id)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.functions.codes import AIR, EMERGENCY, GEO, GNSS_DEGRADED, MILITARY, ON_GROUND, SEA, SQUAWKS, THERMAL
from kelpline.functions.geo import KT_TO_MS, epoch_ms

FOOT_M = 0.3048

COLUMNS = ("ts_ms", "domain", "entity_id", "lat", "lon", "alt_m", "sog_kt", "cog_deg", "flags", "conf", "props", "provenance_id")


def _props(**values: Column) -> Column:
    every = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(every, lambda _, v: v.isNotNull())


def _finish(df: DataFrame, **columns: Column) -> DataFrame:
    types = {"ts_ms": "long", "domain": "int", "flags": "int", "conf": "int", "lat": "double", "lon": "double", "alt_m": "double", "sog_kt": "double", "cog_deg": "double"}
    return df.select(*[columns.get(c, F.col(c) if c == "provenance_id" else F.lit(None)).cast(types[c]).alias(c) if c in types else columns.get(c, F.col("provenance_id")).alias(c) for c in COLUMNS])


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _bit(test: Column, bit: int) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), bit).otherwise(0)


_ADSB = "struct<hex:string,lat:double,lon:double,alt_baro:string,alt_geom:double,gs:double,track:double,dbFlags:int,squawk:string,emergency:string,nic:int,nac_p:int,seen_pos:double,flight:string,r:string,t:string,category:string>"


def normalize_adsb(raw: DataFrame, extra_flags: int = 0) -> DataFrame:
    """Aircraft lists; ``alt_baro`` is feet or the word ground, ``now`` seconds or milliseconds."""
    j = raw.withColumn("j", F.from_json("payload", f"now double, ac array<{_ADSB}>, aircraft array<{_ADSB}>"))
    now = F.coalesce(F.col("j.now") * F.when(F.col("j.now") > 1e12, 1).otherwise(1000), F.col("fetched_ms"))
    a = j.select("provenance_id", now.alias("now"), F.explode(F.coalesce("j.ac", "j.aircraft")).alias("a")).select("provenance_id", "now", "a.*")
    a = a.where(F.col("hex").isNotNull() & _finite(F.col("lat")) & _finite(F.col("lon")))
    seen, trouble = F.coalesce("seen_pos", F.lit(0.0)), F.col("emergency").isNotNull() & (F.col("emergency") != "none") & (F.col("emergency") != "")
    flags = F.lit(extra_flags)
    for test, bit in ((F.col("alt_baro") == "ground", ON_GROUND), (F.col("dbFlags").bitwiseAND(1) == 1, MILITARY), (F.col("squawk").isin(*SQUAWKS) | trouble, EMERGENCY), ((F.col("nic") <= 4) | (F.col("nac_p") <= 5), GNSS_DEGRADED)):
        flags = flags.bitwiseOR(_bit(F.coalesce(test, F.lit(False)), bit))
    # Either of two tests may be unknown while the other holds.
    flags = flags.bitwiseOR(_bit(F.col("nic") <= 4, GNSS_DEGRADED)).bitwiseOR(_bit(F.col("nac_p") <= 5, GNSS_DEGRADED)).bitwiseOR(_bit(trouble, EMERGENCY))
    feet = F.coalesce(F.expr("try_cast(alt_baro AS double)"), "alt_geom")
    props = _props(label=F.trim(F.coalesce("flight", "r", "hex")), kind=F.coalesce("t", "category"), reg=F.col("r"), squawk=F.col("squawk"), nic=F.col("nic"), nacP=F.col("nac_p"), emergency=F.when(trouble, F.col("emergency")))
    return _finish(
        a, ts_ms=F.col("now") - seen * 1000, domain=F.lit(AIR), entity_id=F.concat(F.lit("air:"), F.lower(F.trim("hex"))), lat=F.col("lat"), lon=F.col("lon"), alt_m=feet * FOOT_M,
        sog_kt=F.col("gs"), cog_deg=F.col("track"), flags=flags, conf=F.when(seen < 15, 240).when(seen < 60, 180).otherwise(110), props=props,
    )


def normalize_opensky(raw: DataFrame) -> DataFrame:
    """State vectors as arrays by place; speeds are metres a second."""
    j = raw.withColumn("j", F.from_json("payload", "time double, states array<array<string>>"))
    s = j.select("provenance_id", F.col("j.time").alias("time"), F.explode("j.states").alias("s"))
    at = lambda i: F.get("s", F.lit(i))
    num = lambda i: at(i).cast("double")
    s = s.where((F.coalesce(at(0), F.lit("")) != "") & num(5).isNotNull() & num(6).isNotNull())
    flags = _bit(at(8) == "true", ON_GROUND).bitwiseOR(_bit(at(14).isin(*SQUAWKS), EMERGENCY))
    return _finish(
        s, ts_ms=F.coalesce(num(4), "time", F.lit(0.0)) * 1000, domain=F.lit(AIR), entity_id=F.concat(F.lit("air:"), F.lower(F.trim(at(0)))), lat=num(6), lon=num(5), alt_m=F.coalesce(num(13), num(7)),
        sog_kt=num(9) / KT_TO_MS, cog_deg=num(10), flags=flags, conf=F.lit(200), props=_props(label=F.trim(F.coalesce(at(1), at(0))), country=at(2), squawk=at(14)),
    )


def normalize_quakes(raw: DataFrame) -> DataFrame:
    feature = "struct<id:string,properties:struct<mag:double,place:string,time:long,type:string>,geometry:struct<coordinates:array<double>>>"
    q = raw.withColumn("j", F.from_json("payload", f"features array<{feature}>")).select("provenance_id", "fetched_ms", F.explode("j.features").alias("f"))
    c = lambda i: F.get("f.geometry.coordinates", F.lit(i))
    q = q.where(c(0).isNotNull() & c(1).isNotNull())
    props = _props(label=F.coalesce("f.properties.place", "f.id"), kind=F.coalesce("f.properties.type", F.lit("earthquake")), mag=F.col("f.properties.mag"), depthKm=c(2))
    return _finish(q, ts_ms=F.coalesce("f.properties.time", "fetched_ms"), domain=F.lit(GEO), entity_id=F.concat(F.lit("geo:"), F.col("f.id")), lat=c(1), lon=c(0), alt_m=c(2) * -1000, flags=F.lit(0), conf=F.lit(250), props=props)


def normalize_firms(raw: DataFrame) -> DataFrame:
    """Fire pixels as CSV text with a header, whose columns may come in any order; other bodies give no rows."""
    body = raw.where(~F.col("payload").startswith("<") & F.col("payload").contains("latitude"))
    lines = body.withColumn("lines", F.split(F.trim("payload"), r"\r?\n")).withColumn("names", F.transform(F.split(F.get("lines", F.lit(0)), ","), lambda x: F.trim(x)))
    rows = lines.select("provenance_id", "fetched_ms", "names", F.explode(F.slice("lines", 2, 2_000_000_000)).alias("line")).withColumn("c", F.split("line", ","))
    of = lambda name: F.trim(F.get("c", F.array_position("names", name).cast("int") - 1))
    rows = rows.select("provenance_id", "fetched_ms", *[of(n).alias(n) for n in ("latitude", "longitude", "acq_date", "acq_time", "frp", "confidence", "bright_ti4", "daynight")])
    d = lambda name: F.expr(f"try_cast({name} AS double)")
    rows = rows.where(_finite(d("latitude")) & _finite(d("longitude")))
    hhmm = F.lpad(F.coalesce("acq_time", F.lit("0")), 4, "0")
    ts = F.expr("try_to_timestamp(concat(acq_date, ' ', lpad(coalesce(acq_time, '0'), 4, '0')), 'yyyy-MM-dd HHmm')")
    frp = F.coalesce(d("frp"), F.lit(0.0))
    four = lambda name: F.format_string("%.4f", d(name))
    return _finish(
        rows, ts_ms=F.coalesce(epoch_ms(ts), "fetched_ms"), domain=F.lit(THERMAL), entity_id=F.concat(F.lit("thermal:"), four("latitude"), F.lit(","), four("longitude"), F.lit(","), F.col("acq_date"), hhmm),
        lat=d("latitude"), lon=d("longitude"), flags=F.lit(0), conf=F.when(F.col("confidence") == "h", 240).when(F.col("confidence") == "n", 170).otherwise(110),
        props=_props(label=F.concat(F.lit("FRP "), F.format_string("%.1f", frp), F.lit(" MW")), kind=F.lit("thermal_anomaly"), frp=frp, brightnessK=d("bright_ti4"), dayNight=F.col("daynight")),
    )


def read_tle(spark: SparkSession, path: str, group: str) -> DataFrame:
    """(norad_id, name, line1, line2, grp) of element files: three lines a target; a bad three is left out, the count goes on.
    Files are read whole, as lines belong together only within one."""
    text = spark.read.text(path, wholetext=True)
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.rtrim(x)), lambda x: x != "")
    each = text.select(lines.alias("l")).select("l", F.explode(F.sequence(F.lit(0), F.size("l") - 1, F.lit(3))).alias("i")).where(F.size("l") > 0)
    each = each.select(F.trim(F.get("l", F.col("i"))).alias("name"), F.get("l", F.col("i") + 1).alias("line1"), F.get("l", F.col("i") + 2).alias("line2"))
    good = each.where(F.col("line1").startswith("1 ") & F.col("line2").startswith("2 "))
    return good.select(F.trim(F.substring("line1", 3, 5)).cast("int").alias("norad_id"), "name", "line1", "line2", F.lit(group).alias("grp")).where("norad_id is not null")


def latest_by(df: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), at).alias("o")).select(key, "o.*")


def purge_group(elements: DataFrame, group: str) -> DataFrame:
    return elements.where(~F.coalesce(F.col("grp") == group, F.lit(False)))


def normalize_articles(raw: DataFrame) -> DataFrame:
    a = raw.select("provenance_id", F.explode(F.from_json("payload", "articles array<struct<url:string,title:string,domain:string,seendate:string>>")["articles"]).alias("a")).select("provenance_id", "a.*")
    ts = F.expr("try_to_timestamp(seendate, \"yyyyMMdd'T'HHmmss'Z'\")")
    return a.where(F.col("url").isNotNull()).select(epoch_ms(ts).alias("ts_ms"), "url", "title", "domain", "provenance_id")


def normalize_ais(positions: DataFrame, static: DataFrame) -> DataFrame:
    """(mmsi, ts_ms, lat, lon, sog, cog, provenance_id) with the last (mmsi, ts_ms, name, ship_type) up to then.
    102.3 knots, 360 degrees and latitude 91 or longitude 181 mean not available."""
    p = positions.where((F.col("lat") < 91) & (F.col("lat") >= -90) & (F.col("lon") < 181) & (F.col("lon") >= -180))
    p = p.select("mmsi", "ts_ms", F.lit(1).alias("ask"), "lat", "lon", F.when(F.col("sog") < 102.3, F.col("sog")).alias("sog"), F.when(F.col("cog") < 360, F.col("cog")).alias("cog"), "provenance_id")
    both = p.unionByName(static.select("mmsi", "ts_ms", F.lit(0).alias("ask"), F.struct("name", "ship_type").alias("info")), allowMissingColumns=True)
    w = Window.partitionBy("mmsi").orderBy("ts_ms", "ask").rowsBetween(Window.unboundedPreceding, 0)
    m = both.withColumn("info", F.last("info", ignorenulls=True).over(w)).where("ask = 1")
    mmsi = F.col("mmsi").cast("string")
    return _finish(m, ts_ms=F.col("ts_ms"), domain=F.lit(SEA), entity_id=F.concat(F.lit("sea:"), mmsi), lat=F.col("lat"), lon=F.col("lon"), sog_kt=F.col("sog"), cog_deg=F.col("cog"), flags=F.lit(0), conf=F.lit(200), props=_props(label=F.coalesce("info.name", mmsi), kind=F.col("info.ship_type"), mmsi=mmsi))


def normalize_cameras(raw: DataFrame) -> DataFrame:
    """(id, label, lat, lon, image) of places with a picture; a film's still is its name with .jpg."""
    place = "array<struct<id:string,commonName:string,lat:double,lon:double,additionalProperties:array<struct<key:string,value:string>>>>"
    p = raw.select(F.explode(F.from_json("payload", place)).alias("p")).select("p.*")
    image = F.get(F.filter("additionalProperties", lambda x: x["key"].isin("imageUrl", "videoUrl")), F.lit(0))["value"]
    p = p.withColumn("image", F.regexp_replace(image, r"\.mp4$", ".jpg")).where((F.coalesce("image", F.lit("")) != "") & _finite(F.col("lat")))
    return p.select(F.concat(F.lit("tfl:"), "id").alias("id"), F.regexp_replace("commonName", r"(?i)^JamCam\s*", "").alias("label"), "lat", "lon", "image")


#: Normalisers by source key.
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {"adsb_lol": normalize_adsb, "opensky": normalize_opensky, "usgs_quake": normalize_quakes, "nasa_firms": normalize_firms, "gdelt": normalize_articles}
