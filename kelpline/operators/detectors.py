"""Detection rules over observations.  Each returns rows of one schema (see ``finish``).

A tick is one evaluation: the ``tick_ms`` column of a batch, or a tumbling stretch of event time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.codes import AIR, EXCLUDED_KIND, EXCLUDED_NAME, GEO, GNSS_DEGRADED, MILITARY, ON_GROUND, SEA, THERMAL, has, squawk_severity
from kelpline.functions.geo import bearing_deg, cell_center, geohash, haversine_m, js_round, quantize
from kelpline.functions.kinematics import evaluate_reacquisition, profile_for, reachable_set
from kelpline.operators.state import after_known, deltas, first_watchbox, newest

MIN, HOUR = 60_000, 3_600_000

FIELDS = ("rule", "severity", "ts_start", "ts_end", "lat", "lon", "geohash5", "entity_ids", "title", "evidence", "state", "hash", "dedup_key")


def capped(x: Column) -> Column:
    return F.least(F.lit(100), js_round(x)).cast("int")


def finish(df: DataFrame, rule, severity: Column, ts_start: Column, ts_end: Column, entity_ids: Column, title: Column, evidence: dict[str, Column], **more: Column) -> DataFrame:
    """The detection schema: evidence is JSON with its keys in order; ``hash`` is over all that was found, ``dedup_key``
    over rule, start, place and entities, so that a lasting condition is one detection."""
    rule = rule if isinstance(rule, Column) else F.lit(rule)
    proof = F.struct(*[evidence[k].alias(k) for k in sorted(evidence)])
    out = df.select(
        rule.alias("rule"), severity.alias("severity"), ts_start.cast("long").alias("ts_start"), ts_end.cast("long").alias("ts_end"), "lat", "lon",
        geohash("lat", "lon", 5).alias("geohash5"), F.array_sort(entity_ids).alias("entity_ids"), title.alias("title"), F.to_json(proof).alias("evidence"), proof.alias("proof_"), F.lit("open").alias("state"),
        *[v.alias(k) for k, v in more.items()],
    )
    # Canonical JSON: keys in order at each level, places to six digits.
    six = lambda c: F.col(c).cast("decimal(10,6)").alias(c)
    facts = F.to_json(F.struct(F.col("entity_ids").alias("entityIds"), F.col("proof_").alias("evidence"), six("lat"), six("lon"), "rule", F.col("ts_start").alias("tsStart")))
    key = F.to_json(F.struct(F.col("entity_ids").alias("entityIds"), "geohash5", "rule", F.col("ts_start").alias("tsStart")))
    return out.withColumns({"hash": F.sha2(facts, 256), "dedup_key": F.sha2(key, 256)}).drop("proof_")


def going_dark(obs: DataFrame, now_ms: int, boxes: DataFrame, open_gaps: DataFrame | None = None, default_s: int = 3600, max_age_s: int = 36 * 3600) -> DataFrame:
    """Entities that have fallen silent for longer than their place allows, and have no gap open yet."""
    last = newest(obs.where(F.col("ts_ms") <= now_ms), "entity_id")
    return fallen_silent(last, now_ms, boxes, open_gaps, default_s, max_age_s)


def fallen_silent(last: DataFrame, now_ms: int, boxes: DataFrame, open_gaps: DataFrame | None = None, default_s: int = 3600, max_age_s: int | None = None) -> DataFrame:
    """The same from each entity's last fix; without ``max_age_s`` however long it has been silent."""
    age = (F.lit(now_ms) - F.col("ts_ms")) / 1000
    last = first_watchbox(last.where(F.col("domain").isin(SEA, AIR) & (age > default_s / 2) & (F.lit(True) if max_age_s is None else age < max_age_s)), boxes)
    moored = (F.col("domain") == SEA) & (F.coalesce("sog_kt", F.lit(0.0)) < 0.4)
    landed = (F.col("domain") == AIR) & has("flags", ON_GROUND)
    out = last.where((age >= F.coalesce("dark_threshold_s", F.lit(default_s))) & ~moored & ~landed)
    if open_gaps is not None:
        out = out.join(open_gaps.select("entity_id"), "entity_id", "left_anti")
    return out.select("entity_id", "domain", F.col("ts_ms").alias("went_dark_at"), "lat", "lon", "sog_kt", "cog_deg", "box_key")


def gaps(obs: DataFrame, boxes: DataFrame, default_s: int = 3600, known: DataFrame | None = None) -> DataFrame:
    """Closed gaps: a fix, the one before it, and a silence between that was long enough for the place where it began.

    ``known`` has each entity's last fix before ``obs`` (see ``state.last_known``), however long ago it was."""
    moving = obs.where(F.col("domain").isin(SEA, AIR))
    d = deltas(moving if known is None else after_known(moving, known))
    d = (d if known is None else d.where(~F.col("known_"))).where(F.col("dt_ms") >= 300_000)
    d = first_watchbox(d, boxes, "prev_lat", "prev_lon")
    moored = (F.col("domain") == SEA) & (F.coalesce("prev_sog_kt", F.lit(0.0)) < 0.4)
    landed = (F.col("domain") == AIR) & has("prev_flags", ON_GROUND)
    return judged(d.where((F.col("dt_ms") >= F.coalesce("dark_threshold_s", F.lit(default_s)) * 1000) & ~moored & ~landed))


def judged(d: DataFrame) -> DataFrame:
    """Gaps with what their class could have reached, and the verdict ``v``; rows for themselves, so that streams can have it."""
    leg = ("prev_lat", "prev_lon", "lat", "lon")
    d = d.withColumns({"profile": profile_for("domain", "kind"), "dist_m": haversine_m(*leg), "bearing": bearing_deg(*leg), "gap_s": F.col("dt_ms") / 1000})
    d = d.withColumn("reach", reachable_set("prev_sog_kt", "prev_cog_deg", "gap_s", "profile"))
    return d.withColumn("v", evaluate_reacquisition("prev_lat", "prev_lon", "prev_sog_kt", "prev_cog_deg", "lat", "lon", "gap_s", "profile", "dist_m", "bearing", "reach"))


def reacquisition(obs: DataFrame, boxes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Targets that reappear where their class could not have got to, or off the course it could have held."""
    g = gaps(obs, boxes, known=known).where("v.verdict <> 'CONSISTENT'")
    severity = capped(F.col("v.score") * F.when(F.col("box_key").isNotNull(), 1.15).otherwise(1.0))
    g = g.withColumn("sev", severity).where("sev >= 25")
    rule = F.when(F.col("v.verdict") == "IMPOSSIBLE_TRANSIT", "SPOOF_DISCONTINUITY").otherwise("DARK_VESSEL")
    proof = {"verdict": F.col("v.verdict"), "gapSeconds": js_round(F.col("dt_ms") / 1000), "distM": js_round(F.col("v.dist_m")), "impliedKt": F.round("v.implied_kt", 1), "profile": F.col("profile.name"), "watchbox": F.col("box_key")}
    title = F.concat(F.col("entity_id"), F.lit(" reappeared: "), F.lower(F.replace(F.col("v.verdict"), F.lit("_"), F.lit(" "))))
    return finish(g, rule, F.col("sev"), F.col("prev_ts_ms"), F.col("ts_ms"), F.array("entity_id"), title, proof)


def baseline_samples(obs: DataFrame, precision: int, every_ms: int = HOUR) -> DataFrame:
    """(cell, sample_ms, n): airborne fixes of each cell and clock hour; the live count uses the same filter."""
    air = obs.where((F.col("domain") == AIR) & ~has("flags", ON_GROUND))
    return air.groupBy(geohash("lat", "lon", precision).alias("cell"), quantize("ts_ms", every_ms).alias("sample_ms")).agg(F.count(F.lit(1)).alias("n"))


def baseline(samples: DataFrame, *season: str, least: int = 8) -> DataFrame:
    """(cell, season..., samples, mean, sd, m2) of keys with at least ``least`` samples."""
    n, mean = F.col("samples"), F.col("mean")
    out = samples.groupBy("cell", *season).agg(F.count(F.lit(1)).alias("samples"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"))
    return out.where(n >= least).withColumns({"m2": F.col("sd") * F.col("sd") * (n - 1), "mean": mean})


def merge_baselines(a: DataFrame, b: DataFrame, *season: str) -> DataFrame:
    """One baseline from two over different samples, by pairwise moments."""
    keys = ["cell", *season]
    both = a.select(*keys, "samples", "mean", "m2").unionByName(b.select(*keys, "samples", "mean", "m2"))
    n = F.sum("samples")
    mean = F.sum(F.col("samples") * F.col("mean")) / n
    square = F.sum(F.col("m2") + F.col("samples") * F.col("mean") * F.col("mean"))
    out = both.groupBy(*keys).agg(n.alias("samples"), mean.alias("mean"), (square - n * mean * mean).alias("m2"))
    return out.withColumn("sd", F.sqrt(F.col("m2") / (F.col("samples") - 1)))


def airspace_void(obs: DataFrame, base: DataFrame, tick_ms: int, boxes: DataFrame, precision: int = 4, season: Callable[[Column], Column] | None = None, dedupe: bool = True, ticks: DataFrame | None = None) -> DataFrame:
    """Cells that usually hold traffic and, at a tick, don't.  Driven from the baseline: what isn't seen has no row.

    ``ticks`` (tick_ms) are those to judge, by default all from the first to the last with a fix in the air; a run over one
    batch gives its one tick.  ``base`` may have a column ``season``, which ``season`` gives for a tick.  Without ``dedupe`` fixes count, not aircraft.
    """
    air = obs.where((F.col("domain") == AIR) & ~has("flags", ON_GROUND)).withColumns({"cell": geohash("lat", "lon", precision), "tick_ms": quantize("ts_ms", tick_ms)})
    if dedupe:
        air = newest(air, "entity_id", "tick_ms")
    live = air.groupBy("cell", "tick_ms").agg(F.count(F.lit(1)).alias("observed"), F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"))
    # Ticks are told by the caller, or run from the first fix to the last; cells of other seasons meet none of them.
    if ticks is None:
        span = obs.agg(quantize(F.min("ts_ms"), tick_ms).alias("a"), quantize(F.max("ts_ms"), tick_ms).alias("b")).where("a is not null")
        ticks = span.select(F.explode(F.sequence("a", "b", F.lit(tick_ms).cast("long"))).alias("tick_ms"))
    cells = base.where("mean >= 8")
    if season is None:
        # One row of ticks, opened up beside each cell: absence has no row that could be joined on.
        grid = cells.join(F.broadcast(ticks.agg(F.collect_set("tick_ms").alias("at"))), F.lit(True)).select("cell", "samples", "mean", "sd", F.explode("at").alias("tick_ms"))
    else:
        grid = cells.join(ticks.select("tick_ms").distinct().withColumn("season", season(F.col("tick_ms"))), "season")
    return voids(live, grid, boxes)


def voids(live: DataFrame, grid: DataFrame, boxes: DataFrame) -> DataFrame:
    """Detections for (cell, tick_ms, samples, mean, sd) of which too little was seen: ``live`` has (cell, tick_ms, observed, c_lat,
    c_lon) where anything was."""
    d = grid.join(live, ["cell", "tick_ms"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    d = d.withColumns({"z": (F.col("observed") - F.col("mean")) / F.greatest(F.lit(1.0), "sd"), "drop": 1 - F.col("observed") / F.col("mean")}).where("z <= -3 and drop >= 0.6")
    center = cell_center("cell")
    d = d.withColumns({"lat": F.coalesce("c_lat", center["lat"]), "lon": F.coalesce("c_lon", center["lon"])})
    d = first_watchbox(d, boxes)
    title = F.concat(F.lit("Airspace cleared over "), F.coalesce("box_label", "cell"))
    proof = {"cell": F.col("cell"), "observed": F.col("observed"), "baselineMean": F.round("mean", 2), "baselineSd": F.round("sd", 2), "zScore": F.round("z", 2), "dropFraction": F.round("drop", 3)}
    return finish(d, "AIRSPACE_VOID", capped(40 + F.abs("z") * 8 + F.col("drop") * 25), quantize("tick_ms", 15 * MIN), F.lit(None), F.array().cast("array<string>"), title, proof)


def gnss_bloom(obs: DataFrame, tick_ms: int, boxes: DataFrame, precision: int = 4, dedupe: bool = True) -> DataFrame:
    """Cells in which many aircraft at once report poor navigation integrity."""
    air = obs.where((F.col("domain") == AIR) & ~has("flags", ON_GROUND)).withColumns({"cell": geohash("lat", "lon", precision), "tick_ms": quantize("ts_ms", tick_ms)})
    if dedupe:
        air = newest(air, "entity_id", "tick_ms")
    bad = has("flags", GNSS_DEGRADED)
    g = air.groupBy("cell", "tick_ms").agg(
        F.count_if(bad).alias("degraded"), F.count(F.lit(1)).alias("total"), F.avg(F.when(bad, F.col("lat"))).alias("lat"), F.avg(F.when(bad, F.col("lon"))).alias("lon"),
        F.array_sort(F.collect_set(F.when(bad, F.col("entity_id")))).alias("ids"),
    )
    g = g.withColumn("rate", F.col("degraded") / F.col("total")).where("degraded >= 5 and total >= 8 and rate >= 0.35")
    g = first_watchbox(g, boxes)
    title = F.concat(F.lit("Navigation interference over "), F.coalesce("box_label", "cell"))
    proof = {"cell": F.col("cell"), "degraded": F.col("degraded"), "total": F.col("total"), "rate": F.round("rate", 3)}
    return finish(g, "GNSS_BLOOM", capped(35 + F.col("rate") * 45 + F.least(F.lit(20), "degraded")), quantize("tick_ms", 10 * MIN), F.lit(None), F.col("ids"), title, proof)


def squawk_emergency(obs: DataFrame, tick_ms: int = 30_000) -> DataFrame:
    """Emergency codes, the first of an aircraft in a tick."""
    hits = obs.where((F.col("domain") == AIR) & squawk_severity("squawk").isNotNull()).withColumn("tick_ms", quantize("ts_ms", tick_ms))
    first = hits.groupBy("entity_id", "tick_ms").agg(F.min_by(F.struct("ts_ms", "lat", "lon", "squawk", "label"), F.struct("ts_ms", "obs_id")).alias("o")).select("entity_id", "o.*")
    title = F.concat(F.col("label"), F.lit(" squawks "), F.col("squawk"))
    return finish(first, "SQUAWK_EMERGENCY", squawk_severity("squawk").cast("int"), quantize("ts_ms", HOUR), F.col("ts_ms"), F.array("entity_id"), title, {"squawk": F.col("squawk")})


def thermal_anomaly(obs: DataFrame, boxes: DataFrame) -> DataFrame:
    hot = first_watchbox(obs.where((F.col("domain") == THERMAL) & (F.col("frp") >= 40)), boxes)
    severity = capped(28 + F.log10("frp") * 22 + F.when(F.col("box_key").isNotNull(), 15).otherwise(0))
    return finish(hot, "THERMAL_ANOMALY", severity, F.col("ts_ms"), F.lit(None), F.array("entity_id"), F.concat(F.lit("Hot spot, MW "), F.round("frp", 1).cast("string")), {"frp": F.round("frp", 3), "watchbox": F.col("box_key")})


def seismic_shallow(obs: DataFrame, boxes: DataFrame) -> DataFrame:
    mag, depth = F.coalesce("mag", F.lit(0.0)), F.coalesce("depth_km", F.lit(999.0))
    q = first_watchbox(obs.where((F.col("domain") == GEO) & (mag >= 3.2) & (depth <= 6)), boxes)
    proof = {"mag": F.round("mag", 3), "depthKm": F.round("depth_km", 3), "watchbox": F.col("box_key")}
    return finish(q, "SEISMIC_SHALLOW", capped(25 + mag * 9 + (6 - depth) * 3), F.col("ts_ms"), F.lit(None), F.array("entity_id"), F.concat(F.lit("Shallow event, magnitude "), F.round("mag", 1).cast("string")), proof)


def path_stats(fixes: DataFrame, *keys: str) -> DataFrame:
    """(keys..., fixes, path_m, turn_deg, net_m, duration_ms) of tracks."""
    w = Window.partitionBy(*keys).orderBy("ts_ms", "obs_id")
    leg = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")
    d = fixes.withColumn("leg", leg)
    order, pos = F.struct("ts_ms", "obs_id"), F.struct("lat", "lon")
    out = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("fixes"), F.coalesce(F.sum("leg"), F.lit(0.0)).alias("path_m"), F.min_by(pos, order).alias("a"), F.max_by(pos, order).alias("b"), (F.max("ts_ms") - F.min("ts_ms")).alias("duration_ms"))
    return out.withColumn("net_m", haversine_m("a.lat", "a.lon", "b.lat", "b.lon"))


def cell_pairs(points: DataFrame, neighbours: bool = False, precision: int = 5) -> DataFrame:
    """Pairs (a, b) of a tick's points in one cell, or, with ``neighbours``, in cells that touch; a's entity comes first."""
    here = points.withColumn("cell", geohash("lat", "lon", precision))
    n_lon, n_lat = (5 * precision + 1) // 2, 5 * precision // 2
    dx, dy = 360.0 / (1 << n_lon), 180.0 / (1 << n_lat)
    around = F.array(*[geohash(F.col("lat") + i * dy, (F.col("lon") + j * dx + 540) % 360 - 180, precision) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = here.withColumn("near", F.explode(F.array_distinct(around))) if neighbours else here.withColumn("near", F.col("cell"))
    a = a.select(F.col("tick_ms"), F.col("near"), F.struct(*points.columns).alias("a"))
    b = here.select(F.col("tick_ms").alias("t"), "cell", F.struct(*points.columns).alias("b"))
    return a.join(b, (F.col("tick_ms") == F.col("t")) & (F.col("near") == F.col("cell")) & (F.col("a.entity_id") < F.col("b.entity_id"))).select("tick_ms", "a", "b")


def fixes_before(archive: DataFrame, who: DataFrame, within_ms: int) -> DataFrame:
    """Fixes of each (entity_id, tick_ms) from ``within_ms`` before the tick up to it.  Stretches of that length are part of
    the key, so a fix meets the one or two stretches of ticks that reach it, however long the archive is."""
    asked = who.withColumn("stretch", F.explode(F.array(F.floor(F.col("tick_ms") / F.lit(within_ms)), F.floor(F.col("tick_ms") / F.lit(within_ms)) - 1)))
    f = archive.select("entity_id", "ts_ms", "obs_id", "lat", "lon", F.floor(F.col("ts_ms") / F.lit(within_ms)).alias("stretch"))
    return f.join(asked, ["entity_id", "stretch"]).drop("stretch").where((F.col("ts_ms") >= F.col("tick_ms") - within_ms) & (F.col("ts_ms") <= F.col("tick_ms")))


def rendezvous(batch: DataFrame, archive: DataFrame, boxes: DataFrame, neighbours: bool = False, most_slow: int = 6) -> DataFrame:
    """Two slow hulls side by side, one of them from afar, together for a while, not at an anchorage.

    ``batch`` has one fix an entity and tick_ms; tracks are read from ``archive`` for all pairs at once.
    """
    slow = batch.where((F.col("domain") == SEA) & (F.coalesce("sog_kt", F.lit(99.0)) < 1.2)).withColumn("cell5", geohash("lat", "lon", 5))
    busy = slow.groupBy("tick_ms", "cell5").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < most_slow).drop("n")
    fit = ~F.coalesce("kind", F.lit("")).rlike(EXCLUDED_KIND) & ~F.coalesce("label", F.lit("")).rlike(EXCLUDED_NAME)
    ships = slow.where(fit).join(busy, ["tick_ms", "cell5"]).select("tick_ms", "entity_id", "ts_ms", "lat", "lon", "kind", "label")
    p = cell_pairs(ships, neighbours).withColumn("sep", haversine_m("a.lat", "a.lon", "b.lat", "b.lon"))
    same = (F.coalesce("a.label", F.lit("")) != "") & (F.col("a.label") == F.col("b.label"))
    p = p.where((F.col("sep") >= 25) & (F.col("sep") <= 400) & ~same)
    who = p.select("tick_ms", F.explode(F.array("a.entity_id", "b.entity_id")).alias("entity_id")).distinct()
    fixes = fixes_before(archive, who, 6 * HOUR).where(F.col("ts_ms") > F.col("tick_ms") - 6 * HOUR)
    stats = path_stats(fixes, "entity_id", "tick_ms").where("fixes >= 4").select("entity_id", "tick_ms", "path_m")
    then = fixes.where(F.col("ts_ms") <= F.col("tick_ms") - 25 * MIN).groupBy("entity_id", "tick_ms").agg(F.max_by(F.struct("ts_ms", "lat", "lon"), F.struct("ts_ms", "obs_id")).alias("at"))
    hist = stats.join(then, ["entity_id", "tick_ms"])
    of = lambda s: hist.select("tick_ms", F.col("entity_id").alias(f"{s}_id"), F.col("path_m").alias(f"{s}_path"), F.col("at").alias(f"{s}_at"))
    p = p.withColumns({"a_id": F.col("a.entity_id"), "b_id": F.col("b.entity_id")}).join(of("a"), ["tick_ms", "a_id"]).join(of("b"), ["tick_ms", "b_id"])
    p = p.where((F.col("a_path") >= 3000) | (F.col("b_path") >= 3000)).where(haversine_m("a_at.lat", "a_at.lon", "b_at.lat", "b_at.lon") <= 900)
    p = first_watchbox(p.withColumns({"p_lat": F.col("a.lat"), "p_lon": F.col("a.lon")}), boxes, "p_lat", "p_lon")
    since = F.greatest("a_at.ts_ms", "b_at.ts_ms")
    held = js_round((F.col("tick_ms") - since) / MIN)
    both = lambda words: F.coalesce("a.kind", F.lit("")).rlike(words) & F.coalesce("b.kind", F.lit("")).rlike(words)
    extra = F.when(both("(?i)tanker"), 30).when(both("(?i)tanker|cargo|bulk"), 18).otherwise(0) + F.when(F.col("box_key").isNotNull(), 10).otherwise(0)
    severity = capped(28 + extra + F.least(F.lit(14.0), (400 - F.col("sep")) / 28) + F.least(F.lit(14.0), held / 6))
    p = p.withColumns({"sev": severity, "lat": (F.col("a.lat") + F.col("b.lat")) / 2, "lon": (F.col("a.lon") + F.col("b.lon")) / 2}).where("sev >= 45")
    title = F.concat(F.col("a.label"), F.lit(" and "), F.col("b.label"), F.lit(" alongside"))
    return finish(p, "RENDEZVOUS", F.col("sev"), quantize(since, 30 * MIN), F.lit(None), F.array("a_id", "b_id"), title, {"separationM": js_round(F.col("sep")), "heldMin": held, "watchbox": F.col("box_key")})


def loiter(batch: DataFrame, archive: DataFrame, boxes: DataFrame) -> DataFrame:
    """Aircraft that fly far and get nowhere."""
    ft = F.col("alt_m") * 3.28084
    air = first_watchbox(batch.where((F.col("domain") == AIR) & ~has("flags", ON_GROUND)), boxes)
    mil = has("flags", MILITARY)
    air = air.where((mil & (F.col("sog_kt") >= 60)) | (~mil & (F.col("sog_kt") >= 150) & ft.between(18_000, 55_000) & F.col("box_key").isNotNull()))
    air = air.select("entity_id", "tick_ms", "lat", "lon", mil.alias("mil"), "box_key", "label")
    fixes = fixes_before(archive, air.select("entity_id", "tick_ms"), 45 * MIN)
    t = path_stats(fixes, "entity_id", "tick_ms").where((F.col("fixes") >= 12) & (F.col("path_m") >= 150_000) & (F.col("duration_ms") >= 25 * MIN))
    t = t.withColumn("straight", F.col("net_m") / F.col("path_m")).where("straight <= 0.25")
    d = air.join(t.select("entity_id", "tick_ms", "fixes", "path_m", "straight", "duration_ms"), ["entity_id", "tick_ms"])
    d = d.withColumn("alike", F.count(F.lit(1)).over(Window.partitionBy("tick_ms", geohash("lat", "lon", 4)))).where("mil or alike < 3")
    severity = capped(35 + (1 - F.col("straight")) * 40 + F.when(F.col("mil"), 18).otherwise(0))
    proof = {"pathKm": F.round(F.col("path_m") / 1000, 1), "straightness": F.round("straight", 3), "fixes": F.col("fixes"), "military": F.col("mil"), "watchbox": F.col("box_key")}
    return finish(d, "LOITER", severity, quantize(F.col("tick_ms") - F.col("duration_ms"), 30 * MIN), F.col("tick_ms"), F.array("entity_id"), F.concat(F.col("entity_id"), F.lit(" circles")), proof)


#: Detections of a rule that one tick keeps.  Fixed values.
CAPS = {"RENDEZVOUS": 6, "AIRSPACE_VOID": 8, "GNSS_BLOOM": 8, "LOITER": 10, "SQUAWK_EMERGENCY": 10, "THERMAL_ANOMALY": 15, "SEISMIC_SHALLOW": 15, "REACQUISITION": 20}


def rule_group() -> Column:
    return F.when(F.col("rule").isin("SPOOF_DISCONTINUITY", "DARK_VESSEL"), "REACQUISITION").otherwise(F.col("rule"))


def breaker(detections: DataFrame, tick_ms: int, caps: dict[str, int] = CAPS, default: int = 12) -> tuple[DataFrame, DataFrame]:
    """The strongest detections of each rule group and tick, and a report (rule_group, tick_ms, produced, kept)."""
    d = detections.withColumns({"rule_group": rule_group(), "tick_ms": quantize(F.coalesce("ts_end", "ts_start"), tick_ms)})
    cap = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("rule_group")), F.lit(default))
    w = Window.partitionBy("rule_group", "tick_ms").orderBy(F.col("severity").desc(), "ts_start", "geohash5", F.concat_ws(",", "entity_ids"), "hash")
    # The greatest cap is a number, by which Spark thins each group out before it is dealt; then each rule's own.
    kept = d.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max([default, *caps.values()])).where(F.col("rn") <= cap).drop("rn")
    report = d.groupBy("rule_group", "tick_ms").agg(F.count(F.lit(1)).alias("produced"), F.first(cap).alias("cap"))
    return kept, report.select("rule_group", "tick_ms", "produced", F.least("produced", "cap").alias("kept"))


def append_new(found: DataFrame, existing: DataFrame | None = None, key: str = "dedup_key") -> DataFrame:
    """Detections that aren't there yet, one a key: the strongest, then by hash."""
    w = Window.partitionBy(key).orderBy(F.col("severity").desc(), "hash")
    one = found.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return one if existing is None else one.join(existing.select(key), key, "left_anti")


#: Rules that a batch alone feeds, by name; each takes (obs, boxes) and returns detections.
REGISTRY: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "reacquisition": reacquisition, "squawk": lambda obs, boxes: squawk_emergency(obs), "thermal": thermal_anomaly, "seismic": seismic_shallow,
    "gnss": lambda obs, boxes: gnss_bloom(obs, 30_000, boxes),
}


def checked(name: str, found: DataFrame) -> DataFrame:
    """A rule's detections in the order of the schema; a rule that doesn't return it is refused by name."""
    if missing := [c for c in FIELDS if c not in found.columns]:
        raise ValueError(f"rule {name} lacks {missing}")
    return found.select(*FIELDS)


def run_detectors(obs: DataFrame, boxes: DataFrame, rules: dict | None = None) -> DataFrame:
    """All detections of the rules that a batch alone feeds, one a key; ``engine.run_engine`` runs all nine."""
    out = None
    for name, rule in (rules or REGISTRY).items():
        found = checked(name, rule(obs, boxes))
        out = found if out is None else out.unionByName(found)
    return append_new(out)
