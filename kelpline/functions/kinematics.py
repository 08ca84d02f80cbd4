"""What a target can do in a given time: classes of motion, reachable sets and verdicts on reappearance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelpline.functions.geo import KT_TO_MS, angle_delta, bearing_deg, clamp, col, destination, haversine_m, js_round

SEA, AIR = 2, 1
#: name, greatest knots, drift of the course in degrees an hour, its uncertainty, share of the speed that is kept at least
PROFILES = {
    "tanker": (18.0, 18.0, 5.0, 0.0), "cargo": (24.0, 22.0, 6.0, 0.0), "fast": (45.0, 60.0, 12.0, 0.0), "vessel": (30.0, 28.0, 8.0, 0.0),
    "prop": (300.0, 300.0, 6.0, 0.30), "jet": (620.0, 240.0, 4.0, 0.35), "aircraft": (560.0, 260.0, 5.0, 0.30),
}


def profile_for(domain, kind) -> Column:
    """struct(name, max_kt, drift, eps, decay) by the first class whose word the kind contains."""
    domain, kind = col(domain), F.lower(F.coalesce(col(kind), F.lit("")))
    has = lambda *words: kind.rlike("|".join(words))
    sea = F.when(has("tanker"), "tanker").when(has("cargo", "bulk"), "cargo").when(has("high speed", "craft", "pilot"), "fast").otherwise("vessel")
    air = F.when(has("prop"), "prop").when(has("jet"), "jet").otherwise("aircraft")
    name = F.when(domain == SEA, sea).when(domain == AIR, air).otherwise("vessel")
    value = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in PROFILES.items() for x in (k, v[i])]), name)
    return F.struct(name.alias("name"), value(0).alias("max_kt"), value(1).alias("drift"), value(2).alias("eps"), value(3).alias("decay"))


def reachable_set(sog_kt, cog_deg, elapsed_s, profile) -> Column:
    """struct(r_max_m, r_min_m, half_deg, center_deg, omni): where a target can be after a silence."""
    p, s = col(profile), F.greatest(F.lit(0.0), col(elapsed_s).cast("double"))
    half = F.least(F.lit(180.0), p["eps"] + p["drift"] * (s / 3600))
    cog = col(cog_deg)
    return F.struct(
        (p["max_kt"] * KT_TO_MS * s).alias("r_max_m"), (F.coalesce(col(sog_kt), F.lit(0.0)) * p["decay"] * KT_TO_MS * s).alias("r_min_m"),
        half.alias("half_deg"), F.coalesce(cog, F.lit(0.0)).alias("center_deg"), ((half >= 180) | cog.isNull()).alias("omni"),
    )


def evaluate_reacquisition(lat0, lon0, sog0, cog0, lat1, lon1, gap_s, profile, dist=None, bearing=None, reach=None) -> Column:
    """struct(verdict, score, dist_m, bearing, implied_kt, range_excess_m, bearing_excess_deg, shortfall_m).

    Tests in order: too far for the class's speed, off the course that it could have turned to, not as far as it
    had to fly; silence of up to six hours counts from three quarters to all of a score.  Columns that hold the
    distance, bearing and reachable set already keep the expression small.
    """
    gap, p = col(gap_s).cast("double"), col(profile)
    dist = haversine_m(lat0, lon0, lat1, lon1) if dist is None else col(dist)
    bearing = bearing_deg(lat0, lon0, lat1, lon1) if bearing is None else col(bearing)
    r = reachable_set(sog0, cog0, gap, p) if reach is None else col(reach)
    implied = F.when(gap > 0, dist / KT_TO_MS / gap).otherwise(0.0)
    excess = F.greatest(F.lit(0.0), dist - r["r_max_m"])
    off = F.when(r["omni"], 0.0).otherwise(F.greatest(F.lit(0.0), F.abs(angle_delta(cog0, bearing)) - r["half_deg"]))
    short = F.greatest(F.lit(0.0), r["r_min_m"] - dist)
    verdict = F.when(excess > 0, "IMPOSSIBLE_TRANSIT").when(off > 0, "COURSE_DISCONTINUITY").when(short > 0, "IMPLAUSIBLE_LOITER").otherwise("CONSISTENT")
    raw = F.when(excess > 0, clamp(0.55 + 0.3 * F.log2(F.greatest(F.lit(1.001), implied / p["max_kt"])), 0.0, 1.0) * 100)
    raw = raw.when(off > 0, clamp(0.25 + off / 240, 0.0, 1.0) * 100).when(short > 0, clamp(0.2 + short / F.greatest(F.lit(1.0), r["r_min_m"]) / 2, 0.0, 1.0) * 100).otherwise(0.0)
    score = js_round(F.least(F.lit(100.0), raw * (0.75 + 0.25 * F.least(F.lit(1.0), gap / 21600))))
    return F.struct(
        verdict.alias("verdict"), score.alias("score"), dist.alias("dist_m"), bearing.alias("bearing"), implied.alias("implied_kt"),
        excess.alias("range_excess_m"), off.alias("bearing_excess_deg"), short.alias("shortfall_m"),
    )


def reachable_polygon(lat, lon, reach, steps: int = 48) -> Column:
    """The set's outline as a closed ring of [lon, lat]: outer arc, then the inner arc or the centre."""
    r = col(reach)
    start = F.when(r["omni"], 0.0).otherwise(r["center_deg"] - r["half_deg"])
    sweep = F.when(r["omni"], 360.0).otherwise(r["half_deg"] * 2)

    def arc(meters: Column) -> Column:
        def point(i: Column) -> Column:
            d = destination(lat, lon, start + sweep * i / steps, meters)
            return F.array(d["lon"], d["lat"])

        return F.transform(F.sequence(F.lit(0), F.lit(steps)), point)

    inner = F.when(r["r_min_m"] > 0, F.reverse(arc(r["r_min_m"]))).when(~r["omni"], F.array(F.array(col(lon), col(lat)))).otherwise(F.array().cast("array<array<double>>"))
    ring = F.concat(arc(r["r_max_m"]), inner)
    return F.concat(ring, F.slice(ring, 1, 1))


def extrapolate(lat, lon, sog_kt, cog_deg, elapsed_s) -> Column:
    """struct(lat, lon) along the course; the fix itself without speed or course."""
    moves = (F.coalesce(col(sog_kt), F.lit(0.0)) != 0) & col(cog_deg).isNotNull()
    there = destination(lat, lon, cog_deg, col(sog_kt) * KT_TO_MS * F.greatest(F.lit(0.0), col(elapsed_s).cast("double")))
    return F.when(moves, there).otherwise(F.struct(col(lat).alias("lat"), col(lon).alias("lon")))


def lead_vector(lat, lon, sog_kt, cog_deg, minutes: float = 6) -> Column:
    """struct(lat, lon) of a drawn course line's end on a flat map; null for targets that hardly move."""
    nm = col(sog_kt) * minutes / 60
    rad = F.radians(cog_deg)
    to = F.struct((col(lat) + nm / 60 * F.cos(rad)).alias("lat"), (col(lon) + nm / 60 * F.sin(rad) / F.greatest(F.lit(0.2), F.cos(F.radians(lat)))).alias("lon"))
    return F.when((col(sog_kt) > 2) & col(cog_deg).isNotNull(), to)
