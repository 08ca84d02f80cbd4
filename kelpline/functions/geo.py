"""Geodesy, cells and small numeric idioms as Column expressions.

All take columns (or numbers) and stay inside code generation.  A null in any
argument gives null: least() and greatest() would skip it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
KT_TO_MS = 0.514444
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
#: Approximate cell size at the equator in km, by number of characters.
CELL_KM = {1: 5000.0, 2: 1250.0, 3: 156.0, 4: 39.1, 5: 4.89, 6: 1.22}


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def known(*xs: Column) -> Column:
    return reduce(lambda a, b: a & b, [x.isNotNull() for x in xs])


def js_round(x) -> Column:
    """To the nearest whole number, halves up also below zero."""
    return F.floor(col(x) + F.lit(0.5)).cast("long")


def clamp(x, lo, hi) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def to_fixed(x, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", col(x))


def quantize(ms, bucket: int) -> Column:
    return (F.floor(col(ms) / F.lit(bucket)) * bucket).cast("long")


def epoch_ms(ts) -> Column:
    return F.floor(F.unix_micros(col(ts).cast("timestamp")) / F.lit(1000)).cast("long")


def hour_of_week(ms) -> Column:
    """0 for Sunday's first hour, UTC; the epoch began on a Thursday."""
    hours = F.floor(col(ms) / F.lit(3600000)).cast("long")
    return F.pmod(hours + 96, F.lit(168)).cast("int")


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    a, b, c, d = map(col, (lat1, lon1, lat2, lon2))
    s = F.pow(F.sin(F.radians(c - a) / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(F.radians(d - b) / 2), 2)
    return F.when(known(a, b, c, d), F.asin(F.least(F.lit(1.0), F.sqrt(s))) * (2 * EARTH_RADIUS_M))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    a, b, c, d = map(col, (lat1, lon1, lat2, lon2))
    y = F.sin(F.radians(d - b)) * F.cos(F.radians(c))
    x = F.cos(F.radians(a)) * F.sin(F.radians(c)) - F.sin(F.radians(a)) * F.cos(F.radians(c)) * F.cos(F.radians(d - b))
    return (F.degrees(F.atan2(y, x)) + 360) % 360


def destination(lat, lon, bearing, meters) -> Column:
    """struct(lat, lon), with lon in -180..180."""
    a, b, t, m = map(col, (lat, lon, bearing, meters))
    d = m / EARTH_RADIUS_M
    s = F.sin(F.radians(a)) * F.cos(d) + F.cos(F.radians(a)) * F.sin(d) * F.cos(F.radians(t))
    to = F.asin(clamp(s, -1.0, 1.0))
    y = F.sin(F.radians(t)) * F.sin(d) * F.cos(F.radians(a))
    x = F.cos(d) - F.sin(F.radians(a)) * s
    on = (b + F.degrees(F.atan2(y, x)) + 540) % 360 - 180
    return F.struct(F.degrees(to).alias("lat"), on.alias("lon"))


def angle_delta(a, b) -> Column:
    """From a to b, signed, over -180 up to 180."""
    d = (col(b) - col(a) + 540) % 360 - 180
    return F.when(d <= -180, d + 360).otherwise(d)


def _bits(x: Column, low: float, span: float, n: int) -> Column:
    whole = F.floor((x - low) / span * (1 << n)).cast("long")
    return F.when(x.isNotNull(), F.greatest(F.lit(0), F.least(F.lit((1 << n) - 1), whole))).cast("long")


def _spread(n: Column) -> Column:
    """A number's bits at every other place: its binary digits read as digits of base 4."""
    return F.conv(F.bin(n), 4, 10).cast("long")


def geohash(lat, lon, precision: int = 5) -> Column:
    """The cell's name: bits of longitude and latitude by turns, five a character, longitude first."""
    n_lon, n_lat = (5 * precision + 1) // 2, 5 * precision // 2
    x, y = _spread(_bits(col(lon), -180.0, 360.0, n_lon)), _spread(_bits(col(lat), -90.0, 180.0, n_lat))
    code = x + y * 2 if precision % 2 else y + x * 2  # the last bit is the longitude's if bits are odd in number
    digits = F.lpad(F.conv(code.cast("string"), 10, 32), precision, "0")
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def geohash_bounds(cell) -> Column:
    """struct(min_lat, min_lon, max_lat, max_lon); null if a character isn't one of a cell's name."""
    c = col(cell)
    digits = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.instr(F.lit(BASE32), x) - 1)
    zero = F.struct(F.lit(-90.0).alias("a"), F.lit(90.0).alias("b"), F.lit(-180.0).alias("c"), F.lit(180.0).alias("d"), F.lit(True).alias("on_lon"))

    # One step a bit: a step's result is referred to often, so bits are steps of the fold, not of the expression.
    bits = F.flatten(F.transform(digits, lambda v: F.array(*[F.shiftright(v, 4 - j).bitwiseAND(1) == 1 for j in range(5)])))

    def step(s: Column, up: Column) -> Column:
        lat, lon, on = (s["a"] + s["b"]) / 2, (s["c"] + s["d"]) / 2, s["on_lon"]
        return F.struct(
            F.when(~on & up, lat).otherwise(s["a"]).alias("a"), F.when(~on & ~up, lat).otherwise(s["b"]).alias("b"),
            F.when(on & up, lon).otherwise(s["c"]).alias("c"), F.when(on & ~up, lon).otherwise(s["d"]).alias("d"), (~on).alias("on_lon"),
        )

    done = lambda s: F.struct(s["a"].alias("min_lat"), s["c"].alias("min_lon"), s["b"].alias("max_lat"), s["d"].alias("max_lon"))
    return F.when(c.isNotNull() & ~F.exists(digits, lambda v: v < 0), F.aggregate(bits, zero, step, done))


def cell_center(cell) -> Column:
    b = geohash_bounds(cell)
    return F.struct(((b["min_lat"] + b["max_lat"]) / 2).alias("lat"), ((b["min_lon"] + b["max_lon"]) / 2).alias("lon"))


def precision_for_bounds(min_lat, min_lon, max_lat, max_lon, target: int = 256) -> Column:
    """The first precision of 1..6 whose cells number at least a quarter of ``target`` across the box; else 6."""
    span = F.greatest(haversine_m(min_lat, min_lon, max_lat, min_lon), haversine_m(min_lat, min_lon, min_lat, max_lon)) / 1000
    out = F.lit(6)
    for p in range(5, 0, -1):
        out = F.when(F.pow(F.greatest(F.lit(1.0), span / CELL_KM[p]), 2) >= target / 4, p).otherwise(out)
    return out


def cells_for_bounds(min_lat, min_lon, max_lat, max_lon, precision: int, cap: int | None = None) -> Column:
    """Names of the cells that cover a box, south-west first by rows; ``cap`` keeps that many."""
    n_lon, n_lat = (5 * precision + 1) // 2, 5 * precision // 2
    dx, dy = 360.0 / (1 << n_lon), 180.0 / (1 << n_lat)
    rows = F.sequence(_bits(col(min_lat), -90.0, 180.0, n_lat), _bits(col(max_lat), -90.0, 180.0, n_lat))
    cols = F.sequence(_bits(col(min_lon), -180.0, 360.0, n_lon), _bits(col(max_lon), -180.0, 360.0, n_lon))
    cells = F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: geohash((r + 0.5) * dy - 90.0, (c + 0.5) * dx - 180.0, precision))))
    cells = F.array_distinct(cells)
    return F.slice(cells, 1, cap) if cap else cells


def in_box(lat, lon, box: str = "") -> Column:
    """Whether a point lies in the box of the columns min_lat, ..., which ``box`` may prefix; edges count."""
    return col(lat).between(F.col(f"{box}min_lat"), F.col(f"{box}max_lat")) & col(lon).between(F.col(f"{box}min_lon"), F.col(f"{box}max_lon"))


def in_viewport(lat, lon, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> Column:
    """The same for a map's viewport, whose longitudes may lie outside -180..180 or cross the antimeridian."""
    wrap = lambda x: ((x + 180) % 360 + 360) % 360 - 180
    world = max_lon - min_lon >= 359.9
    west, east = (-180.0, 180.0) if world else (wrap(min_lon), wrap(max_lon))
    lat, lon = col(lat), col(lon)
    inside = (lon >= west) & (lon <= east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(max(-90.0, min_lat), min(90.0, max_lat)) & inside


def fmt_duration(seconds, short: bool = True) -> Column:
    """As text: ``short`` writes 75s, 12m, 2h 5m; otherwise minutes are spelled 12 min and seconds not told."""
    s = col(seconds)
    h, m = F.floor(s / 3600).cast("string"), js_round(s % 3600 / 60)
    hours = F.when(m > 0, F.concat(h, F.lit("h "), m.cast("string"), F.lit("m"))).otherwise(F.concat(h, F.lit("h")))
    minutes = F.concat(js_round(s / 60).cast("string"), F.lit("m" if short else " min"))
    out = F.when(s < 5400, minutes).otherwise(hours)
    return F.when(s < 90, F.concat(js_round(s).cast("string"), F.lit("s"))).otherwise(out) if short else out


def fmt_nm(meters) -> Column:
    return F.concat(to_fixed(col(meters) / 1852, 1), F.lit(" nm"))


def describe_place(box_key, lat, lon) -> Column:
    """A watchbox's name, or else the place in degrees and its cell."""
    lat, lon = col(lat), col(lon)
    where = F.concat(
        to_fixed(F.abs(lat), 1), F.when(lat >= 0, "N").otherwise("S"), F.lit(" "),
        to_fixed(F.abs(lon), 1), F.when(lon >= 0, "E").otherwise("W"), F.lit(" ("), geohash(lat, lon, 4), F.lit(")"),
    )
    return F.coalesce(F.replace(F.nullif(col(box_key), F.lit("")), F.lit("_"), F.lit(" ")), where)
