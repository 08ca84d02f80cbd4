"""Current state, replay and tracks of entities, folded from observations."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.geo import col


def newest(obs: DataFrame, *keys: str) -> DataFrame:
    """The newest observation of each key; of equal times the one with the least id."""
    best = obs.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in obs.columns if c not in keys]), F.struct("ts_ms", -F.col("obs_id"))).alias("o"))
    return best.select(*keys, "o.*")


def current_state(obs: DataFrame) -> DataFrame:
    """One row an entity: first and last time, the newest fix, and the last known value of what a fix may lack."""
    order = F.struct("ts_ms", -F.col("obs_id"))
    last = lambda c: F.max_by(c, order).alias(c)
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return obs.groupBy("entity_id").agg(
        F.min("ts_ms").alias("first_seen"), F.max("ts_ms").alias("last_seen"), F.count(F.lit(1)).alias("n_obs"),
        *map(last, ("domain", "lat", "lon", "flags", "geohash5")), *map(known, ("sog_kt", "cog_deg", "alt_m", "label", "kind")),
        F.array_sort(F.collect_set("source_id")).alias("source_ids"),
    )


def merged_props(obs: DataFrame, props: str = "props") -> DataFrame:
    """(entity_id, props): of each key of the map ``props`` the value that came last; keys without a value count as not told."""
    one = obs.select("entity_id", "ts_ms", "obs_id", F.explode(props).alias("key", "value")).where("value is not null")
    last = one.groupBy("entity_id", "key").agg(F.max_by("value", F.struct("ts_ms", -F.col("obs_id"))).alias("value"))
    return last.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("props"))


def live_entities(obs: DataFrame, now_ms: int, max_age_s: int = 2700, limit: int | None = 40_000) -> DataFrame:
    """State as of ``now_ms`` of what was heard within ``max_age_s``, newest first."""
    seen = obs.where((F.col("ts_ms") <= now_ms) & (F.col("ts_ms") > now_ms - max_age_s * 1000))
    out = current_state(seen).orderBy(F.col("last_seen").desc(), "entity_id")
    return out.limit(limit) if limit else out


def snapshot_at(obs: DataFrame, t_ms: int, window_s: int = 180, domains: list[int] | None = None, viewport: Column | None = None) -> DataFrame:
    """The newest fix of each entity in the ``window_s`` up to t, then those inside the viewport."""
    seen = obs.where((F.col("ts_ms") > t_ms - window_s * 1000) & (F.col("ts_ms") <= t_ms))
    if domains:
        seen = seen.where(F.col("domain").isin(domains))
    out = newest(seen, "entity_id")
    return out.where(viewport) if viewport is not None else out


def snapshot_counts(obs: DataFrame, t_ms: int, window_s: int = 180, domains: list[int] | None = None, viewport: Column | None = None) -> DataFrame:
    """(scanned, kept): fixes that a replay looks at, and entities that it shows."""
    seen = obs.where((F.col("ts_ms") > t_ms - window_s * 1000) & (F.col("ts_ms") <= t_ms))
    if domains:
        seen = seen.where(F.col("domain").isin(domains))
    last = seen.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("lat", "lon"), F.struct("ts_ms", -F.col("obs_id"))).alias("o")).select("n", "o.*")
    return last.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scanned"), F.count_if(F.lit(True) if viewport is None else viewport).alias("kept"))


def snapshots_at(obs: DataFrame, every_ms: int, window_s: int = 180) -> DataFrame:
    """The same at every multiple of ``every_ms``: a fix is dealt to the few times whose window holds it."""
    first = F.ceil(F.col("ts_ms") / F.lit(every_ms)).cast("long")
    last = F.floor((F.col("ts_ms") + window_s * 1000 - 1) / F.lit(every_ms)).cast("long")
    times = F.filter(F.sequence(first, F.greatest(first, last)), lambda k: k <= last)
    return newest(obs.withColumn("at_ms", F.explode(F.transform(times, lambda k: k * every_ms))), "entity_id", "at_ms")


def snapshot_delta(before: DataFrame, after: DataFrame, resend_s: int = 20) -> DataFrame:
    """(entity_id, change): new, changed, resent (unchanged, but sent ``resend_s`` ago), gone or same.
    Both have entity_id, last_seen; before has sent_ms and after now_ms."""
    b = before.select("entity_id", F.col("last_seen").alias("was"), "sent_ms")
    a = after.select("entity_id", F.col("last_seen").alias("seen"), "now_ms")
    change = F.when(F.col("was").isNull(), "new").when(F.col("seen").isNull(), "gone").when(F.col("seen") != F.col("was"), "changed")
    change = change.when(F.col("now_ms") - F.col("sent_ms") >= resend_s * 1000, "resent").otherwise("same")
    return b.join(a, "entity_id", "full_outer").select("entity_id", change.alias("change"))


def deltas(obs: DataFrame) -> DataFrame:
    """Each fix beside the one before it: prev_* columns, dt_ms."""
    w = Window.partitionBy("entity_id").orderBy("ts_ms", "obs_id")
    prev = {f"prev_{c}": F.lag(c).over(w) for c in ("ts_ms", "lat", "lon", "obs_id")}
    # Speed and course as known when the earlier fix came: the last that were told up to it.
    carried = {f"prev_{c}": F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for c in ("sog_kt", "cog_deg", "flags")}
    return obs.withColumns({**prev, **carried}).withColumn("dt_ms", F.col("ts_ms") - F.col("prev_ts_ms"))


#: What is kept of an entity's last fix; speed, course and flags are the last that were told up to it.
LAST = "entity_id string, ts_ms long, obs_id long, domain int, lat double, lon double, sog_kt double, cog_deg double, flags int"
LAST_FIELDS = tuple(c.split()[0] for c in LAST.split(", "))


def last_known(obs: DataFrame) -> DataFrame:
    """Each entity's last fix, with the last speed, course and flags that it told."""
    order = F.struct("ts_ms", "obs_id")
    told = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("sog_kt", "cog_deg", "flags")]
    out = obs.where("entity_id is not null").groupBy("entity_id").agg(F.max_by(F.struct("ts_ms", "obs_id", "domain", "lat", "lon"), order).alias("o"), *told)
    return out.select("entity_id", "o.*", "sog_kt", "cog_deg", "flags").select(*LAST_FIELDS)


def after_known(obs: DataFrame, known: DataFrame) -> DataFrame:
    """Fixes behind the last one that is known of their entity, and that one before them (``known_`` is true).  Fixes that come
    later than newer ones are left out: what lay between those has been judged."""
    k = known.select(*LAST_FIELDS)
    marks = k.select("entity_id", F.struct("ts_ms", "obs_id").alias("mark_"))
    new = obs.join(marks, "entity_id", "left").where(F.col("mark_").isNull() | (F.struct("ts_ms", "obs_id") > F.col("mark_"))).drop("mark_")
    here = k.join(obs.select("entity_id").distinct(), "entity_id", "left_semi")
    return new.withColumn("known_", F.lit(False)).unionByName(here.withColumn("known_", F.lit(True)), allowMissingColumns=True)


def tracks(obs: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Each entity's fixes in a time range, in order, as one array; meant for a selection of entities or hours."""
    seen = obs.where(F.col("ts_ms").between(from_ms, to_ms))
    fixes = F.array_sort(F.collect_list(F.struct("ts_ms", "obs_id", "lat", "lon", "sog_kt")))
    return seen.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), fixes.alias("track"))


def as_of(obs: DataFrame, wanted: DataFrame, at: str = "at_ms") -> DataFrame:
    """For each (entity_id, at) the last fix at or before it: fixes and questions are sorted into one line."""
    mark = F.struct("ts_ms", "lat", "lon", "obs_id")
    both = obs.select("entity_id", F.col("ts_ms").alias("t"), F.lit(0).alias("ask"), mark.alias("fix"), F.col("obs_id").alias("o"))
    both = both.unionByName(wanted.select("entity_id", F.col(at).alias("t"), F.lit(1).alias("ask")), allowMissingColumns=True)
    w = Window.partitionBy("entity_id").orderBy("t", "ask", "o").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("fix", F.last("fix", ignorenulls=True).over(w)).where("ask = 1")
    return out.select("entity_id", F.col("t").alias(at), F.col("fix.ts_ms").alias("fix_ms"), F.col("fix.lat").alias("lat"), F.col("fix.lon").alias("lon"))


#: Boxes up to which a list is sent to all executors as one row; more are joined by cells.
MOST_BOXES = 10_000
BOX_FIELDS = ("box_id", "box_key", "box_label", "dark_threshold_s", "min_lat", "min_lon", "max_lat", "max_lon")
#: Finest level of the cells that cover boxes: about 0.7 nautical miles.
FINEST = 14
_few: WeakKeyDictionary = WeakKeyDictionary()


def few_boxes(boxes: DataFrame) -> bool:
    """Whether a list is short; counted once for each table of boxes, and no further than matters."""
    if (known := _few.get(boxes)) is None or known[0] != MOST_BOXES:
        _few[boxes] = known = (MOST_BOXES, boxes.limit(MOST_BOXES + 1).count() <= MOST_BOXES)
    return known[1]


def _box_list(boxes: DataFrame) -> DataFrame:
    return F.broadcast(boxes.agg(F.array_sort(F.collect_list(F.struct(*BOX_FIELDS))).alias("boxes_")))


def first_watchbox(points: DataFrame, boxes: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds box_key, box_label, dark_threshold_s of the first box by id that holds a point, or nulls.

    A list kept by hand is looked through by each point in an array that is one row wide; a long one is an index of cells.
    """
    if few_boxes(boxes):
        held = F.filter("boxes_", lambda b: col(lat).between(b["min_lat"], b["max_lat"]) & col(lon).between(b["min_lon"], b["max_lon"]))
        out = points.join(_box_list(boxes), F.lit(True), "left").withColumn("box_", F.get(held, F.lit(0))).drop("boxes_")
    else:
        out = first_of_cover(points, boxes, lat, lon)
    return out.withColumns({c: F.col(f"box_.{c}") for c in ("box_key", "box_label", "dark_threshold_s")}).drop("box_")


def _cell(degrees: Column, span: float, level: Column) -> Column:
    return F.floor((degrees + span / 2) / span * F.pow(F.lit(2.0), level)).cast("long")


def _covered(boxes: DataFrame) -> DataFrame:
    """(b, level, x, y): each box with the cells that cover it, of the size that suits it: five by five at most."""
    size = F.greatest(F.col("max_lat") - F.col("min_lat"), (F.col("max_lon") - F.col("min_lon")) / 2, F.lit(1e-9))
    level = F.least(F.lit(FINEST), F.greatest(F.lit(0), F.floor(F.log2(F.lit(180.0) / size)) + 1)).cast("int")
    c = boxes.where((F.col("min_lat") <= F.col("max_lat")) & (F.col("min_lon") <= F.col("max_lon"))).select(*BOX_FIELDS, level.alias("level"))
    run = lambda lo, hi, span: F.explode(F.sequence(_cell(F.col(lo), span, F.col("level")), _cell(F.col(hi), span, F.col("level"))))
    c = c.withColumn("x", run("min_lon", "max_lon", 360.0)).withColumn("y", run("min_lat", "max_lat", 180.0))
    return c.select(F.struct(*BOX_FIELDS).alias("b"), "level", "x", "y")


def _at_cell(lat: str, lon: str, level: int) -> Column:
    return (_cell(col(lon), 360.0, F.lit(level)) == F.col("x_")) & (_cell(col(lat), 180.0, F.lit(level)) == F.col("y_"))


def _levels(cover: DataFrame) -> list[int]:
    """The sizes of cells that a cover has: FINEST + 1 at most."""
    return [r.level for r in cover.select("level").distinct().orderBy("level").collect()]


def box_cover(boxes: DataFrame) -> DataFrame:
    """(level, x, y, whole, some): the cells that cover boxes.  ``whole`` is the first box that holds all of a cell, which needs no test;
    ``some`` are boxes before it that hold a part of it, in order."""
    c = _covered(boxes)
    edge = lambda i, span: i * span / F.pow(F.lit(2.0), F.col("level")) - span / 2
    # A hair inside, as a point's cell is rounded.
    inside = (edge(F.col("x"), 360.0) >= F.col("b.min_lon") + 1e-9) & (edge(F.col("x") + 1, 360.0) <= F.col("b.max_lon") - 1e-9) & (edge(F.col("y"), 180.0) >= F.col("b.min_lat") + 1e-9) & (edge(F.col("y") + 1, 180.0) <= F.col("b.max_lat") - 1e-9)
    cells = c.groupBy("level", "x", "y").agg(F.min(F.when(inside, F.col("b"))).alias("whole"), F.array_sort(F.collect_list(F.when(~inside, F.col("b")))).alias("some"))
    return cells.withColumn("some", F.filter("some", lambda b: F.col("whole").isNull() | (b["box_id"] < F.col("whole.box_id"))))


def first_of_cover(points: DataFrame, boxes: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds ``box_``, the first box by id that holds a point: one join by cell for each size of cell that the cover has, each of which finds a
    point one cell at most."""
    cover = box_cover(boxes)
    out, found = points, []
    for level in (levels := _levels(cover)):
        cells = cover.where(F.col("level") == level).select(F.col("x").alias("x_"), F.col("y").alias("y_"), F.col("whole").alias(f"whole_{level}"), F.col("some").alias(f"some_{level}"))
        out = out.join(cells, _at_cell(lat, lon, level), "left").drop("x_", "y_")
        held = F.filter(f"some_{level}", lambda b: col(lat).between(b["min_lat"], b["max_lat"]) & col(lon).between(b["min_lon"], b["max_lon"]))
        found.append(F.coalesce(F.get(held, F.lit(0)), F.col(f"whole_{level}")))
    return out.withColumn("box_", F.array_min(F.array(*found))).drop(*[f"{n}_{level}" for level in levels for n in ("whole", "some")])


def all_watchboxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each point with each box that holds it, from the same list or index."""
    if few_boxes(boxes):
        held = F.filter("boxes_", lambda b: col("lat").between(b["min_lat"], b["max_lat"]) & col("lon").between(b["min_lon"], b["max_lon"]))
        return points.join(_box_list(boxes), F.lit(True)).withColumn("box_", F.explode(held)).select(*points.columns, "box_.*")
    cover, out = _covered(boxes), None
    for level in _levels(cover):  # a box has cells of one size, and a point lies in one of them
        cells = cover.where(F.col("level") == level).select(F.col("x").alias("x_"), F.col("y").alias("y_"), F.col("b").alias("box_"))
        one = points.join(cells, _at_cell("lat", "lon", level)).where(col("lat").between(F.col("box_.min_lat"), F.col("box_.max_lat")) & col("lon").between(F.col("box_.min_lon"), F.col("box_.max_lon")))
        one = one.select(*points.columns, "box_.*")
        out = one if out is None else out.unionByName(one)
    return out
