"""One run of all rules: each by itself, through the breaker, against what is known, then fused into incidents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions.geo import hour_of_week
from kelpline.operators import detectors, fusion
from kelpline.operators.state import after_known, last_known, newest
from kelpline.plans.checkpoints import checkpointed


@dataclass
class Context:
    """What rules look at: a batch of fixes and, for those that look back, an archive and a baseline.

    ``batch`` is that of one tick, or of several, told apart by ``tick_ms``; ``at_tick`` has one fix an entity and tick, by
    default the newest of each.  ``season`` gives a tick's season as the baseline knows it.  ``known`` has each entity's last fix before
    the batch: with it silences of any length are closed by the batch's fixes, without it those that the archive holds.  With ``now_ms``
    entities that have fallen silent by then, and have none of ``open_gaps``, are looked for.
    """

    batch: DataFrame
    boxes: DataFrame
    tick_ms: int = 30_000
    archive: DataFrame | None = None
    base: DataFrame | None = None
    at_tick: DataFrame | None = None
    ticks: DataFrame | None = None
    precision: int = 4
    season: Callable[[Column], Column] | None = hour_of_week
    dedupe: bool = True
    known: DataFrame | None = None
    open_gaps: DataFrame | None = None
    now_ms: int | None = None

    def newest_fixes(self) -> DataFrame:
        if self.at_tick is not None:
            return self.at_tick
        dealt = self.batch.withColumn("tick_ms", detectors.quantize("ts_ms", self.tick_ms))
        # A tick's fixes are looked back from its last moment.
        return newest(dealt, "entity_id", "tick_ms").withColumn("tick_ms", F.col("tick_ms") + self.tick_ms - 1)

    def history(self) -> DataFrame:
        return self.batch if self.archive is None else self.archive


Rule = Callable[[Context], DataFrame | None]


def _void(c: Context) -> DataFrame | None:
    """Nothing is usual yet where there is no baseline."""
    if c.base is None:
        return None
    return detectors.airspace_void(c.batch, c.base, c.tick_ms, c.boxes, c.precision, c.season, c.dedupe, c.ticks)


#: The nine rules, by the group that the breaker knows (two of them share one).
RULES: dict[str, Rule] = {
    "SQUAWK_EMERGENCY": lambda c: detectors.squawk_emergency(c.batch, min(c.tick_ms, 30_000)),
    "GNSS_BLOOM": lambda c: detectors.gnss_bloom(c.batch, c.tick_ms, c.boxes, c.precision, c.dedupe),
    "RENDEZVOUS": lambda c: detectors.rendezvous(c.newest_fixes(), c.history(), c.boxes),
    "THERMAL_ANOMALY": lambda c: detectors.thermal_anomaly(c.batch, c.boxes),
    "SEISMIC_SHALLOW": lambda c: detectors.seismic_shallow(c.batch, c.boxes),
    "REACQUISITION": lambda c: detectors.reacquisition(c.history() if c.known is None else c.batch, c.boxes, c.known),
    "AIRSPACE_VOID": _void,
    "LOITER": lambda c: detectors.loiter(c.newest_fixes(), c.history(), c.boxes),
}


@dataclass
class Run:
    """``found``: what the rules produced; ``kept``: what the breaker left of it; ``new``: of that what wasn't known, one a
    key; ``report``: produced and kept by rule group and tick; ``errors``: message by rule that failed; ``opened``: who has
    fallen silent, where the context has a ``now_ms``."""

    found: DataFrame
    kept: DataFrame
    new: DataFrame
    report: DataFrame
    errors: dict[str, str] = field(default_factory=dict)
    opened: DataFrame | None = None


def told(e: Exception) -> str:
    """An error in one line."""
    return f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"


def run_engine(c: Context, existing: DataFrame | None = None, rules: dict[str, Rule] | None = None, caps: dict[str, int] = detectors.CAPS) -> Run:
    """Runs each rule by itself and keeps its rows in the shared checkpoint folder, so that one that fails, when it is planned
    or when it runs, is told in ``errors`` and takes no other with it.  ``existing`` has the dedup_key of what is known."""
    found, errors = None, {}
    for name, rule in (RULES if rules is None else rules).items():
        try:
            rows = rule(c)
            if rows is None:
                continue
            rows = checkpointed(detectors.checked(name, rows))
        except Exception as e:  # noqa: BLE001 - a rule may fail in any way
            errors[name] = told(e)
            continue
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise RuntimeError(f"no rule gave a result: {errors}")
    kept, report = detectors.breaker(found, c.tick_ms, caps)
    return Run(found, kept, detectors.append_new(kept.drop("rule_group", "tick_ms"), existing), report, errors, _silent(c, errors))


def _silent(c: Context, errors: dict[str, str]) -> DataFrame | None:
    """The scan for silence; it fails by itself, too."""
    if c.now_ms is None:
        return None
    try:
        seen, still = c.batch.where(F.col("ts_ms") <= c.now_ms), c.open_gaps
        if c.known is not None:
            seen = after_known(seen, c.known)
            if still is not None:  # who was heard again has no gap open any longer
                still = still.join(seen.where("not known_").select("entity_id"), "entity_id", "left_anti")
            seen = seen.unionByName(c.known, allowMissingColumns=True)
        return checkpointed(detectors.fallen_silent(last_known(seen), c.now_ms, c.boxes, still))
    except Exception as e:  # noqa: BLE001
        errors["SCAN_DARK"] = told(e)
        return None


def numbered(new: DataFrame) -> DataFrame:
    """Detections with a number for fusion, from their hash."""
    return new.withColumn("id", F.xxhash64("hash"))


def incidents_of(known: DataFrame, now_ms: int | None = None, lookback_h: int = 6, **how) -> DataFrame:
    """Incidents of the detections of the last ``lookback_h`` hours before ``now_ms``, or of all: they come last, as only what
    exists can be fused."""
    if now_ms is not None:
        known = known.where((F.col("ts_start") > now_ms - lookback_h * detectors.HOUR) & (F.col("ts_start") <= now_ms))
    return fusion.confluence(numbered(known), **how)
