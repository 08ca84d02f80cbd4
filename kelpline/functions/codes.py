"""Flag bits, codes and categories of observations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelpline.functions.geo import col

EMERGENCY, GNSS_DEGRADED, DARK, LOITER, STALE, MILITARY, ON_GROUND, SPOOF_SUSPECT = (1 << i for i in range(8))
AIR, SEA, ORBIT, GEO, THERMAL, MEDIA = range(1, 7)
DOMAINS = {"air": AIR, "sea": SEA, "orbit": ORBIT, "geo": GEO, "thermal": THERMAL, "media": MEDIA}

# Codes and lists that results depend on.
KIND_CODES = {"tanker": 1, "cargo": 2, "passenger": 3, "high speed craft": 4, "fishing": 5, "tug": 6, "military": 7, "sailing": 8, "pleasure craft": 9, "earthquake": 20, "thermal_anomaly": 21}
SQUAWKS = {"7500": 100, "7600": 62, "7700": 88}
KEPT_PROPS = ("squawk", "nic", "nacP", "emergency", "navStatus", "heading", "mag", "depthKm", "frp", "brightnessK", "dayNight")
# Kinds and names of vessels that lie alongside others as their work.
EXCLUDED_KIND = r"(?i)pilot|tug|rescue|fishing|pleasure|sailing|high speed|special|passenger|dredg|law enforce|port tender|sar"
EXCLUDED_NAME = r"(?i)^(pilot|rescue|f\/v|fv |kbv |sar |tug |rv |r\/v )|^(vg|fn|hv|gg|ka|s\d|h\d|o\d|r\d)[\s-]?\d|\bpilot\b|\brescue\b|svitzer|fairplay|multrasalvor|\bferry\b|\btug\b"


def has(flags, bit: int) -> Column:
    return col(flags).bitwiseAND(bit) != 0


def lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def kind_code(kind) -> Column:
    return F.coalesce(lookup(KIND_CODES, F.lower(F.coalesce(col(kind), F.lit("")))), F.lit(0))


def squawk_severity(squawk) -> Column:
    """Null for a code that is no emergency."""
    return lookup(SQUAWKS, F.coalesce(col(squawk), F.lit("")))


def domain_codes(names: str | None, default: tuple[int, ...] = (AIR, SEA)) -> list[int]:
    """Codes of a comma-separated list of names; unknown ones are left out, and none at all gives the default."""
    found = [DOMAINS[n.strip().lower()] for n in (names or "").split(",") if n.strip().lower() in DOMAINS]
    return found or list(default)


def slim_props(props) -> Column:
    """A props map with the keys that detectors read and no nulls; null if nothing is left."""
    kept = F.map_filter(col(props), lambda k, v: k.isin(*KEPT_PROPS) & v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def strip_heavy(evidence, most: int = 12) -> Column:
    """An evidence map of JSON values without those that are long arrays."""
    return F.map_filter(col(evidence), lambda k, v: F.coalesce(F.json_array_length(v), F.lit(0)) <= most)


def contact_status(flags, age_s) -> Column:
    return F.when(has(flags, EMERGENCY), "emergency").when(has(flags, GNSS_DEGRADED), "degraded").when(col(age_s) > 600, "dark").otherwise("normal")


def severity_band(severity, high: int = 80, middle: int = 60) -> Column:
    s = col(severity)
    return F.when(s >= high, "high").when(s >= middle, "middle").otherwise("low")


def flag_states(flags, age_s, looping, verdict) -> Column:
    """Flags with the bits that follow from state: dark and stale by age, loiter, and spoofing by verdict."""
    on = lambda test, bit: F.when(F.coalesce(test, F.lit(False)), bit).otherwise(0)
    return (
        col(flags).bitwiseOR(on(col(age_s) > 3600, DARK)).bitwiseOR(on(col(age_s) > 600, STALE))
        .bitwiseOR(on(col(looping), LOITER)).bitwiseOR(on(col(verdict) == "IMPOSSIBLE_TRANSIT", SPOOF_SUSPECT))
    )
