"""Small dimension tables: sources, watchboxes, methods.  Each is a fixed list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Key, label, min_lat, min_lon, max_lat, max_lon, seconds of silence that count as dark.
WATCHBOXES = (
    ("hormuz", "Strait of Hormuz", 25.2, 54.2, 27.4, 57.6, 1800),
    ("malacca", "Strait of Malacca", -0.5, 98.0, 6.5, 105.0, 2700),
    ("bab_el_mandeb", "Bab-el-Mandeb / S. Red Sea", 11.0, 41.0, 16.5, 45.0, 1800),
    ("suez", "Suez Canal approaches", 27.0, 32.0, 32.5, 34.5, 1800),
    ("bosphorus", "Bosphorus / Sea of Marmara", 40.2, 26.5, 41.6, 30.2, 1800),
    ("panama", "Panama Canal approaches", 7.5, -80.5, 10.5, -78.0, 2700),
    ("taiwan_strait", "Taiwan Strait", 22.0, 117.0, 26.5, 122.5, 1800),
    ("kerch", "Kerch Strait / N. Black Sea", 44.0, 33.0, 47.0, 39.5, 1800),
    ("gulf_of_guinea", "Gulf of Guinea", -2.0, 2.0, 7.0, 9.5, 3600),
    ("baltic_approaches", "Danish Straits / Baltic", 54.0, 10.0, 60.0, 22.0, 2700),
)
# Id, key, domain.
SOURCES = ((1, "adsb_lol", 1), (2, "opensky", 1), (3, "aisstream", 2), (4, "celestrak", 3), (5, "usgs_quake", 4), (6, "nasa_firms", 5), (7, "gdelt", 6))

METHODS = (
    ("DARK_VESSEL", "position after a silence tested against the set its class can reach", "coverage gaps look like silence"),
    ("SPOOF_DISCONTINUITY", "reappeared farther off than its class can travel", "a reused identity looks the same"),
    ("AIRSPACE_VOID", "airborne count per cell against its usual count for the hour of the week", "receivers that fail look the same"),
    ("GNSS_BLOOM", "share of aircraft per cell that report poor navigation integrity", "old transponders report poorly too"),
    ("SQUAWK_EMERGENCY", "emergency transponder code", "codes are set by mistake, too"),
    ("RENDEZVOUS", "two slow hulls side by side for a time, away from anchorages", "both must transmit"),
    ("LOITER", "long path, little net motion", "holding patterns are left out by density only"),
    ("THERMAL_ANOMALY", "radiative power of a fire pixel", "flares and farming burn as well"),
    ("SEISMIC_SHALLOW", "shallow and strong enough event", "most are natural"),
    ("CONFLUENCE", "detections of independent modalities close in space and time", "closeness is no cause"),
)


def _values(rows) -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else repr(x)
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


def watchboxes(spark: SparkSession) -> DataFrame:
    rows = [(i, *w) for i, w in enumerate(WATCHBOXES)]
    return spark.sql(f"SELECT * FROM VALUES {_values(rows)} AS t(box_id, box_key, box_label, min_lat, min_lon, max_lat, max_lon, dark_threshold_s)")


def sources(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_values(SOURCES)} AS t(source_id, source_key, source_domain)")


def methods(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_values(METHODS)} AS t(rule, method, limitation)")
