"""The registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kelpline.plans import feeds, oracle, queries as observations, runs

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return observations.QUERIES | feeds.QUERIES | runs.QUERIES


def oracle_sql() -> dict[str, str]:
    return oracle.ORACLE | feeds.ORACLE | runs.ORACLE
