"""JSON in one form: keys in order at each level, no blanks, numbers in one notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings, numbers, and what stands between them.
TOKEN = r'"(?:[^"\\]|\\.)*+"|-?\d[\d.eE+-]*|[^"\d-]+'


def canonical_number(text: Column) -> Column:
    """A number as its shortest decimals, with an exponent only from 1e21 on and below 1e-6: 2e3, 2000.0 and 2000 are one."""
    size, scientific = F.abs(text.cast("double")), text.rlike("[eE]")
    spelled = F.when(~scientific, text).when(size < 1, text.cast("decimal(38,30)").cast("string")).otherwise(text.cast("decimal(38,17)").cast("string"))
    plain = F.regexp_replace(F.regexp_replace(spelled, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    power = F.regexp_replace(F.regexp_replace(text.cast("double").cast("string"), r"\.0(?=E)", ""), r"E(?=\d)", "e+")
    short = F.when(size == 0, F.lit("0")).when((size >= 1e-6) & (size < 1e20), plain).otherwise(F.replace(power, F.lit("E"), F.lit("e")))
    return F.when(scientific | text.contains("."), short).otherwise(text)


def canonical_json(text: Column) -> Column:
    """Any JSON text in its one form.  VARIANT holds an object's fields in order of their names, at every level; null stays null, and a
    text that isn't JSON fails."""
    tokens = F.regexp_extract_all(F.to_json(F.parse_json(text)), F.lit(TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^-?\d"), canonical_number(t)).otherwise(t)), "")


def json_sha(text: Column) -> Column:
    """The digest of what a JSON text says, however it is written down."""
    return F.sha2(canonical_json(text).cast("binary"), 256)
