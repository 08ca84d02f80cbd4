"""One form of JSON, against a plain writer."""

import json
import random

from pyspark.sql import functions as F

from kelpline.functions.canonical import canonical_json, json_sha


def number(x):
    """Shortest decimals, an exponent only from 1e21 on and below 1e-6."""
    if x == 0:
        return "0"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, power = f"{x!r}".partition("e")
    if 1e-6 <= abs(x) < 1e21:
        return f"{x:.17f}".rstrip("0") if power else digits
    return f"{digits.removesuffix('.0')}e{int(power):+d}"


def plain(v):
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{plain(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, float):
        return number(v)
    return json.dumps(v, ensure_ascii=False)


def some(rng, deep=0):
    kind = rng.randrange(8 if deep < 4 else 6)
    if kind == 7:
        return {rng.choice(["b", "a", "é", "B", "aa", "a:1.0,", "x\"y"]): some(rng, deep + 1) for _ in range(rng.randrange(5))}
    if kind == 6:
        return [some(rng, deep + 1) for _ in range(rng.randrange(4))]
    return (None, True, rng.randrange(-(10**9), 10**9), rng.choice([0.0, -0.5, 1.25, 2000.0, 1e7, 12345678.5, 1e-5]), rng.choice(["", "1.0,2E5", "[3.0]", "q\"\\n", "é\n", "-7.0"]), rng.random())[kind]


def test_one_form_for_all_ways_to_write(spark):
    rng = random.Random(3)
    values = [some(rng) for _ in range(300)] + [{"n": [1e21, 1.5e-7, 1e-7]}, [], {}, "text", 5]
    rows = []
    for i, v in enumerate(values):
        rows.append((i, json.dumps(v)))
        rows.append((i, json.dumps(v, indent=2, ensure_ascii=False)))
    df = spark.createDataFrame(rows, "i int, j string")
    got = df.select("i", canonical_json(F.col("j")).alias("c"), json_sha(F.col("j")).alias("h")).collect()
    for r in got:
        assert r.c == plain(values[r.i]), (values[r.i], r.c)
    assert all(len({r.h for r in got if r.i == i}) == 1 for i in range(0, len(values), 17))
    same = spark.createDataFrame([("[2e3, 1.50]",), ("[2000.0,1.5]",), (" [2000 , 15e-1]",)], "j string")
    assert {r[0] for r in same.select(canonical_json(F.col("j"))).collect()} == {"[2000,1.5]"}
    assert spark.range(1).select(canonical_json(F.lit(None).cast("string")).alias("c")).first().c is None
