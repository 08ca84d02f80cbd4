"""Texts and rows that are made to be slow, and lines that fail, against plain versions."""

import random
import re
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from kelpline.llm import near_dup, quality, secret_scan

MIB = 1 << 20


@pytest.mark.parametrize("piece", ["eyJ", "eyJabcdefgh.", "eyJabcdefghabcdefgh.a.", "-----BEGIN RSA PRIVATE KEY-----\n", "a-", "A" * 64 + "\n", "----", "\n", "Key: v\n", "xoxb-", "https://a:", "token : "])
def test_secrets_of_long_texts_take_linear_time(piece):
    head = "-----BEGIN RSA PRIVATE KEY-----\n"
    text = head + piece * (16 * MIB // len(piece))
    for kind, pattern, _, _ in secret_scan.scanner(secret_scan.RULES).rules:
        if kind in ("jwt", "pem"):
            tracemalloc.start()
            began = time.process_time()
            n = sum(1 for _ in pattern.finditer(text))
            assert time.process_time() - began < 5 and tracemalloc.get_traced_memory()[1] < 300 * MIB and n >= (kind == "pem")
            tracemalloc.stop()


def test_tokens_and_keys_are_what_plain_expressions_find():
    jwt = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    pem = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:(?:-{0,4}[^-])*-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----|(?:\s*(?:[A-Za-z][A-Za-z-]{2,30}:\x20[^\n]{0,200}\n|[A-Za-z0-9+/=]{32,}))*)", re.A)
    bits = ["eyJ", "abcdefgh", "a", ".", ".", "-", "-----", " ", "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "\n", "A" * 40, "DEK-Info: AES\n", "é"]
    rng = random.Random(4)
    made = ["".join(rng.choice(bits) for _ in range(rng.randrange(24))) for _ in range(20000)]
    got = secret_scan.scanner(secret_scan.RULES).scan(made)
    found = 0
    for text, spans in zip(made, got, strict=True):
        for kind, plain in (("jwt", jwt), ("pem", pem)):
            want = [m.span() for m in plain.finditer(text)]
            assert [(a, b) for k, a, b in spans if k == kind] == want, text
            found += len(want)
    assert found > 1000


def test_rows_repeated_with_one_id_cost_no_square(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    one, two, other = " ".join(words), " ".join([*words[:-3], "x", "y", "z"]), " ".join(words[::-1])
    rows = [(1, one), (2, two)] * 10_000 + [(3, other), (1, other)]
    began = time.monotonic()
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {tuple(r) for r in got.groupBy("doc_id", "n_shingles", "component_id", "kept").count().collect()}
    # The id 1 stands for two sets, so the third document is in its component by the copy.
    assert got == {(1, 296, 1, True, 10_001), (2, 296, 1, False, 10_000), (3, 296, 1, False, 1)}
    assert time.monotonic() - began < 60


def test_lines_that_fail_go(spark):
    rng = random.Random(7)
    good = [" ".join(f"word{rng.randrange(10**5)}" for _ in range(9)) + "." for _ in range(12)]
    bad = ["Home | News | About", "Click here", "BUY ALL OF IT NOW TODAY FOR NOTHING", "Wow! Wow! Wow! Wow!", "We use cookies on this site, accept."]
    text = "\n".join([bad[0], *good[:6], "", *bad[1:4], *good[6:], bad[4], " \t"])
    rows = [(1, text, 5), (2, "\n".join(good), 6), (3, "\n".join(bad * 20), 7), (4, None, 8), (5, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, q_kept long")
    got = {r.doc_id: (r.text, r.q_kept) for r in quality.keep_good(df).collect()}
    assert got == {1: ("\n".join([*good[:6], "", *good[6:], " \t"]), 5), 2: ("\n".join(good), 6)}
    left = quality.assess(quality.keep_good(df.drop("q_kept"))).agg(F.sum("lost_words")).first()[0]
    assert left == 0
