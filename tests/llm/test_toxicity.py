"""The clause grammar against a plain reading, learnt families, held-out rows, and odd rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.llm import toxicity as T
from tests.llm.helpers import clashing, odd_docs


def plain_events(symbols):
    """Factors of a clause's events, by looking around each word instead of by states."""
    out = []
    spoken = []
    said = quoted = False
    for a in symbols:
        spoken.append(said or quoted)
        said, quoted = said or a == T.REPORT, quoted != (a == T.QUOTE)
    denied = [T.NOT in symbols[max(0, i - T.REACH_NOT) : i] for i in range(len(symbols))]
    near = lambda i, kind, n: kind in symbols[max(0, i - n) : i]
    free = [a == T.INSULT and not spoken[i] and not denied[i] for i, a in enumerate(symbols)]
    open_until = -1  # a plain insult without a target before it waits for one
    threat_until = -1
    for i, a in enumerate(symbols):
        if a == T.INSULT:
            f = (T.REPORTED if spoken[i] else 1.0) * (T.NEGATED if denied[i] else 1.0)
            out.append((i, f * (T.TARGETED if free[i] and near(i, T.TARGET, T.REACH_TARGET) else 1.0)))
            if free[i]:
                open_until = -1 if near(i, T.TARGET, T.REACH_TARGET) else i + T.REACH_TARGET
        elif a == T.THREAT and not spoken[i] and not denied[i] and near(i, T.WILL, T.REACH_WILL):
            threat_until = i + T.REACH_WILL
        elif a == T.TARGET:
            if i <= open_until:  # which the later transducer doesn't see as a target
                out.append((i, T.AIMED))
                open_until = -1
            elif i <= threat_until:
                out.append((i, T.MENACE))
                threat_until = -1
    return out


def machine_events(symbols):
    table, state, out = T.grammar(), 0, []
    for i, a in enumerate(symbols):
        event, factor, state = table[state][a]
        if event:
            out.append((i, factor))
    return out


def test_composed_machine_equals_a_plain_reading():
    few = (T.OTHER, T.INSULT, T.TARGET, T.NOT)
    for n in range(1, 7):
        for symbols in itertools.product(few, repeat=n):
            assert machine_events(symbols) == plain_events(symbols), symbols
    rng = random.Random(2)
    for _ in range(20_000):
        symbols = [rng.choice(T.SYMBOLS) for _ in range(rng.randrange(1, 25))]
        got, want = machine_events(symbols), plain_events(symbols)
        assert [i for i, _ in got] == [i for i, _ in want] and [f for _, f in got] == pytest.approx([f for _, f in want]), symbols


def test_context_of_a_clause_counts():
    s = T.Scorer({"quaxl": 2.0})
    best = lambda t: s.clause(t)[0]
    assert best("what an idiot") == 1.0 and best("you are an idiot") == T.TARGETED and best("an idiot like you") == T.AIMED
    assert best("he isn't an idiot") == T.NEGATED and best("she said he was an idiot") == T.REPORTED and best('"idiot"') == T.REPORTED
    assert best("we will hurt you") == T.MENACE and best("it will hurt") == 0 and best("she said we will hurt you") == 0
    assert best("ein quaxlhafter") == 2.0 and s.clause("quaxling quaxlung")[1] == {"quaxling", "quaxlung"}
    # Single words without their clause, and words that only end or go on alike, are nothing.
    assert s.features("Kill. You. Idiotic? aquaxl") == (1.0 * 0, 0, 0)
    assert s.features("An idiot. An idiot. An IDIOT. Moron!")[:2] == (2.0, 2.0)
    assert s.features("idiot " * 50_000) == (1.0, 1.0, 1.0)


def labelled(spark, n=900):
    """Invented rows: toxic ones hold words of two families that clean rows never have; many copies of one toxic row."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abdegilmnorstu") for _ in range(rng.randrange(3, 8)))
    usual = [word() for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(usual) for _ in range(60)]
        toxic = i % 5 == 1
        for _ in range(4 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["zork", "plimf"]) + word()
        docs.append((i, " ".join(w[:30]) + ". " + " ".join(w[30:])))
        labels.append((i, 1, int(toxic)))
    copy = " ".join(rng.choice(usual) + "q" for _ in range(40))
    for i in range(n, n + 200):
        docs.append((i, copy))
        labels.append((i, 1, 1))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_families_are_learnt_and_copies_are_not(spark):
    docs, labels = labelled(spark)
    known, b = T.learn(docs, labels)
    assert {k for k, _ in known} == {"zork", "plimf"}
    rows = T.score_documents(docs, known, b).join(labels, "doc_id").where("doc_id < 900").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.predicted == r.toxic for r in held)
    # Held-out labels teach nothing.
    turned = labels.withColumn("toxic", F.when(T.remainder(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    known2, b2 = T.learn(docs, turned)
    assert known2 == known and np.allclose(b, b2)
    few, _ = T.learn(docs, labels, most_rows=5)
    assert len(few) <= len(known)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_rows_of_the_tables(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = T.score_documents(docs, *T.learn(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    toxic = [r for r in rows if r.toxic]
    assert right >= 0.95 and sum(r.predicted for r in toxic) >= 0.75 * len(toxic)


def test_odd_documents(spark):
    odd = odd_docs(spark)
    none = spark.createDataFrame([(None, None, 1), (4, None, None), (1, 1, 1), (1, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    known, b = T.learn(clashing(odd), none)
    got = T.score_documents(clashing(odd), known, b).collect()
    assert len(got) == odd.count() and known == ()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.score for r in got if r.doc_id in (1, 2, 3)} == {min(r.score for r in got)}
    assert next(r.held_out for r in got if r.doc_id is None)
    assert T.score_documents(odd.limit(0), *T.learn(odd.limit(0), none.limit(0))).count() == 0
    assert math.isclose(T.fit(np.zeros((0, 3)), np.zeros(0))[0], T.START[0])
