"""Clusters from bit planes against plain integers and SQL."""

import numpy as np
import pytest

from kelpline.llm import centroids as C
from kelpline.llm.oracle import ORACLE
from tests.compare import agree, duck
from tests.llm.helpers import clashing

VECTORS = "vec_id long, embedding array<float>, label int"


def test_planes_give_exact_products_norms_and_sums():
    rng = np.random.default_rng(5)
    for most in (1, 3, 1000, C.LARGEST):
        x, c = rng.integers(-most, most + 1, (50, 64)), rng.integers(-most // 3, most // 2 + 1, (7, 64))
        x[0], x[1], c[0] = most, -most, -most // 3
        p, q = C.pack(x), C.pack(c)
        assert (C.products(p, q) == x @ c.T).all() and (C.norms(p) == (x * x).sum(1)).all() and (C.component_sums(p) == x.sum(0)).all()
    assert C.pack(np.zeros((2, 64), np.int64)).shape == (2, 1) and C.pack(np.full((1, 64), -1)).shape == (1, 1)


def plain(rows, k=8, rounds=10):
    import hashlib

    x = {i: [int(np.floor(float(np.float32(v)) * 1024)) for v in vec] for i, vec in rows}
    ids = sorted(x, key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())
    m = [list(x[i]) for i in ids[:k]]
    for step in range(rounds + 1):
        far = {i: [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in m] for i, v in x.items()}
        of = {i: f.index(min(f)) for i, f in far.items()}
        for j in range(len(m)) if step < rounds else ():
            if own := [x[i] for i in x if of[i] == j]:
                m[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return {i: (of[i], far[i][of[i]]) for i in x}


def test_clusters_equal_plain_loops(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=64) * (0.2, 3, 4000)[i % 3]).astype(np.float32).tolist()) for i in range(70)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]  # a hot vector
    df = clashing(spark.createDataFrame([(*r, 0) for r in rows], VECTORS)).repartition(3)
    got, m = C.cluster_vectors(df)
    assert {r.vec_id: (r.cluster, r.distance) for r in got.collect()} == plain(rows) and m.shape == (8, 64)


def test_odd_vectors(spark):
    one = [0.5] * 64
    bad = [(1, None, 0), (2, [], 0), (3, [1.0] * 63, 0), (4, [1.0] * 65, 0), (5, [None, *one[1:]], 0), (6, [float("nan"), *one[1:]], 0), (7, [float("inf"), *one[1:]], 0), (8, [-float("inf"), *one[1:]], 0)]
    good = [(9, one, 0), (9, one, 0), (None, [-1.0] * 64, 0), (10, [3e38, *[-3e38] * 63], None)]
    got = C.with_inertia(*C.cluster_vectors(spark.createDataFrame(bad + good, VECTORS))).collect()
    assert sorted((r.vec_id or 0, r.distance) for r in got) == [(0, 0), (9, 0), (9, 0), (10, 0)]
    # Of the two equal first centroids the smaller number has both vectors, and the other stays where it was.
    assert len({r.cluster for r in got}) == 3 and {r.inertia for r in got} == {0}
    assert C.with_inertia(*C.cluster_vectors(spark.createDataFrame(bad, VECTORS))).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_agrees_with_sql(spark, sf):
    from kelpline.llm.queries import QUERIES

    agree(QUERIES["op13_clusters"](spark, f"/root/testdata/{sf}"), duck(f"/root/testdata/{sf}"), ORACLE["op13_clusters"])
