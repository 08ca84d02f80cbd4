"""Clustering around centroids with distances from bit planes.

A vector of 64 integers is kept as its bit planes in two's complement: plane i packs bit i of all 64 components into one unsigned
64-bit word.  The product of two vectors is then a sum of popcounts, weighted by the planes' places:
``x . c = sum over i, j of place(i) * place(j) * popcount(x_i & c_j)``, where the top plane's place is negative.  Squared distances
follow exactly from products and norms, and sums by cluster from counts of set bits a component and plane.  Vectors are packed once,
into a checkpoint; a round reads it, and each task sends one row for each cluster and component.  Only centroids reach the driver.

Defined cases: vectors of another length, or with a null, infinite or undefined component, are left out; integers beyond
``LARGEST`` either way count as ``LARGEST``, so that each distance fits a long; a null id counts as empty when first centroids are
chosen; repeated ids and vectors are vectors of their own; of equal ids the lesser vector comes first; with fewer vectors than
``k`` each starts a cluster; an empty table gives an empty result; a sum of distances beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.text import require
from kelpline.plans.checkpoints import checkpointed, release

WIDTH = 64
LARGEST = (1 << 27) - 1
#: Vectors that are compared at a time.
BLOCK = 4096
LONG = 1 << 63


def integers(vector: Column, scale: int) -> Column:
    """The components as floor(scale * x), held within ``LARGEST``."""
    whole = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST))))
    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    """Whether there are 64 components and all are finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    return F.coalesce((F.size(vector) == WIDTH) & F.forall(vector, finite), F.lit(False))


def pack(numbers: np.ndarray) -> np.ndarray:
    """Rows of 64 integers as planes: n x planes, lowest bit first, the last plane being the sign's."""
    most = int(max(numbers.max(initial=0), -1 - numbers.min(initial=0)))
    bits = (numbers[:, None, :] >> np.arange(most.bit_length() + 1)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def places(n: int) -> np.ndarray:
    """What a set bit of each of n planes is worth."""
    worth = np.left_shift(np.int64(1), np.arange(n, dtype=np.int64))
    worth[-1] = -worth[-1]
    return worth


def products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x . c for all rows of x (n x planes) and of c (k x planes): n x k."""
    out = np.zeros((len(x), len(c)), np.int64)
    of_x, of_c = places(x.shape[1]), places(c.shape[1])
    for i in range(x.shape[1]):
        for j in range(c.shape[1]):
            out += np.bitwise_count(x[:, i, None] & c[None, :, j]).astype(np.int64) * (of_x[i] * of_c[j])
    return out


def norms(x: np.ndarray) -> np.ndarray:
    """x . x for all rows."""
    out, worth = np.zeros(len(x), np.int64), places(x.shape[1])
    for i in range(x.shape[1]):
        for j in range(i, x.shape[1]):
            out += np.bitwise_count(x[:, i] & x[:, j]).astype(np.int64) * (worth[i] * worth[j] * (1 + (i != j)))
    return out


def component_sums(x: np.ndarray) -> np.ndarray:
    """The 64 sums of all rows' components."""
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.shape[1], 8), axis=2, bitorder="little")
    return places(x.shape[1]) @ bits.sum(axis=0, dtype=np.int64)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches in pieces whose vectors all have the same planes; shorter ones repeat their sign's."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            planes = part.column("planes")
            ends = np.asarray(planes.offsets)
            flat, sizes = np.asarray(planes.flatten()).view(np.uint64), np.diff(ends)
            column = np.minimum(np.arange(sizes.max())[None, :], sizes[:, None] - 1)
            yield part, flat[(ends[:-1] - ends[0])[:, None] + column]


def nearest(part: pa.RecordBatch, x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid, the first of equals, and its squared distance."""
    c = pack(centroids)
    far = np.asarray(part.column("norm"))[:, None] - 2 * products(x, c) + norms(c)[None, :]
    best = far.argmin(axis=1)
    return best, far[np.arange(len(far)), best]


def packed(df: DataFrame) -> DataFrame:
    """``id`` and ``numbers`` (64 longs) as ``id``, ``planes`` and ``norm``."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = pack(np.asarray(part.column("numbers").flatten()).reshape(-1, WIDTH))
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                planes = pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), planes, pa.array(norms(x))], ["id", "planes", "norm"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, planes array<long>, norm long")


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """For each cluster with vectors: how many, and the sums of their components."""

    def run(batches):
        n, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), WIDTH), np.int64)
        for part, x in blocks(batches):
            best, _ = nearest(part, x, centroids)
            for k in np.unique(best):
                n[k] += (own := best == k).sum()
                sums[k] += component_sums(x[own])
        has = np.repeat(n > 0, WIDTH)
        columns = (np.repeat(np.arange(len(n), dtype=np.int32), WIDTH), np.tile(np.arange(WIDTH, dtype=np.int32), len(n)), np.repeat(n, WIDTH), sums.reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(x[has]) for x in columns], ["cluster", "place", "n", "total"])

    each = vectors.mapInArrow(run, "cluster int, place int, n long, total long")
    found: dict[int, tuple[int, list[int]]] = {}
    for r in each.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        found.setdefault(r.cluster, (r.n, [0] * WIDTH))[1][r.place] = int(r.total)
    return found


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``id``, ``cluster`` and ``distance`` of each vector."""

    def run(batches):
        for part, x in blocks(batches):
            best, far = nearest(part, x, centroids)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(best.astype(np.int32)), pa.array(far)], ["id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """The vectors' clusters as ``id_col``, ``cluster`` and ``distance`` (squared), and the centroids (k x 64).

    The first centroids are the vectors with the least sha256 of ``seed:id``.  Each round assigns all vectors to their nearest
    centroid and moves each centroid that has any to the floor of their mean; then all are assigned once more.
    """
    require(df, id_col, vector_col)
    given = df.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), integers(F.col(vector_col), scale).alias("numbers"))
    lot = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = given.orderBy(lot, "numbers").limit(k).collect()
    centroids = np.array([r.numbers for r in first], np.int64).reshape(-1, WIDTH)
    vectors = checkpointed(packed(given))
    for _ in range(rounds if len(first) else 0):
        for i, (n, sums) in cluster_sums(vectors, centroids).items():
            centroids[i] = [s // n for s in sums]
    release(df.sparkSession)
    return assigned(vectors, centroids).withColumnRenamed("id", id_col), centroids


def with_inertia(clusters: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``cluster_inertia`` and ``inertia``, the distances' sums, and ``centroid_sha256``."""
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: int(r.total) for r in clusters.groupBy("cluster").agg(total.alias("total")).collect()}
    long = lambda n: F.lit(n if n < LONG else None).cast("long")
    own, sha = F.lit(None).cast("long"), F.lit(None).cast("string")
    for i, n in sorted(sums.items()):
        own, sha = F.when(F.col("cluster") == i, long(n)).otherwise(own), F.when(F.col("cluster") == i, digest(centroids[i])).otherwise(sha)
    return clusters.withColumns({"cluster_inertia": own, "inertia": long(sum(sums.values())), "centroid_sha256": sha})
