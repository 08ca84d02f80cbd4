"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Each source's documents are put in a pseudo-random order by a seeded hash and
   laid end to end, as words, on a line of ``source_size`` words.  The line is cut
   into blocks.
2. Targets come from the weights, with a ceiling on repeats; a source's quota is
   its number of draws of blocks, pass after pass over its line.
3. The draws of all sources are split exactly among the output shards: at each
   node of a binary tree the draws of the left half are one multivariate
   hypergeometric sample.  A shard walks from the root to its leaf; nodes seed
   their own generators, so all shards agree, and no task holds the tree.
4. A seeded permutation deals a source's draws to the shards' ranges, so ranges
   are disjoint and mixed; within a shard rows are ordered by a hash.

Defined cases: a null or empty text has size 0 and is never taken; a null source
is a source, the last one; a source without words has target 0; repeated rows
are documents of their own; an empty table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.text import WORD, require

WEIGHTS = (3.0, 1.0, 2.0)
#: Words in a block, and about how many blocks a shard gets.
BLOCK, PER_SHARD = 4096, 4096
#: Sources that a mix may have: their quotas travel as one array.
MOST_SOURCES = 1_000_000
#: Documents that one range of a source's line holds on average; ranges are summed, then summed up.
PER_RANGE = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From (source, source_size) the columns source, source_size, rank, target.

    The target is min(most * size, level * weight) with the level at which all
    targets add up: what a full source can't take goes to the others by weight.
    Windows run over one row a source.
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    a = sizes.withColumn("rank", F.row_number().over(by_code_point) - 1)
    a = a.withColumn("weight", F.get(table, F.col("rank") % len(weights))).withColumn("cap", F.col("source_size") * float(most))
    # In the order in which sources fill up, the level that holds if all before are full rises up to the first
    # source that isn't, and falls after it: the highest is the one.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    a = a.withColumn("goal", F.sum("source_size").over(whole) * float(share)).withColumn("weights", F.sum("weight").over(whole))
    a = a.withColumn("level", (F.col("goal") - F.coalesce(F.sum("cap").over(filling), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(filling), F.lit(0.0))))
    return a.select("source", "source_size", "rank", F.least("cap", F.max("level").over(whole) * F.col("weight")).alias("target"))


def lay_out(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, told_by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, source, size, tie, start, copy): where each document's words start on its source's line, a hash of its
    text (and of ``told_by``), and a number that tells rows apart which are equal in all of these, also those without words."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col, *told_by).alias("tie"))
    docs = docs.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "tie"))
    # Ranges of the key's upper bits, as many as the source's documents ask for; each is small however large the source.
    # Grouped by the finest range first, so that nothing is gathered by source alone.
    fine = F.shiftrightunsigned("key", 44).alias("fine")
    per = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / PER_RANGE))).cast("int")
    per = per.withColumn("bits", F.least(bits, F.lit(20)))
    docs = docs.withColumn("fine", fine).join(per.select(F.col("source").alias("s"), "bits"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    docs = docs.withColumn("range", F.expr("shiftright(fine, 20 - bits)"))
    ranges = docs.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "tie")
    docs = docs.withColumns({"start": F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "copy": F.row_number().over(within)})
    docs = docs.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    return docs.select("doc_id", "source", "size", "tie", (F.col("start") + F.col("base")).alias("start"), "copy")


#: Populations that numpy draws from.
MOST_NUMPY = 1_000_000_000


def large_hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` are good, by ratios of uniforms: accepted under the probability itself, from logarithms of factorials.

    The hat is the usual one for such distributions, of a width that follows from the variance; half of all tries are accepted."""
    total = good + bad
    share = good / total
    mode = (draws + 1) * (good + 1) // (total + 2)
    spread = math.sqrt((total - draws) * draws * share * (1 - share) / max(1, total - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    low, high = max(0, draws - bad), min(good, draws)
    log = lambda k: -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(draws - k + 1) + math.lgamma(bad - draws + k + 1))
    top = log(mode)
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(draws * share + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= log(k) - top:
            return k


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    return int(rng.hypergeometric(good, bad, draws)) if good < MOST_NUMPY and bad < MOST_NUMPY else large_hypergeometric(rng, good, bad, draws)


def split_path(counts: np.ndarray, shard: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """What a shard gets of each source, and how many draws of each source go to the shards before it."""
    lo, hi, before, node = 0, shards, np.zeros(len(counts), np.int64), 1
    counts = counts.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, node])
        want, left, rest = int(counts.sum()) * (mid - lo) // (hi - lo), np.zeros(len(counts), np.int64), int(counts.sum())
        for i, n in enumerate(counts.tolist()):  # one source after the other, given what is left
            rest -= n
            left[i] = hypergeometric(rng, n, rest, want) if 0 < want and n and rest else min(n, want)
            want -= int(left[i])
        if shard < mid:
            counts, hi, node = left, mid, 2 * node
        else:
            before, counts, lo, node = before + left, counts - left, mid, 2 * node + 1
    return counts, before


def permuted(draws: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A permutation of 0 .. n-1 at some places: four Feistel rounds, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), draws.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in range(4):
            mixed = (right + np.uint64((seed * 4 + k + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - half) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def shard_draws(targets: DataFrame, seed: int, block: int, per_shard: int) -> DataFrame:
    """Rows (shard, source, pass, block, turn): which blocks each shard draws; a turn orders a shard's blocks."""
    src = targets.withColumn("words", F.round("target").cast("long")).where("words > 0")
    src = src.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    full = F.expr("words div source_size")
    src = src.withColumn("quota", full * F.col("blocks") + F.ceil((F.col("words") - full * F.col("source_size")) / block)).select("rank", "source", "blocks", "quota")
    one = src.agg(F.sort_array(F.collect_list(F.struct("rank", "source", "blocks", "quota"))).alias("sources"), F.sum("quota").alias("draws"))
    one = one.where("draws is not null").withColumn("guard", F.when(F.size("sources") > MOST_SOURCES, F.raise_error(F.lit("too many sources"))))
    one = one.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("draws") / per_shard)).cast("long"))
    one = one.where("guard is null")
    # One row of at most MOST_SOURCES quotas goes to all tasks; the shards' numbers alone are dealt out.
    each = one.select(F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")).repartition("shard")
    each = each.join(F.broadcast(one.select("sources", "shards")), F.lit(True))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for sources, shards, shard in zip(frame["sources"], frame["shards"], frame["shard"], strict=True):
                quota = np.array([s["quota"] for s in sources], np.int64)
                mine, before = split_path(quota, int(shard), int(shards), seed)
                drawn = []
                for i in np.flatnonzero(mine):
                    s, n, first = sources[i], int(mine[i]), int(before[i])
                    draws = permuted(np.arange(first, first + n), s["quota"], seed + s["rank"])
                    turn = (draws * 0x9E3779B1 + s["rank"] * 0x85EBCA77 + seed) % (1 << 32)
                    drawn.append(pd.DataFrame({"shard": shard, "source": s["source"], "pass": draws // s["blocks"], "block": draws % s["blocks"], "turn": turn}))
                if drawn:
                    yield pd.concat(drawn)

    return each.mapInPandas(run, "shard long, source string, pass long, block long, turn long")


def mix(df: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, block: int = BLOCK, per_shard: int = PER_SHARD, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", told_by: tuple[str, ...] = ()) -> DataFrame:
    """The mix as pieces of documents: doc_id, tie, source, size, source_size, target, and for a piece that
    is taken shard, pass, turn, first (word of the document) and words; a document without a piece has
    one row with nulls there.  ``tie`` tells rows of one id with different texts (or ``told_by``) apart.

    A piece is what a block holds of a document.  The draws end at the exact word of the target.
    """
    require(df, id_col, text_col, source_col)
    laid = lay_out(df, id_col, text_col, source_col, seed, told_by)
    sizes = laid.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    draws = shard_draws(targets, seed, block, per_shard)
    info = targets.select(F.col("source").alias("s"), "source_size", "target")
    docs = laid.join(info, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("row", F.xxhash64("doc_id", "tie", "start"))
    last = F.greatest(F.col("start"), F.col("start") + F.col("size") - 1)
    cut = docs.withColumn("b", F.explode(F.sequence(F.expr(f"start div {block}"), F.floor(last / block))))
    d = draws.select("shard", F.col("source").alias("ds"), F.col("pass").alias("p"), F.col("block").alias("db"), "turn")
    # Where the piece and the words that this pass may take overlap.
    got = cut.join(d, F.col("source").eqNullSafe(F.col("ds")) & (F.col("b") == F.col("db")), "left")
    ends = F.least(F.col("source_size"), F.round("target").cast("long") - F.col("p") * F.col("source_size"))
    got = got.withColumn("from", F.greatest(F.col("start"), F.col("b") * block)).withColumn("to", F.least(F.col("start") + F.col("size"), (F.col("b") + 1) * block, ends))
    taken = F.col("shard").isNotNull() & (F.col("to") > F.col("from"))
    some = lambda c: F.when(taken, c)
    return got.select(
        "doc_id", "tie", "source", "size", "source_size", "target", "start", "copy",
        some(F.col("shard")).alias("shard"), some(F.col("p")).alias("pass"), some(F.col("turn")).alias("turn"),
        some(F.col("from") - F.col("start")).alias("first"), F.coalesce(some(F.col("to") - F.col("from")), F.lit(0)).alias("words"),
    )


def taken(mixed: DataFrame) -> DataFrame:
    """One row a document: doc_id, tie, start, source, size, source_size, target, taken (words, repeats counted)."""
    return mixed.groupBy("doc_id", "tie", "source", "start", "copy").agg(*[F.first(c).alias(c) for c in ("size", "source_size", "target")], F.sum("words").alias("taken"))


def repeat_whole(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as whole rows with the input's columns, each as often as it is taken; where a target ends inside a document,
    it is taken if at least half of its words are.  Rows without words, and those that the mix has no room for, don't
    come out.  Columns go by place, so their names may be any.
    """
    require(df, id_col, text_col, source_col)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    key, text, source = (f"c{df.columns.index(c)}" for c in (id_col, text_col, source_col))
    # Rows that are equal in all columns are alike: what is taken of them is summed up, and one of them is repeated.
    told_by = tuple(c for c, t in plain.dtypes if "map<" not in t and "variant" not in t)
    got = taken(mix(plain, id_col=key, text_col=text, source_col=source, told_by=told_by, **how)).where("taken > 0")
    times = got.groupBy(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("tie").alias("m_tie")).agg(F.sum(F.round(F.col("taken") / F.col("size")).cast("int")).alias("m_times"))
    rows = plain.withColumn("m_key", F.xxhash64(text, *told_by)).dropDuplicates([key, source, "m_key"])
    rows = rows.join(times.where("m_times > 0"), F.col(key).eqNullSafe(F.col("m_id")) & F.col(source).eqNullSafe(F.col("m_source")) & (F.col("m_key") == F.col("m_tie")))
    return rows.withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.col("m_times")))).select(plain.columns).toDF(*df.columns)
