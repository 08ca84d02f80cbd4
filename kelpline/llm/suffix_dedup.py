"""Removal of long repeated byte strings, by a run-length suffix index over routed contexts.

A string of LENGTH bytes has an anchor: the leftmost least of its hashed SEED-byte
substrings.  Equal strings have equal anchors at equal places, so only contexts of
one anchor (the strings that share an occurrence of it, overlapping) need be
compared, and contexts are dealt by anchor.

1. Each document's contexts are hashed.  An anchor that occurs once needs nothing more.
   Those that a slice of documents holds twice are known to occur again and aren't
   dealt by anchor; the slice sends one mark for them, so no anchor, however hot, has
   more than one row a slice there.
2. Contexts that are alike become one group with its number of copies, combined before
   the shuffle, and one of each is fetched from its document.
3. Tasks build run-compressed Burrows-Wheeler transforms of bounded size over whole
   anchors, one string a group, stream matching statistics from the sampled run ends,
   and mark the strings whose match is long enough; a group of several copies matches
   as a whole, as its copies would fill the same runs.  Where all of an anchor's groups
   do, they tell nothing of each other and aren't indexed.
4. An anchor with more groups than an index may hold is split by longer seeds: the
   strings of its contexts have anchors of 128 bytes, and where these are still hot, of
   all LENGTH, under which no two groups meet.
5. Marks go to all members of a group.  There each context's bytes are compared with
   those that were indexed, by a 128-bit digest, marks are merged per document, and the
   bytes between them kept.

Defined cases: texts are UTF-8 bytes, null is empty; a text shorter than LENGTH loses
nothing; equal rows repeat each other, so all their strings go; matches never cross
texts, and all is judged on the input.  If two contexts of one anchor had one 64-bit
hash but other bytes, the job would fail and say so, rather than take them as alike.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.run_index import RunIndex
from kelpline.llm.shingles import mix64, powers, stream
from kelpline.llm.text import require, slices
from kelpline.plans.checkpoints import checkpointed, release

LENGTH, SEED = 200, 64
#: Seeds by which hot anchors are split, one after the other.
LONGER = (128, LENGTH)
SLICE = 2 << 20
#: Groups of one anchor that go into an index, and bytes after which an index takes no further anchor.
HOT, INDEX_BYTES = 4096, 1 << 20

U = np.uint64
BYTE = stream(77, 256)


class Hashed:
    """Rolling hashes of many texts at once."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.bounds = np.cumsum([0, *map(len, texts)])
        up, self.down = powers(len(self.data) + 1)
        self.total = np.zeros(len(self.data) + 1, U)
        np.cumsum(BYTE[self.data] * up[:-1], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.total[end] - self.total[start]) * self.down[start])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row: of the two blocks that they lie in, one's end and the other's start."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    start = np.minimum.accumulate(blocks, axis=1).ravel()
    end = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(end[:n], start[width - 1 : width - 1 + n])


def contexts(texts: list[bytes], seed: int = SEED):
    """(text, first, last, anchor, context) arrays: strings starting from first to last, relative to the text, share an anchor."""
    h = Hashed(texts)
    n = len(h.data)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    if n < LENGTH:
        return none
    at = np.arange(n - seed + 1)
    seeds = h.of(at, at + seed)
    # Upper bits of the hash, then the place: of equal seeds the leftmost.
    least = sliding_least((seeds >> U(32) << U(32)) | at.astype(U), LENGTH - seed + 1)
    place = (least & U(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(place))
    text = np.repeat(np.arange(len(texts)), np.diff(h.bounds))[: len(place)]
    inside = start + LENGTH <= h.bounds[text + 1]
    start, place, text = start[inside], place[inside], text[inside]
    if not len(start):
        return none
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])))
    last = np.append(first[1:], len(start)) - 1
    a, b, p, t = start[first], start[last], place[first], text[first]
    anchor = seeds[p]
    context = h.of(a, b + LENGTH) + mix64(((p - a) << 32 | (b - a)).astype(U))
    return t, a - h.bounds[t], b - h.bounds[t], anchor, context


def occurrences(docs: DataFrame) -> DataFrame:
    """(anchor, context, row, check, first, last, times) from (row, check, text).  ``times`` is null for an occurrence whose anchor its slice
    holds twice or more; for each such anchor there is a row without a context, with 2 times."""

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            t, a, b, anchor, context = contexts(batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist())
            if not len(t):
                continue
            row, check = (batch.column(c).to_numpy()[t] for c in ("row", "check"))
            order = np.argsort(anchor, kind="stable")
            new = np.append(True, anchor[order][1:] != anchor[order][:-1])
            twice = np.zeros(len(t), bool)
            twice[order] = ~(new & np.append(new[1:], True))
            marks = order[new & twice[order]]
            out = np.concatenate([np.arange(len(t)), marks])
            mark = np.arange(len(out)) >= len(t)
            of = lambda x, kind: pa.array(x[out].astype(kind), mask=mark)
            times = pa.array(np.where(mark, 2, 1).astype(np.int32), mask=np.concatenate([twice, np.zeros(len(marks), bool)]))
            cols = [pa.array(anchor[out].view(np.int64)), pa.array(context[out].view(np.int64), mask=mark), of(row, np.int64), of(check, np.int32), of(a, np.int32), of(b, np.int32), times]
            yield pa.RecordBatch.from_arrays(cols, ["anchor", "context", "row", "check", "first", "last", "times"])

    return docs.mapInArrow(run, "anchor long, context long, row long, check int, first int, last int, times int")


def elements(lists: pa.ListArray) -> tuple[np.ndarray, list[pa.Array]]:
    """The row of each element of the lists, and the elements, by field if they are structs; a null list has none."""
    size = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    values = lists.flatten()
    return np.repeat(np.arange(len(lists)), size), values.flatten() if pa.types.is_struct(values.type) else [values]


def fetch(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(anchor, context, copies, bytes) of (anchor, context, copies, rep), with the bytes of each group's representative."""
    lists = groups.groupBy("rep.row", "rep.check").agg(F.collect_list(F.struct("anchor", "context", "copies", "rep.first", "rep.last")).alias("wanted"))
    joined = docs.join(lists, ["row", "check"])

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            of, (anchor, context, copies, first, last) = elements(batch.column("wanted"))
            cut = [raw[i][a : b + LENGTH] for i, a, b in zip(of.tolist(), first.to_pylist(), last.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([anchor, context, copies, pa.array(cut, pa.binary())], ["anchor", "context", "copies", "bytes"])

    # Equal rows yield a group several times; only one of them goes into an index.
    return joined.select("text", "wanted").mapInArrow(run, GROUP)


GROUP = "anchor long, context long, copies long, bytes binary"
MARKS = "anchor long, context long, digest binary, starts array<int>, ends array<int>"


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true values start and end (exclusive)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def digest(raw: bytes) -> bytes:
    return blake2b(raw, digest_size=16).digest()


def undecided(anchor: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Which groups, sorted by anchor, an index must tell of: those of anchors with several groups, of which one has no other copy."""
    if not len(anchor):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    size = np.diff(np.append(first, len(anchor)))
    return np.repeat((size > 1) & (np.minimum.reduceat(copies, first) == 1), size)


def indexed_marks(groups: DataFrame) -> DataFrame:
    """Rows of MARKS: where the groups' strings are repeated, from groups that are sorted by anchor in each partition."""

    def marks(rows: pa.Table):
        place = np.rec.fromarrays([rows[c].to_numpy() for c in ("anchor", "context")], names="anchor,context")
        rows = rows.take(pa.array(np.unique(place, return_index=True)[1]))
        strings, copies = rows["bytes"].to_pylist(), rows["copies"].to_numpy()
        open_ = np.flatnonzero(undecided(rows["anchor"].to_numpy(), copies))
        inside = [strings[i] for i in open_.tolist()]
        long = RunIndex.build(inside).matching_statistics(copies[open_], LENGTH) > 0 if inside else np.zeros(0, bool)
        begin = np.cumsum([0, *[len(s) + 1 for s in inside]])
        a, b = runs_of(long)
        which = np.searchsorted(begin, a, side="right") - 1
        a, b, which = a - begin[which], b - begin[which], open_[which]
        # Groups of several copies that aren't indexed match as a whole, too.
        copied = np.setdiff1d(np.flatnonzero(copies > 1), open_)
        size = np.array([len(strings[i]) for i in copied.tolist()], np.int64)
        which, a, b = (np.concatenate(x) for x in ((which, copied), (a, np.zeros_like(copied)), (b, size - LENGTH + 1)))
        order = np.argsort(which, kind="stable")
        which, a, b = which[order], a[order], b[order]
        has, first = np.unique(which, return_index=True)
        bounds = np.append(first, len(which)).astype(np.int32)
        spans = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (a, b - 1 + LENGTH)]
        some = rows.take(pa.array(has))
        cols = [some["anchor"].combine_chunks(), some["context"].combine_chunks(), pa.array([digest(strings[i]) for i in has.tolist()], pa.binary()), *spans]
        return pa.RecordBatch.from_arrays(cols, ["anchor", "context", "digest", "starts", "ends"])

    def run(batches):
        held: list[pa.Table] = []
        size = 0
        for batch in slices(batches, "bytes", INDEX_BYTES):
            part = pa.Table.from_batches([batch])
            held.append(part)
            size += part["bytes"].nbytes
            if size >= INDEX_BYTES:
                table = pa.concat_tables(held)
                last = table["anchor"].to_numpy()
                done = int(np.searchsorted(last, last[-1]))  # whole anchors only
                if done:
                    yield marks(table.slice(0, done))
                held = [table.slice(done).combine_chunks()]
                size = held[0]["bytes"].nbytes * (table.num_rows - done) // max(1, table.num_rows)
        if held and (table := pa.concat_tables(held)).num_rows:
            yield marks(table)

    return groups.mapInArrow(run, MARKS)


def shorter(groups: DataFrame, seed: int) -> DataFrame:
    """The groups' contexts cut by a longer seed: (outer_anchor, outer_context, at, anchor, context, copies, bytes)."""

    def run(batches):
        for batch in slices(batches, "bytes", SLICE // 8):
            raw = batch.column("bytes").to_pylist()
            t, a, b, anchor, context = contexts(raw, seed)
            if not len(t):
                continue
            outer = [batch.column(c).take(pa.array(t)) for c in ("anchor", "context", "copies")]
            cut = [raw[i][x : y + LENGTH] for i, x, y in zip(t.tolist(), a.tolist(), b.tolist(), strict=True)]
            cols = [outer[0], outer[1], pa.array(a.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), outer[2], pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["outer_anchor", "outer_context", "at", "anchor", "context", "copies", "bytes"])

    return groups.mapInArrow(run, f"outer_anchor long, outer_context long, at int, {GROUP}")


def marked(groups: DataFrame, seeds: tuple[int, ...] = LONGER) -> DataFrame:
    """Rows of MARKS for groups of any number; hot anchors are split by the first of ``seeds``, then by the others."""
    # The longest seed is a whole string, and an anchor's only group.
    hot = groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select(F.col("anchor").alias("h")) if seeds else None
    if hot is None or (hot := checkpointed(hot)).isEmpty():
        return indexed_marks(groups.repartition("anchor").sortWithinPartitions("anchor"))
    is_hot = F.col("anchor") == F.col("h")
    cool = groups.join(hot, is_hot, "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    parts = checkpointed(shorter(groups.join(hot, is_hot, "left_semi"), seeds[0]))
    inner = parts.groupBy("anchor", "context").agg(F.sum("copies").alias("copies"), F.max("bytes").alias("bytes"))
    again = inner.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1").select(F.col("anchor").alias("h"))
    found = marked(checkpointed(inner.join(again, is_hot, "left_semi")), seeds[1:])
    # Each part is held against the bytes that stood for it, then its marks are moved to its place.
    found = parts.join(found, ["anchor", "context"])
    shift = lambda c: F.transform(c, lambda x: (x + F.col("at")).cast("int"))
    out = found.groupBy("outer_anchor", "outer_context").agg(F.collect_list(F.struct("at", "bytes", "digest", shift("starts").alias("starts"), shift("ends").alias("ends"))).alias("parts"))
    whole = groups.select("anchor", "context", "bytes").dropDuplicates(["anchor", "context"]).join(out, (F.col("anchor") == F.col("outer_anchor")) & (F.col("context") == F.col("outer_context")))

    def run(batches):
        for batch in slices(batches, "bytes", SLICE // 8):
            rows = []
            for raw, anchor, context, ps in zip(*(batch.column(c).to_pylist() for c in ("bytes", "anchor", "context", "parts")), strict=True):
                if any(digest(p["bytes"]) != p["digest"] for p in ps):
                    raise ValueError(COLLISION)
                rows.append((anchor, context, digest(raw), [x for p in ps for x in p["starts"]], [x for p in ps for x in p["ends"]]))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["anchor", "context", "digest", "starts", "ends"])

    return indexed_marks(cool).unionByName(whole.select("anchor", "context", "bytes", "parts").mapInArrow(run, MARKS))


COLLISION = "two contexts of one anchor have one hash but other bytes; use another seed of BYTE"


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(row, check, marks: array<struct<first,last,digest,starts,ends>>) of the rows of (row, check, text) that have repeated strings."""
    seen = occurrences(docs)
    times = F.sum("times").over(Window.partitionBy("anchor"))
    dealt = seen.where("times is not null").withColumn("all", times).where("all > 1 and context is not null").drop("all")
    live = checkpointed(seen.where("times is null").unionByName(dealt).drop("times"))
    del seen, dealt, times
    release(docs.sparkSession)
    groups = live.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "check", "first", "last")).alias("rep"))
    found = checkpointed(fetch(docs, groups))
    del groups
    release(docs.sparkSession)
    marks = checkpointed(marked(found))
    del found
    release(docs.sparkSession)
    mine = live.join(marks, ["anchor", "context"])
    mine = checkpointed(mine.groupBy("row", "check").agg(F.collect_list(F.struct("first", "last", "digest", "starts", "ends")).alias("marks")))
    del live, marks
    release(docs.sparkSession)
    return mine


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, removed: array<struct<start,end>> in bytes, kept_bytes binary) for each row.

    Runs jobs while it is called: contexts that may be repeated are kept in the shared checkpoint folder.
    """
    require(df, id_col, text_col)
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # Rows go by 96 bits of hashes, equal rows by the same.
    docs = docs.withColumns({"row": F.xxhash64("doc_id", "text"), "check": F.hash("doc_id", "text")})
    spans = repeated_spans(docs.select("row", "check", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            raw = batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
            n = np.array([len(r) for r in raw], np.int64)
            row, (first, last, found, starts, ends) = elements(batch.column("marks"))
            if any(digest(raw[i][x : y + LENGTH]) != d for i, x, y, d in zip(row.tolist(), first.to_pylist(), last.to_pylist(), found.to_pylist(), strict=True)):
                raise ValueError(COLLISION)
            # Rows lie one after the other with a place between, so that spans of one row alone are merged.
            begin = np.cumsum(n + 1) - (n + 1)
            mark, (starts,) = elements(starts)
            at = (begin[row] + first.to_numpy())[mark]
            start, end = at + starts.to_numpy(), at + elements(ends)[1][0].to_numpy()
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.maximum.accumulate(end[order])
            new = np.flatnonzero(np.append(True, start[1:] > end[:-1])[: len(start)])
            start, end = start[new], end[np.append(new[1:] - 1, len(end) - 1)[: len(new)]]
            of_row = np.searchsorted(begin, start, side="right") - 1
            start, end, bounds = start - begin[of_row], end - begin[of_row], np.searchsorted(of_row, np.arange(len(raw) + 1))
            removed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (start, end)], ["start", "end"]))
            start, end, kept = start.tolist(), end.tolist(), []
            for r, i, j in zip(raw, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                kept.append(b"".join(r[x:y] for x, y in zip([0, *end[i:j]], [*start[i:j], len(r)], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), removed, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept_bytes"])

    joined = docs.join(spans, ["row", "check"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, removed array<struct<start:int,end:int>>, kept_bytes binary").withColumnRenamed("doc_id", id_col)
