"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces.

A text's lines are its leaves in order: lines with a word are paragraphs, runs of
lines without one are gaps.  A gap, or a paragraph whose hash falls on one in SECTION,
ends a section.  Long paragraphs are nodes over several pieces, cut after words whose
hash falls on one in CUT, so an edit moves no cut but those beside it.  Every node's
hash is over its children's hashes alone, and the root's over sections and gaps, so a
tree can be put together from parts.  Kinds of nodes hash apart, with 128 bits: roots
are equal if and only if texts are.  Comparing trees from the top, only differing
branches are entered, down to the pieces that an edit changed.

As text a fingerprint is the root's hash and, for each section, paragraph and piece,
its hash and size, and for each gap too:  ``root|sectionhash(paragraphhash(piece:size,...),...),~gaphash:size``.

Defined cases: null is the empty text, whose tree has one gap; equal texts have equal
fingerprints; likeness is 1 for equal roots, and two texts without a common part have
0; documents that share an id follow each other by their texts, and a null id comes last.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.text import require, slices
from kelpline.plans.checkpoints import checkpointed

SECTION, CUT = 8, 12
#: Bytes of a hash.
WIDTH = 16
#: Code points in which a piece must have its end if a word can be ended there.
PIECE = 1024

_WORDS = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def digest(kind: bytes, data: bytes) -> str:
    return blake2b(data, digest_size=WIDTH, person=kind).hexdigest()


def over(kind: bytes, children) -> str:
    """The hash of a node over its children's."""
    return digest(kind, "".join([c[0] for c in children]).encode())


def pieces(paragraph: str) -> list[str]:
    out, start = [], 0
    for m in _WORDS.finditer(paragraph):
        end = m.end()
        if end - start >= PIECE or (end - start >= 24 and sum(m[0].encode()) * 2654435761 % (1 << 32) < (1 << 32) // CUT):
            out.append(paragraph[start:end])
            start = end
    if start < len(paragraph):
        out.append(paragraph[start:])
    return out


#: A root, and below it sections (hash, size, paragraphs) and gaps (hash, size, ()); a paragraph is (hash, size, pieces), a piece (hash, size).
Tree = tuple[str, list]
BLANK = " \t\r\x0b\x0c"


def tree(text: str) -> Tree:
    top, section, gap = [], [], []

    def end_section():
        if section:
            top.append((over(b"section", section), sum(p[1] for p in section), section.copy()))
            section.clear()

    def end_gap():
        if gap:
            blank = "\n".join(gap)
            top.append((digest(b"gap", blank.encode()), len(blank) + 1, ()))
            gap.clear()

    for line in text.split("\n"):
        if not line.strip(BLANK):
            end_section()
            gap.append(line)
            continue
        end_gap()
        leaves = [(digest(b"piece", x.encode()), len(x)) for x in pieces(line)]
        name = over(b"paragraph", leaves)
        section.append((name, len(line), leaves))
        if int(name[:8], 16) % SECTION == 0:
            end_section()
    end_section()
    end_gap()
    return over(b"root", top), top


def written(t: Tree) -> str:
    leaf = lambda x: f"{x[0]}:{x[1]}"
    paragraph = lambda p: f"{p[0]}({','.join(map(leaf, p[2]))})" if len(p[2]) > 1 else leaf(p)
    return f"{t[0]}|" + ",".join(f"{s[0]}({','.join(map(paragraph, s[2]))})" if s[2] else f"~{leaf(s)}" for s in t[1])


def _unmatched(left: list, right: list) -> tuple[int, list, list]:
    """The size of what two lists of nodes share by hash, and the nodes that differ."""
    mine, theirs = Counter(x[0] for x in left), Counter(x[0] for x in right)
    shared = mine & theirs
    size, rest = 0, []
    take = Counter(shared)
    for x in left:
        if take[x[0]]:
            take[x[0]] -= 1
            size += x[1]
        else:
            rest.append(x)
    take, other = Counter(shared), []
    for x in right:
        if take[x[0]]:
            take[x[0]] -= 1
        else:
            other.append(x)
    return size, rest, other


def likeness(a: Tree, b: Tree) -> float:
    """2 * shared size / both sizes, entering only branches that differ."""
    if a[0] == b[0]:
        return 1.0
    total = sum(s[1] for s in a[1]) + sum(s[1] for s in b[1])
    shared, left, right = _unmatched(a[1], b[1])
    for _ in range(2):
        size, left, right = _unmatched([p for s in left for p in s[2]], [p for s in right for p in s[2]])
        shared += size
    return 2 * shared / total if total else 0.0


def differing(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """(section, paragraph) places of a's paragraphs that b hasn't: where an edit lies."""
    if a[0] == b[0]:
        return []
    theirs = {s[0] for s in b[1]}
    known = {p[0] for s in b[1] for p in s[2]}
    return [(i, j) for i, s in enumerate(a[1]) if s[0] not in theirs for j, p in enumerate(s[2]) if p[0] not in known]


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, root, fingerprint) for each row; no shuffle."""
    require(df, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "text"):
            trees = [tree(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([t[0] for t in trees]), pa.array([written(t) for t in trees])], ["id", "root", "fingerprint"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, root string, fingerprint string").withColumnRenamed("id", id_col)


#: Size of tables of ranges up to which they are sent to all executors.
BROADCAST_BYTES = 64 << 20
#: Bytes of text in a range of ids, which is one task's stretch of the ring, as long as there are fewer than so many ranges a
#: core (several may fall into one task), and beyond; and coarse ranges at most: a coarse range has as many fine ones as it takes.
FEW_BYTES, PER_CORE, RANGE_BYTES, COARSE = 1 << 20, 16, 64 << 20, 1024


def in_ring(docs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """Rows (range, doc_id, text, copy) in descending order of doc_id within each range, each range followed by a
    copy of the row that comes after its last one; after the last range's last row, that is the first row of all.

    ``doc_id`` must be an integer or null.  Ranges are cut at approximate quantiles, which only balance them: the
    driver gets those of at most COARSE ranges, those within them stay in a table of numbers.  Text is shuffled once.
    """
    if n_ranges is None:
        size = docs.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
        n_ranges = 1 + max(size // RANGE_BYTES, min(size // FEW_BYTES, PER_CORE * docs.sparkSession.sparkContext.defaultParallelism))
    coarse = min(n_ranges, COARSE)
    per = -(-n_ranges // coarse)
    at = [i / coarse for i in range(1, coarse)]
    cuts = sorted({int(c) for c in docs.approxQuantile("doc_id", at, max(0.1 / coarse, 0.0005))}, reverse=True) if at else []
    # Coarse range k has the ids over cuts[k] and not over cuts[k - 1]; a null id comes in the last.
    # Found in two steps, so a row is held against about twice the root of their number.
    step = max(1, round(len(cuts) ** 0.5))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.array().cast("array<long>")
    above = lambda a: F.size(F.filter(a, lambda c: F.col("doc_id") <= c))
    docs = docs.withColumn("first", above(longs(cuts[::step])))
    place = F.when(F.col("first") == 0, 0).otherwise((F.col("first") - 1) * step + above(F.slice(longs(cuts), (F.col("first") - 1) * step + 1, step)))
    ranged = docs.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(place).cast("long")).drop("first")
    if per > 1:
        # Fine cuts by coarse range: a row a range, as wide as the coarse range has fine ones.
        fine = ranged.where("doc_id is not null").groupBy("range").agg(F.percentile_approx("doc_id", [i / per for i in range(1, per)], 20 * per).alias("fine"))
        fine = checkpointed(fine.select(F.col("range").alias("r"), F.reverse("fine").alias("fine")))
        ranged = ranged.join(F.broadcast(fine) if n_ranges * 8 <= BROADCAST_BYTES else fine, F.col("range") == F.col("r"), "left")
        ranged = ranged.withColumn("range", F.col("range") * per + F.when(F.col("doc_id").isNull(), per - 1).otherwise(F.coalesce(above(F.col("fine")), F.lit(0)))).drop("r", "fine")
    # One row a range: its head, and the range before it that isn't empty; before the first comes the last.
    heads = checkpointed(ranged.groupBy("range").agg(F.max("doc_id").alias("head")))
    order = Window.partitionBy(F.lit(0)).orderBy("range")
    heads = heads.select(F.col("range").alias("r"), "head", F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy(F.lit(0)))).alias("before"))
    # The first row of each range: of rows that share its id the one with the least text.
    if n_ranges * 24 <= BROADCAST_BYTES:
        heads = F.broadcast(heads)
    first = ranged.join(heads, (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("head")))
    first = first.groupBy("before", "doc_id").agg(F.min(F.struct(F.col("text").isNotNull(), F.col("text"))).alias("t"))
    first = first.select(F.col("before").alias("range"), "doc_id", F.col("t.text").alias("text"), F.lit(True).alias("copy"))
    both = ranged.select("range", "doc_id", "text", F.lit(False).alias("copy")).unionByName(first)
    return both.repartition(n_ranges, "range").sortWithinPartitions("range", "copy", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_ranges: int | None = None) -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The edited text has the last half of a text's code points replaced by the first as many of the next text,
    in descending order of ids around the ring.
    """
    from hashlib import sha256

    require(df, id_col, text_col)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        held = None  # the row that waits for its next one: range, id, text, tree
        for batch in slices(batches, "text"):
            out = []
            for r, i, t, copy in zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "text", "copy")), strict=True):
                t = t or ""
                mine = tree(t)
                if held is not None and held[0] == r:
                    text, half = held[2], len(held[2]) // 2
                    edited = text[: len(text) - half] + t[:half]
                    changed = tree(edited)
                    out.append((held[1], len(text), sha256(edited.encode()).hexdigest(), written(held[3]), written(changed), likeness(held[3], changed), likeness(held[3], mine)))
                held = None if copy else (r, i, t, mine)
            if out:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    shape = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_ring(docs, n_ranges).mapInArrow(run, shape).withColumnRenamed("doc_id", id_col)
