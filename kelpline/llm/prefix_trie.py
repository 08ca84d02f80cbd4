"""The prefix trie of conversations, as adaptive radix trees over turn ids.

A turn's id is a digest of 16 bytes of its role and text, and a conversation's key its ids one after the other.  Equal keys are
one sequence with its number of conversations.  Sequences are dealt out in ranges of their keys; each task builds an adaptive
radix tree of its range: nodes of 4, 16, 48 or 256 children that grow as they fill, edges of many bytes held as places in a key.
Depths that are whole turns are nodes of the result; branches inside an id are not.

A prefix of a range's first or last key may go on in the next range.  These two paths (spines) are sent as one row each, with what
hangs off them already summed, and one task merges them all: two rows a range, whatever the sizes of groups.  Everything else is
final in its range; children of spine nodes get their parent's name by a join.

Defined cases: rows without a conversation id belong to none; a null role or text is empty; of turns with one number the lesser id
comes first; repeated turns are turns; remainders of negative ids are negative, as SQL has them; a table without conversations has
no nodes.  A task holds a conversation's ids (24 bytes a turn), never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.text import WORD, require
from kelpline.plans.checkpoints import checkpointed, release

#: Bytes of a turn's id.
TURN = 16
#: Conversations of one block begin with turns of its first; of those turns so many at most.
BLOCK, MOST_SHARED = 20, 3
#: Sequences in a range: so many at least, unless there are tasks to spare, and at most about so many.
LEAST_RANGE, MOST_RANGE = 4096, 100_000
#: Numbers of ids that fall into one bucket, which is joined before buckets are put in order.
BUCKET = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Sorted:
    """Up to 4 or 16 children beside their bytes in order."""

    def __init__(self, room: int = 4):
        self.room, self.bytes, self.nodes = room, bytearray(), []

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return None if at < 0 else self.nodes[at]

    def add(self, byte: int, node):
        if len(self.nodes) == self.room:
            grown = Sorted(16) if self.room == 4 else Indexed()
            for b, x in zip(self.bytes, self.nodes, strict=True):
                grown.add(b, x)
            return grown.add(byte, node)
        at = sum(b < byte for b in self.bytes)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def __iter__(self):
        return iter(self.nodes)


class Indexed:
    """Up to 48 children behind an index of 256 bytes."""

    def __init__(self):
        self.index, self.nodes = bytearray(256), []

    def get(self, byte: int):
        at = self.index[byte]
        return self.nodes[at - 1] if at else None

    def add(self, byte: int, node):
        if len(self.nodes) == 48:
            grown = Direct()
            for b, at in enumerate(self.index):
                if at:
                    grown.add(b, self.nodes[at - 1])
            return grown.add(byte, node)
        self.nodes.append(node)
        self.index[byte] = len(self.nodes)
        return self

    def __iter__(self):
        return (self.nodes[at - 1] for at in self.index if at)


class Direct:
    """A place for each byte."""

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def add(self, byte: int, node):
        self.nodes[byte] = node
        return self

    def __iter__(self):
        return (x for x in self.nodes if x is not None)


class Node:
    """An edge (bytes start to end of the key of sequence ``seq``) and what is below it.  ``ends`` is the sequence that ends here."""

    __slots__ = ("seq", "start", "end", "ends", "children", "first", "last", "n", "least", "tops", "leaves", "saved")

    def __init__(self, seq: int, start: int, end: int, ends: int = -1, children=None):
        self.seq, self.start, self.end, self.ends, self.children = seq, start, end, ends, children

    def turns(self) -> range:
        """Depths in turns that end on this edge."""
        return range(self.start // TURN + 1, self.end // TURN + 1) if self.end else range(1)


def common(a: bytes, b: bytes) -> int:
    """How many bytes two strings share at their beginnings."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


class RadixTree:
    """Adaptive radix tree of keys; a key may be a prefix of others."""

    def __init__(self, keys: list[bytes]):
        self.keys, self.root = keys, Node(0, 0, 0)
        for i in range(len(keys)):
            self.insert(i)

    def insert(self, i: int) -> None:
        key, node = self.keys[i], self.root
        while True:
            if (at := node.start + common(self.keys[node.seq][node.start : node.end], key[node.start : node.end])) < node.end:
                below = Node(node.seq, at, node.end, node.ends, node.children)
                node.end, node.ends, node.children = at, -1, Sorted().add(self.keys[node.seq][at], below)
            if len(key) == node.end:
                node.ends = i
                return
            if node.children is None:
                node.children = Sorted()
            if (child := node.children.get(key[node.end])) is None:
                node.children = node.children.add(key[node.end], Node(i, node.end, len(key), i))
                return
            node = child

    def below_first(self) -> list[Node]:
        """All nodes, parents before their children."""
        out, todo = [], [self.root]
        while todo:
            out.append(node := todo.pop())
            if node.children is not None:
                todo += node.children
        return out


COUNTS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
SPINES = ("n", "least", "kids", "leaves", "saved", "words")
RANGE_COLUMNS = ", ".join(["kind int", *(f"{c} long" for c in COUNTS), "ends_sha256 string, range int, side int, key binary", *(f"{c} array<long>" for c in SPINES), "ends array<string>"])
WHOLE, UNDER_SPINE, SPINE = range(3)
SOME_ROWS = 20_000


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _long(*names: str) -> list[pa.Field]:
    return [pa.field(n, pa.int64()) for n in names]


RANGE_SCHEMA = pa.schema([("kind", pa.int32()), *_long(*COUNTS), ("ends_sha256", pa.string()), ("range", pa.int32()), ("side", pa.int32()), ("key", pa.binary()), *((c, pa.list_(pa.int64())) for c in SPINES), ("ends", pa.list_(pa.string()))])


def range_rows(keys: list[bytes], words: list[list[int]], n: list[int], least: list[int], ends: list[str], where: int) -> Iterator[tuple]:
    """The rows of one range of sorted keys: nodes, and its spines."""
    nodes = RadixTree(keys).below_first()
    for x in reversed(nodes):
        own = x.ends
        x.first, x.last, x.n, x.least = (own, own, n[own], least[own]) if own >= 0 else (len(keys), -1, 0, None)
        x.tops = x.leaves = x.saved = 0  # of what is below the edge
        for y in x.children or ():
            depths, spine = y.turns(), y.first == 0 or y.last == len(keys) - 1
            x.first, x.last, x.n = min(x.first, y.first), max(x.last, y.last), x.n + y.n
            x.least = y.least if x.least is None else min(x.least, y.least)
            if spine:  # itself counted by the merge
                x.tops, x.leaves, x.saved = x.tops + y.tops * (not depths), x.leaves + y.leaves, x.saved + y.saved
            else:
                x.tops += 1 if depths else y.tops
                x.leaves += y.leaves or 1
                x.saved += y.saved + (y.n - 1) * sum(words[y.seq][d - 1] for d in depths)
    spines: tuple[list[tuple], list[tuple]] = ([], [])
    todo = [(nodes[0], None)]  # parents: (side, depth) of a spine's, or a name
    while todo:
        x, parent = todo.pop()
        depths, of = x.turns(), words[x.seq] if keys else []
        if x.first == 0 or x.last == len(keys) - 1:
            side = int(x.first != 0)
            for d in depths:
                bottom = d == depths[-1]
                ended = ends[x.ends] if x.ends >= 0 and d * TURN == x.end else None
                spines[side].append((d, x.n, x.least, x.tops if bottom else 0, x.leaves, x.saved, of[d - 1] if d else 0, ended))
                parent = (side, d)
        else:
            saved = x.saved + (x.n - 1) * sum(of[d - 1] for d in depths)
            for d in depths:
                bottom = d == depths[-1]
                ended = ends[x.ends] if x.ends >= 0 and d * TURN == x.end else NO_ENDS
                row = (x.n, x.tops if bottom else 1, x.leaves or 1, saved, ended)
                if isinstance(parent, tuple):
                    yield (UNDER_SPINE, x.least, d, parent[1], *row, where, parent[0], *[None] * 8)
                else:
                    yield (WHOLE, x.least, d, parent, *row, *[None] * 10)
                saved -= (x.n - 1) * of[d - 1]
                parent = x.least
        todo += ((y, parent) for y in x.children or ())
    for side, path in enumerate(spines):
        if path:
            depth, *columns = zip(*sorted(path), strict=True)
            yield (SPINE, None, depth[0], *[None] * 6, where, side, keys[-side], *map(list, columns))


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range, sorted by key."""
    table = pa.Table.from_batches(list(batches), schema=pa.schema([("key", pa.binary()), ("words", pa.list_(pa.int32())), *_long("n", "least"), ("ends", pa.string())])) if (batches := [b for b in batches if b.num_rows]) else None
    held = []
    for row in range_rows(*(table.column(c).to_pylist() for c in ("key", "words", "n", "least", "ends")), TaskContext.get().partitionId()) if table is not None else ():
        held.append(row)
        if len(held) == SOME_ROWS:
            yield as_batch(held, RANGE_SCHEMA)
            held = []
    if held:
        yield as_batch(held, RANGE_SCHEMA)


MERGED_SCHEMA = pa.schema([*_long(*COUNTS), ("ends_sha256", pa.string()), ("range", pa.int32()), ("side", pa.int32()), ("names", pa.list_(pa.int64()))])
MERGED_COLUMNS = ", ".join([*(f"{c} long" for c in COUNTS), "ends_sha256 string, range int, side int, names array<long>"])


def merge_spines(rows: list[dict]) -> Iterator[tuple]:
    """Final nodes of all spines, sorted by key, and for each spine its nodes' names from its first depth on."""
    parent, depth, n, least, kids, leaves, saved, words, ends = ([] for _ in range(9))
    path: list[int] = []  # the node at each depth of the key that is being read
    before, of_row = b"", []
    for r in rows:
        del path[common(before, r["key"]) // TURN + 1 :]
        before = r["key"]
        for i, d in enumerate(range(r["depth"], r["depth"] + len(r["n"]))):
            if d == len(path):
                path.append(len(n))
                parent.append(path[d - 1] if d else -1)
                depth.append(d)
                for column in (n, kids, leaves, saved):
                    column.append(0)
                least.append(r["least"][i])
                words.append(r["words"][i])
                ends.append(None)
            x = path[d]
            n[x] += r["n"][i]
            least[x] = min(least[x], r["least"][i])
            kids[x] += r["kids"][i]
            leaves[x] += r["leaves"][i]
            saved[x] += r["saved"][i]
            ends[x] = ends[x] or r["ends"][i]
        of_row.append(path[r["depth"] : r["depth"] + len(r["n"])])
    # Sums of spine nodes below; a parent stands before its children.
    own, spine_leaves, spine_saved = kids.copy(), [0] * len(n), [0] * len(n)
    for x in reversed(range(len(n))):
        spine_leaves[x] += own[x] == 0
        spine_saved[x] += (n[x] - 1) * words[x]
        if (p := parent[x]) >= 0:
            own[p] += 1
            spine_leaves[p] += spine_leaves[x]
            spine_saved[p] += spine_saved[x]
    for x in range(len(n)):
        yield (least[x], depth[x], least[parent[x]] if parent[x] >= 0 else None, n[x], own[x], leaves[x] + spine_leaves[x], saved[x] + spine_saved[x], ends[x] or NO_ENDS, None, None, None)
    for r, xs in zip(rows, of_row, strict=True):
        yield (None, r["depth"], *[None] * 6, r["range"], r["side"], [least[x] for x in xs])


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in merge_spines([r for b in batches for r in b.to_pylist()]):
        held.append(row)
        if len(held) == SOME_ROWS:
            yield as_batch(held, MERGED_SCHEMA)
            held = []
    if held:
        yield as_batch(held, MERGED_SCHEMA)


SEQUENCE_SCHEMA = pa.schema([("key", pa.binary()), ("words", pa.list_(pa.int32())), *_long("n", "least"), ("ends", pa.string())])


def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sequence follow each other, by ascending ids: hashes its ids as they come."""
    held, now = [], None
    key = words = sha = None
    n = least = 0

    def row():
        return (key, words, n, least, sha.hexdigest())

    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("same", "ids", "key", "words")), strict=True):
            text = ",".join(map(str, r[1])).encode()
            if r[0] == now:
                sha.update(b"," + text)
                n += len(r[1])
                continue
            if now is not None:
                held.append(row())
                if len(held) == SOME_ROWS:
                    yield as_batch(held, SEQUENCE_SCHEMA)
                    held = []
            now, n, least, key, words, sha = r[0], len(r[1]), r[1][0], r[2], r[3], hashlib.sha256(text)
    if now is not None:
        yield as_batch([*held, row()], SEQUENCE_SCHEMA)


def rebuilt(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each conversation's ``conv`` and ``turns`` (id as hex, words), its first turns taken from its block's first conversation.

    Shuffled once, by block, without texts."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    conv = F.col(conv_col).cast("long")
    turn = F.struct(F.col(turn_col).alias("turn"), F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("id"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    each = df.where(conv.isNotNull()).select((conv - conv % BLOCK).alias("block"), conv.alias("conv"), turn.alias("turn")).repartition("block")
    own = each.groupBy("block", "conv").agg(F.sort_array(F.collect_list("turn")).alias("own"))
    first = F.max(F.when(F.col("conv") == F.col("block"), F.slice("own", 1, MOST_SHARED))).over(Window.partitionBy("block"))
    shared = (F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")
    turns = F.concat(F.slice(F.coalesce(first, F.slice("own", 1, 0)), F.lit(1), shared), F.slice("own", shared + 1, F.size("own")))
    return own.select("conv", turns.alias("turns"))


def sequences(conversations: DataFrame) -> DataFrame:
    """Distinct sequences: ``key``, ``words`` by turn, ``n`` conversations, the ``least`` id, and ``ends`` (the ids' digest).

    Ids of one bucket are gathered first, so a sequence that a third of all conversations have goes on in rows of thousands."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    each = conversations.select("conv", F.floor(F.col("conv") / BUCKET).alias("bucket"), key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words")).withColumn("same", F.unhex(F.md5("key")))
    gathered = each.groupBy("same", "bucket").agg(F.sort_array(F.collect_list("conv")).alias("ids"), F.first("key").alias("key"), F.first("words").alias("words"))
    return gathered.repartition("same").sortWithinPartitions("same", "bucket").mapInArrow(join_ends, "key binary, words array<int>, n long, least long, ends string")


def ranges(n: int, cores: int) -> int:
    """In how many ranges n sequences are dealt."""
    return max(1, -(-n // MOST_RANGE), min(-(-n // LEAST_RANGE), 3 * cores))


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a node: ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``."""
    require(df, conv_col, turn_col, role_col, text_col)
    found = checkpointed(sequences(rebuilt(df, conv_col, turn_col, role_col, text_col)))
    parts = ranges(found.count(), df.sparkSession.sparkContext.defaultParallelism)
    built = checkpointed(found.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(build, RANGE_COLUMNS))
    merged = checkpointed(built.where(F.col("kind") == SPINE).select("key", "depth", "range", "side", *SPINES, "ends").repartition(1).sortWithinPartitions("key").mapInArrow(merge, MERGED_COLUMNS))
    release(df.sparkSession)
    out = (*COUNTS, "ends_sha256")
    names = merged.where(F.col("names").isNotNull()).select("range", "side", F.posexplode("names").alias("i", "name"), F.col("depth").alias("start")).select("range", "side", (F.col("start") + F.col("i")).alias("parent_depth"), "name")
    under = built.where(F.col("kind") == UNDER_SPINE).withColumnRenamed("parent_conv_id", "parent_depth").join(names, ["range", "side", "parent_depth"]).withColumnRenamed("name", "parent_conv_id")
    return built.where(F.col("kind") == WHOLE).select(*out).unionByName(under.select(*out)).unionByName(merged.where(F.col("names").isNull()).select(*out))
