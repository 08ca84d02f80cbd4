"""MinHash near-duplicates by a multi-index Hamming join, confirmed on full shingle sets.

A document's signature has 64 symbols of 16 bits, in 16 chunks of four.  Two
signatures that differ in at most 31 symbols have, by the pigeonhole principle,
a chunk with at most one error; each chunk is therefore indexed under its four
ways to leave one symbol out, and every pair within that distance shares a key.
Pairs farther apart that share one are tried as well: at a similarity of 0.75 a
symbol differs with probability 1/4, and no chunk of 16 is left with at most one
error in about one pair of two thousand millions.

1. Documents with one shingle set are one node; only nodes are indexed.
2. In each key's bucket, all nodes are tried against the most central one: that
   whose own buckets hold the most nodes, as the origin of edited copies does.
3. Where a bucket still holds several components, nodes of different components
   are compared inside the task, in blocks of bounded size.  Nodes of a bucket with
   more than BLOCK are dealt out once more, by two symbols of either one of the next
   two chunks (the first follows the last).  This loses no pair within the distance:
   if each chunk with at most one error had two after it with three or more each,
   such three had six errors or more, each other chunk two, and all of them 32.
4. Before texts are fetched, pairs are bounded by their parities: a bit a range of
   hashes tells whether a set has an odd number of them, so two sets differ in at
   least as many hashes as their parities differ in bits.  Only pairs that can't be
   as similar as asked are left out.
5. Candidates are confirmed on the sets of their whole texts, and components of
   confirmed links are labelled with the least document id.

Nothing is capped, and a large bucket never yields all its pairs: what it links
in step 2 isn't compared in step 3.

Sets are of 64-bit hashes, and sets with one 64-bit fingerprint count as equal.
Defined cases: words are runs of anything but ASCII white space, A-Z in lower
case; a text with fewer words than a shingle has all of them as one; null and
empty texts have no shingles and are linked with nothing; a null id is the least
of none and gets no component; rows that share an id are judged by their texts.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpline.llm import shingles
from kelpline.llm.text import require, slices
from kelpline.operators.components import connected_components
from kelpline.plans.checkpoints import checkpointed, release

WIDTH, SIMILARITY = 5, (3, 4)
SYMBOLS, CHUNK = 64, 4
CHUNKS = SYMBOLS // CHUNK
#: Differences of two signatures that the index finds for certain, in buckets of any size.
REACH = 2 * CHUNKS - 1
#: Nodes of one side of a block in a bucket.
BLOCK = 4096
SLICE = 2 << 20
#: Sets at most whose components are broadcast.
MANY = 10_000

HASHES = shingles.stream(101, SYMBOLS) | np.uint64(1)
U = np.uint64


def signature(distinct: np.ndarray) -> np.ndarray:
    """The 16-bit symbols of a set of hashes."""
    low = np.full(SYMBOLS, U(2**64 - 1))
    for at in range(0, len(distinct), 4096):
        low = np.minimum(low, (HASHES[:, None] * distinct[None, at : at + 4096]).min(axis=1))
    return (shingles.mix64(low) & U(0xFFFF)).astype("<u2")


#: Bytes of a parity that pairs are first compared by; a whole one has at least two bits a hash.
FOLDED = 128


def parity(distinct: np.ndarray) -> bytes:
    """A bit for each range of low bits of a set's hashes: whether there is an odd number of them."""
    bits = max(8 * FOLDED, 1 << (2 * len(distinct) - 1).bit_length())
    odd = np.bincount((distinct & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def fold(whole: bytes, size: int) -> np.ndarray:
    """A parity over fewer ranges: each takes the parities of those that fall together."""
    # Ranges are numbers modulo the number of ranges, so these are what stands one size apart.
    return np.bitwise_xor.reduce(np.frombuffer(whole, np.uint8).reshape(-1, size), axis=0)


def may_link(size_a: np.ndarray, size_b: np.ndarray, whole_a: list[bytes], whole_b: list[bytes], folded_a: np.ndarray | None = None, folded_b: np.ndarray | None = None) -> np.ndarray:
    """Whether pairs can be as similar as asked, by bounds that never leave out one that is: with s hashes in both sets
    together and d in one only, s - d over s + d is the similarity."""
    least, full = SIMILARITY
    most = (size_a + size_b) * (full - least) / (full + least)
    ok = full * np.minimum(size_a, size_b) >= least * np.maximum(size_a, size_b)
    at = np.flatnonzero(ok)
    if not len(at):
        return ok
    if folded_a is None:
        folded_a, folded_b = (np.stack([fold(whole[i], FOLDED) for i in at]) for whole in (whole_a, whole_b))
    else:
        folded_a, folded_b = folded_a[at], folded_b[at]
    ok[at] = np.bitwise_count(folded_a ^ folded_b).sum(axis=1) <= most[at]
    for i in np.flatnonzero(ok).tolist():
        x, y = whole_a[i], whole_b[i]
        if (size := min(len(x), len(y))) > FOLDED:
            ok[i] = np.bitwise_count(fold(x, size) ^ fold(y, size)).sum() <= most[i]
    return ok


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """The 64 index keys of each signature: chunk, symbol left out, and the three that stay."""
    s = signatures.reshape(-1, CHUNKS, CHUNK).astype(np.int64)
    out = np.empty((len(s), CHUNKS, CHUNK), np.int64)
    for gone in range(CHUNK):
        a, b, c = (s[:, :, k] for k in range(CHUNK) if k != gone)
        out[:, :, gone] = (np.arange(CHUNKS) * CHUNK + gone) << 48 | a << 32 | b << 16 | c
    return out.reshape(len(s), SYMBOLS)


#: Symbols of a chunk that stay with two errors allowed, and the chunks after a key's own that they are taken from.
STAY, AFTER = tuple(combinations(range(CHUNK), 2)), (1, 2)


def second_keys(keys: np.ndarray, signatures: np.ndarray) -> np.ndarray:
    """The further keys of signatures in large buckets, each row's by its bucket's key: which chunk after that of the key, the two
    symbols that stay, and their values."""
    s = signatures.reshape(-1, CHUNKS, CHUNK).astype(np.int64)
    chunk, rows = keys // (CHUNK << 48), np.arange(len(s))
    out = np.empty((len(s), len(AFTER), len(STAY)), np.int64)
    for i, after in enumerate(AFTER):
        of = s[rows, (chunk + after) % CHUNKS]
        for j, (a, b) in enumerate(STAY):
            out[:, i, j] = (i * len(STAY) + j) << 32 | of[:, a] << 16 | of[:, b]
    return out.reshape(len(s), -1)


def node_of(distinct: np.ndarray) -> int:
    """A 64-bit fingerprint of a set of hashes."""
    total = shingles.mix64(distinct ^ U(0x5851F42D4C957F2D)).sum(dtype=U) + U(len(distinct))
    return int(shingles.mix64(np.array([total]))[0].astype(np.int64))


def sketch(docs: DataFrame, signatures: bool = True) -> DataFrame:
    """(doc_id, n_shingles, node, signature, parity) of (doc_id, text); the last three are null for a text without words,
    and the last two left out without ``signatures``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            found = shingles.word_shingles(batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist(), WIDTH)
            n, node, sig, odd = [], [], [], []
            for i in range(batch.num_rows):
                d = found.distinct(i)
                n.append(len(d))
                node.append(node_of(d) if len(d) else None)
                if not signatures:
                    continue
                sig.append(signature(d).tobytes() if len(d) else None)
                odd.append(parity(d) if len(d) else None)
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64())]
            cols += [pa.array(sig, pa.binary()), pa.array(odd, pa.binary())] * signatures
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "node", "signature", "parity"][: len(cols)])

    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, node long" + ", signature binary, parity binary" * signatures)


def index_keys(nodes: DataFrame) -> DataFrame:
    """(key, node) for each of a node's keys."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                b = batch.slice(at, 8192)
                sig = np.frombuffer(b"".join(b.column("signature").to_pylist()), "<u2").reshape(-1, SYMBOLS)
                node = np.repeat(b.column("node").to_numpy(), SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array(keys_of(sig).ravel()), pa.array(node)], ["key", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "key long, node long")


def near_pairs(bucket: np.ndarray, key: np.ndarray, second: np.ndarray, wide: np.ndarray, side: np.ndarray, label: np.ndarray, size: np.ndarray, sig: np.ndarray, whole: list[bytes]):
    """Places (i, j) of rows in one bucket, sorted by bucket, that differ in label and may be linked; two rows that share
    several buckets count in one of them.

    ``bucket`` tells buckets apart, by the numbers of their keys, ``second`` being -1 where there is one key; ``wide`` has a bit for
    each of a row's keys that leads to a large bucket; ``side`` is -1, or 0 and 1 where only pairs across sides count.
    """
    least, full = SIMILARITY
    live, i, j, step = np.arange(len(key)), [], [], 1
    while True:
        live = live[live + step < len(key)]
        live = live[(bucket[live] == bucket[live + step])]
        if not len(live):
            break
        a, b = live, live + step
        ok = (label[a] != label[b]) & (full * np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b])) & ((side[a] < 0) | (side[a] != side[b]))
        i.append(a[ok])
        j.append(b[ok])
        step += 1
    if not i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(i), np.concatenate(j)
    folded = np.stack([fold(w, FOLDED) for w in whole])
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 16384):
        a, b = i[at : at + 16384], j[at : at + 16384]
        first = np.flatnonzero(counts_here((sig[a] == sig[b]).reshape(-1, CHUNKS, CHUNK), wide[a], key[a], second[a]))
        a, b = a[first], b[first]
        keep[at + first] = may_link(size[a], size[b], [whole[x] for x in a.tolist()], [whole[x] for x in b.tolist()], folded[a], folded[b])
    return i[keep], j[keep]


def counts_here(agree: np.ndarray, wide: np.ndarray, key: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether pairs, given by the symbols in which they agree, count in this bucket: the first small one that they share, or, if
    they share none, the first part of a large one."""
    n = len(agree)
    hits = (agree.sum(axis=2)[:, :, None] - agree == CHUNK - 1).reshape(n, SYMBOLS)  # the others of the chunk agree
    large = (wide.astype(U)[:, None] >> np.arange(SYMBOLS, dtype=U) & U(1)).astype(bool)
    small = hits & ~large
    here = (second < 0) & (small.argmax(axis=1) == key)
    if len(split := np.flatnonzero((second >= 0) & ~small.any(axis=1))):
        stay = np.stack([np.roll(agree[split], -after, axis=1)[:, :, pair].all(axis=2) for after in AFTER for pair in map(list, STAY)], axis=2)
        parts = (hits & large)[split].reshape(-1, CHUNKS, CHUNK, 1) & stay[:, :, None, :]
        here[split] = parts.reshape(len(split), -1).argmax(axis=1) == key[split] * stay.shape[2] + second[split]
    return here


def blocked_pairs(members: DataFrame) -> DataFrame:
    """(a, b) from (key, second, i, j, wide, side, node, label, size, signature, parity), sorted by the first four in each partition."""
    bucket_of = ("key", "second", "i", "j")

    def run(batches):
        held: pa.Table | None = None

        def emit(table: pa.Table):
            place = [table[c].to_numpy() for c in bucket_of]
            bucket = np.rec.fromarrays(place, names=",".join(bucket_of))
            key, second = place[0] >> 48, np.where(place[1] < 0, -1, place[1] >> 32)
            sig = np.frombuffer(b"".join(table["signature"].to_pylist()), "<u2").reshape(-1, SYMBOLS)
            node = table["node"].to_numpy()
            a, b = near_pairs(bucket, key, second, table["wide"].to_numpy(), table["side"].to_numpy(), table["label"].to_numpy(), table["size"].to_numpy(), sig, table["parity"].to_pylist())
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], ["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = pa.Table.from_batches([batch.slice(at, 8192)])
                held = part if held is None else pa.concat_tables([held, part])
                last = tuple(held[c][-1].as_py() for c in bucket_of)
                same = np.logical_and.reduce([held[c].to_numpy() == v for c, v in zip(bucket_of, last, strict=True)])
                done = held.num_rows - int(same.sum())
                if done:
                    yield emit(held.slice(0, done))
                    held = held.slice(done)
        if held is not None and held.num_rows:
            yield emit(held)

    return members.mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, ra, rb, linked) for candidate pairs of nodes, on the sets of their representatives' whole texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Equal rows are one, so that a pair isn't confirmed once for each two of them.
    same = Window.partitionBy("doc_id", F.xxhash64("text"), F.octet_length("text")).orderBy(F.lit(0))
    texts = docs.select("doc_id", "text").repartition("doc_id").withColumn("nth", F.row_number().over(same)).where("nth = 1").drop("nth")
    at = nodes.select("node", "rep")
    pairs = pairs.join(at.select(F.col("node").alias("b"), F.col("rep").alias("rb")), "b").join(at.select(F.col("node").alias("a"), F.col("rep").alias("ra")), "a")
    # Texts are dealt by id once; both joins read that exchange.
    pairs = pairs.join(texts.select(F.col("doc_id").alias("rb"), F.col("text").alias("tb")), "rb")
    pairs = pairs.join(texts.select(F.col("doc_id").alias("ra"), F.col("text").alias("ta")), "ra")

    def run(batches):
        least, full = SIMILARITY
        last_text, last = None, None
        for batch in slices(slices(batches, "ta", SLICE), "tb", SLICE):
            ta = batch.column("ta").cast(pa.binary()).to_pylist()
            found = shingles.word_shingles(batch.column("tb").cast(pa.binary()).to_pylist(), WIDTH)
            ok = []
            # Rows come sorted by the first text's id, so its set is at hand for the whole run of a hub.
            for i, (t, a, b) in enumerate(zip(ta, batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                if t != last_text:
                    last_text, last = t, shingles.word_shingles([t], WIDTH).distinct(0)
                d = found.distinct(i)
                both = len(np.intersect1d(last, d, assume_unique=True))
                # An id may have several texts: only those of the two nodes count.
                ok.append(full * both >= least * (len(last) + len(d) - both) and node_of(last) == a and node_of(d) == b)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "ra", "rb")), pa.array(ok)], ["a", "b", "ra", "rb", "linked"])

    return pairs.select("a", "b", "ra", "rb", "ta", "tb").mapInArrow(run, f"a long, b long, ra {kind}, rb {kind}, linked boolean")


def candidates_by_leader(keys: DataFrame, counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket's first node with each other node that it may be linked with."""
    shared = counts.where("n > 1").select(F.col("key").alias("k"), "first")
    pairs = keys.join(shared, F.col("key") == F.col("k")).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    at = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"s{c}"), F.col("parity").alias(f"p{c}"))
    pairs = pairs.join(at("b"), "b").join(at("a"), "a")
    least, full = SIMILARITY
    pairs = pairs.where(full * F.least("sa", "sb") >= least * F.greatest("sa", "sb"))

    def run(batches):
        for batch in batches:
            for part in (batch.slice(at, 8192) for at in range(0, batch.num_rows, 8192)):
                ok = may_link(part.column("sa").to_numpy(), part.column("sb").to_numpy(), part.column("pa").to_pylist(), part.column("pb").to_pylist())
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return pairs.select("a", "b", "sa", "sb", "pa", "pb").mapInArrow(run, "a long, b long")


def split_large(rows: DataFrame) -> DataFrame:
    """(key, second, node, label) of (key, node, label, signature): a large bucket's nodes by their further keys."""

    def run(batches):
        for batch in batches:
            for b in (batch.slice(at, 8192) for at in range(0, batch.num_rows, 8192)):
                sig = np.frombuffer(b"".join(b.column("signature").to_pylist()), "<u2").reshape(-1, SYMBOLS)
                second = second_keys(b.column("key").to_numpy(), sig)
                of = [np.repeat(b.column(c).to_numpy(), second.shape[1]) for c in ("key", "node", "label")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (of[0], second.ravel(), *of[1:])], ["key", "second", "node", "label"])

    return rows.select("key", "node", "label", "signature").mapInArrow(run, "key long, second long, node long, label long")


def candidates_across(keys: DataFrame, counts: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that share a bucket but not a component, and may be linked."""
    lab = nodes.join(labels.select(F.col("node.node").alias("node"), F.col("component.node").alias("component")), "node", "left")
    lab = lab.select("node", "size", "signature", "parity", F.coalesce("component", "node").alias("label"))
    rows = keys.join(lab.select("node", "label"), "node")
    several = rows.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select(F.col("key").alias("k"))
    several = checkpointed(several.join(counts.select(F.col("key").alias("c"), "n"), F.col("k") == F.col("c")).drop("c"))
    rows = keys.join(several, F.col("key") == F.col("k")).drop("k").withColumn("second", F.lit(-1).cast("long"))
    large = rows.where(F.col("n") > BLOCK).select("key", "node")
    twice = split_large(large.join(lab.select("node", "label", "signature"), "node"))
    sizes = twice.groupBy("key", "second").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("l"), F.max("label").alias("h"))
    twice = twice.join(sizes.where("l <> h").drop("l", "h"), ["key", "second"])
    columns = ("key", "second", "node", "n")
    rows = rows.where(F.col("n") <= BLOCK).select(*columns).unionByName(twice.select(*columns)).join(lab, "node")
    wide = large.groupBy("node").agg(F.expr("bit_or(shiftleft(1L, cast(shiftright(key, 48) AS int)))").alias("wide"))
    rows = rows.join(wide, "node", "left").withColumn("wide", F.coalesce("wide", F.lit(0).cast("long")))
    # What still holds more than BLOCK nodes is dealt into parts; each pair of parts is a block of its own.
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    side = F.when(F.col("i") == F.col("j"), F.lit(-1)).otherwise((F.col("part") == F.col("j")).cast("int"))
    rows = rows.select("key", "second", "i", "j", "wide", side.alias("side"), "node", "label", "size", "signature", "parity")
    bucket = ("key", "second", "i", "j")
    return blocked_pairs(rows.repartition(*bucket).sortWithinPartitions(*bucket)).distinct()


def linked_components(links: DataFrame) -> DataFrame:
    """(node, component) structs of nodes that have a link.  A node goes by its representative's id first, so the least
    node of a component has the least id, and no join by component is needed to find it."""
    end = lambda c: F.struct(F.col(f"r{c}").isNull().alias("none"), F.col(f"r{c}").alias("rep"), F.col(c).alias("node")).alias(c)
    return connected_components(links.select(end("a"), end("b")), "a", "b")


def components_of_nodes(docs: DataFrame) -> DataFrame:
    """(node, rep, copies, component: struct<none, rep, node>) for each shingle set of (doc_id, text).

    Runs jobs while it is called: sketches, buckets and links are kept in the shared checkpoint folder.
    """
    spark = docs.sparkSession
    # Signatures are kept for nodes only; the documents' own rows are made again without them, which is cheap.
    nodes = sketch(docs).where("node is not null").groupBy("node")
    nodes = checkpointed(nodes.agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("size"), F.max("signature").alias("signature"), F.max("parity").alias("parity")))
    keys = index_keys(nodes)
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("k"), "n")
    keys = checkpointed(keys.join(counts, F.col("key") == F.col("k")).drop("k"))
    central = keys.groupBy("node").agg(F.sum("n").alias("central"))
    counts = checkpointed(keys.join(central, "node").groupBy("key").agg(F.max("n").alias("n"), F.max_by("node", F.struct("central", "node")).alias("first")))
    keys = keys.select("key", "node")
    release(spark)
    tried = checkpointed(confirm(candidates_by_leader(keys, counts, nodes), nodes, docs))
    labels = linked_components(tried.where("linked"))
    release(spark)
    across = candidates_across(keys, counts, nodes, labels)
    pair = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = checkpointed(across.join(tried.select(pair.alias("p")).select("p.*"), ["a", "b"], "left_anti"))
    del labels, keys, counts, central
    release(spark)
    more = confirm(across, nodes, docs)
    links = checkpointed(tried.where("linked").unionByName(more.where("linked")).drop("linked"))
    labels = linked_components(links)
    del tried, across, more, links
    release(spark)
    alone = F.struct(F.col("rep").isNull().alias("none"), F.col("rep"), F.col("node"))
    labels = labels.select(F.col("node.node").alias("node"), "component")
    return nodes.select("node", "rep", "copies").join(labels, "node", "left").select("node", "rep", "copies", F.coalesce("component", alone).alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row; component_id is the least id that links reach.

    Runs jobs while it is called (see components_of_nodes).
    """
    require(df, id_col, text_col)
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lab = checkpointed(components_of_nodes(docs).select(F.col("node").alias("of"), "copies", F.col("component.rep").alias("component_id")))
    # Sets that more than one in MANY rows has are at most MANY: they are sent to the rows, and what then needs no partner, or
    # has no words, is dealt out by its id, so that neither copies nor empty texts come to one task.
    rows = lab.agg(F.sum("copies")).first()[0] or 0
    many = lab.where(F.col("copies") * MANY > rows).select(F.col("of").alias("hot"), F.col("component_id").alias("hot_id"))
    out = sketch(docs, signatures=False).join(F.broadcast(many), F.col("node") == F.col("hot"), "left")
    by = F.when(F.col("hot").isNull() & F.col("node").isNotNull(), F.col("node")).otherwise(F.xxhash64("doc_id", "node"))
    out = out.withColumn("by", by).join(lab.drop("copies"), F.col("by") == F.col("of"), "left")
    found = F.when(F.col("hot").isNotNull(), F.col("hot_id")).when(F.col("node") == F.col("of"), F.col("component_id"))
    out = out.select("doc_id", "n_shingles", F.coalesce(found, "doc_id").alias("component_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with the input's columns: the one with the least id, and of several rows of one id
    and shingle set the one with the first text; rows without words all stay.

    Runs jobs while it is called (see components_of_nodes).
    """
    require(df, id_col, text_col)
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    key, text = names[df.columns.index(id_col)], names[df.columns.index(text_col)]
    found = components_of_nodes(plain.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    first = found.where(F.col("node") == F.col("component.node")).select(F.col("rep").alias("k_rep"), F.col("node").alias("k_node"))

    def run(batches):
        for batch in slices(batches, text, SLICE):
            sets = shingles.word_shingles(batch.column(text).cast(pa.binary()).fill_null(b"").to_pylist(), WIDTH)
            nodes = [node_of(d) if len(d := sets.distinct(i)) else None for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], [*names, "node"])

    rows = plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("node", T.LongType())]))
    by_id = rows.join(first, (F.col(key) == F.col("k_rep")) & (F.col("node") == F.col("k_node")), "left_semi")
    without = rows.where(F.col(key).isNull()).join(first.where("k_rep is null"), F.col("node") == F.col("k_node"), "left_semi")
    # Rows of one id and set follow each other by their texts; there are few.
    rest = [F.col(c) for c, t in plain.dtypes if c not in (key, text) and "map<" not in t and "variant" not in t]
    one = lambda of, *by: of.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(text), *rest))).where("place = 1").drop("place")
    of = one(by_id, key, "node").unionByName(one(without, "node"))
    return of.unionByName(rows.where("node is null")).drop("node").toDF(*df.columns)
