"""The prefix trie against plain dictionaries and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from kelpline.llm import prefix_trie as T
from kelpline.llm.oracle import ORACLE
from tests.compare import agree, duck
from tests.llm.helpers import clashing

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = (*T.COUNTS, "ends_sha256")


def plain(rows):
    """Nodes from dictionaries of whole prefixes.  Turns of one number are told apart by their ids."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in own.items():
        h, b = zlib.crc32(str(c).encode()) % 4, int(c - (abs(c) % 20) * (1 if c > 0 else -1))
        key = tuple(own.get(b, [])[:h] + ts[h:])
        for d in range(len(key) + 1):
            members[key[:d]].append(c)
        ends[key].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, ms in members.items():
        own_saved = (len(ms) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += own_saved
    return sorted(
        ((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, ms in members.items()),
        key=str,
    )


def nodes(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in T.prefix_trie(df).collect()), key=str)


def talk(rng, n, words, longest=6):
    return [(c, i, rng.choice(["user", "assistant", None]), rng.choice(words)) for c in range(-30, n) for i in range(rng.randrange(longest))]


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_nodes_equal_plain_dictionaries(spark, monkeypatch, parts):
    monkeypatch.setattr(T, "ranges", lambda n, cores: parts)
    rng = random.Random(parts)
    rows = talk(rng, 150, ["a", "b c", "", None])
    # A first turn that most share, one conversation very often, one very long, and one with the long one's beginning.
    rows += [(c, 0, "user", "hi there you") for c in range(1000, 1100)] + [(c, i, "user", f"t{i}") for c in range(2000, 2060) for i in range(4)]
    rows += [(c, i, "x", f"{i % 3} w") for c, n in ((3000, 300), (3100, 90)) for i in range(n)]
    rng.shuffle(rows)
    assert nodes(clashing(spark.createDataFrame(rows, TURNS))) == plain(rows)


def test_odd_turns(spark):
    rows = [(None, 0, "user", "nobody's"), (1, None, "u", "last of all?"), (1, 0, None, None), (1, 0, None, None), (1, 2, "u", ""), (1, 2, "u", "tie"), (1, 2, "s", "tie"), (2, 5, "u", "x" * 100_000), (41, 0, "u", "lost"), (-1, 0, "u", "minus"), (-41, 1, "u", "minus")]
    rows += [(c, 0, "ab", "c") for c in (5, 6, 7)] + [(c, 0, "a", "bc") for c in (8, 9)]  # no mixing up of role and text
    assert nodes(spark.createDataFrame(rows, TURNS)) == plain(rows)
    assert T.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert T.prefix_trie(spark.createDataFrame(rows[:1], TURNS)).count() == 0


def test_layouts_grow_and_keep_order():
    for n in (1, 4, 5, 16, 17, 48, 49, 256):
        order = random.Random(n).sample(range(256), n)
        node = T.Sorted()
        for b in order:
            node = node.add(b, b)
        assert list(node) == sorted(order) and all(node.get(b) == (b if b in order else None) for b in range(256))
        assert isinstance(node, T.Sorted if n <= 16 else T.Indexed if n <= 48 else T.Direct)


def test_tree_compresses_paths():
    keys = sorted([b"", b"a" * 16, b"a" * 64, b"a" * 60 + b"b" * 20, b"a" * 63 + b"c"])
    tree = T.RadixTree(keys)
    assert len(tree.below_first()) == 7  # root, the key of 16, branches at 60 and 63, and three ends
    assert sorted(x.ends for x in tree.below_first() if x.ends >= 0) == [0, 1, 2, 3, 4]
    shuffled = T.RadixTree(keys[::-1])
    assert len(shuffled.below_first()) == 7


def test_ends_go_on_over_batches_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(T, "BUCKET", 3)
    rows = [(c, 0, "u", "same") for c in range(0, 500)]
    assert nodes(spark.createDataFrame(rows, TURNS)) == plain(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_agrees_with_sql(spark, sf):
    from kelpline.llm.queries import QUERIES

    agree(QUERIES["op11_prefix_trie"](spark, f"/root/testdata/{sf}"), duck(f"/root/testdata/{sf}"), ORACLE["op11_prefix_trie"])
