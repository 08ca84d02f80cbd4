"""Token counts of a BPE vocabulary with word ends, by rank-synchronous array merging.

A batch's distinct pre-tokens are held as one ragged numpy array of symbols.
Each round finds every sequence's pair of lowest rank and applies it in all
sequences at once; sequences without a pair leave, and what is left of their
symbols is counted.

Defined cases: a null or empty text has no tokens; special strings inside a text
count as one token, as is the default of the library whose counts these are;
rows are never merged or dropped.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.text import require, slices, texts

NONE = np.int64(1) << 40  # the rank of a pair that is never merged
#: Entries that a worker remembers of chunks and pre-tokens; more are counted again.
REMEMBERED = 400_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabularies of byte-level BPE."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class WordBpe:
    """A BPE model in the JSON format of the tokenizers library: NFC, lower case, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"]
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        self.n = max(vocab.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], np.int64(1) << 62), np.append(order.astype(np.int64), NONE)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.special_start = min((t["content"][:2] for t in spec["added_tokens"]), default="\0\0")

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text and how many special strings it has."""
        special = 0
        parts = [text]
        if self.special_start in text:
            parts = self.special.split(text)
            special = len(parts) - 1
        found: list[str] = []
        for part in parts:
            # Case by character: the sigma at a word's end is an ordinary one.
            found += self.split.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return found, special

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.n + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, tokens: list[str]) -> np.ndarray:
        """The number of symbols that each pre-token ends with."""
        if not tokens:
            return np.zeros(0, np.int64)
        raw = [t.encode() for t in tokens]
        sizes = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        sym = self.inner[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        left = sizes.copy()
        who = np.arange(len(tokens))  # the sequences that still merge
        rank = np.full(len(sym), NONE)
        rank[:-1] = self.rank(sym[:-1], sym[1:])
        rank[ends - 1] = NONE  # the last symbol has no pair
        while len(who):
            starts = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat(rank, starts)
            going = low < NONE
            if not going.all():
                left[who[~going]] = sizes[~going]
                keep = np.repeat(going, sizes)
                sym, rank, sizes, who, low = sym[keep], rank[keep], sizes[going], who[going], low[going]
                if not len(who):
                    break
                starts = np.cumsum(sizes) - sizes
            hit = rank == np.repeat(low, sizes)
            at = np.flatnonzero(hit)
            # Of overlapping occurrences (a pair of equal symbols) every second goes, from the left.
            first = np.ones(len(at), bool)
            first[1:] = np.diff(at) > 1
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            sym[at] = self.made[rank[at]]
            rank[at] = rank[at + 1]  # none, if the right part was the last
            alive = np.ones(len(sym), bool)
            alive[at + 1] = False
            sizes = sizes - np.add.reduceat(~alive, starts)
            new = np.cumsum(alive) - 1
            sym, rank, at = sym[alive], rank[alive], new[at]
            is_end = np.zeros(len(sym), bool)
            is_end[np.cumsum(sizes) - 1] = True
            touched = np.concatenate([at, at[at > 0] - 1])
            rank[touched] = NONE
            touched = touched[~is_end[touched]]
            rank[touched] = self.rank(sym[touched], sym[touched + 1])
        return left


class Counter:
    """Counts texts, remembering what it has counted of chunks between white space."""

    def __init__(self, bpe: WordBpe):
        self.bpe, self.of_chunk, self.of_token = bpe, {}, {}

    def learn(self, chunks) -> None:
        split = [(c, *self.bpe.pre_tokens(c)) for c in chunks]
        fresh = list({t for _, found, _ in split for t in found if t not in self.of_token})
        self.of_token.update(zip(fresh, self.bpe.count(fresh).tolist(), strict=True))
        for c, found, special in split:
            self.of_chunk[c] = special + sum(map(self.of_token.__getitem__, found))

    def counts(self, batch: list[str]) -> list[int]:
        if len(self.of_chunk) > REMEMBERED or len(self.of_token) > REMEMBERED:
            self.of_chunk, self.of_token = {}, {}
        # No composition crosses white space.  Python's split() knows four separators more than the pattern does.
        split = [[t] if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in batch]
        known = self.of_chunk
        self.learn({c for chunks in split for c in chunks if c not in known})
        return [sum(map(known.__getitem__, chunks)) for chunks in split]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(WordBpe(path))


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Returns ``id_col``, ``n_bytes`` long, ``n_tokens`` long and ``over_limit`` (more than ``limit``) for each row; no shuffle."""
    require(df, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        count = counter(vocabulary)
        for batch in slices(batches, "text"):
            n = pa.array(count.counts(texts(batch, "text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), n], ["id", "n_bytes", "n_tokens"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = src.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
