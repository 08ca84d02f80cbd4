"""Byte-level BPE encoding and decoding with a local rank file.

The tiktoken library merges; long texts are first cut where a cut can't change
the matches of the pre-splitting pattern, so no call holds the GIL or memory
for a whole book.  Ids are decoded to raw bytes, not to text, as a token may
end inside a character.

Defined cases: a null or empty text has no ids and decodes to no bytes; rows
with equal ids or texts are all kept; further columns are not touched; an empty
table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.text import require, slices, texts

#: Code points of a text that go to the library at a time.
PIECE = 1 << 15

#: A letter before a space or line feed: each alternative of the pattern that takes
#: letters ends there, and none looks back, so matching starts anew at the space.
_SAFE = regex.compile(r"(?<=\p{L})(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (base64 of the token, blank, rank), without special tokens."""
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cuts a text at safe boundaries after at least ``size`` code points; it stays whole where there is none."""
    start = 0
    while len(text) - start > size and (m := _SAFE.search(text, start + size)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


def encode(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of a text as unsigned 32-bit integers."""
    got = [enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text)]
    return (got[0] if len(got) == 1 else np.concatenate(got)).astype("<u4", copy=False)


def encode_decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """Returns ``id_col``, ``n_tokens`` long, ``ids`` binary (little-endian unsigned 32-bit) and, with
    ``decode``, ``decoded`` binary for each row.  No shuffle; memory is bounded by ``SLICE_BYTES`` and the longest text."""
    require(df, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in slices(batches, "text"):
            ids = [encode(enc, t) for t in texts(batch, "text")]
            cols = [batch.column("id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            if decode:
                cols.append(pa.array([enc.decode_bytes(x.tolist()) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "ids", "decoded"][: len(cols)])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids binary" + ", decoded binary" * decode)
    return out.withColumnRenamed("id", id_col)
