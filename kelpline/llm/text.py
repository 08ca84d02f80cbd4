"""Small helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: A word: a run of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], text_col: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches by rows into pieces with about ``size`` bytes of text, so that a
    worker's memory doesn't follow the number of rows that Spark puts in a batch."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pa.compute.binary_length(batch.column(text_col)).fill_null(0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, text_col: str) -> list[str]:
    """The texts of a batch; a null counts as an empty text."""
    return batch.column(text_col).fill_null("").to_pylist()


def require(df, *columns: str) -> None:
    """Says plainly which columns an operator misses."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
