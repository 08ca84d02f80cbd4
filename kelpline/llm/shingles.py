"""Hashed word shingles of many texts at once, as numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers under which close values lie far apart."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit integers."""
    return mix64(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


#: A value for each byte, the same for both cases of A-Z; and the base of the hash and its inverse.
BYTE = stream(11, 256)
BYTE[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]
BASE = 0x9E6D62D06F6A9A9B
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, U(BASE)), np.full(n, U(INVERSE))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


@dataclass
class Shingles:
    """Hashes of shingles in the order of the texts; of text i those from bounds[i] to bounds[i + 1], repeats included."""

    hashes: np.ndarray
    bounds: np.ndarray

    def distinct(self, i: int) -> np.ndarray:
        return np.unique(self.hashes[self.bounds[i] : self.bounds[i + 1]])


def word_shingles(texts: list[bytes], width: int = 5) -> Shingles:
    """Shingles of ``width`` words, in lower-case A-Z; a text with fewer words has all of them as its one shingle."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    first = np.cumsum([0, *[len(t) + 1 for t in texts]])
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE[data] * up[: len(data)], out=total[1:])
    word = mix64((total[end] - total[start]) * down[start] + (end - start).astype(U))
    at = np.searchsorted(start, first)  # the words of text i: at[i] to at[i + 1]
    n = np.diff(at)
    weight = stream(23, width) | U(1)
    if len(word) >= width:
        sums = sum(word[k : len(word) - width + 1 + k] * weight[k] for k in range(width))
    else:
        sums = np.zeros(0, U)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    full = np.repeat(n >= width, count)
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - at[:-1], count)
    out = np.empty(bounds[-1], U)
    out[full] = sums[place[full]]
    for i in np.flatnonzero((n > 0) & (n < width)).tolist():
        w = word[at[i] : at[i + 1]]
        out[bounds[i]] = (w * weight[: len(w)]).sum(dtype=U) + U(len(w))
    return Shingles(mix64(out), bounds)
