"""A run-compressed Burrows-Wheeler transform of short strings, and matching statistics streamed from it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class RunIndex:
    """The transform as runs, with the text positions of each run's first and last row.

    ``texts`` are the strings' bytes plus one, each followed by a 0; ``left`` is how many symbols
    follow a position up to its string's 0; ``levels`` are ranks of substrings of doubling length.
    """

    symbols: np.ndarray
    heads: np.ndarray
    tails: np.ndarray
    left: np.ndarray
    levels: list[tuple[int, np.ndarray]]
    text: np.ndarray

    @staticmethod
    def build(strings: list[bytes]) -> RunIndex:
        lengths = np.array([len(s) for s in strings], np.int64)
        text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8).astype(np.int64) + 1
        stops = np.cumsum(lengths + 1) - 1
        text[stops] = 0
        n = len(text)
        left = np.repeat(stops, lengths + 1) - np.arange(n)
        # Suffixes are sorted by substrings of 7 symbols of 9 bits, then those that are still equal by twice the length.
        # Past its 0 a suffix runs on; ``left`` bounds what counts.  A rank is the place of the first of its equals.
        padded = np.concatenate([text, np.zeros(7, np.int64)])
        key = np.zeros(n, np.int64)
        for k in range(7):
            key = key << 9 | padded[k : n + k]
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order[1:]] != key[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        width, levels = 7, [(7, rank.astype(np.int32))]
        while width <= lengths.max(initial=0):
            at = np.flatnonzero(~(new & np.append(new[1:], True)))
            if not len(at):
                break
            open_ = order[at]
            after = open_ + width
            key = rank[open_] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            sort = np.argsort(key, kind="stable")
            open_, key = open_[sort], key[sort]
            first = np.append(True, key[1:] != key[:-1])
            order[at], new[at] = open_, first
            rank[open_] = np.maximum.accumulate(np.where(first, at, 0))
            width *= 2
            levels.append((width, rank.astype(np.int32)))
        bwt = text[order - 1]
        start = np.ones(n, bool)  # a 0 is a run of its own: what precedes a string is no context of it
        start[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)
        first = np.flatnonzero(start)
        return RunIndex(bwt[first], order[first], order[np.append(first[1:], n) - 1], left, levels, text)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length of the longest common prefix of what starts at i and j in their strings."""
        n, most, total = len(self.text), np.minimum(self.left[i], self.left[j]), np.zeros(len(i), np.int64)
        at, to = i.copy(), j.copy()
        for width, rank in reversed(self.levels):
            ok = (at < n) & (to < n)
            ok[ok] = rank[at[ok]] == rank[to[ok]]
            total, at, to = total + width * ok, at + width * ok, to + width * ok
        for _ in range(6):
            ok = (at < n) & (to < n)
            ok[ok] = self.text[at[ok]] == self.text[to[ok]]
            total, at, to = total + ok, at + ok, to + ok
            # what has stopped stays: its next symbols differ again
        return np.minimum(total, most)

    def matching_statistics(self, copies: np.ndarray | None = None, least: int = 0) -> np.ndarray:
        """For each position of the text the length of the longest match that starts there and at another place too,
        or 0 if it is less than ``least``.

        A match is longest with a neighbour in suffix order.  Inside a run both rows are preceded by the same
        symbol, so the match is one shorter than one that starts a position earlier; only the pairs of rows at
        the sampled run ends are compared.  A string that stands for several ``copies``, whose rows would lie in
        the same runs, matches another as a whole.
        """
        n = len(self.text)
        a, b = self.tails[:-1], self.heads[1:]
        if least:
            # A shorter match at a sample gives only shorter ones after it.
            far = np.minimum(self.left[a], self.left[b]) >= least
            a, b = a[far], b[far]
            width, rank = next((x for x in reversed(self.levels) if x[0] <= least), (0, None))
            if width:
                same = rank[a] == rank[b]
                a, b = a[same], b[same]
        common = self.common(a, b)
        reach = np.full(n, -1, np.int64)  # where a match that starts at a sample ends
        np.maximum.at(reach, a, a + common)
        np.maximum.at(reach, b, b + common)
        if copies is not None:
            begin = np.flatnonzero(np.append(True, self.text[:-1] == 0))[copies > 1]
            reach[begin] = begin + self.left[begin]
        match = np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)
        return np.where(match >= least, match, 0)
