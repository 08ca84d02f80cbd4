"""Boolean trigram queries that follow from a regular expression, and an index that answers them.

A query is True (any text may match), a trigram, or ("and" | "or", parts).
Trigrams are of lower-case UTF-8 bytes, so a query never misses a match,
whichever case the expression asks for.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser

import numpy as np

Query = bool | bytes | tuple

#: Strings that a stretch of an expression may spell before it counts as open.
SPELLINGS = 64


def both(a: Query, b: Query) -> Query:
    if a is True or b is True:
        return b if a is True else a
    return a if a == b else ("and", a, b)


def either(parts: list[Query]) -> Query:
    if any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", *parts)


def of_string(s: bytes) -> Query:
    query: Query = True
    for g in dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2)):
        query = both(query, g)
    return query


def of_spellings(spellings: set[bytes]) -> Query:
    return either([of_string(s) for s in sorted(spellings)])


def spelled(items) -> set[bytes] | None:
    """All that a sequence of parsed items can spell, or None if that is open."""
    out = {b""}
    for op, arg in items:
        got: set[bytes] | None = None
        if op is sre.LITERAL:
            got = {chr(arg).lower().encode()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            got = {chr(a).lower().encode() for _, a in arg}
        elif op is sre.SUBPATTERN:
            got = spelled(arg[-1])
        elif op is sre.BRANCH:
            parts = [spelled(p) for p in arg[1]]
            got = None if None in parts else set().union(*parts)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 8:
            once, got = spelled(arg[2]), None
            if once is not None:
                reps, got = {b""}, set()
                for n in range(arg[1] + 1):
                    got |= reps if n >= arg[0] else set()
                    reps = {a + b for a in reps for b in once}
                    if len(reps) > SPELLINGS:
                        return None
        elif op is sre.AT:
            got = {b""}
        if got is None or len(out := {a + b for a in out for b in got}) > SPELLINGS:
            return None
    return out


def derive(pattern: str) -> Query:
    """The query that every text with a match of the pattern fulfils."""
    return _derive(parser.parse(pattern))


def _derive(items) -> Query:
    query: Query = True
    run: list = []

    def flush():
        nonlocal query, run
        if run:
            query = both(query, of_spellings(spelled(run)))
        run = []

    for item in items:
        if spelled([*run, item]) is not None:
            run.append(item)
            continue
        flush()
        if spelled([item]) is not None:
            run.append(item)
            continue
        op, arg = item
        if op is sre.SUBPATTERN:
            query = both(query, _derive(arg[-1]))
        elif op is sre.BRANCH:
            query = both(query, either([_derive(p) for p in arg[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            query = both(query, _derive(arg[2]))
    flush()
    return query


def trigrams_of(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1:]))


class Index:
    """Postings of the trigrams that some queries name, over the texts of one batch."""

    def __init__(self, queries: list[Query]):
        self.grams = sorted(set().union(*map(trigrams_of, queries)))
        self.slot = {g: i for i, g in enumerate(self.grams)}
        self.table = np.zeros(1 << 24, np.uint16)
        for g, i in self.slot.items():
            self.table[g[0] << 16 | g[1] << 8 | g[2]] = i + 1
        self.fold = np.arange(256, dtype=np.uint32)
        self.fold[ord("A") : ord("Z") + 1] += 32

    def postings(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One row a trigram, one column a text.  data: the texts' bytes in a row, ends: where each ends."""
        out = np.zeros((len(self.grams), len(ends)), bool)
        if len(data) > 2 and self.grams:
            low = self.fold[data]
            which = self.table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            at = np.flatnonzero(which)
            text = np.searchsorted(ends, at, side="right")
            inside = at + 3 <= ends[text]
            out[which[at[inside]] - 1, text[inside]] = True
        return out

    def answer(self, query: Query, postings: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(postings.shape[1], bool)
        if isinstance(query, bytes):
            return postings[self.slot[query]]
        parts = [self.answer(q, postings) for q in query[1:]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)
