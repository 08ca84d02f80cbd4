"""Secret scans with a trigram inverted index.

For each batch of texts a worker builds postings of the trigrams that the
rules' Boolean queries name, intersects them, and runs a rule's expression only
on the texts that are left; a rule without mandatory trigrams scans all texts.
The index never leaves the task, so there is no shuffle.

Defined cases: a null or empty text has no spans; offsets are code points, the
end is exclusive; spans of one rule don't overlap, those of several may.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.text import require, slices, texts
from kelpline.llm.trigrams import Index, derive


@dataclass(frozen=True)
class Rule:
    """kind: its name; pattern: found from the left without overlaps; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Rules in the order of their kinds; the first three are the base.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
    # To its END line; if that is missing, the headers and full lines that follow.
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:[^-]*+(?:-{1,4}[^-]++)*+-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----|(?:\s*(?:[A-Za-z][A-Za-z-]{2,30}:\x20[^\n]{0,200}\n|[A-Za-z0-9+/=]{32,}))*+)"),
    # A run without two more parts is read over whole, as no start inside it has them either.
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}(\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})?", 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("bearer", r"(?i:authorization)[\"']?\x20*[:=]\x20*[\"']?(?i:bearer|basic)\x20+[A-Za-z0-9+/_.=-]{16,}"),
    Rule("url", r"[a-z][a-z0-9+.]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@[^\s/@]+"),
)

BASE = ("assign", "access", "hex")

SPANS = "array<struct<kind:string,start:int,end:int>>"


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r.kind, re.compile(r.pattern, re.ASCII), r.group, r.least) for r in rules]
        # A maximal run of single characters is as long as asked, or no match: the scan can ask for that length.
        self.rules = [(k, re.compile(p.pattern[:-1] + "{%d,}" % least, re.ASCII) if re.fullmatch(r"\[[^\]]*\]\+", p.pattern) and not group else p, group, least) for k, p, group, least in self.rules]
        self.queries = [derive(r.pattern) for r in rules]
        self.index = Index(self.queries)

    def scan(self, batch: list[str]) -> list[list[tuple[str, int, int]]]:
        raw = [t.encode() for t in batch]
        ends = np.cumsum([len(r) for r in raw])
        postings = self.index.postings(np.frombuffer(b"".join(raw), np.uint8), ends)
        found: list[list] = [[] for _ in batch]
        for nth, ((kind, pattern, group, least), query) in enumerate(zip(self.rules, self.queries, strict=True)):
            for i in np.flatnonzero(self.index.answer(query, postings)).tolist():
                for m in pattern.finditer(batch[i]):
                    if m.end(group) - m.start(group) >= least:
                        found[i].append((m.start(), nth, kind, m.end()))
        return [[(kind, a, b) for a, _, kind, b in sorted(x)] if x else x for x in found]


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns ``id_col`` and ``spans`` (by start, then by the rules' order) for each row."""
    require(df, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        scan = scanner(rules).scan
        for batch in slices(batches, "text"):
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in scan(texts(batch, "text"))]
            of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, of)], ["id", "spans"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col)


def mask_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Returns all columns of all rows, with secrets in ``text_col`` replaced; a null text stays null."""
    require(df, text_col)
    names = df.columns
    at = names.index(text_col)

    def run(batches):
        scan = scanner(rules).scan
        for batch in slices(batches, "text"):
            column = batch.column(at)
            given = texts(batch, "text")
            spans = scan(given)
            if any(spans):
                column = pa.array([None if not ok else redact(t, s) for t, s, ok in zip(given, spans, column.is_valid().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(batch.columns)], [f"c{i}" if i != at else "text" for i in range(batch.num_columns)])

    # Columns go by place through the function, as their names may clash.
    src = df.toDF(*[f"c{i}" if i != at else "text" for i in range(len(names))])
    return src.mapInArrow(run, src.schema).toDF(*names)
