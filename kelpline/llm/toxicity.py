"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, will, target, negation, report, quote, other).  Four small sequential transducers rewrite
them: speech that is reported or quoted weakens an insult, a negation shortly before it too, a target near it strengthens it, and a
threat counts once it is aimed at somebody.  They are composed into one machine; its arcs' factors multiply along the cascade.  A
clause scores its best event (factor times the weight of the word), and a document the sum over its different clauses.

Which words insult is known for a few and learnt for the rest: words and beginnings of words (families) that toxic rows of a
sample of the labels have far more often than others, each counted once for a group of near-copies.  A logistic fit on the same
sample turns sums of clauses into a score between 0 and 1; it starts from fixed values, which also hold where nothing is labelled.

The sample takes at most ``most_rows`` rows of each label, by hash order of their ids, never held-out ones; it is the only part
that is bounded.  All documents are scored, in one pass without a shuffle.

Defined cases: a null or empty text has no clauses and the least score; a null id counts as an empty one for the fold; an id with
several labels is toxic if any says so, null labels say nothing; of rows with one id that are learnt from, the one with the
greatest hash; repeated rows are scored each; without labels only the known words count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.text import require, slices, texts
from kelpline.plans.checkpoints import checkpointed

OTHER, INSULT, THREAT, WILL, TARGET, NOT, REPORT, QUOTE = SYMBOLS = range(8)

#: Words by symbol. Fixed values.
KNOWN = {
    INSULT: "idiot idiots moron morons stupid scum loser losers trash clown pathetic worthless disgusting dumb fool fools jerk bastard bastards bitch filth vermin imbecile cretin coward liar freak pig dummkopf abschaum trottel versager arschloch crétin connard salaud imbécile ordure idiota estúpido imbécil basura cabrón",
    THREAT: "kill hurt destroy beat punch smash crush burn shoot stab töten umbringen schlagen vernichten tuer détruire frapper matar destruir golpear",
    WILL: "will gonna shall ll going werde werden vais allons voy vamos",
    TARGET: "you your you're youre u yourself they them their he she him her his people du dich dir dein deine ihr euch sie tu te toi ton ta vous votre ils elles tú ti usted ustedes ellos ellas",
    NOT: "not no never isn't aren't wasn't don't doesn't didn't cannot can't nobody nicht kein keine niemals ne pas jamais aucun nunca ningún jamás",
    REPORT: "said says say called calls quoted quotes wrote writes claimed claims reported sagte schrieb nannte dit appelle écrit dijo llamó escribió",
}
#: Factors of what is reported, negated, near a target before or after, and of an aimed threat. Fixed values.
REPORTED, NEGATED, TARGETED, AIMED, MENACE = 0.4, 0.3, 1.5, 1.25, 1.5
#: Words that a negation, a target and an intention reach.
REACH_NOT, REACH_TARGET, REACH_WILL = 3, 4, 4
CLAUSE_ENDS = ".!?;\n…"
CLAUSE_END = re.compile(f"[{re.escape(CLAUSE_ENDS)}]")
TOKEN = re.compile(r"""[\w'’]+|["“”«»„]""")
#: So many families are taken, of so many candidates.
MOST_FAMILIES, MOST_CANDIDATES = 400, 2000
#: A family needs so many different rows with it, and this share of all toxic ones, so much surprise (twice the log likelihood
#: ratio), and such odds (their log).
LEAST_ROWS, LEAST_SHARE, LEAST_SURPRISE, LEAST_ODDS = 4, 0.01, 24.0, 2.0
SHORTEST, LONGEST = 3, 12


class Transducer:
    """A sequential transducer: ``arcs[state, symbol]`` is (output, factor, next state)."""

    def __init__(self, start, step, symbols=SYMBOLS):
        self.start, self.symbols, self.arcs = start, symbols, {}
        todo = [start]
        while todo:
            s = todo.pop()
            for a in symbols:
                if (s, a) not in self.arcs:
                    self.arcs[s, a] = arc = step(s, a)
                    if (arc[2], symbols[0]) not in self.arcs:
                        todo.append(arc[2])

    def then(self, other: Transducer) -> Transducer:
        """Composition: what this one writes the other one reads; factors multiply."""

        def step(s, a):
            out, f, p = self.arcs[s[0], a]
            last, g, q = other.arcs[s[1], out]
            return last, f * g, (p, q)

        return Transducer((self.start, other.start), step, self.symbols)


#: What transducers write beside their symbols: an insult that is no longer plain, and a word that brings an event about.
SOFT, EVENT = 8, 9
WIDER = (*SYMBOLS, SOFT, EVENT)


def reported_speech() -> Transducer:
    """State: (after a word of reporting, inside quotes)."""

    def step(s, a):
        said, quoted = s
        to = (said or a == REPORT, quoted != (a == QUOTE))
        if a in (INSULT, THREAT) and (said or quoted):
            return (SOFT if a == INSULT else OTHER), REPORTED, to
        return a, 1.0, to

    return Transducer((False, False), step, WIDER)


def negation() -> Transducer:
    """State: how many words a negation still reaches."""

    def step(s, a):
        to = REACH_NOT if a == NOT else max(0, s - 1)
        return (SOFT, NEGATED, to) if s and a in (INSULT, SOFT) else (OTHER, 1.0, to) if s and a == THREAT else (a, 1.0, to)

    return Transducer(0, step, WIDER)


def target() -> Transducer:
    """State: how many words ago at most a target and a plain insult may stand.  An insult after a target is an event with the higher
    factor; a target after an insult raises that insult by being an event itself."""

    def step(s, a):
        near, open_ = s
        to = (REACH_TARGET if a == TARGET else max(0, near - 1), max(0, open_ - 1))
        if a == INSULT:
            return EVENT, TARGETED if near else 1.0, (to[0], 0 if near else REACH_TARGET)
        if a == SOFT:
            return EVENT, 1.0, to
        if a == TARGET and open_:
            return EVENT, AIMED, (to[0], 0)
        return a, 1.0, to

    return Transducer((0, 0), step, WIDER)


def threat() -> Transducer:
    """State: how many words an intention and a threat after it still reach.  The target is what makes it an event."""

    def step(s, a):
        meant, held = s
        to = (REACH_WILL if a == WILL else max(0, meant - 1), REACH_WILL if a == THREAT and meant else max(0, held - 1))
        return (EVENT, MENACE, (to[0], 0)) if a == TARGET and held else (a, 1.0, to)

    return Transducer((0, 0), step, WIDER)


@lru_cache(maxsize=1)
def grammar() -> list[list[tuple[bool, float, int]]]:
    """The composed machine as a table: [state][symbol] is (is it an event, factor, next state); state 0 begins a clause."""
    g = reported_speech().then(negation()).then(target()).then(threat())
    number = {g.start: 0}
    for s, _ in g.arcs:
        number.setdefault(s, len(number))
    table = [[(False, 1.0, 0)] * len(SYMBOLS) for _ in number]
    for (s, a), (out, factor, to) in g.arcs.items():
        if a < len(SYMBOLS):
            table[number[s]][a] = (out == EVENT, factor, number[to])
    return table


class Scorer:
    """Finds clauses with an insult or threat and runs the machine over them.  ``families``: weight by beginning of a word."""

    def __init__(self, families: dict[str, float]):
        self.symbol = {w: s for s in sorted(KNOWN, reverse=True) for w in KNOWN[s].split()}
        self.families = families
        self.machine, self.table = ahocorasick.Automaton(), grammar()
        for w in [*families, *(w for s in (INSULT, THREAT) for w in KNOWN[s].split())]:
            self.machine.add_word(w, len(w))
        self.machine.make_automaton()

    def weight(self, word: str) -> float:
        """The weight of a word's family, else 1 for a known insult, else 0."""
        for n in range(min(len(word), LONGEST), SHORTEST - 1, -1):
            if (w := self.families.get(word[:n])) is not None:
                return w
        return float(self.symbol.get(word) == INSULT)

    def clauses(self, low: str) -> Iterator[str]:
        """Clauses of a lower-cased text in which a word begins like an insult or threat."""
        end = 0
        for last, n in self.machine.iter(low):
            at = last - n + 1
            if at < end or (at and (low[at - 1].isalnum() or low[at - 1] in "_'’")):
                continue
            start = max(end, 1 + max(low.rfind(c, end, at) for c in CLAUSE_ENDS))
            end = m.start() if (m := CLAUSE_END.search(low, at)) else len(low)
            yield low[start:end].strip()

    def clause(self, text: str) -> tuple[float, set[str]]:
        """The best event of a clause, and the insults in it."""
        best, state, held, found = 0.0, 0, 1.0, set()
        for word in TOKEN.findall(text):
            weight = 0.0
            if word in "\"“”«»„":
                symbol = QUOTE
            elif weight := self.weight(word):
                symbol, held = INSULT, weight
                found.add(word)
            else:
                symbol = self.symbol.get(word, OTHER)
                held = 1.0 if symbol == THREAT else held
            event, factor, state = self.table[state][symbol]
            if event:
                best = max(best, factor * held)
        return best, found

    def features(self, text: str) -> tuple[float, float, float]:
        """Sums over different clauses with an event, how many there are, and how many different insults they hold."""
        best: dict[str, float] = {}
        words: set[str] = set()
        for clause in self.clauses(text.lower()):
            if clause not in best:
                best[clause], found = self.clause(clause)
                words |= found
        scores = [x for x in best.values() if x]
        return sum(scores), float(len(scores)), float(len(words))


@lru_cache(maxsize=2)
def scorer(families: tuple[tuple[str, float], ...]) -> Scorer:
    return Scorer(dict(families))


#: Where the fit starts from, and how firmly: constant, then the logs of the three sums. Fixed values.
START, FIRM = np.array([-4.0, 1.5, 1.0, 2.0]), np.array([0.05, 0.2, 0.2, 0.2])


def design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.log1p(x.reshape(-1, 3))])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Logistic coefficients by Newton's method with halved steps, held to ``START``; those of sums never fall below zero."""
    b, a = START.copy(), design(x)

    def loss(c):
        z = a @ c
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * (FIRM * (c - START) ** 2).sum()

    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(FIRM), a.T @ (y - p) - FIRM * (b - START))
        for shorter in range(30):
            c = b + step / 2**shorter
            c[1:] = np.maximum(c[1:], 0)
            if loss(c) < loss(b):
                break
        else:
            break
        b = c
    return b


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def sampled(documents: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """``id``, ``text`` and ``toxic`` of at most ``most_rows`` labelled ids of either label outside the held-out fold.

    The sample is small enough to be sent to all documents, and so are the texts that it meets: one an id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    part = lambda t: known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    picked = part(1).unionByName(part(0)).withColumnRenamed("doc_id", "id")
    rows = documents.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    return rows.groupBy("id").agg(F.max(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("r")).select("id", "r.text", "r.toxic")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each text, beside the least hash of its 3-word windows."""
    for batch in slices(batches, "text"):
        toxic, group, found = [], [], []
        for text, label in zip(texts(batch, "text"), batch.column("toxic").to_pylist(), strict=True):
            words = TOKEN.findall(text.lower())
            least = min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(len(words))), default=0) >> 1
            own = [w for w in set(words) if len(w) >= SHORTEST]
            toxic += [label] * len(own)
            group += [least] * len(own)
            found += own
        yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(group, pa.int64()), pa.array(found, pa.string())], ["toxic", "group", "word"])


def families(sample: DataFrame) -> tuple[tuple[str, float], ...]:
    """Beginnings of words that tell toxic rows, with weights.

    A word counts once for each group of rows with the same least hash of their 3-word windows, so copies don't make words telling."""
    each = sample.select("text", "toxic").mapInArrow(_words, "toxic int, group long, word string").distinct()
    counts = each.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    counts = checkpointed(counts)
    toxic_rows = sample.where("toxic = 1").count()
    total = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if not total["a"] or not total["b"]:
        return ()
    starts = F.explode(F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST))), lambda n: F.substring("word", F.lit(1), n)))
    c = counts.select(starts.alias("start"), "a", "b").groupBy("start").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") >= max(LEAST_ROWS, LEAST_SHARE * toxic_rows))
    share = (total["a"] + 1.0) / (total["a"] + total["b"] + 2.0)
    n, a, b = F.col("a") + F.col("b"), F.col("a"), F.col("b")
    xlog = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(F.lit(0.0))
    odds = F.log((a + 0.5) / (total["a"] + 1.0)) - F.log((b + 0.5) / (total["b"] + 1.0))
    told = c.withColumns({"odds": odds, "surprise": 2 * (xlog(a, n * share) + xlog(b, n * (1 - share)))}).where((F.col("odds") >= LEAST_ODDS) & (F.col("surprise") >= LEAST_SURPRISE))
    best = told.orderBy(F.col("surprise").desc(), F.length("start").desc(), "start").limit(MOST_CANDIDATES).collect()
    taken: dict[str, float] = {}
    for r in best:
        if len(taken) < MOST_FAMILIES and not any(r.start.startswith(t) or t.startswith(r.start) for t in taken):
            taken[r.start] = round(min(2.0, r.odds / 3), 6)
    return tuple(taken.items())


def feature_rows(df: DataFrame, known: tuple[tuple[str, float], ...]) -> DataFrame:
    """``id`` and the three sums of each row's text."""

    def run(batches):
        s = scorer(known)
        for batch in slices(batches, "text"):
            x = np.array([s.features(t) for t in texts(batch, "text")]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x[:, i]) for i in range(3))], ["id", "score", "clauses", "words"])

    return df.select("id", "text").mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, score double, clauses double, words double")


def learn(documents: DataFrame, labels: DataFrame, most_rows: int = 10_000) -> tuple[tuple[tuple[str, float], ...], np.ndarray]:
    """The families and the coefficients that a bounded sample of labelled rows teaches."""
    require(documents, "doc_id", "text")
    require(labels, "doc_id", "toxic")
    sample = checkpointed(sampled(documents, labels, most_rows))
    known = families(sample)
    rows = feature_rows(sample.withColumnRenamed("id", "doc").select(F.struct("doc", "toxic").alias("id"), "text"), known).select("id.toxic", "score", "clauses", "words").collect()
    x = np.array([r[1:] for r in rows], float).reshape(-1, 3)
    return known, fit(x, np.array([r.toxic for r in rows], float))


def score_documents(documents: DataFrame, known: tuple[tuple[str, float], ...], coefficients: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score`` between 0 and 1, ``predicted`` and the number of ``clauses`` with an event."""
    require(documents, id_col, text_col)
    sums = feature_rows(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), known)
    b = [float(x) for x in coefficients]
    z = F.lit(b[0])
    for weight, c in zip(b[1:], ("score", "clauses", "words"), strict=True):
        z = z + weight * F.log1p(c)
    out = sums.select(F.col("id").alias(id_col), (remainder(F.col("id")) == 0).alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"), F.col("clauses").cast("long").alias("clauses"))
    return out.select(id_col, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")
