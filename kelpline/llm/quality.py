"""Quality rules, line first, with DataFrame functions only.

Each line is tried against rules for punctuation, navigation, symbols, shouting
and boilerplate; a document that loses too many of its words with the lines that
fail, or fails the base rules, is rejected.  What is kept goes on without these lines.

Defined cases: a null text has no words and is rejected as too short; lines
without a word neither fail nor count; repeated rows are judged each by itself;
all columns of the input stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.text import WORD, require

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
TERMINAL = r"""[.!?:;"'”’»)\]…。！？]\s*$"""
BOILERPLATE = r"(?i)(cookie|javascript|lorem ipsum|terms of (use|service)|privacy policy|all rights reserved|sign (in|up)|log ?in|subscribe|newsletter|click here|read more|share this|back to top)"

#: Words of a text; share of words in repeated 3-word windows, in per cent.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A line of fewer words needs a terminal mark; boilerplate is looked for in lines up to so many words.
SHORT_LINE, BOILERPLATE_LINE = 6, 20
#: Symbols and exclamation marks in a line, in per cent of its words.
MOST_SYMBOLS, MOST_SHOUTS = 20, 50
#: Words that lines that failed may take from a document, in per cent.
MOST_LOST = 40


def let(value: Column, f) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Bits for a window's place when hash and place share one long; longer texts take the other way.
PLACE = 20


def _cover(places: Column) -> Column:
    """Words that 3-word windows at these ascending places cover: each adds what it covers beyond the one before."""
    zero = F.struct(F.lit(-3).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
    step = lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"))
    return F.aggregate(places, zero, step, lambda a: a["n"])


def with_repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words that lie in 3-word windows found twice or more in ``words``.

    Hashes of windows are sorted with their places in the low bits, as plain longs; windows equal to a neighbour are
    repeated.  If hashes differ in the bits that had to go, or the text is too long, whole hashes and places are sorted.
    """
    w, g, q = F.col(words), f"{out}_g", f"{out}_q"
    size = F.greatest(F.size(w) - 2, F.lit(0))
    df = df.withColumn(g, F.transform(F.slice(w, 1, size), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    head = lambda x: F.shiftright(x, PLACE)
    place = lambda x: x.bitwiseAND((1 << PLACE) - 1)
    packed = F.transform(g, lambda h, i: F.shiftleft(head(h), PLACE).bitwiseOR(place(i.cast("long"))))
    df = df.withColumn(q, F.sort_array(packed))
    before, after = lambda k: F.get(q, k - 1), lambda k: F.get(q, k + 1)
    twice = F.filter(q, lambda x, k: (head(x) == head(before(k))) | (head(x) == head(after(k))))
    of = lambda x: F.get(g, place(x).cast("int"))
    clash = F.size(F.filter(q, lambda x, k: (head(x) == head(before(k))) & (of(x) != of(before(k))))) > 0
    short = _cover(F.sort_array(F.transform(twice, place)))
    whole = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    again = lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
    long = let(whole, lambda s: _cover(F.array_sort(F.transform(again(s), lambda x: x["i"]))))
    return df.withColumn(out, F.when((F.size(g) >= 1 << PLACE) | clash, long).otherwise(short).cast("long")).drop(g, q)


def line_fails(line: Column, n: Column) -> Column:
    """Whether a line of n words fails one of the line rules; the cheap ones and those that end early come first."""
    return (
        ((n < SHORT_LINE) & ~line.rlike(TERMINAL))  # menus and other fragments
        | ((n >= SHORT_LINE) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}"))  # shouting
        | ((F.octet_length(line) - F.octet_length(F.replace(line, F.lit("!"), F.lit("")))) * 100 > n * MOST_SHOUTS)
        | (F.regexp_count(line, F.lit(SYMBOLS)) * 100 > n * MOST_SYMBOLS)  # symbols and navigation bars
        | ((n <= BOILERPLATE_LINE) & line.rlike(BOILERPLATE))
    )


def assess(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), lost_words (long: in lines that failed),
    base_failed and kept (boolean) to all columns; ``prefix`` goes before these names."""
    require(df, text_col)
    p = prefix
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines, words = f"{p}lines", f"{p}words"
    # White space ends lines and words alike, so a text's words are those of its lines.
    of_line = lambda x: F.struct(x.alias("line"), F.regexp_extract_all(x, F.lit(WORD), F.lit(0)).alias("words"))
    out = df.withColumn(lines, F.filter(F.transform(F.split(text, "\n"), of_line), lambda x: F.size(x["words"]) > 0))
    out = out.withColumn(words, F.flatten(F.transform(lines, lambda x: x["words"])))
    lost = F.aggregate(lines, F.lit(0), lambda n, x: n + F.when(line_fails(x["line"], F.size(x["words"])), F.size(x["words"])).otherwise(0))
    out = out.withColumns({
        f"{p}n_words": F.size(words).cast("long"),
        f"{p}word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        f"{p}n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        f"{p}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(F.transform(lines, lambda x: x["line"])))).cast("long"),
        f"{p}lost_words": lost.cast("long"),
    })
    out = with_repeated_words(out, words, f"{p}n_repeat_words").drop(lines, words)
    n = F.col(f"{p}n_words")
    out = out.withColumn(f"{p}base_failed", (n < LEAST_WORDS) | (F.col(f"{p}n_repeat_words") * 100 > n * MOST_REPEATED))
    out = out.withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & (F.col(f"{p}lost_words") * 100 <= n * MOST_LOST))
    # Counts for listeners; a filter on the verdict also stays above this node, where arrays are columns that have been
    # computed once, rather than expressions to be computed again for each element.
    return out.observe(f"quality-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("judged"), F.count_if(f"{p}kept").alias("kept"))


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that pass, with the input's columns; lines that fail are out of their texts."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    text = f"c{df.columns.index(text_col)}"
    good = assess(plain, text, "q_").where("q_kept")
    return good.withColumn(text, without_failures(F.col(text))).select(plain.columns).toDF(*df.columns)


def without_failures(text: Column) -> Column:
    """A text without its lines that fail; lines without a word stay."""
    fails = lambda x: let(F.regexp_count(x, F.lit(WORD)), lambda n: (n > 0) & line_fails(x, n))
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~fails(x)), "\n")
