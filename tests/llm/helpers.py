"""Odd rows that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} item{i % 31}." for i in range(30_000))


def odd_docs(spark):
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4), (4, "one", "en", None, 3), (5, "Same text, said twice over here.", "en", "b", 32), (6, "Same text, said twice over here.", "en", "b", 32),
        (6, "Same text, said twice over here.", "en", "b", 32), (6, "another text of the same id", "en", "b", 27), (None, "a row without an id", "en", "", 19), (7, LONG, "en", "b", len(LONG)), (8, "x" * 3000, "en", "c", 3000), (9, "Ünïcode 漢字 😀 text\n\n## * | $", "de", "c", 20),
    ]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The same with further columns whose names operators use inside."""
    from pyspark.sql import functions as F

    for c in ("id", "row", "node", "key", "size", "start", "words", "lines", "spans", "range", "c0", "tie", "label", "n_words"):
        df = df.withColumn(c, F.lit("clash"))
    return df
