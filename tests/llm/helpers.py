"""Tables of odd rows that every operator must take."""

from __future__ import annotations

LONG = "lorem ipsum dolor sit amet " * 12_000
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (1, None, "en", "a", None), (2, "", None, "a", 0), (3, LONG, "en", None, len(LONG)), (4, LONG, "en", "b", len(LONG)), (5, "x" * 70_000, "en", "b", 70_000),
    (None, "no id at all here", "en", "a", 17), (6, "   \n\t ", "en", "a", 6), (7, "one two three four five six", "en", "a", 27), (7, "one two three four five six", "en", "a", 27),
    (8, "one two three four five six", "en", "b", 27), (9, "Ünïcödé 🎉 日本語 text", "de", "c", 18), (10, "word", "en", "c", 4),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark):
    """Extra columns with the names that operators use for their results."""
    from pyspark.sql import functions as F

    names = ["key", "score", "keep", "copies", "codes", "token_ids", "n_tokens", "_mix", "_near", "node", "rank", "start", "end", "jaccard", "leaf", "h"]
    return odd(spark).select("*", *[F.lit("mine").alias(n) for n in names])


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)
