"""Texts of every length are searched, and the bound on lengths loses none that is similar enough."""

import random

from pyspark.sql import functions as F

from foliospark.functions import similar_enough, similarity
from foliospark.plans import catalogue
from foliospark.sources import text


def test_texts_of_every_length_are_found(spark):
    lines = ["Of the and.", "Of the and now.", "Of the and then, so.", "Of the and then, so it goes.", "e and", "and", "", "!?"]
    e = text.from_documents(spark.createDataFrame([(1, "\n".join(lines))], "doc_id bigint, text string"))
    found = {r["text"] for r in catalogue.pdf_search(e).collect()}
    assert found == {"Of the and.", "Of the and now.", "Of the and then, so.", "e and"}


def test_bound_on_lengths_loses_nothing(spark):
    rng, pattern = random.Random(1), "Of the and."
    texts = ["".join(rng.choices(pattern + "xé", k=k)) for k in range(40) for _ in range(8)]
    texts += [pattern[:k] for k in range(12)] + [pattern + "x" * k for k in range(30)] + ["x" * k + pattern for k in range(30)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for threshold in (0.1, 0.3, 0.4, 0.5, 0.6, 0.75, 1.0):
        cut = similar_enough(F.col("text"), F.lit(pattern), threshold, len(pattern))
        whole = similarity(F.col("text"), F.lit(pattern)) >= threshold
        assert df.where(cut != whole).count() == 0


def test_texts_are_cleaned_once(spark):
    e = text.from_documents(spark.createDataFrame([(1, "a\n !? \n\n.\n ,\né"), (2, None)], "doc_id bigint, text string"))
    files = catalogue.as_pdf(e)
    assert files._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert [r["text"] for r in catalogue.pdf_elements(e).orderBy("doc_idx").collect()] == ["a", ".", ","]
