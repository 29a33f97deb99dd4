"""From raw documents to token ids, in stages that each read what the one before wrote.

Null texts and texts without words are rejected by the first stage; an empty table passes through as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import jaccard, mixing, quality, secrets, sentencepieces
from foliospark.llm.common import gone, small_batches, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, does not reject."""
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group that pairs of near copies connect."""
    small_batches(spark)
    return jaccard.distinct_texts(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    small_batches(spark)
    return secrets.redacted(docs, secrets.fit(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks, once at least."""
    small_batches(spark)
    return mixing.mix_sources(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the text that they decode to."""
    small_batches(spark)
    return sentencepieces.encode_decode(docs)


STAGES: list[tuple[str, Stage]] = [("quality", good), ("near copies", distinct), ("secrets", masked), ("mixing", mixed), ("sentencepiece", encoded)]

#: Trained models and Viterbi decoding have no SQL; the pipeline is tested against a plain run of its stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        gone(*before)  # each stage reads what the last one wrote, and nothing older
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
