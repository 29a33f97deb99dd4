"""Bins of deviations do not depend on the order in which a document's rows arrive."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark.plans import catalogue
from foliospark.sources import text

from .test_queries import cell


@pytest.fixture(scope="module")
def half_bins():
    """Documents of a title, headings and body lines in which some deviations lie half between two bins."""
    rng, docs = random.Random(3), []
    for headings, body in [(0, 16), (1, 3), (13, 3), (16, 28), (33, 3), (61, 19), (69, 115), (96, 40)] * 4:
        lines = ["Some heading"] * headings + ["body " * 14] * body
        rng.shuffle(lines)
        docs.append((len(docs), "\n".join(["Title", *lines])))
    return docs


def rows_of(df):
    at = sorted(df.columns)
    return sorted([cell(r[c]) for c in at] for r in df.collect())


def same_rows(spark, docs, name):
    e = text.from_documents(spark.createDataFrame(docs, "doc_id bigint, text string"))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    cur = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted([cell(r[i]) for i in at] for r in cur.fetchall())
    moved = [e, e.coalesce(1).sortWithinPartitions(F.desc("doc_idx")), e.coalesce(1).sortWithinPartitions(F.hash("doc_idx"))]
    for rows in moved:
        assert rows_of(getattr(catalogue, name)(rows)) == want


def test_style_key(spark, half_bins):
    same_rows(spark, half_bins, "style_key")


def test_style_buckets(spark, half_bins):
    same_rows(spark, half_bins, "style_buckets")
