"""Operators that SQL can't express, held against plain loops over whole small tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliospark.llm import mixing, neighbours, quality, secrets, topk, toxicity
from foliospark.llm.common import raw, strings, table

from . import plain
from .test_search import brute_neighbours


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def test_quality_agrees_with_plain_loops(spark, sf_dir, docs):
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    found = {r["doc_id"]: r for r in quality.scored(docs, model).collect()}
    for r in docs.collect():
        want = plain.quality_score(model, r["text"])
        assert found[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-5)
        assert found[r["doc_id"]]["keep"] == (want >= model.threshold) or abs(want - model.threshold) < 1e-5


def test_toxicity_agrees_with_plain_loops(spark, sf_dir, docs):
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    assert len(chain.vocabulary)
    found = {r["doc_id"]: r for r in toxicity.flagged(docs, chain, every=True).collect()}
    for r in docs.collect():
        want = plain.toxic_probabilities(chain, r["text"])
        assert [found[r["doc_id"]][f"p_{c}"] for c in toxicity.CATEGORIES] == pytest.approx(want, abs=1e-5)
    flagged = {r["doc_id"] for r in toxicity.flagged(docs, chain).collect()}
    assert flagged == {k for k, r in found.items() if r["p_toxic"] >= chain.threshold}


def test_words_that_a_fold_has_not_seen_do_not_mark_it():
    """A word that only one fold's toxic texts have is no marking word to that fold's model."""
    y = np.array([1] * 30 + [0] * 60)
    row = np.concatenate([np.arange(12), np.arange(90)])
    h = np.concatenate([np.full(12, 7), np.full(90, 9)]).astype(np.uint64)
    assert 7 in toxicity.marking(row, h, y) and 7 not in toxicity.marking(row, h, np.where(np.arange(90) < 12, -1, y))


def test_secrets_agree_with_plain_loops(docs):
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()] + ["password =hunter and x", "a=secret b:sécret7 =secret", 'k: v= "=abcdef" ==abcdef:']
    net = secrets.train(strings(pa.array(texts)), epochs=2)
    buf, offsets = raw(strings(pa.array(texts)))
    doc, a, b = secrets.candidates(buf, offsets)
    got = list(zip(doc.tolist(), (a - offsets[doc]).tolist(), (b - offsets[doc]).tolist(), strict=True))
    want = [(k, x, y) for k, t in enumerate(texts) for x, y in plain.secret_candidates(t or "")]
    assert got == want and len(got) > 20
    some = np.linspace(0, len(got) - 1, 40).astype(int)
    s = net.score(buf, offsets[doc][some], offsets[doc + 1][some], a[some], b[some])
    assert s == pytest.approx([plain.secret_score(net, texts[k], x, y) for k, x, y in (got[i] for i in some)], abs=1e-4)


@pytest.mark.parametrize("leaf", [mixing.LEAF, 4, 1])
def test_mixing_agrees_with_plain_loops(spark, leaf):
    """Sources of very unlike sizes, so that most rows have a fraction."""
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('s', cast(log2(id + 1) AS int)) AS source")
    n = F.count(F.lit(1)).over(Window.partitionBy("source"))
    hashed = docs.withColumn("h", F.xxhash64(F.lit(mixing.SEED), F.col("doc_id").cast("string"), "source")).withColumn("leaf", F.pmod(F.xxhash64("h", F.lit(1)), F.ceil(n / leaf)))
    want = plain.copies([(r["doc_id"], r["source"], r["h"], r["leaf"]) for r in hashed.collect()], leaf)
    got = {r["doc_id"]: r["copies"] for r in mixing.copies(docs, leaf=leaf).collect()}
    assert got == want and len(set(want.values())) > 2


def test_mixing_of_unlike_rows_of_one_id(spark):
    d = spark.createDataFrame([(1, "a", f"t{k}") for k in range(7)] + [(k, "b", "x") for k in range(3)], "doc_id bigint, source string, text string")
    found = [sorted(map(tuple, mixing.copies(d.repartition(k), weights={"a": 1.0, "b": 1.0}, total=9).collect())) for k in (1, 3, 5)]
    assert found[0] == found[1] == found[2] and sum(r[3] for r in found[0]) == 9


@pytest.mark.parametrize("kind", ["structured", "random"])
def test_neighbours_of_many_lists(spark, kind):
    """Over a dozen lists, of which each query searches a few; vectors with structure, and in all directions."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5000, 24)) + (4 * rng.normal(size=(60, 24))[rng.integers(0, 60, 5000)] if kind == "structured" else 0)
    x = np.round(x, 4).astype(np.float32)
    d = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(5000)), "embedding": pa.array(list(x))})).repartition(4)
    found = neighbours.search(d, length=256).groupBy("vec_id").agg(F.collect_set("neighbour").alias("n")).collect()
    d2 = (x.astype(float) ** 2).sum(1)
    dist = d2[:, None] + d2[None] - 2 * x.astype(float) @ x.astype(float).T
    np.fill_diagonal(dist, np.inf)
    true = np.argpartition(dist, 10, 1)[:, :10]
    assert len(found) == 5000 and np.mean([len(set(true[r["vec_id"]].tolist()) & set(r["n"])) / 10 for r in found]) >= 0.9


def test_neighbours_with_names(spark):
    d = spark.createDataFrame([(f"v{k}", [float(k), 0.0]) for k in range(40)], "vec_id string, embedding array<float>")
    found = {(r["vec_id"], r["rank"]): r["neighbour"] for r in neighbours.search(d, k=2, length=8).collect()}
    true = brute_neighbours([f"v{k}" for k in range(40)], np.array([[float(k), 0.0] for k in range(40)]), 2)
    assert found["v0", 1] == "v1" and np.mean([found[i, r] in n for i, n in true.items() for r in (1, 2)]) > 0.9


def test_rows_of_one_query_are_one_query(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "d")], "doc_id bigint, text string")
    split = topk.search(spark.createDataFrame([(1, "a"), (1, "b d")], "item_id bigint, text string"), docs).collect()
    whole = topk.search(spark.createDataFrame([(1, "a b d")], "item_id bigint, text string"), docs).collect()
    assert sorted(split) == sorted(whole) and len(whole) == 3
