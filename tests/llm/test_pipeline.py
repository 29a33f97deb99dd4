"""The pipeline against a plain run of its five stages, and its stages on odd tables."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import mixing, quality, secrets, sentencepieces
from foliospark.llm.common import table, written

from . import plain
from .helpers import clashing, empty, odd
from .test_search import brute_pairs


def test_pipeline_agrees_with_plain_stages(spark, monkeypatch):
    sf_dir, fitted = "/root/testdata/sf0.01", {}  # the smallest with secrets in it

    def kept(module):
        fit = module.fit

        def run(*args, **how):
            fitted[module.__name__] = fit(*args, **how)
            return fitted[module.__name__]

        monkeypatch.setattr(module, "fit", run)

    kept(quality)
    kept(secrets)
    got = Counter((r["doc_id"], tuple(r["token_ids"]), r["n_tokens"], r["decoded"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    model, net = fitted[quality.__name__], fitted[secrets.__name__]

    docs = {r["doc_id"]: r for r in table(spark, sf_dir, "documents").collect()}
    docs = {k: r for k, r in docs.items() if plain.quality_score(model, r["text"]) >= model.threshold}
    assert len(docs) > 100
    parent = {k: k for k in docs}

    def root(k):
        return k if parent[k] == k else root(parent[k])

    for a, b in brute_pairs([(k, r["text"]) for k, r in docs.items()], 2, 0.6):
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    left = {k: docs[k] for k in docs if parent[k] == k}
    assert 0 < len(left) < len(docs)
    texts = {}
    for k, r in left.items():
        data, at, out = r["text"].encode(), 0, []
        for a, b in plain.secret_candidates(r["text"]):
            if plain.secret_score(net, r["text"], a, b) >= net.threshold:
                out += [data[at:a], secrets.MASK.encode()]
                at = b
        texts[k] = b"".join([*out, data[at:]]).decode()
    assert any(texts[k] != left[k]["text"] for k in left)
    hashes = spark.createDataFrame([(k, r["source"]) for k, r in left.items()], "doc_id bigint, source string").select("doc_id", "source", F.xxhash64(F.lit(mixing.SEED), F.col("doc_id").cast("string"), "source").alias("h"))
    copies = plain.copies([(r["doc_id"], r["source"], r["h"], 0) for r in hashes.collect()])
    pieces, want = sentencepieces.Pieces.load(), Counter()
    for k, n in copies.items():
        ids = pieces.encode(pa.array([texts[k]]))
        want[k, tuple(ids.to_pylist()[0]), len(ids.to_pylist()[0]), pieces.decode(ids).to_pylist()[0]] = n
    assert got == want


@pytest.mark.parametrize("given", [odd, clashing, empty])
def test_stages_take_odd_tables(spark, sf_dir, given):
    docs = given(spark)
    columns, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, sf_dir), "odd")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns and after.dtypes == docs.dtypes, name
        ids = {r["doc_id"] for r in docs.collect()}
        assert {r["doc_id"] for r in after.collect()} <= ids and (count == 0) == (after.count() == 0), name
        if name in ("secrets", "mixing", "sentencepiece"):
            assert {r["doc_id"] for r in after.collect()} == ids, name
        docs = after


def test_tables_of_finished_stages_are_deleted(spark, sf_dir, tmp_path):
    was = spark.conf.get("spark.checkpoint.dir")
    assert corpus_pipeline.run(spark, sf_dir).columns[0] == "doc_id"
    left = [p for p in spark._jvm.java.io.File(was.removeprefix("file://")).list() if p.startswith("pipeline-")]
    assert all(p.startswith("pipeline-mixing") for p in left)
