import numpy as np
import pyarrow as pa
import pytest

from foliospark.llm import quality, toxicity
from foliospark.llm.common import strings, table

from .helpers import ODD, clashing, empty, odd, rows

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    d = table(spark, BIG, "documents").join(table(spark, BIG, "labels"), "doc_id").select("doc_id", "text", "quality", "toxic").orderBy("doc_id").toArrow()
    return strings(d["text"]), d["quality"].to_numpy().astype(np.int64), d["toxic"].to_numpy().astype(np.int64)


@pytest.fixture(scope="module")
def model(labelled):
    half = pa.array(np.arange(0, len(labelled[0]), 2))
    return quality.train(labelled[0].take(half), labelled[1][::2])


@pytest.fixture(scope="module")
def chain(labelled):
    half = pa.array(np.arange(0, len(labelled[0]), 2))
    return toxicity.train(labelled[0].take(half), labelled[2][::2])


def test_quality_of_held_out_documents(labelled, model):
    rest = pa.array(np.arange(1, len(labelled[0]), 2))
    score, y = model.scores(labelled[0].take(rest))[0], labelled[1][1::2]
    assert (score >= model.threshold)[y == 1].mean() > 0.99
    assert (score < model.threshold)[y == 0].mean() > 0.95


def test_gradient_agrees_with_differences(labelled):
    rng = np.random.default_rng(0)
    m = quality.train(labelled[0].slice(0, 40), np.arange(40) % 2, epochs=1)
    x, at = rng.normal(size=(9, quality.WIDTH)), np.array([0, 4, 5, 9])
    y, w = np.array([1, 0, 1]), np.ones(3)

    def loss():
        s = m.forward(x, at)["score"]
        return -(w * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / w.sum()

    g = m.step(x, at, y, w)
    for name in ("W", "V", "U", "w", "c"):
        p = m.p[name].reshape(-1)
        p[0] += 1e-5
        up = loss()
        p[0] -= 2e-5
        down = loss()
        p[0] += 1e-5
        assert abs((up - down) / 2e-5 - g[name].reshape(-1)[0]) < 1e-6, name


def test_attention_weights_add_up(model, labelled):
    x, at = quality.passages(*_bytes(labelled[0].slice(0, 5)))
    a = model.forward((x - model.mean) / model.scale, at)["a"]
    assert np.allclose(np.add.reduceat(a, at[:-1]), 1)


def _bytes(texts):
    from foliospark.llm.common import raw

    return raw(texts)


def test_passages_cover_whole_texts():
    _, at = quality.passages(*_bytes(strings(pa.array(["w " * 1000, "", "a b", None]))))
    assert np.diff(at).tolist() == [16, 0, 1, 0]


@pytest.mark.parametrize("given", [odd, clashing])
def test_odd_rows_and_names(spark, model, chain, given):
    docs = given(spark)
    found = {r["doc_id"]: r for r in quality.scored(docs, model).collect()}
    assert not found[1]["keep"] and found[1]["score"] == 0 and not found[2]["keep"] and not found[6]["keep"]
    assert found[3]["score"] == pytest.approx(found[4]["score"], abs=1e-9) and found[3]["n_passages"] == -(-60_000 // quality.WORDS)
    kept = quality.kept(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in found.items() if r["keep"]}
    assert toxicity.flagged(docs, chain, every=True).count() == len(ODD)
    assert toxicity.flagged(docs, chain).count() == 0


def test_empty_tables_and_missing_labels(spark, model, chain):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.scored(empty(spark), model).count() == quality.kept(empty(spark), model).count() == toxicity.flagged(empty(spark), chain).count() == 0
    blind = quality.fit(odd(spark), none)
    assert rows(quality.kept(odd(spark), blind)) == rows(odd(spark))
    one = spark.createDataFrame([(7, 1, 1), (None, 0, 0), (8, None, None)], none.schema)
    assert quality.kept(odd(spark), quality.fit(odd(spark), one)).count() == len(ODD)
    assert toxicity.flagged(odd(spark), toxicity.fit(odd(spark), one)).count() == 0


def test_toxicity_of_held_out_documents(labelled, chain):
    rest = pa.array(np.arange(1, len(labelled[0]), 2))
    found, y = chain.probabilities(labelled[0].take(rest))[:, -1] >= chain.threshold, labelled[2][1::2]
    assert found[y == 1].mean() > 0.97 and found[y == 0].mean() < 0.01
    assert len(chain.weights) == len(toxicity.CATEGORIES) and [len(w) for w in chain.weights] == [len(chain.vocabulary) + 3 + k for k in range(3)]


def test_word_counts_agree_with_plain_ones():
    texts = ["A b a.", "", "Ünï b b", "stemming stemmed"]
    row, h, n, total = toxicity.counts(strings(pa.array(texts)))
    assert list(zip(row.tolist(), n.tolist(), strict=True)).count((0, 2)) == 1 and total.tolist() == [3, 0, 3, 2]
    assert n[row < 3].sum() == 7 and sorted(n[row == 3].tolist()) == [1, 1, 2] and len(set(h.tolist())) == 7
