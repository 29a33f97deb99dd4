import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import jaccard, neighbours, queries, topk
from foliospark.llm.common import table

from .helpers import clashing, empty, odd, rows


def brute_pairs(texts, n, t):
    sets = {}
    for i, text in texts:
        w = (text or "").lower().split()
        if w:
            sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}
    ids = sorted(sets)
    out = {}
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            s = both / (len(sets[a]) + len(sets[b]) - both)
            if s >= t:
                out[a, b] = s
    return out


def near_texts(seed, count):
    """Originals, copies with edits from none to many, and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 5)))
    shared, out = [word() for _ in range(60)], []
    while len(out) < count:
        own = [word() for _ in range(rng.choice([1, 3, 12, 40, 200]))] + (shared if rng.random() < 0.3 else [])
        for _ in range(rng.choice([1, 1, 2, 6])):
            rate = rng.choice([0, 0.02, 0.05, 0.15])
            out.append(" ".join(word() if rng.random() < rate else w for w in own))
    return list(enumerate(out))


@pytest.mark.parametrize("t", [0.6, 0.8])
def test_jaccard_recall_and_precision(spark, t):
    texts = near_texts(1, 400)
    true = brute_pairs(texts, 2, t)
    found = {(r[0], r[1]): r[2] for r in jaccard.near_pairs(spark.createDataFrame(texts, "doc_id bigint, text string"), t=t).collect()}
    assert set(found) <= set(true) and all(found[k] == true[k] for k in found)
    assert len(found) >= 0.97 * len(true) and len(true) > 100


def test_jaccard_across_tiles(spark):
    texts = near_texts(2, 60)
    d = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert {(r["a"], r["b"]) for r in jaccard.verified(d, tile=3).collect()} == {(r["a"], r["b"]) for r in jaccard.verified(d).collect()} or {frozenset((r["a"], r["b"])) for r in jaccard.verified(d, tile=3).collect()} == {frozenset((r["a"], r["b"])) for r in jaccard.verified(d).collect()}


def test_tree_bounds_keep_all_pairs():
    rng = np.random.default_rng(0)
    sets = [np.sort(rng.choice(400, rng.integers(1, 120), replace=False)).astype(np.uint64) for _ in range(80)]
    sets += [s[: max(1, len(s) - 3)] for s in sets]
    grams = np.concatenate(sets) * np.uint64(1 << 39)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    everyone = np.arange(len(sets))
    i, j, s = jaccard.similar(grams, at, everyone, everyone, 0.5)
    true = {(a, b) for a in everyone for b in everyone[a + 1 :] if len(np.intersect1d(sets[a], sets[b])) >= 0.5 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == true and (s >= 0.5).all()


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100), (200, 201), (201, 202), (202, 200)]
    found = dict(jaccard.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert {found[i] for i in range(41)} == {0} and found[100] == 100 and {found[i] for i in (200, 201, 202)} == {200}
    assert jaccard.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_bound_of_long_texts_over_a_power_of_two():
    grams = np.unique(np.random.default_rng(0).integers(0, 1 << 48, 140_000).astype(np.uint64))
    for few, many in ((64_000, 67_000), (130_000, 133_000)):
        whole = np.random.default_rng(1).permutation(grams)[:many]
        a, b = jaccard.vectors(np.concatenate([np.sort(whole[:few]), np.sort(whole)]), np.array([0, few, few + many]))
        assert len(b) == 2 * len(a) and jaccard.may_pair(a, b, few / many)


@pytest.mark.parametrize("part", [1 << 20, 600])
def test_no_pair_is_lost_to_an_unlike_head(spark, monkeypatch, part):
    """All texts under one key, of which nearly all are longer and share a passage; copies have an unlike head too."""
    monkeypatch.setattr(jaccard, "keys", lambda grams, at, t: np.zeros((len(at) - 1, 1), np.int64))
    monkeypatch.setattr(jaccard, "PART", part, raising=False)
    passage, own = " ".join(f"p{k}" for k in range(65)), lambda i, n: " ".join(f"{i}w{k}" for k in range(n))
    texts = [(i, f"{passage} {own(i, 160)}") for i in range(30)] + [(i, f"{passage} {own(i, 17)}") for i in (30, 31)] + [(i, own(40, 90)) for i in (40, 41)] + [(i, own(42, 100) + " " + own(i, 30)) for i in (42, 43, 44)]
    found = jaccard.near_pairs(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {(r[0], r[1]): r[2] for r in found} == brute_pairs(texts, 2, jaccard.THRESHOLD) and len(found) == 5


@pytest.mark.parametrize("given", [odd, clashing])
def test_jaccard_odd_rows(spark, given):
    docs = given(spark)
    assert rows(jaccard.near_pairs(docs)) == [(3, 4, 1.0), (7, 8, 1.0)]
    left = jaccard.distinct_texts(docs)
    assert left.columns == docs.columns
    assert sorted(map(str, [r["doc_id"] for r in left.collect()])) == sorted(map(str, [1, 2, 3, 5, None, 6, 7, 9, 10]))


def test_jaccard_empty(spark):
    assert jaccard.near_pairs(empty(spark)).count() == jaccard.distinct_texts(empty(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    texts = near_texts(3, 200)
    parent = {i: i for i, _ in texts}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in brute_pairs(texts, 2, jaccard.THRESHOLD):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    left = {r["doc_id"] for r in jaccard.distinct_texts(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    want = {find(i) for i, _ in texts}
    assert want <= left and len(left) <= 1.02 * len(want) + 1


def test_topk_ties_nulls_and_blocks(spark):
    docs = spark.createDataFrame([(3, "a b"), (1, "a b"), (2, "a c"), (4, None), (None, "a"), (5, ""), (6, "z")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "A a"), (2, None), (3, "q"), (4, "b c"), (None, "a")], "item_id bigint, text string")
    found = rows(topk.search(queries, docs, k=2).select("item_id", "rank", "doc_id"))
    assert found == [(1, 1, 1), (1, 2, 2), (4, 1, 2), (4, 2, 1)]
    assert rows(topk.search(queries, docs, k=2, block=1).select("item_id", "rank", "doc_id")) == found
    assert topk.search(queries, docs.limit(0)).count() == topk.search(queries.limit(0), docs).count() == 0
    assert topk.search(spark.createDataFrame([(1, "lorem")], "item_id bigint, text string"), clashing(spark)).select("doc_id").collect()[0][0] == 3


def brute_neighbours(ids, x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    d[np.arange(len(x)), np.arange(len(x))] = np.inf
    return {i: {ids[j] for j in np.argsort(d[r], kind="stable")[:k]} for r, i in enumerate(ids)}


@pytest.mark.parametrize("length", [512, 32])
def test_neighbour_recall(spark, sf_dir, length):
    v = table(spark, sf_dir, "embeddings")
    data = v.orderBy("vec_id").toPandas()
    true = brute_neighbours(data.vec_id.tolist(), np.stack(data.embedding.to_list()), 10)
    found = neighbours.search(v, length=length).groupBy("vec_id").agg(F.collect_set("neighbour").alias("n"), F.max("rank").alias("r")).collect()
    assert len(found) == len(true) and all(r["r"] == 10 for r in found)
    assert np.mean([len(true[r["vec_id"]] & set(r["n"])) / 10 for r in found]) >= (0.99 if length == 512 else 0.9)


def test_bisection_is_balanced():
    parts = neighbours.bisect(np.random.default_rng(0).normal(size=(1000, 8)).astype(np.float32), 7, np.random.default_rng(1))
    assert len(parts) == 7 and sum(map(len, parts)) == 1000 and max(map(len, parts)) - min(map(len, parts)) <= 2


def test_neighbours_odd_rows(spark):
    data = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [1.0]), (None, [0.0, 0.0]), (7, [float("nan"), 0.0]), (8, [None, 1.0])]
    v = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    assert rows(neighbours.search(v, k=2)) == [(1, 1, 2, 0.0), (1, 2, 3, 1.0), (2, 1, 1, 0.0), (2, 2, 3, 1.0), (3, 1, 1, 1.0), (3, 2, 2, 1.0)]
    assert neighbours.search(v.limit(0)).count() == 0 and neighbours.search(v.where("vec_id = 1")).count() == 0
    assert rows(neighbours.search(v.withColumn("list", F.lit("mine")).withColumn("rank", F.lit(0)), k=1)) == [(1, 1, 2, 0.0), (2, 1, 1, 0.0), (3, 1, 1, 1.0)]


def test_neighbours_of_the_rows_that_are_asked(spark, sf_dir):
    """Every id that is divisible by 50 is a query, and no other; all rows are neighbours."""
    data = table(spark, sf_dir, "embeddings").orderBy("vec_id").toPandas()
    true = brute_neighbours(data.vec_id.tolist(), np.stack(data.embedding.to_list()), 10)
    found = queries.op2_neighbours(spark, sf_dir).groupBy("vec_id").agg(F.collect_set("neighbour").alias("n"), F.max("rank").alias("r")).collect()
    assert {r["vec_id"] for r in found} == {i for i in true if i % 50 == 0} and all(r["r"] == 10 for r in found)
    assert np.mean([len(true[r["vec_id"]] & set(r["n"])) / 10 for r in found]) >= 0.9 and any(n % 50 for r in found for n in r["n"])


def test_asking_for_some_gives_their_rows_of_all(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    whole = neighbours.search(v, length=32)
    assert rows(neighbours.search(v, length=32, asked=lambda i: i % 50 == 0)) == rows(whole.where("vec_id % 50 = 0"))
    assert neighbours.search(v, asked=lambda i: i < 0).count() == 0


def in_classes(pairs, ids):
    """doc_id, class_id and links that pairs of ids come to."""
    near = {i: set() for i in ids}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = []
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((i, min(seen), len(near[i])))
    return sorted(out, key=str)


@pytest.mark.parametrize("of", [lambda i: i, lambda i: i * 7 % 90])
def test_classes_and_links_are_those_of_all_pairs(spark, of):
    """Ids of one text each, and ids that several unlike texts share; tiles so small that groups span many."""
    texts = [(of(i), text) for i, text in near_texts(5, 240)]
    d = spark.createDataFrame(texts, "doc_id bigint, text string")
    pairs = {(r["a"], r["b"]) for r in jaccard.verified(d).collect()}
    assert len(pairs) > 50
    for tile in (jaccard.TILE, 3):
        assert rows(jaccard.classes(d, tile=tile)) == in_classes(pairs, {i for i, _ in texts})


def test_copies_give_a_row_each_and_lose_no_link(spark, tmp_path):
    """300 copies of one text and 40 near copies of it pair with each other, and the rows follow the documents."""
    own = [f"w{k}" for k in range(60)]
    texts = [(i, " ".join(own)) for i in range(300)] + [(i, " ".join([*own, f"x{i}"])) for i in range(300, 340)] + [(400, "something else altogether")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(queries.op10_jaccard(spark, str(tmp_path))) == sorted([(i, 0, 339) for i in range(340)] + [(400, 400, 0)], key=str)


@pytest.mark.parametrize("given", [odd, clashing, empty, lambda spark: odd(spark).union(spark.createDataFrame([(7, "one text two text", None, None, 1), (11, "one two three four five six", None, None, 1), (11, "one text two text", None, None, 1), (12, "ONE text\ttwo text", None, None, 1)], odd(spark).schema)), None])
def test_classes_are_those_of_their_sql(spark, sf_dir, tmp_path, given):
    import duckdb

    at = sf_dir if given is None else str(tmp_path)
    if given is not None:
        given(spark).repartition(3).write.parquet(f"{at}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet{'' if given is None else '/*.parquet'}'")
    found = queries.op10_jaccard(spark, at)
    cur = con.execute(queries.oracle_sql()["op10_jaccard"])
    assert [c[0] for c in cur.description] == found.columns == ["doc_id", "class_id", "links"]
    assert rows(found) == sorted(cur.fetchall(), key=str)
