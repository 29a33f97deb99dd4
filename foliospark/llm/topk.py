"""Exact top-k search: every query against every document, by exhaustive term-at-a-time accumulation.

Terms are lower-cased words (runs between ASCII white space). A document's score for a query is BM25: the sum over
the query's distinct terms of count in the query * ln(1 + (N - df + 0.5) / (df + 0.5)) *
tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean length)), rounded to 6 places. N, df, lengths and
their mean are taken over all documents with words.

A block of documents is turned into postings, of the queries' terms only. Each query row scatters its terms'
weighted postings, one term after the other, into a dense array of the block's scores; a partition
selects the k highest, and the selections are merged per task and then per query. Queries are taken in
blocks of ``QUERIES`` rows, each block a pass over the documents, so no broadcast grows with them.

Defined results: ties go to the lower id; documents with score 0, without an id or without words are not
found; a null or empty query finds nothing; repeated rows of documents are rows of their own; the rows of one query
id are one query of all their terms. Only ids, texts and scores are kept, so other columns can't clash. Fewer than k matches give fewer rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, span_hash, words

K, K1, B, QUERIES, BLOCK = 10, 1.2, 0.75, 20_000, 4096


class Terms:
    """The query terms, by hash."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h of the query terms, and the terms' numbers."""
        pick = np.flatnonzero(self.bits[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[pick]), len(self.hashes) - 1)
        ok = self.hashes[at] == h[pick]
        return pick[ok], at[ok]

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and count of each pair, and each text's number of words."""
        pairs, times, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, _, buf, offsets in chunks(column, lower=True):
            starts, ends, first = words(buf, offsets)
            at, term = self.find(span_hash(buf, starts, ends))
            doc = np.searchsorted(first, at, "right") - 1 + a
            p, n = np.unique(doc * len(self.hashes) + term, return_counts=True)
            pairs.append(p)
            times.append(n)
            total.append(np.diff(first))
        doc, term = np.divmod(np.concatenate(pairs), max(1, len(self.hashes)))
        return doc, term, np.concatenate(times), np.concatenate(total)


def query_rows(table: pa.Table) -> tuple[Terms, list[tuple[np.ndarray, np.ndarray]]]:
    """The terms, and each query's distinct terms with their counts."""
    rows = []
    for _, _, buf, offsets in chunks(table["text"], lower=True):
        starts, ends, first = words(buf, offsets)
        h = span_hash(buf, starts, ends)
        rows += [np.unique(h[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
    every = np.unique(np.concatenate([r[0] for r in rows] or [np.zeros(0, np.uint64)]))
    return Terms(every), [(np.searchsorted(every, h), n) for h, n in rows]


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, ties by id."""
    place = np.flatnonzero(score > 0)
    if len(place) > k:
        limit = np.partition(score[place], len(place) - k)[len(place) - k]
        place = place[score[place] >= limit]
    return place[np.lexsort((ids[place], -score[place]))[:k]]


def search(queries: DataFrame, docs: DataFrame, k: int = K, query_key: str = "item_id", key: str = "doc_id", text: str = "text", query_text: str = "text", block: int = QUERIES) -> DataFrame:
    """query_key, rank, key and score of the k best documents of each query."""
    q = queries.select(queries[query_key].alias("q"), queries[query_text].cast("string").alias("text")).where("q IS NOT NULL").groupBy("q").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    d = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text"))
    kind, qkind = d.schema["id"].dataType.simpleString(), q.schema["q"].dataType.simpleString()
    blocks = max(1, math.ceil(q.count() / block))
    out = None
    for b in range(blocks):
        part = q.where(F.pmod(F.xxhash64(F.col("q").cast("string")), F.lit(blocks)) == b) if blocks > 1 else q
        found = _search(part.toArrow().sort_by([("q", "ascending")]), d, k, kind, qkind)
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query_key), "rank", F.col("id").alias(key), "score")


def _search(table: pa.Table, d: DataFrame, k: int, kind: str, qkind: str) -> DataFrame:
    terms, rows = query_rows(table)
    names = table["q"].combine_chunks()
    size = len(terms.hashes)

    def measure(batches):
        df, n, length = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            _, term, _, total = terms.counts(batch.column(1))
            df += np.bincount(term, minlength=size)
            n, length = n + int((total > 0).sum()), length + int(total.sum())
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(has, [-1, -2])), pa.array(np.append(df[has], [n, length]))], ["term", "n"])

    measured = {r[0]: r[1] for r in d.mapInArrow(measure, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each term of the queries
    n, mean = measured.get(-1, 0), measured.get(-2, 0) / max(1, measured.get(-1, 0))
    df = np.array([measured.get(i, 0) for i in range(size)], float)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

    def score(batches):
        top: list[tuple[list, list]] = [([], []) for _ in rows]
        held: list[pa.RecordBatch] = []

        def flush():
            ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])
            doc, term, tf, total = terms.counts(pa.chunked_array([b.column(1) for b in held]))
            weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * total[doc] / mean))
            order = np.argsort(term, kind="stable")
            doc, weight = doc[order], weight[order]
            first = np.searchsorted(term[order], np.arange(size + 1))
            dense = np.zeros(len(ids))
            for (own, times), (scores, names_) in zip(rows, top, strict=True):
                dense[:] = 0
                for t, m in zip(own.tolist(), times.tolist(), strict=True):
                    a, b = first[t], first[t + 1]
                    dense[doc[a:b]] += m * weight[a:b]
                s = np.round(dense, 6)
                place = best(s, ids, k)
                scores.append(s[place])
                names_.append(ids[place])
                if len(scores) > 32:
                    s, i = np.concatenate(scores), np.concatenate(names_)
                    place = best(s, i, k)
                    scores[:], names_[:] = [s[place]], [i[place]]
            held.clear()

        waiting = 0
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            for a in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(a, BLOCK))
                waiting += held[-1].num_rows
                if waiting >= BLOCK:
                    flush()
                    waiting = 0
        if held:
            flush()
        q, ids, out = [], [], []
        for i, (scores, names_) in enumerate(top):
            if scores:
                s, x = np.concatenate(scores), np.concatenate(names_)
                place = best(s, x, k)
                q.append(np.full(len(place), i)), ids.append(x[place]), out.append(s[place])
        if q:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(q))), pa.array(np.concatenate(ids)), pa.array(np.concatenate(out))], ["q", "id", "score"])

    return d.mapInArrow(score, f"q {qkind}, id {kind}, score double")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\v\f\r]+'), lambda x: x <> '')) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS m FROM q GROUP BY ALL),
n AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d WHERE len(w) > 0),
u AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM d),
p AS (SELECT doc_id, size, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT item_id, doc_id, round(sum(m * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score
      FROM qt JOIN p USING (term) JOIN f USING (term) CROSS JOIN n GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
