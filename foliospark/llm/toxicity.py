"""Toxicity by a classifier chain of logistic regressions over the words that mark it.

The categories, in the chain's order, are ``severe`` (at least ``SEVERE`` marking words), ``dense``
(marking words are at least ``DENSE`` of all words) and ``toxic`` (the given label). The tables have one label, ``toxic``;
the others are grades of the documents so labelled by their marking words, which the models see too, so they order
the toxic documents and add no knowledge of their own. Each model sees the words' rates and
presence and the earlier categories' probabilities. While fitting, those are out-of-fold predictions, from models and
marking words that the fold had no part in, so a
later model learns from probabilities as they are on texts not seen before; when scoring they come
from the models fitted on all.

A word is a lower-cased run of letters and digits; its first ``STEM`` bytes count as a word too, if it is longer. Marking words are those whose share of toxic documents
exceeds that of the others by ``Z`` standard errors, in ``LEAST`` documents at least, however many there are; of
near copies one is counted. ``fit`` uses up to ``PER_CLASS`` labelled documents of each class, the only bound. The
threshold is the one of highest F1 on out-of-fold predictions, half-way to the nearest clean score.

Defined results: a null text and one without words have the probabilities of a text without marking
words; without labels of both classes nothing is flagged. Repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import MARKS, chunks, labelled, mix, span_hash, words
from .quality import sigmoid

CATEGORIES, PER_CLASS, FOLDS, SEVERE, DENSE, Z, LEAST, STEM, SEED = ("severe", "dense", "toxic"), 3000, 3, 3, 0.02, 5.0, 3, 4, 11


def counts(column: pa.Array, vocabulary: np.ndarray | None = None):
    """Text number, hash of word or stem and count of each pair, and the number of words of each text. vocabulary: sorted hashes, the only words to count."""
    rows, hashes, times, total = [], [], [], [np.zeros(0, np.int64)]
    if vocabulary is not None:
        bits = np.zeros(1 << 16, bool)
        bits[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    for a, _, buf, offsets in chunks(column, lower=True):
        starts, ends, first = words(buf, offsets, MARKS)
        n = np.diff(first)
        total.append(n)
        long = np.flatnonzero(ends - starts > STEM)
        h = np.concatenate([span_hash(buf, starts, ends), mix(span_hash(buf, starts[long], starts[long] + STEM))])
        word = np.concatenate([np.arange(len(starts)), long])
        if vocabulary is not None:
            pick = np.flatnonzero(bits[(h >> np.uint64(48)).astype(np.int64)])
            place = np.minimum(np.searchsorted(vocabulary, h[pick]), len(vocabulary) - 1)
            ok = vocabulary[place] == h[pick] if len(vocabulary) else np.zeros(0, bool)
            h, word = h[pick[ok]], word[pick[ok]]
        doc = np.searchsorted(first, word, "right") - 1
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        at = np.flatnonzero(new)
        rows.append(doc[at] + a)
        hashes.append(h[at])
        times.append(np.diff(np.append(at, len(h))))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(rows, np.int64), join(hashes, np.uint64), join(times, np.int64), np.concatenate(total)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Weights, the last of them the intercept, by Nesterov's method; classes weigh alike."""
    w, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    if y.min() == y.max():
        w[-1] = 8.0 if y.min() == 1 else -8.0
        return w
    x = np.column_stack([x, np.ones(len(x))])
    c = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    top = np.ones(x.shape[1])
    for _ in range(30):  # the greatest eigenvalue, a little above
        top = x.T @ (c * (x @ (top / np.linalg.norm(top))))
    rate = 4 / (1.1 * float(np.linalg.norm(top)) + 4 * ridge)
    for t in range(steps):
        ahead = v
        g = x.T @ (c * (sigmoid(x @ ahead) - y)) + ridge * np.append(ahead[:-1], 0)
        step = ahead - rate * g
        v, w = step + t / (t + 3) * (step - w), step
    return w


def unlike(column: pa.Array, keys: int = 8, alike: int = 6) -> np.ndarray:
    """Texts that share fewer than so many of their least three-word hashes with any kept one, so that copies count once in a fit.

    Texts of a Jaccard similarity of 0.9 share six of eight 19 times in 20, those of 0.3 once in 90."""
    kept, seen, at = [], {}, 0
    for _, _, buf, offsets in chunks(column, lower=True):
        starts, ends, first = words(buf, offsets, MARKS)
        h = span_hash(buf, starts, ends)
        three = h.copy()
        three[:-2] = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)
        for a, b in zip(first[:-1], first[1:], strict=True):
            own = [(k, int(mix(three[a : max(a + 1, b - 2)] ^ np.uint64(k)).min())) for k in range(keys)] if b > a else []
            shared: dict[int, int] = {}
            for key in own:
                for other in seen.get(key, ()):
                    shared[other] = shared.get(other, 0) + 1
            if max(shared.values(), default=0) < alike:
                kept.append(at)
                for key in own:
                    seen.setdefault(key, []).append(at)
            at += 1
    return np.array(kept, np.int64)


def marking(row: np.ndarray, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sorted hashes of the words that mark toxic documents. row: a text of each word, y: labels of the texts, -1 for those left out."""
    use = y[row] >= 0
    seen, inverse = np.unique(h[use], return_inverse=True)
    toxic, all_ = int((y == 1).sum()), int((y >= 0).sum())
    if not 0 < toxic < all_:
        return np.zeros(0, np.uint64)
    bad = np.bincount(inverse, y[row[use]], minlength=len(seen))
    clean = np.bincount(inverse, minlength=len(seen)) - bad
    size = (bad + clean) / all_
    z = (bad / toxic - clean / (all_ - toxic)) / np.sqrt(size * (1 - size) * (1 / toxic + 1 / (all_ - toxic)) + 1e-12)
    return seen[(bad + clean >= LEAST) & (z >= Z)]


def features(row: np.ndarray, h: np.ndarray, n: np.ndarray, total: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text, and its number of marking words, from words and counts; other words are passed over."""
    x = np.zeros((len(total), 2 + len(vocabulary)), np.float32)
    place = np.searchsorted(vocabulary, h)
    own = vocabulary[np.minimum(place, len(vocabulary) - 1)] == h if len(vocabulary) else np.zeros(len(h), bool)
    hits = np.bincount(row[own], n[own], minlength=len(total))
    x[:, 0], x[:, 1] = np.log1p(hits), np.minimum(50 * hits / np.maximum(total, 1), 5)
    x[row[own], 2 + place[own]] = 1
    return x, hits


@dataclass
class Chain:
    vocabulary: np.ndarray
    weights: list[np.ndarray]
    threshold: float

    def features(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Features, and the number of marking words and of words of each text."""
        return features(*counts(column, self.vocabulary), self.vocabulary)

    def probabilities(self, column: pa.Array) -> np.ndarray:
        if not self.weights:
            return np.zeros((len(column), len(CATEGORIES)))
        x, hits = self.features(column)
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.column_stack([out, sigmoid(np.column_stack([x, out]) @ w[:-1] + w[-1])])
        return out


def train(texts: pa.Array, y: np.ndarray, seed: int = SEED) -> Chain:
    if len(set(y.tolist())) < 2:
        return Chain(np.zeros(0, np.uint64), [], 2.0)
    own = unlike(texts)
    texts, y = texts.take(pa.array(own)), y[own]
    if len(set(y.tolist())) < 2:
        return Chain(np.zeros(0, np.uint64), [], 2.0)
    row, h, n, total = counts(texts)
    fold = np.random.default_rng(seed).permutation(len(y)) % FOLDS
    graded = lambda hits: {"toxic": y, "severe": y * (hits >= SEVERE), "dense": y * (hits >= DENSE * np.maximum(total, 1))}
    chain = Chain(marking(row, h, y), [], 2.0)
    whole, hits = features(row, h, n, total, chain.vocabulary)
    parts = [features(row, h, n, total, marking(row, h, np.where(fold == k, -1, y))) for k in range(FOLDS)]  # each knows nothing of its fold's labels
    earlier = np.zeros((len(y), 0), np.float32)
    for name in CATEGORIES:
        chain.weights.append(logistic(np.column_stack([whole, earlier]), graded(hits)[name]))
        apart = np.zeros(len(y), np.float32)
        for k, (x, found) in enumerate(parts):
            given = np.column_stack([x, earlier])
            w = logistic(given[fold != k], graded(found)[name][fold != k])
            apart[fold == k] = sigmoid(given[fold == k] @ w[:-1] + w[-1])
        earlier = np.column_stack([earlier, apart])
    order = np.argsort(-earlier[:, -1], kind="stable")
    s, hit = earlier[order, -1], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = 0
    best = int(np.argmax(f1))
    chain.threshold = float((s[best] + (s[best + 1] if best + 1 < len(s) else s[best])) / 2)
    return chain


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = SEED) -> Chain:
    return train(*labelled(docs, labels, "toxic", per_class, seed), seed)


def flagged(docs: DataFrame, chain: Chain, every: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, a probability for each category and toxic: the rows that are flagged, or every row.

    One pass without a shuffle; other columns are left out, so none can clash."""
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            p = chain.probabilities(batch.column(1))
            toxic = p[:, -1] >= chain.threshold
            found = pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in p.T), pa.array(toxic)], ["key", *(f"p_{c}" for c in CATEGORIES), "toxic"])
            yield found if every else found.filter(pa.array(toxic))

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {', '.join(f'p_{c} double' for c in CATEGORIES)}, toxic boolean").withColumnRenamed("key", key)
