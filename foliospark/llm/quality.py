"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of ``WORDS`` words, all of them. Each passage is encoded as shares of
character classes, repetition of words at short distance, word length and hashed words, then by a learned
layer h = tanh(xW + b). Gated attention, softmax over the bag of w . (tanh(hV) * sigmoid(hU)), weighs the
passages; the document's score is a logistic of the weighted sum of h. Only documents have labels, and the
attention weights are learned from them.

``fit`` uses up to ``PER_CLASS`` labelled documents of each class (the only bound here), a quarter of them
held out. A document is kept from a score of 0.5, or of the lower one at which ``KEEP`` of the held-out
good documents are kept.

Defined results: a null text or one without words has score 0 and no passages, and is rejected; without
labels of both classes every score is the share of good labels (1 if there are none), and as a fit that
can't tell anything apart must not drop documents, all are kept. Equal texts have equal scores, but for rounding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, labelled, span_hash, words

WORDS, PER_CLASS, HIDDEN, GATES, HASHED, KEEP, SEED = 64, 2000, 24, 12, 32, 0.995, 5
PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
CLASS = np.zeros(256, np.int64)
for _i, _c in enumerate(PUNCTUATION):
    CLASS[_c] = 6 + _i
for _c in range(256):
    if _c >= 128:
        CLASS[_c] = 5
    elif chr(_c).isalnum():
        CLASS[_c] = 1 if chr(_c).islower() else 2 if chr(_c).isupper() else 3
    elif _c in (10, 13):
        CLASS[_c] = 4
CLASSES, LAGS = 6 + len(PUNCTUATION), 8
WIDTH = CLASSES + 4 + HASHED


def passages(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and len + 1 offsets of each text's first."""
    starts, ends, first = words(buf, offsets)
    n = np.diff(first)
    count = -(-n // WORDS)
    at = np.concatenate([[0], np.cumsum(count)])
    if not at[-1]:
        return np.zeros((0, WIDTH), np.float32), at
    doc = np.repeat(np.arange(len(n)), count)
    word0 = first[doc] + WORDS * (np.arange(at[-1]) - at[doc])
    word1 = np.minimum(word0 + WORDS, first[doc + 1])
    length = word1 - word0
    of_word = np.repeat(np.arange(at[-1]), length)
    h = span_hash(buf, starts, ends)
    b0, b1 = starts[word0], ends[word1 - 1]
    x = np.zeros((at[-1], WIDTH), np.float32)
    for a in range(0, at[-1], 4096):  # bounds the counters, not the texts
        z = min(a + 4096, at[-1])
        span = b1[a:z] - b0[a:z]
        whole = CLASS[buf[b0[a] : b1[z - 1]]]
        gap = np.append(b0[a + 1 : z], b1[z - 1]) - b1[a:z]
        owner = np.repeat(np.stack([np.arange(z - a), np.full(z - a, z - a)], 1).ravel(), np.stack([span, gap], 1).ravel())  # what lies between passages goes to none
        x[a:z, :CLASSES] = np.bincount(owner * CLASSES + whole, minlength=(z - a + 1) * CLASSES).reshape(-1, CLASSES)[: z - a] / np.maximum(span, 1)[:, None]
    near = np.zeros(len(h), bool)
    for lag in range(1, LAGS + 1):
        same = (h[lag:] == h[:-lag]) & (of_word[lag:] == of_word[:-lag])
        near[lag:] |= same
        if lag == 1:
            x[:, CLASSES] = np.bincount(of_word[1:][same], minlength=at[-1]) / length
    x[:, CLASSES + 1] = np.bincount(of_word[near], minlength=at[-1]) / length
    x[:, CLASSES + 2] = np.minimum((b1 - b0) / length / 10, 10)
    x[:, CLASSES + 3] = np.log1p(length)
    bucket = (h >> np.uint64(40)).astype(np.int64) % HASHED
    x[:, CLASSES + 4 :] = np.sqrt(np.bincount(of_word * HASHED + bucket, minlength=at[-1] * HASHED).reshape(at[-1], HASHED) / length[:, None])
    return x, at


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Attention:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    threshold: float = 0.5
    constant: float | None = None

    def forward(self, x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """x: features of the passages of bags that are not empty; at: len + 1 offsets of the bags."""
        p, bag = self.p, np.repeat(np.arange(len(at) - 1), np.diff(at))
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (v * u) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, at[:-1])[bag])
        a = e / np.add.reduceat(e, at[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, at[:-1])
        return {"bag": bag, "h": h, "v": v, "u": u, "a": a, "z": z, "score": sigmoid(z @ p["c"] + p["d"])}

    def step(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the weighted log loss."""
        p, f = self.p, self.forward(x, at)
        g = (f["score"] - y) * weight / weight.sum()
        dz = (g[:, None] * p["c"])[f["bag"]]
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, at[:-1])[f["bag"]])
        gate = de[:, None] * p["w"]
        dv, du = gate * f["u"] * (1 - f["v"] ** 2), gate * f["v"] * f["u"] * (1 - f["u"])
        dh = (f["a"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ g, "d": g.sum(keepdims=True)}

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of passages of each text."""
        score, count = [np.zeros(0)], [np.zeros(0, np.int64)]
        for _, _, buf, offsets in chunks(column):
            x, at = passages(buf, offsets)
            n = np.diff(at)
            s = np.zeros(len(n))
            if len(x):
                full = n > 0
                s[full] = self.constant if self.constant is not None else self.forward((x - self.mean) / self.scale, np.unique(at))["score"]
            score.append(s)
            count.append(n)
        return np.concatenate(score), np.concatenate(count)


def train(texts: pa.Array, y: np.ndarray, seed: int = SEED, epochs: int = 12, batch: int = 128) -> Attention:
    made = [(passages(buf, offsets)) for _, _, buf, offsets in chunks(texts)]
    x = np.concatenate([m[0] for m in made] or [np.zeros((0, WIDTH), np.float32)])
    n = np.concatenate([np.diff(m[1]) for m in made] or [np.zeros(0, np.int64)])
    y, start, n = y[n > 0], (np.cumsum(n) - n)[n > 0], n[n > 0]
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    rng = np.random.default_rng(seed)
    shape = {"W": (WIDTH, HIDDEN), "b": HIDDEN, "V": (HIDDEN, GATES), "U": (HIDDEN, GATES), "w": GATES, "c": HIDDEN, "d": 1}
    model = Attention(mean, scale, {k: rng.normal(0, 0.0 if k in "bd" else 1 / np.sqrt(np.atleast_1d(s)[0]), s) for k, s in shape.items()})
    if len(set(y.tolist())) < 2:
        model.constant, model.threshold = float(y.mean()) if len(y) else 1.0, 0.0
        return model
    x = ((x - mean) / scale).astype(np.float64)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 4], order[len(y) // 4 :]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    t = 0
    for _ in range(epochs):
        for k in range(0, len(own), batch):
            rows = rng.permutation(own)[:batch] if k else own[:batch]
            at = np.concatenate([[0], np.cumsum(n[rows])])
            pick = np.concatenate([np.arange(start[r], start[r] + n[r]) for r in rows])
            t += 1
            for name, g in model.step(x[pick], at, y[rows], weight[rows]).items():
                g = g + 1e-4 * model.p[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                model.p[name] = model.p[name] - 0.01 * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)
    good = held[y[held] == 1]
    if len(good):
        pick = np.concatenate([np.arange(start[r], start[r] + n[r]) for r in good])
        s = np.sort(model.forward(x[pick], np.concatenate([[0], np.cumsum(n[good])]))["score"])
        model.threshold = float(min(0.5, s[int((1 - KEEP) * len(s))]))
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = SEED) -> Attention:
    return train(*labelled(docs, labels, "quality", per_class, seed), seed)


def kept(docs: DataFrame, model: Attention, text: str = "text") -> DataFrame:
    """The rows of docs that are not rejected, with all their columns. One pass without a shuffle."""
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(place))[0] >= model.threshold) if model.constant is None else pa.array([True] * batch.num_rows, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def scored(docs: DataFrame, model: Attention, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, n_passages and keep of every row; other columns are left out, so none can clash."""
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            s, n = model.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(n, pa.int32()), pa.array((s >= model.threshold) | (model.constant is not None))], ["key", "score", "n_passages", "keep"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, score double, n_passages int, keep boolean").withColumnRenamed("key", key)
