"""Secret scans: a character convolutional network, in numpy, over every candidate and its surroundings.

Words (between white space) are split at ``= : , ; &`` and quotes; an address with ``://`` is one piece up to its
parameters, or its password is. A candidate is a piece, less quotes and brackets around it, that is a value of 6 bytes
at least, whatever its characters, or has 8 bytes at least and a digit, or 20 bytes at least with changes of case, or 16
capitals. A value is what follows ``=`` or ``:``, also with space between; the name belongs to its surroundings.
Cheap byte counts over the whole text find them, so all of a text is looked at.

The network sees 32 bytes before, the candidate and 16 bytes after. Each byte is embedded by its
character and its zone, a convolution of width 5 and a maximum in each zone follow, then a hidden
layer and a logistic. A candidate of more than ``SPAN`` bytes is scored in windows, and the highest counts.

It is trained on labelled findings: the candidates of up to ``DOCS`` documents (the only bound), labelled
by the forms of known kinds of key, and made-up keys and harmless look-alikes placed among words of the
same documents. A quarter is held out: it calibrates the scores (Platt's method), and the threshold is
the highest that finds ``RECALL`` of its secrets; made-up keys that give no candidate count as not found.

Defined results: null and empty texts have no findings; a text with several has a row for each, in order;
repeated rows are scanned alike; offsets count characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, sample, strings, words
from .quality import sigmoid

BEFORE, SPAN, AFTER, DOCS, RECALL, SEED = 32, 48, 16, 4000, 0.997, 13
LENGTH, CHARS, EMBED, FILTERS, HIDDEN, WIDE = BEFORE + SPAN + AFTER, 98, 12, 32, 24, 5
MASK = "[REDACTED]"
EDGE = b"\"'`()[]{}<>,;.!?\\"
KNOWN = [re.compile(p) for p in (
    rb"AKIA[0-9A-Z]{16}", rb"gh[pousr]_[0-9A-Za-z]{36}", rb"sk-[0-9A-Za-z]{32,48}", rb"xox[abp]-[0-9]{10,12}-[0-9A-Za-z]{16,24}", rb"eyJ[0-9A-Za-z_-]{16,}\.[0-9A-Za-z_-]{16,}\.[0-9A-Za-z_-]{16,}", rb"AIza[0-9A-Za-z_-]{35}",
)]
NAMED = re.compile(rb"(?i)(?:password|passwd|pwd|secret|token|api_?key|auth)[\"']?\s*[=:]\s*[\"']?$")
#: Pieces of a word: addresses up to their parameters, else runs without separators, with the = that fill encoded bytes up.
PIECE = re.compile(rb"(?P<url>[A-Za-z][0-9A-Za-z+.-]*://(?:[^/:@?#\"']*:(?P<password>[^/@\"']+)@)?[^?#&=,;\"']*)|[^=:,;&\"']+(?:={1,2}(?=[,;&]|[^=0-9A-Za-z]*$|[\"'][,;&:}\]]))?")
VALUE = re.compile(rb"[=:][\"'`\\\[({<]*$")
CASE, CAPITAL, FIGURE = (re.compile(p) for p in (rb"[a-z](?=[A-Z])", rb"[A-Z]", rb"[0-9]"))
UPPER, LOWER, DIGIT = (np.array([chr(c).isascii() and getattr(chr(c), k)() for c in range(256)]) for k in ("isupper", "islower", "isdigit"))


def pieces(w: bytes, after: bool) -> Iterator[tuple[int, int]]:
    """Start and end of each candidate in a word. after: whether the word follows a name."""
    for m in PIECE.finditer(w):
        x, y = m.span("password") if m["password"] else m.span()
        value = bool(m["password"]) or not m["url"] and (bool(VALUE.search(w, max(0, x - 8), x)) or after and not w[:x].strip(EDGE))
        quoted = value and x > 0 and w[x - 1 : x] in (b'"', b"'") and w[x - 1 : x] == w[y : y + 1]
        if not quoted:
            v = w[x:y]
            x, y = x + len(v) - len(v.lstrip(EDGE)), x + len(v.rstrip(EDGE))
        v = w[x:y]
        if value and len(v) >= 6 or len(v) >= 8 and (FIGURE.search(v) or len(v) >= 16 and (len(CAPITAL.findall(v)) >= 16 or len(v) >= 20 and len(CASE.findall(v)) > 2)):
            yield x, y


def candidates(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and end (in bytes of buf) of each candidate."""
    starts, ends, first = words(buf, offsets)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    named = np.zeros(len(starts), bool)
    named[1:] = np.isin(buf[ends[:-1] - 1], (58, 61))
    named[first[:-1][first[:-1] < len(starts)]] = False
    long = np.flatnonzero((ends - starts >= 7) | named & (ends - starts >= 6))  # 7: a sign and a value of 6

    def within(mark: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mark, dtype=np.int32)])
        return total[ends[long]] - total[starts[long]]

    turn = np.zeros(len(buf), bool)
    turn[1:] = UPPER[buf[1:]] & LOWER[buf[:-1]]
    take = named[long] | (within(DIGIT[buf]) > 0) | (within((buf == 61) | (buf == 58)) > 0) | ((ends - starts)[long] >= 20) & (within(turn) > 2) | (within(UPPER[buf]) >= 16)
    own = long[take]
    doc = np.searchsorted(first, own, "right") - 1
    out = []
    for d, a, b, after in zip(doc.tolist(), starts[own].tolist(), ends[own].tolist(), named[own].tolist(), strict=True):
        w = buf[a:b].tobytes()
        out += [(d, a + x, a + y) for x, y in pieces(w, after)]
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def pictures(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of each window with its zones, and the candidate of each. lo, hi: bounds of the texts."""
    n = np.maximum(1, -(-(b - a) // SPAN))
    owner = np.repeat(np.arange(len(a)), n)
    part = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    s = a[owner] + SPAN * part
    e = np.minimum(s + SPAN, b[owner])
    code = np.zeros((len(owner), LENGTH), np.int64)
    ascii_ = np.where((buf >= 32) & (buf < 127), buf.astype(np.int64) - 30, 1)
    for zone, (x0, x1) in enumerate(((np.maximum(s - BEFORE, lo[owner]), s), (s, e), (e, np.minimum(e + AFTER, hi[owner])))):
        place = {0: BEFORE - (x1 - x0), 1: np.full(len(s), BEFORE), 2: np.full(len(s), BEFORE + SPAN)}[zone]
        m = x1 - x0
        col = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        row = np.repeat(np.arange(len(s)), m)
        code[row, np.repeat(place, m) + col] = ascii_[np.repeat(x0, m) + col]
        code[:, (0, BEFORE, BEFORE + SPAN)[zone] : (BEFORE, BEFORE + SPAN, LENGTH)[zone]] += zone * CHARS
    return code, owner


ZONES = ((0, BEFORE), (BEFORE, BEFORE + SPAN), (BEFORE + SPAN, LENGTH))


@dataclass
class Network:
    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def forward(self, code: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = p["E"][code]
        pad = np.zeros((len(x), WIDE // 2, EMBED), np.float32)
        x = np.concatenate([pad, x, pad], 1)
        cols = np.concatenate([x[:, k : k + LENGTH] for k in range(WIDE)], 2)
        y = cols @ p["K"] + p["k"]
        best = np.stack([y[:, a:b].argmax(1) + a for a, b in ZONES], 1)
        top = np.take_along_axis(y, best.reshape(len(y), -1, FILTERS), 1).reshape(len(y), -1)
        m = np.maximum(top, 0)
        h = np.maximum(m @ p["H"] + p["h"], 0)
        return {"cols": cols, "best": best, "m": m, "h": h, "z": (h @ p["o"] + p["q"]).astype(np.float64)}

    def step(self, code: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(code)
        g = ((sigmoid(f["z"]) - y) / len(y)).astype(np.float32)
        dh = g[:, None] * p["o"] * (f["h"] > 0)
        dm = (dh @ p["H"].T * (f["m"] > 0)).reshape(len(y), 3, FILTERS)
        dK, dE = np.zeros_like(p["K"]), np.zeros((3 * CHARS + 1, EMBED), p["E"].dtype)  # the last row takes what falls off the ends
        rows, around = np.arange(len(y))[:, None], np.pad(code, ((0, 0), (WIDE // 2, WIDE // 2)), constant_values=3 * CHARS)
        for zone in range(3):
            at, d = f["best"][:, zone], dm[:, zone]
            dK += np.einsum("nfc,nf->cf", f["cols"][rows, at], d)
            for k in range(WIDE):
                np.add.at(dE, around[rows, at + k].ravel(), (d[:, :, None] * p["K"][k * EMBED : (k + 1) * EMBED].T).reshape(-1, EMBED))
        dE = dE[:-1]
        return {"E": dE, "K": dK, "k": dm.sum((0, 1)), "H": f["m"].T @ dh, "h": dh.sum(0), "o": f["h"].T @ g, "q": g.sum(keepdims=True)}

    def logits(self, code: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self.forward(code[a : a + 256])["z"] for a in range(0, len(code), 256))])

    def score(self, buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Calibrated chance of each candidate."""
        out = np.full(len(a), -np.inf)
        for k in range(0, len(a), 512):
            code, owner = pictures(buf, lo[k : k + 512], hi[k : k + 512], a[k : k + 512], b[k : k + 512])
            np.maximum.at(out, k + owner, self.logits(code))
        return sigmoid(self.slope * out + self.shift)

    def findings(self, column: pa.Array) -> Iterator[tuple[int, int, int, float, bytes]]:
        """Text number, start and end in its bytes, chance and the text's bytes, for each finding."""
        for first, _, buf, offsets in chunks(column):
            doc, a, b = candidates(buf, offsets)
            if len(doc):
                lo, hi = offsets[doc], offsets[doc + 1]
                s = self.score(buf, lo, hi, a, b)
                for k in np.flatnonzero(s >= self.threshold):
                    yield first + int(doc[k]), int(a[k] - lo[k]), int(b[k] - lo[k]), float(s[k]), buf[lo[k] : hi[k]].tobytes()


def made(rng: np.random.Generator, fill: list[bytes], count: int) -> tuple[list[tuple[bytes, int, int]], list[int]]:
    """Made-up keys and look-alikes among words: text, start and end of each, and labels."""
    def draw(alphabet: str, n: int) -> str:
        return "".join(rng.choice(list(alphabet), n))

    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word, hexa, b62 = lambda: draw(low, int(rng.integers(3, 10))), "0123456789abcdef", low + up + dig
    name = lambda: str(rng.choice(["password", "passwd", "pwd", "token", "api_key", "apikey", "secret", "auth_token", "PASSWORD", "SECRET_KEY", "access_key"]))
    around = lambda: [("{}={}", '{} = "{}"', "{}: {}", '"{}": "{}"', "{}='{}'")[int(rng.integers(5))].split("{}")]
    keys = [lambda: ("", "AKIA" + draw(up + dig, 16), ""), lambda: ("", "ghp_" + draw(b62, 36), ""), lambda: ("", "sk-" + draw(b62, int(rng.integers(32, 48))), ""), lambda: ("", "xoxb-" + draw(dig, 11) + "-" + draw(b62, 20), ""), lambda: ("", "AIza" + draw(b62, 35), ""), lambda: ("", f"eyJ{draw(b62, 17)}.{draw(b62, 30)}.{draw(b62, 30)}", "")]
    named = [lambda: draw(hexa, int(rng.integers(12, 41))), lambda: draw(hexa, int(rng.choice([18, 32, 40, 64]))), lambda: draw(b62, int(rng.integers(10, 33))), lambda: draw(b62 + "!@#$%", int(rng.integers(8, 20))), lambda: draw(b62, int(rng.integers(6, 11))), lambda: word_of(6) + draw(dig, int(rng.integers(1, 4))), lambda: word_of(3).title() + word_of(3).title() + word_of(3).title()]
    word_of = lambda n: draw(low, int(rng.integers(n, 10)))
    plain = [
        lambda: f"{word()}: {word_of(6)}", lambda: f"{word()} = {word_of(6)}", lambda: f"{word().title()}: {word_of(6).title()}", lambda: f'"{word()}": "{word_of(6)}"', lambda: f"{word()}: {text_word()}", lambda: f"{word()}={word_of(6)};{word()}={draw(dig, 6)}", lambda: f"{word()}={draw(dig, 6)}&{word()}={word_of(6)}",
        lambda: f"{word()}.{draw(dig, 2)}@{word()}{draw(dig, 1)}.example.com", lambda: f"{word()}{draw(dig, 3)}@{word()}.org", lambda: ".".join(str(int(rng.integers(1, 255))) for _ in range(4)), lambda: f"{draw(dig, 3)}-{draw(dig, 3)}-{draw(dig, 4)}", lambda: f"{draw(dig, 3)}-{draw(dig, 4)}", lambda: f"20{draw(dig, 2)}-{draw('01', 2)}-{draw('012', 2)}T{draw('01', 2)}:{draw('012345', 2)}", lambda: f"https://{word()}.example.com/{word()}/{draw(dig, 4)}?page={draw(dig, 1)}", lambda: f"{draw(hexa, 8)}-{draw(hexa, 4)}-{draw(hexa, 4)}-{draw(hexa, 4)}-{draw(hexa, 12)}", lambda: f"{word()}-{draw(dig, 4)}.{word()}", lambda: f"{word()}_{word()}_{draw(dig, 2)}", lambda: draw(dig, int(rng.integers(8, 17))),
        lambda: f"v{draw(dig, 1)}.{draw(dig, 2)}.{draw(dig, 1)}-beta", lambda: f"{word()}:{word()}", lambda: f"{word()}={word()}{draw(dig, 2)}", lambda: f"${draw(dig, 3)},{draw(dig, 3)}.{draw(dig, 2)}", lambda: f"978-{draw(dig, 1)}-{draw(dig, 4)}-{draw(dig, 4)}-{draw(dig, 1)}", lambda: f"{word().title()}{word().title()}{word().title()}{word().title()}", lambda: f"{word()}{draw(dig, 1)}{word()}", lambda: "commit " + draw(hexa, 40), lambda: joined().upper() + "!!", lambda: joined().upper(), lambda: joined().upper() + "!!", lambda: joined().upper()[:16], lambda: joined().upper()[:20] + ".", lambda: joined().upper()[:18], lambda: joined(), lambda: f"{draw(up, 2)}{draw(dig, 2)} {draw(dig, 4)} {draw(dig, 8)}",
    ]
    text_word = lambda: fill[int(rng.integers(len(fill)))].decode(errors="ignore")
    joined = lambda: "".join(fill[i].decode(errors="ignore").strip(".,!?") for i in rng.integers(0, len(fill), int(rng.integers(2, 6))))[: int(rng.integers(16, 30))]
    texts, labels = [], []
    for _ in range(count):
        y = int(rng.random() < 0.5)
        if y and rng.random() < 0.45:
            pre, v, post = keys[int(rng.integers(len(keys)))]()
        elif y:
            v = named[int(rng.integers(len(named)))]()
            parts = around()[0]
            pre, post = name() + parts[1], parts[2] if len(parts) > 2 else ""
            pre = parts[0] + pre
        else:
            v = plain[int(rng.integers(len(plain)))]()
            pre, post = ("", "")
        l, r = (b" ".join(fill[i] for i in rng.integers(0, len(fill), 5)) for _ in range(2))
        if not y and v.upper() == v and len(v) >= 16 and rng.random() < 0.7:  # shouted among shouted words
            l, r = (b" ".join(x.decode(errors="ignore").upper().encode() + b"!!" for x in part.split()) for part in (l, r))
        head = l + (b"\n" if rng.random() < 0.2 else b" ") + pre.encode()
        texts.append((head + v.encode() + post.encode() + b" " + r, len(head), len(head) + len(v.encode())))
        labels.append(y)
    return texts, labels


def gather(column: pa.Array, seed: int, count: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Pictures and labels of findings, real and made up."""
    return gathered(column, seed, count)[:2]


def gathered(column: pa.Array, seed: int, count: int = 5000) -> tuple[np.ndarray, np.ndarray, int]:
    """As ``gather``, and the number of made-up keys that give no candidate."""
    rng, codes, labels, fill, missed = np.random.default_rng(seed), [], [], [], 0
    for _, _, buf, offsets in chunks(column):
        doc, a, b = candidates(buf, offsets)
        if len(doc):
            code, owner = pictures(buf, offsets[doc], offsets[doc + 1], a, b)
            whole = [buf[x:z].tobytes() for x, z in zip(a, b, strict=True)]
            y = np.array([any(k.fullmatch(w) for k in KNOWN) or bool(NAMED.search(buf[max(o, x - BEFORE) : x].tobytes())) and len(w) >= 6 for w, x, o in zip(whole, a, offsets[doc], strict=True)], int)
            codes.append(code)
            labels.append(y[owner])
        starts, ends, _ = words(buf, offsets)
        pick = rng.integers(0, len(starts), 200) if len(starts) else []
        fill += [buf[starts[k] : ends[k]].tobytes() for k in pick]
    texts, y = made(rng, fill or [b"text"], count)
    data = np.frombuffer(b"".join(t[0] for t in texts), np.uint8)
    hi = np.cumsum([len(t[0]) for t in texts])
    lo = hi - [len(t[0]) for t in texts]
    for t, o, label in zip(texts, lo, y, strict=True):  # as the scan would cut them
        doc, a, b = candidates(data[o : o + len(t[0])], np.array([0, len(t[0])]))
        inside = [(x, z) for x, z in zip(a, b, strict=True) if x < t[2] and z > t[1]]
        if inside:
            x, z = (np.array(v) + o for v in zip(*inside, strict=True))
            code, _ = pictures(data, np.full(len(x), o), np.full(len(x), o + len(t[0])), x, z)
            codes.append(code)
            labels.append(np.full(len(code), label))
        elif label:
            missed += 1
    return np.concatenate(codes), np.concatenate(labels), missed


def bar(scores: np.ndarray, missed: int, recall: float) -> float:
    """The highest threshold that finds the share recall of the secrets, of which missed are never scored."""
    lose = int((1 - recall) * (len(scores) + missed) + 1e-9) - missed
    return float(np.sort(scores)[max(0, lose)]) if len(scores) else 0.5


def train(column: pa.Array, seed: int = SEED, epochs: int = 10, batch: int = 64, recall: float = RECALL) -> Network:
    code, y, missed = gathered(column, seed)
    rng = np.random.default_rng(seed)
    normal = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
    p = {"E": normal(3 * CHARS, EMBED) * 4, "K": normal(WIDE * EMBED, FILTERS), "k": np.zeros(FILTERS, np.float32), "H": normal(3 * FILTERS, HIDDEN), "h": np.zeros(HIDDEN, np.float32), "o": normal(HIDDEN), "q": np.zeros(1, np.float32)}
    net = Network(p)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 4], order[len(y) // 4 :]
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    t = 0
    for _ in range(epochs):
        own = rng.permutation(own)
        for k in range(0, len(own), batch):
            t += 1
            rows = own[k : k + batch]
            for name, g in net.step(code[rows], y[rows]).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                net.p[name] = net.p[name] - np.float32(0.004) * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)
    z, w = net.logits(code[held]), y[held]
    target = np.where(w == 1, (w.sum() + 1) / (w.sum() + 2), 1 / (len(w) - w.sum() + 2))
    s = np.array([1.0, 0.0])
    for _ in range(50):  # Newton's steps of Platt's method
        q = sigmoid(s[0] * z + s[1])
        g, v = np.array([((q - target) * z).sum(), (q - target).sum()]), q * (1 - q) + 1e-9
        s = s - 0.5 * np.linalg.solve(np.array([[(v * z * z).sum(), (v * z).sum()], [(v * z).sum(), v.sum()]]) + 1e-6 * np.eye(2), g)
    net.slope, net.shift = float(s[0]), float(s[1])
    net.threshold = bar(sigmoid(net.slope * z + net.shift)[w == 1], -(-missed // 4), recall)
    return net


def fit(docs: DataFrame, rows: int = DOCS, seed: int = SEED, key: str = "doc_id", text: str = "text") -> Network:
    found = sample(docs.select(docs[key], docs[text].cast("string").alias("text")), rows, seed, key).select("text").toArrow().sort_by("text")
    return train(strings(found["text"]), seed)


def scan(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end (in characters), score and the first characters of each finding. One pass without a shuffle."""
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            f = list(net.findings(batch.column(1)))
            start = [len(x[4][: x[1]].decode()) for x in f]
            size = [len(x[4][x[1] : x[2]].decode()) for x in f]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([x[0] for x in f], pa.int64())), pa.array(start, pa.int32()), pa.array([a + b for a, b in zip(start, size, strict=True)], pa.int32()), pa.array([x[3] for x in f], pa.float64()), pa.array([x[4][x[1] : x[2]].decode()[:4] + "..." for x in f], pa.string())], ["key", "start", "end", "score", "preview"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, start int, end int, score double, preview string").withColumnRenamed("key", key)


def redacted(docs: DataFrame, net: Network, text: str = "text", length: str = "n_chars") -> DataFrame:
    """All rows of docs with their secrets masked, and the length column (if there is one) following the text."""
    place, size = docs.columns.index(text), docs.columns.index(length) if length in docs.columns else None

    def run(batches):
        for batch in batches:
            cuts: dict[int, list[tuple[int, int, bytes]]] = {}
            for row, a, b, _, whole in net.findings(batch.column(place)):
                cuts.setdefault(row, []).append((a, b, whole))
            if not cuts:
                yield batch
                continue
            texts, columns = batch.column(place).to_pylist(), list(batch.columns)
            for row, own in cuts.items():
                out, at = [], 0
                for a, b, whole in own:
                    out += [whole[at:a], MASK.encode()]
                    at = b
                texts[row] = (b"".join(out) + own[-1][2][at:]).decode()
            columns[place] = pa.array(texts, batch.column(place).type)
            if size is not None:
                n = columns[size].to_pylist()
                for row in cuts:
                    n[row] = len(texts[row])
                columns[size] = pa.array(n, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
