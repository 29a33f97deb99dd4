"""Plain loops over single texts and rows that operators must agree with."""

from __future__ import annotations

import math
import re

import numpy as np

from foliospark.llm import mixing, quality, secrets, toxicity
from foliospark.llm.common import mix, span_hash

WORD = re.compile(rb"[^ \t\n\v\f\r]+")


def hashed(data: bytes) -> int:
    return int(span_hash(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0])


def sigmoid(z):
    return 1 / (1 + math.exp(-z))


def quality_score(model: quality.Attention, text: str | None) -> float:
    data = (text or "").encode()
    found, bag = [m.span() for m in WORD.finditer(data)], []
    for k in range(0, len(found), quality.WORDS):
        own = found[k : k + quality.WORDS]
        x, span, names = np.zeros(quality.WIDTH), data[own[0][0] : own[-1][1]], [hashed(data[a:b]) for a, b in own]
        for c in span:
            x[quality.CLASS[c]] += 1 / len(span)
        x[quality.CLASSES] = sum(i > 0 and names[i - 1] == n for i, n in enumerate(names)) / len(own)
        x[quality.CLASSES + 1] = sum(n in names[max(0, i - quality.LAGS) : i] for i, n in enumerate(names)) / len(own)
        x[quality.CLASSES + 2] = min(len(span) / len(own) / 10, 10)
        x[quality.CLASSES + 3] = math.log1p(len(own))
        for n in names:
            x[quality.CLASSES + 4 + (n >> 40) % quality.HASHED] += 1 / len(own)
        x[quality.CLASSES + 4 :] **= 0.5
        p = model.p
        h = np.tanh((x - model.mean) / model.scale @ p["W"] + p["b"])
        bag.append((math.exp(sum(w * math.tanh(v) * sigmoid(u) for w, v, u in zip(p["w"], h @ p["V"], h @ p["U"], strict=True))), h))
    if not bag:
        return 0.0
    whole = sum(e for e, _ in bag)
    return sigmoid(float(sum(e / whole * h for e, h in bag) @ model.p["c"] + model.p["d"][0]))


def toxic_probabilities(chain: toxicity.Chain, text: str | None) -> list[float]:
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").lower().encode())
    place = {int(h): k for k, h in enumerate(chain.vocabulary)}
    seen = [hashed(w) for w in words] + [int(mix(np.array([hashed(w[: toxicity.STEM])], np.uint64))[0]) for w in words if len(w) > toxicity.STEM]
    hits = [h for h in seen if h in place]
    x = [math.log1p(len(hits)), min(50 * len(hits) / max(len(words), 1), 5), *[0.0] * len(place)]
    for h in hits:
        x[2 + place[h]] = 1.0
    out: list[float] = []
    for w in chain.weights:
        out.append(sigmoid(sum(a * b for a, b in zip(w[:-1], x + out, strict=True)) + w[-1]))
    return out


def secret_candidates(text: str) -> list[tuple[int, int]]:
    data, out, before = text.encode(), [], b""
    for m in WORD.finditer(data):
        out += [(m.start() + a, m.start() + b) for a, b in secrets.pieces(m[0], before[-1:] in (b":", b"="))]
        before = m[0]
    return out


def secret_score(net: secrets.Network, text: str, a: int, b: int) -> float:
    data, best = text.encode(), -math.inf
    for s in range(a, b, secrets.SPAN):
        e, code = min(s + secrets.SPAN, b), [0] * secrets.BEFORE + [secrets.CHARS] * secrets.SPAN + [2 * secrets.CHARS] * secrets.AFTER
        of = lambda c: c - 30 if 32 <= c < 127 else 1
        for k, c in enumerate(reversed(data[max(0, s - secrets.BEFORE) : s])):
            code[secrets.BEFORE - 1 - k] += of(c)
        for k, c in enumerate(data[s:e]):
            code[secrets.BEFORE + k] += of(c)
        for k, c in enumerate(data[e : e + secrets.AFTER]):
            code[secrets.BEFORE + secrets.SPAN + k] += of(c)
        p, half, filters = net.p, secrets.WIDE // 2, []
        for at in range(secrets.LENGTH):
            window = [p["E"][code[i]] if 0 <= i < secrets.LENGTH else np.zeros(secrets.EMBED) for i in range(at - half, at + half + 1)]
            filters.append(np.concatenate(window) @ p["K"] + p["k"])
        top = np.concatenate([np.maximum(np.max(filters[x:y], axis=0), 0) for x, y in secrets.ZONES])
        best = max(best, float(np.maximum(top @ p["H"] + p["h"], 0) @ p["o"] + p["q"][0]))
    return sigmoid(net.slope * best + net.shift)


MASK = (1 << 64) - 1


def scrambled(h: int) -> int:
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
    return h ^ (h >> 31)


def meet(rows: list[tuple[int, int]], n: int, level: int, seed: int = mixing.SEED) -> tuple[set[int], tuple[int, int] | None]:
    """Of (hash, mass) the filled hashes, and the one left with its mass."""
    full, held, salt = set(), None, scrambled(seed * 1000 + level)
    for k, (h, b) in enumerate(sorted(rows)):
        u = (scrambled(scrambled((h + k) & MASK) ^ salt) >> 11) / 2.0**53
        if held is None:
            held = (h, b)
        else:
            other, a = held
            if a + b <= n:
                held = (other if u * (a + b) < a else h, a + b)
            elif u * (2 * n - a - b) < n - b:
                full.add(other)
                held = (h, a + b - n)
            else:
                full.add(h)
                held = (other, a + b - n)
        if held[1] == n:
            full.add(held[0])
            held = None
    return full, held


def copies(rows: list[tuple[object, object, int, int]], leaf: int = mixing.LEAF) -> dict[object, int]:
    """Copies of each id at tempered weights. rows: id, source, hash, leaf number; ids are unlike."""
    counts: dict[object, int] = {}
    for _, s, _, _ in rows:
        counts[s] = counts.get(s, 0) + 1
    want = mixing.shares(counts, *mixing.tempered(counts, mixing.ALPHA))
    out = {}
    for s, n in counts.items():
        base, mass = divmod(want[s], n)
        own = [r for r in rows if r[1] == s]
        groups: dict[int, list[tuple[int, int]]] = {}
        for _, _, h, at in own:
            groups.setdefault(at, []).append((h, mass))
        filled: set[int] = set()
        level, deep = 0, max(math.ceil(x / leaf) for x in counts.values())
        while mass:
            left: dict[int, list[tuple[int, int]]] = {}
            for at, members in groups.items():
                full, rest = meet(members, n, level)
                filled |= full
                if rest:
                    left.setdefault(at // mixing.FAN, []).append(rest)
            if deep <= 1:
                break
            groups, level, deep = left, level + 1, -(-deep // mixing.FAN)
        out |= {i: base + (h in filled) for i, _, h, _ in own}
    return out
