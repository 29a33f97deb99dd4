"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of scored pieces.

The model file of a public tokenizer is read as it is (nothing is trained). Its pieces' log scores are
either the file's own (``scores="file"``) or, for files that hold merge ranks instead of log
probabilities, Zipf log probabilities of the rank, -ln(rank) - ln(H) (``scores="zipf"``).

Encoding puts a space before the text, writes spaces as the white-space marker, and finds the sequence
of pieces of highest total score. A character that no piece holds costs the lowest score less 10, as in
the public library, and is written as byte pieces. Decoding joins the pieces' bytes, turns markers into
spaces and drops the first. Ties go to the edge that starts first.

Defined results: a null text has null ids and a null decoded text; an empty text has no ids and decodes
to an empty text; the marker character itself (U+2581) decodes to a space, as in the public library;
control ids decode to nothing and the unknown id to " ⁇ ". Any other text decodes to itself.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import chunks, parts, ragged, span_hash, strings

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
KEPT = 1_000_000
KNOWN: dict[str, tuple] = {}  # of a worker process: hashes of stretches, sorted, and their ids
CHAR_LEN = np.ones(256, np.int64)
CHAR_LEN[0xC0:0xE0], CHAR_LEN[0xE0:0xF0], CHAR_LEN[0xF0:] = 2, 3, 4


def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol buffer message: number and content."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[i : i + n]
            i += n


def read_model(path: str) -> tuple[list[str], list[float], list[int]]:
    """Pieces, their scores and their kinds."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds = [], [], []
    for number, content in fields(data):
        if number == 1:
            m = dict(fields(content))
            pieces.append(m.get(1, b"").decode())
            scores.append(struct.unpack("<f", m[2])[0] if 2 in m else 0.0)
            kinds.append(m.get(3, NORMAL))
    return pieces, scores, kinds


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of each state; from state s byte c leads to t = base[s] + c if check[t] == s."""
    nodes: list[dict[int, int]] = [{}]
    value = [-1]
    for key, v in keys:
        s = 0
        for c in key:
            t = nodes[s].get(c)
            if t is None:
                t = len(nodes)
                nodes[s][c] = t
                nodes.append({})
                value.append(-1)
            s = t
        value[s] = v
    size = 4 * len(nodes) + 1024
    base, check, out = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = bytearray(size)
    taken[0] = 1
    place = {0: 0}
    queue, low, wide = [0], 1, 1
    for s in queue:
        kids = sorted(nodes[s])
        at = place.pop(s)
        out[at] = value[s]
        if not kids:
            continue
        if len(kids) == 1:  # these fill the gaps that wider states leave
            while taken[low] or low <= kids[0]:
                low += 1
            b = low - kids[0]
        else:
            b = wide
            while any(taken[b + c] for c in kids):
                b += 1
            wide = b
        base[at] = b
        for c in kids:
            taken[b + c] = 1
            check[b + c] = at
            place[nodes[s][c]] = b + c
        queue += [nodes[s][c] for c in kids]
    last = max(i for i, x in enumerate(taken) if x) + 257
    return base[:last].astype(np.int64), check[:last].copy(), out[:last].astype(np.int64)


@dataclass
class Pieces:
    """A model made ready; small and of a size set by its vocabulary, so it goes to the tasks with their code."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    score: np.ndarray
    unk_score: float
    unk_id: int
    byte_id: np.ndarray
    longest: int
    by_space: bool
    alone: np.ndarray
    piece_start: np.ndarray
    piece_len: np.ndarray
    piece_bytes: np.ndarray
    single: np.ndarray
    name: str
    lists: list | None = field(default=None, repr=False)

    @classmethod
    def load(cls, path: str = MODEL, scores: str = "zipf") -> Pieces:
        pieces, score, kinds = read_model(path)
        if scores == "zipf":
            first = next(i for i, k in enumerate(kinds) if k == NORMAL)
            total = math.log(sum(1 / r for r in range(1, len(pieces) - first + 1)))
            score = [-math.log(i - first + 1) - total if k == NORMAL else 0.0 for i, k in enumerate(kinds)]
        elif scores != "file":
            raise ValueError(f"scores: file or zipf, not {scores}")
        keys = [(p.replace("▁", " ").encode(), i) for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k in (NORMAL, USER)]
        base, check, value = double_array(keys)
        byte_id = np.full(256, -1, np.int32)
        surface = []
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == BYTE:
                byte_id[int(p[3:5], 16)] = i
                surface.append(bytes([int(p[3:5], 16)]))
            else:
                surface.append(b"" if k in (CONTROL, UNUSED) else " ⁇ ".encode() if k == UNKNOWN else p.replace("▁", " ").encode())
        length = np.array([len(s) for s in surface], np.int64)
        held = {c for k, _ in keys if len(k) > 1 for c in k}
        return cls(
            base, check, value, np.array(score, np.float32), np.float32(min(s for s, k in zip(score, kinds, strict=True) if k == NORMAL)) - np.float32(10), kinds.index(UNKNOWN), byte_id,
            max(len(k) for k, _ in keys), not any(b" " in k.lstrip(b" ") for k, _ in keys), np.array([c < 128 and c != 32 and c not in held for c in range(256)]),
            np.cumsum(length) - length, length, np.frombuffer(b"".join(surface), np.uint8),
            np.isin(np.arange(256), [k[0] for k, _ in keys if len(k) == 1]), f"{path} {scores}",
        )

    def segments(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the stretches that no piece crosses, and len + 1 offsets of each text's first."""
        cut = np.zeros(len(buf), bool)
        cut[offsets[:-1][offsets[:-1] < len(buf)]] = True
        if self.by_space:
            space = buf == 32
            cut[1:] |= space[1:] & ~space[:-1]
        alone = self.alone[buf]
        cut |= alone
        cut[1:] |= alone[:-1]
        starts = np.flatnonzero(cut)
        return starts, np.searchsorted(starts, offsets)

    def viterbi(self, m: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and id of each piece of the best path of each row of bytes.

        Rows come longest first and are filled up with 255, which no text holds, so all of them step through
        the trie together. best and how are the paths' arrays, laid out flat: a row has width + 1 places."""
        n, width = m.shape
        w = width + 1
        m = m.ravel()
        best = np.full(n * w, -np.inf, np.float32)
        best[::w] = 0
        how = np.full(n * w, -1, np.int64)  # piece id (or -1) in the high half, start in the low half
        alive_at = n - np.searchsorted(lens[::-1], np.arange(width), "right")
        for i in range(width):
            rows = np.arange(alive_at[i])
            place = rows * w + i
            till = best[place]
            live = till > -np.inf
            if not live.all():
                rows, place, till = rows[live], place[live], till[live]
            if not len(rows):
                continue
            byte = rows * width + i
            c = m[byte]
            char = CHAR_LEN[c]
            single, wide = self.single[c], char.max() > 1
            k, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for j in range(min(self.longest, width - i)):
                t = self.base[node] + m[byte[k] + j]
                ok = np.flatnonzero(self.check[t] == node)
                if not len(ok):
                    break
                k, node = k[ok], t[ok]
                v = self.value[node]
                has = np.flatnonzero(v >= 0)
                if not len(has):
                    continue
                kk, v = k[has], v[has]
                if wide and 0 < j < 4:
                    single[kk[char[kk] == j + 1]] = True
                to, cand = place[kk] + (j + 1), till[kk] + self.score[v]
                up = np.flatnonzero(cand > best[to])
                to = to[up]
                best[to], how[to] = cand[up], (v[up] << 32) + i
            if not single.all():
                rest = np.flatnonzero(~single)
                to, cand = place[rest] + np.minimum(char[rest], lens[rows[rest]] - i), till[rest] + self.unk_score
                up = np.flatnonzero(cand > best[to])
                to = to[up]
                best[to], how[to] = cand[up], (-1 << 32) + i
        found, rows, pos = [], np.arange(n), lens.copy()
        while len(rows := rows[pos[rows] > 0]):
            p = pos[rows]
            x = how[rows * w + p]
            b, v = x & 0xFFFFFFFF, (x >> 32).astype(np.int32)
            if (v >= 0).all():
                found.append((rows, b, v))
            else:
                known = v >= 0
                found.append((rows[known], b[known], v[known]))
                r, s, e = rows[~known], b[~known], p[~known]
                if (self.byte_id >= 0).all():
                    at, r = ragged(s, e - s), np.repeat(r, e - s)
                    found.append((r, at, self.byte_id[m[r * width + at]]))
                else:
                    found.append((r, s, np.full(len(r), self.unk_id, np.int32)))
            pos[rows] = b
        row, start, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(row * width + start, kind="stable")
        return row[order], start[order], ids[order]

    def viterbi_one(self, data: bytes) -> list[int]:
        """The same for one long stretch, where steps over arrays of one row would cost more than plain ones."""
        if self.lists is None:
            self.lists = [x.tolist() for x in (self.base, self.check, self.value)] + [list(self.score)]
        base, check, value, score = self.lists
        n, lowest = len(data), np.float32(-np.inf)
        best, back, pid = [lowest] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = np.float32(0)
        for i in range(n):
            till = best[i]
            if till == lowest:
                continue
            node, single, end = 0, False, i + int(CHAR_LEN[data[i]])
            for j in range(i, min(n, i + self.longest)):
                t = base[node] + data[j]
                if check[t] != node:
                    break
                node = t
                v = value[t]
                if v >= 0:
                    single |= j + 1 == end
                    if (x := till + score[v]) > best[j + 1]:
                        best[j + 1], back[j + 1], pid[j + 1] = x, i, v
            if not single and (x := till + self.unk_score) > best[end := min(end, n)]:
                best[end], back[end], pid[end] = x, i, -1
        out: list[int] = []
        while n:
            i = back[n]
            if pid[n] >= 0:
                out.append(pid[n])
            elif (self.byte_id >= 0).all():
                out += [int(self.byte_id[c]) for c in reversed(data[i:n])]
            else:
                out.append(self.unk_id)
            n = i
        return out[::-1]

    def stretches(self, buf: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each stretch, and all ids one after the other."""
        count, parts, left = np.zeros(len(s), np.int64), [], 0
        while left < n.max():
            right = max(8, left * 3 // 2)
            pick = np.flatnonzero((n > left) & (n <= right))
            left = right
            if right > 64 and len(pick) < right:
                for k in pick:
                    ids = self.viterbi_one(buf[s[k] : s[k] + n[k]].tobytes())
                    count[k] = len(ids)
                    parts.append((pick[pick == k], np.array(ids, np.int32)))
                continue
            pick = pick[np.argsort(-n[pick], kind="stable")]
            step = max(1, (1 << 19) // right)
            for a in range(0, len(pick), step):
                own = pick[a : a + step]
                m = np.full((len(own), int(n[own[0]])), 255, np.uint8)
                m[np.repeat(np.arange(len(own)), n[own]), ragged(np.zeros(len(own), np.int64), n[own])] = buf[ragged(s[own], n[own])]
                row, _, ids = self.viterbi(m, n[own])
                count[own] = np.bincount(row, minlength=len(own))
                parts.append((own, ids))
        begin = np.zeros(len(s), np.int64)
        total = 0
        for own, ids in parts:
            begin[own] = total + np.cumsum(count[own]) - count[own]
            total += len(ids)
        return count, np.concatenate([x for _, x in parts])[ragged(begin, count)]

    def encode_bytes(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and len + 1 offsets. A stretch is decoded once; a worker remembers ``KEPT`` of them."""
        starts, first = self.segments(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(buf))
        hashes, at, inverse = np.unique(span_hash(buf, starts, ends) ^ (ends - starts).astype(np.uint64), return_index=True, return_inverse=True)
        known, begin, count, ids = KNOWN.get(self.name) or (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        place = np.searchsorted(known, hashes)
        new = np.flatnonzero(known[np.minimum(place, len(known) - 1)] != hashes) if len(known) else np.arange(len(hashes))
        if len(new):
            c, more = self.stretches(buf, starts[at[new]], ends[at[new]] - starts[at[new]])
            b = np.cumsum(c) - c + len(ids)
            known, begin, count, ids = np.insert(known, place[new], hashes[new]), np.insert(begin, place[new], b), np.insert(count, place[new], c), np.concatenate([ids, more])
            if len(known) <= KEPT:
                KNOWN[self.name] = known, begin, count, ids
            else:
                KNOWN.pop(self.name, None)
            place = np.searchsorted(known, hashes)
        each = count[place][inverse]
        ends_of = np.concatenate([[0], np.cumsum(each)])
        return ids[ragged(begin[place][inverse], each)], ends_of[first]

    def encode(self, texts: pa.Array) -> pa.ListArray:
        known = strings(texts)
        if pc.any(pc.match_substring(known, "▁")).as_py():
            known = pc.replace_substring(known, "▁", " ")
        marked = pc.if_else(pc.equal(pc.binary_length(known), 0), "", pc.binary_join_element_wise(pa.scalar("", pa.large_string()), known, pa.scalar(" ", pa.large_string())))
        ids, counts = [], []
        for _, _, buf, offsets in chunks(marked, size=1 << 21):
            x, o = self.encode_bytes(buf, offsets)
            ids.append(x)
            counts.append(np.diff(o))
        offsets = np.concatenate([[0], *([np.concatenate(counts).cumsum()] if counts else [])]).astype(np.int32)
        values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
        return pc.if_else(pc.is_valid(texts), made, pa.scalar(None, made.type)) if texts.null_count else made

    def decode(self, lists: pa.ListArray) -> pa.StringArray:
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        length = self.piece_len[ids]
        data = self.piece_bytes[ragged(self.piece_start[ids], length)]
        token_end = np.concatenate([[0], np.cumsum(length)])
        o = token_end[np.concatenate([[0], np.cumsum(n)]).astype(np.int64)]
        filled = np.flatnonzero(np.diff(o) > 0)
        lead = filled[data[o[filled]] == 32]
        keep = np.ones(len(data), bool)
        keep[o[lead]] = False
        dropped = np.zeros(len(o), np.int64)
        dropped[lead + 1] = 1
        o, data = (o - np.cumsum(dropped)).astype(np.int64), data[keep]
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(o), pa.py_buffer(np.ascontiguousarray(data))])
        try:
            out = made.cast(pa.large_string())
        except pa.ArrowInvalid:
            out = pa.array([x.decode(errors="replace") for x in made.to_pylist()], pa.large_string())
        return pc.if_else(pc.is_valid(lists), out, pa.scalar(None, out.type)).cast(pa.string())


def encode_decode(docs: DataFrame, model: str = MODEL, scores: str = "zipf", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, token_ids, n_tokens and decoded, a row for each row of docs; other columns are left out, so none can clash.

    One pass without a shuffle. n_tokens is null where the text is."""
    pieces = Pieces.load(model, scores)
    source = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in parts(batch):
                ids = pieces.encode(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pc.list_value_length(ids), pieces.decode(ids)], ["key", "token_ids", "n_tokens", "decoded"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, token_ids array<int>, n_tokens int, decoded string").withColumnRenamed("key", key)
