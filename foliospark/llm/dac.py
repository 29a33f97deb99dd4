"""Token ids as directly addressable codes (DACs): any token is read without decoding a block.

An id is split into chunks of bits, lowest first. Level 0 holds the first chunk of every id, level 1 the
second chunk of the ids that have one, and so on. Each level but the last has a continuation bitmap,
whose rank gives an id's place in the next level; a directory holds the rank before every 512 bits. The
chunk widths of each document are those, of at most four levels, that take the fewest bits for its ids.

Layout, little-endian: b"DA", levels (1 byte), number of ids (4 bytes); a width (1 byte) and a count
(4 bytes) for each level; then for each level its packed chunks and, but for the last level, its bitmap
and its directory of 4-byte ranks, each part filled up to whole bytes.

Defined results: null ids have a null code; no ids give a code of 0 ids; ids must be 0 to 2^31 - 1 (a
negative one or a null within a list raises ValueError). Equal lists have equal codes.
"""

from __future__ import annotations

import itertools
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import local_path, parts
from .sentencepieces import MODEL, Pieces

RANK_BITS, LEVELS = 512, 4
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@lru_cache(32)
def layouts(bits: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All splits of so many bits into up to four levels; what an id that reaches past b bits costs in each."""
    found, cost = [], []
    for k in range(min(LEVELS, bits)):
        for cuts in itertools.combinations(range(1, bits), k):
            edges = (0, *cuts, bits)
            c = np.zeros(bits)
            for a, b in itertools.pairwise(edges):
                c[a] = b - a + (0 if b == bits else 1 + 32 / RANK_BITS)
            found.append(tuple(b - a for a, b in itertools.pairwise(edges)))
            cost.append(c)
    return found, np.array(cost)


def encode(ids: np.ndarray) -> bytes:
    x = np.asarray(ids, np.int64)
    if len(x) and (x.min() < 0 or x.max() >= 1 << 31):
        raise ValueError("ids must be 0 to 2^31 - 1")
    if not len(x):
        return b"DA" + struct.pack("<BI", 0, 0)
    size = np.maximum(1, np.frexp(x.astype(np.float64))[1])
    bits = int(size.max())
    reach = len(x) - np.cumsum(np.bincount(size, minlength=bits + 1))[:bits]  # ids longer than b bits
    reach[0] = len(x)
    found, cost = layouts(bits)
    widths = found[int(np.argmin(cost @ reach))]
    heads, body = [], []
    for k, w in enumerate(widths):
        heads.append(struct.pack("<BI", w, len(x)))
        chunk = x & ((1 << w) - 1)
        body.append(np.packbits(((chunk[:, None] >> np.arange(w)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes())
        if k + 1 < len(widths):
            more = size > sum(widths[: k + 1])
            bitmap = np.packbits(more, bitorder="little")
            body.append(bitmap.tobytes())
            body.append(np.add.accumulate(np.append(0, np.add.reduceat(POPCOUNT[bitmap].astype(np.uint32), np.arange(0, len(bitmap), RANK_BITS // 8))))[:-1].astype("<u4").tobytes())
            x, size = x[more] >> w, size[more]
    return b"DA" + struct.pack("<BI", len(widths), len(ids)) + b"".join(heads) + b"".join(body)


class Codes:
    """Reads a code in place; only the bytes that hold a token's chunks and ranks are touched."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        if bytes(self.data[:2]) != b"DA":
            raise ValueError("not a directly addressable code")
        levels, self.n = struct.unpack_from("<BI", self.data, 2)
        at, self.levels = 7 + 5 * levels, []
        for k in range(levels):
            w, m = struct.unpack_from("<BI", self.data, 7 + 5 * k)
            bits = at
            at += (w * m + 7) // 8
            bitmap = ranks = None
            if k + 1 < levels:
                bitmap, ranks = at, at + (m + 7) // 8
                at = ranks + 4 * -(-((m + 7) // 8) // (RANK_BITS // 8))
            self.levels.append((w, m, bits, bitmap, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for w, _, bits, bitmap, ranks in self.levels:
            a, b = i * w, i * w + w
            value |= (int.from_bytes(self.data[bits + a // 8 : bits + (b + 7) // 8], "little") >> (a % 8) & ((1 << w) - 1)) << shift
            if bitmap is None or not self.data[bitmap + i // 8] >> (i % 8) & 1:
                break
            block = i // RANK_BITS
            inside = int.from_bytes(self.data[bitmap + block * (RANK_BITS // 8) : bitmap + i // 8 + 1], "little") & ((1 << (i % RANK_BITS)) - 1)
            i = struct.unpack_from("<I", self.data, ranks + 4 * block)[0] + inside.bit_count()
            shift += w
        return value

    def all(self) -> np.ndarray:
        out, at, shift = np.zeros(self.n, np.int64), np.arange(self.n), 0
        for w, m, bits, bitmap, _ in self.levels:
            flat = np.unpackbits(np.frombuffer(self.data[bits : bits + (w * m + 7) // 8], np.uint8), count=w * m, bitorder="little")
            out[at] |= (flat.reshape(m, w).astype(np.int64) << np.arange(w)).sum(1) << shift
            if bitmap is not None:
                at = at[np.unpackbits(np.frombuffer(self.data[bitmap : bitmap + (m + 7) // 8], np.uint8), count=m, bitorder="little").astype(bool)]
            shift += w
        return out


def _codes(lists: pa.ListArray) -> pa.Array:
    values = lists.flatten()
    if values.null_count:
        raise ValueError("an id is null")
    x = values.to_numpy(zero_copy_only=False)
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(n)
    return pa.array([encode(x[e - k : e]) if ok else None for e, k, ok in zip(ends, n, pc.is_valid(lists).to_pylist(), strict=True)], pa.binary())


def encode_lists(frame: DataFrame, ids: str = "token_ids", key: str = "doc_id") -> DataFrame:
    """key, n_tokens and codes of a column of lists of ids."""
    rows = frame.select(frame[key].alias("key"), frame[ids].cast("array<int>").alias("ids"))

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.list_value_length(lists), _codes(lists)], ["key", "n_tokens", "codes"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_tokens int, codes binary").withColumnRenamed("key", key)


def encode_texts(docs: DataFrame, model: str = MODEL, scores: str = "zipf", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and codes of each document's token ids, in one pass without a shuffle."""
    pieces = Pieces.load(model, scores)
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in parts(batch):
                lists = pieces.encode(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pc.list_value_length(lists), _codes(lists)], ["key", "n_tokens", "codes"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_tokens int, codes binary").withColumnRenamed("key", key)


def write_shards(coded: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """Writes each partition's codes to one binary file in a folder that all executors share.

    Returns where each lies: key, file, offset, length (-1, with no bytes, for a null code). A task that
    runs again writes the same file under the same name."""
    rows = coded.select(coded[key].alias("key"), "codes")

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get()
        files, base = local_path(folder)
        files.create_dir(base, recursive=True)
        name = f"codes-{at.partitionId():06d}.dac"
        offset, index = 0, []
        with files.open_output_stream(f"{base}/.{name}-{at.taskAttemptId()}") as out:
            for batch in batches:
                codes = batch.column(1).to_pylist()
                length = np.array([-1 if c is None else len(c) for c in codes], np.int64)
                ends = offset + np.cumsum(np.maximum(length, 0))
                index.append(pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(codes), pa.string()), pa.array(ends - np.maximum(length, 0)), pa.array(length)], ["key", "file", "offset", "length"]))
                out.write(b"".join(c for c in codes if c is not None))
                offset = int(ends[-1]) if len(ends) else offset
        files.move(f"{base}/.{name}-{at.taskAttemptId()}", f"{base}/{name}")
        yield from index

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, file string, offset long, length long").withColumnRenamed("key", key)
