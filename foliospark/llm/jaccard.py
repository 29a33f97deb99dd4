"""N-gram Jaccard join by count-vector R-trees.

A text's set is its distinct runs of ``NGRAM`` lower-cased words (a text of fewer words has one run, all of
it). Two texts pair if their sets' Jaccard similarity is ``THRESHOLD`` or more.

The tree: a set's n-grams are hashed into groups, and the group counts are a point. The overlap of two sets
is at most the sum over groups of the lesser count, and with a box of points the sum of the lesser of
count and upper corner. A branch is left out if that is below t / (1 + t) times the least sum of sizes, and
pairs of points that survive are verified by their n-grams.

A tree over unrelated texts can't tell them apart by boxes alone: in many dimensions boxes of random
points cover each other, and the work grows with the square of the corpus. So sets are first brought
together: each of many groups is represented by its least n-gram (an empty group by the next one's), and a
set sends ``bands(t)`` keys of ``ROWS`` representatives each. Two sets of similarity s share a key with
chance s^ROWS, and there are enough keys that a pair of similarity exactly t is expected to share
``AGREE``; it is missed with a chance of about exp(-AGREE), 0.25 %, and more alike ones less. The members of a
key are linked to its least, and links whose count vectors rule out a similarity of t^2 go. That says nothing of the
members left over: each is compared with all members of the key that it is not yet connected with, and linked
unless the counts rule out t, so no pair that shares a key is lost to an unlike third text. What is connected is
a neighbourhood. A large one is cut into tiles of like sizes, tiles of sizes that can't pair are left out,
and each pair of tiles is joined through a tree. No bound on members or partners.

All this is done with sets, each once however many rows have it: a task sends a set's keys when it first meets it, and
ids come back by a join on the set's name. ``near_pairs`` gives all pairs of ids, which grow with the square of a group; ``classes`` gives
each id's class and number of links instead, from the same comparisons. ``distinct_texts`` needs connections only, not all pairs: each set is
first compared with one it is linked to, and then only with those that it is not yet connected with.

Defined results: null and empty texts and rows without an id are in no pair; repeated rows of one id
count once; ids of a pair are in order, never equal. Where rows of one id have different texts each
is compared. In ``classes`` ids without words are classes of their own. In ``distinct_texts`` rows without words and rows without an id stay, and rows of one id and one set
count once. Extra columns are kept by ``distinct_texts``, whatever their names, and left out by ``near_pairs`` and ``classes``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, LongType, StructField, StructType

from .common import chunks, free, gone, local_path, mix, ragged, span_hash, words, written

NGRAM, THRESHOLD, AGREE, ROWS, TILE, LEAF, BITS, PART, HELD, MARKS, SLICES = 2, 0.6, 6.0, 5, 256, 8, np.uint64(48), 1 << 20, 1 << 20, 28, 8


def gram_sets(buf: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 48-bit n-grams of each text, and len + 1 offsets."""
    if len(offsets) > 1 << 15:
        raise ValueError("too many texts in a chunk")
    starts, ends, first = words(buf, offsets)
    size = np.diff(first)
    h = span_hash(buf, starts, ends)
    doc = np.repeat(np.arange(len(size)), size)
    left = first[1:][doc] - np.arange(len(h))
    g = np.zeros(len(h), np.uint64)
    for k in range(n):
        have = np.flatnonzero(left > k)
        g[have] += mix(h[have + k] + np.uint64(k * 2 + 1)) * np.uint64(2 * k + 1)
    whole = (left >= n) | (left == size[doc])
    key = np.sort((doc[whole].astype(np.uint64) << BITS) | (mix(g[whole]) >> np.uint64(16)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    at = np.searchsorted(key >> BITS, np.arange(len(size) + 1, dtype=np.uint64))
    return key & np.uint64((1 << 48) - 1), at


def segment_sum(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of x[at[i]:at[i + 1]], with 0 for empty ones."""
    total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)])
    return total[at[1:]] - total[at[:-1]]


def names(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each set; equal sets have the same."""
    return mix(segment_sum(mix(grams), at) + np.diff(at).astype(np.uint64)).view(np.int64)


def bands(t: float) -> int:
    return math.ceil(AGREE / t**ROWS)


def keys(grams: np.ndarray, at: np.ndarray, t: float) -> np.ndarray:
    """The keys of each set that has any n-grams: a row for each set.

    Each of a key's representatives comes from a grouping of its own, and from another place in it, so that
    the keys of a small set, whose groups are mostly empty, don't repeat each other."""
    count, n = bands(t), len(at) - 1
    doc = np.repeat(np.arange(n) * count, np.diff(at))
    out, none = np.zeros((n, count), np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF)
    for r in range(ROWS):
        h = mix(grams ^ np.uint64((r + 1) << 56))
        least = np.full(n * count, none)
        np.minimum.at(least, doc + (((h >> np.uint64(16)) * np.uint64(count)) >> BITS).astype(np.int64), mix(h))
        least = least.reshape(n, count)
        nearest = np.where(least != none, np.arange(count), 2 * count)
        wrap = nearest.min(1, keepdims=True) + count
        nearest = np.minimum(np.minimum.accumulate(nearest[:, ::-1], 1)[:, ::-1], wrap)
        value = np.take_along_axis(least, nearest % count, 1) + (nearest - np.arange(count)).astype(np.uint64)
        out = mix(out ^ value[:, np.random.default_rng(r).permutation(count)])
    return mix(out + np.arange(count, dtype=np.uint64)).view(np.int64)


def counted(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each set's n-grams in groups, as many as n-grams, a power of 2, a byte each, and len + 1 offsets."""
    size = np.diff(at)
    power = np.ceil(np.log2(np.maximum(size, 8))).astype(np.int64)
    end = np.concatenate([[0], np.cumsum(2**power)])
    place = np.repeat(end[:-1], size) + (grams >> np.repeat(int(BITS) - power, size).astype(np.uint64)).astype(np.int64)
    return np.minimum(np.bincount(place, minlength=int(end[-1])), 255).astype(np.uint8), end


def vectors(grams: np.ndarray, at: np.ndarray) -> list[bytes]:
    flat, end = counted(grams, at)
    return [flat[a:b].tobytes() for a, b in zip(end[:-1], end[1:], strict=True)]


def may_pair(a: bytes, b: bytes, t: float) -> bool:
    """Whether the counts' bound allows a similarity of t."""
    return bool(may_pairs(pa.array([a], pa.binary()), pa.array([b], pa.binary()), t)[0])


def may_pairs(a: pa.Array, b: pa.Array, t: float) -> np.ndarray:
    """``may_pair`` of each row's two vectors, those of the same widths at once."""
    out = np.zeros(len(a), bool)
    wide = [pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)]
    for x, y in np.unique(np.stack(wide, 1), axis=0).tolist():
        own = np.flatnonzero((wide[0] == x) & (wide[1] == y))
        step, w = max(1, (1 << 21) // (x + y)), min(x, y)
        for k in range(0, len(own), step):
            rows = own[k : k + step]
            u, v = (raw_bytes(c.take(pa.array(rows))).reshape(len(rows), w, -1).sum(2, dtype=np.int32) for c in (a, b))
            out[rows] = np.minimum(u, v).sum(1) * (1 + t) >= t * (u.sum(1) + v.sum(1)) - 1e-9
    return out


def raw_bytes(column: pa.Array) -> np.ndarray:
    """All bytes of a column without nulls, one value after the other."""
    wide = column.cast(pa.large_binary())
    o = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8)
    return np.frombuffer(wide.buffers()[2], np.uint8)[o[0] : o[-1]]


def members_links(vectors_: list[bytes], left: np.ndarray, sides: np.ndarray | None, t: float) -> list[tuple[int, int]]:
    """Links that connect all members whose counts' bound allows t, of pairs with one left over at least; the others are connected.

    sides: only pairs of unlike sides are compared; None: all."""
    width = np.array([len(v) for v in vectors_])
    own = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
    points = {w: np.frombuffer(b"".join(vectors_[k] for k in rows), np.uint8).reshape(len(rows), w) for w, rows in own.items()}
    total = np.array([int(np.frombuffer(v, np.uint8).sum(dtype=np.int64)) for v in vectors_])
    folded: dict[tuple[int, int], np.ndarray] = {}

    def fold(w: int, to: int) -> np.ndarray:
        if w <= to:
            return points[w]
        if (w, to) not in folded:
            folded[w, to] = points[w].reshape(len(points[w]), to, -1).sum(2, dtype=np.uint32)
        return folded[w, to]

    part = np.where(left, np.arange(len(left)) + 1, 0)  # what is connected has one number
    out = []
    for k in np.flatnonzero(left).tolist():
        x, n = np.frombuffer(vectors_[k], np.uint8), total[k]
        for w, rows in own.items():
            pick = (part[rows] != part[k]) & (total[rows] >= t * n - 1e-9) & (total[rows] * t <= n + 1e-9)
            if sides is not None:
                pick &= sides[rows] != sides[k]
            pick = np.flatnonzero(pick)
            if not len(pick):
                continue
            to = min(w, len(x))
            both = np.minimum(fold(w, to)[pick], x.reshape(to, -1).sum(1, dtype=np.uint32)).sum(1, dtype=np.int64)
            for m in rows[pick[both * (1 + t) >= t * (n + total[rows[pick]]) - 1e-9]].tolist():
                if part[m] != part[k]:
                    out.append((k, m))
                    part[part == part[m]] = part[k]
    return out


def sent(docs: DataFrame, n: int, t: float, key: str, text: str) -> DataFrame:
    """What is known of the sets, in one pass: (key, name) for each key of a set, (name, size, vector) for each
    set, both once a task, and (name, id) for each row that has an id and words."""
    rows = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    columns = ["key", "name", "size", "vector", "id"]

    def send(batches):
        seen = np.zeros(0, np.int64)
        for batch in batches:
            ids, none = batch.column(0), lambda k: pa.nulls(k, pa.int64())
            for first, last, buf, offsets in chunks(batch.column(1), lower=True):
                grams, at = gram_sets(buf, offsets, n)
                own = np.flatnonzero(np.diff(at))
                at = np.append(at[own], at[-1])
                name = names(grams, at)
                given = ids.slice(first, last - first).take(pa.array(own))
                has = given.is_valid()
                many = pc.sum(has).as_py() or 0
                yield pa.RecordBatch.from_arrays([none(many), pa.array(name).filter(has), none(many), pa.nulls(many, pa.binary()), given.filter(has)], columns)
                fresh, at0 = np.unique(name, return_index=True)
                at0 = at0[~np.isin(fresh, seen, assume_unique=True)]
                seen = np.union1d(seen, fresh)
                size = np.diff(at)[at0]
                grams, name, at = grams[ragged(at[at0], size)], name[at0], np.concatenate([[0], np.cumsum(size)])
                sets = len(name)
                if not sets:
                    continue
                key = keys(grams, at, t)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(name, key.shape[1])), none(key.size), pa.nulls(key.size, pa.binary()), pa.nulls(key.size, ids.type)], columns)
                flat, end = counted(grams, at)
                vector = pa.Array.from_buffers(pa.large_binary(), sets, [None, pa.py_buffer(end.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([none(sets), pa.array(name), pa.array(size), vector, pa.nulls(sets, ids.type)], columns)

    return rows.mapInArrow(send, f"key long, name long, size long, vector binary, id {kind}")


def joined_by_key(sent_: DataFrame, t: float) -> DataFrame:
    """Links a, b (a below b) between sets. sent_: a table of what ``sent`` gives."""

    def meet(batches):  # sorted by key and name
        keys_, names_, held = [], [], 0
        for batch in batches:
            keys_.append(batch.column(0).to_numpy())
            names_.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held >= HELD and keys_[-1][-1] != keys_[0][0]:
                key, name = np.concatenate(keys_), np.concatenate(names_)
                cut = int(np.searchsorted(key, key[-1]))  # the last key may have more
                yield from met(key[:cut], name[:cut])
                keys_, names_, held = [key[cut:]], [name[cut:]], 0
        if keys_:
            yield from met(np.concatenate(keys_), np.concatenate(names_))

    def met(key, name):
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])  # other tasks may have sent it too
        key, name = key[new], name[new]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.append(np.flatnonzero(new), len(key))
        size = np.diff(first)
        group = mix(segment_sum(mix(name.view(np.uint64)), first) + size.astype(np.uint64)).view(np.int64)  # the same members under many keys are one
        a, group, many = (np.repeat(x, size)[~new] for x in (name[first[:-1]], group, size > 2))
        b = name[~new]
        group[~many] = 0
        if len(a):
            order = np.lexsort((b, a, group))
            a, b, group, many = a[order], b[order], group[order], many[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (group[1:] != group[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(group[new], mask=~many[new]), pa.array(a[new]), pa.array(b[new])], ["g", "a", "b"])

    def prune(batches):
        for batch in batches:
            near = may_pairs(batch.column(2), batch.column(3), t * t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], ["a", "b", "near"])

    def among(group, rows):
        side, left = (rows[c].to_numpy(zero_copy_only=False) for c in ("side", "left"))
        found = members_links(rows["vector"].to_pylist(), left, None if group[1].as_py() == group[2].as_py() else side, t)
        name = rows["name"].to_numpy()
        ends = name[np.array(found, np.int64).reshape(-1, 2)]
        return pa.table({"a": ends.min(1), "b": ends.max(1)})

    keyed = sent_.where("key IS NOT NULL").select("key", "name").repartition("key").sortWithinPartitions("key", "name")
    links = written(keyed.mapInArrow(meet, "g long, a long, b long").distinct(), "links")
    of = sent_.where("vector IS NOT NULL").select("name", "vector").join(links.select(F.col("a").alias("name")).union(links.select("b")), "name", "left_semi").groupBy("name").agg(F.first("vector").alias("vector"))
    ends = links.select("a", "b").distinct().join(of.toDF("a", "va"), "a").join(of.toDF("b", "vb"), "b").select("a", "b", "va", "vb")
    told = written(ends.mapInArrow(prune, "a long, b long, near boolean"), "told")
    apart = links.where("g IS NOT NULL").join(told.where("NOT near").select("a", "b"), ["a", "b"]).select("g", F.col("b").alias("name"), F.lit(True).alias("left"))
    apart = written(apart, "apart")
    found = told.where("near").select("a", "b")
    if apart.isEmpty():
        out = written(found, "agreeing")
        gone(links, told, apart)
        return out
    members = links.join(apart.select("g").distinct(), "g", "left_semi").select("g", F.explode(F.array("a", "b")).alias("name")).distinct()
    members = members.join(apart, ["g", "name"], "left").select("g", "name", F.coalesce("left", F.lit(False)).alias("left")).join(of, "name")
    total = Window.partitionBy("g").orderBy(F.octet_length("vector"), "name").rowsBetween(Window.unboundedPreceding, 0)
    members = written(members.withColumn("part", F.floor((F.sum(F.octet_length("vector")).over(total) - 1) / PART).cast("int")), "members")
    parts_ = members.groupBy("g", "part").agg(F.min(F.octet_length("vector")).alias("least"), F.max(F.octet_length("vector")).alias("most"), F.max("left").alias("any"))
    x, y = parts_.alias("x"), parts_.alias("y")
    meets = x.join(y, F.expr(f"x.g = y.g AND x.part <= y.part AND (x.any OR y.any) AND 2 * x.most >= {t} * y.least")).select(F.col("x.g").alias("g"), F.col("x.part").alias("i"), F.col("y.part").alias("j"))
    inside = meets.select("g", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("part"))
    both = members.join(inside, ["g", "part"]).select("g", "i", "j", (F.col("part") == F.col("j")).alias("side"), "name", "left", "vector")
    out = written(found.union(both.groupBy("g", "i", "j").applyInArrow(among, "a long, b long")).distinct(), "agreeing")
    gone(links, told, apart, members)
    return out


def forest_of(pair: np.ndarray) -> np.ndarray:
    """Of edges between nodes those that a spanning forest needs, and all from a node to itself."""
    nodes, index = np.unique(pair, return_inverse=True)
    parent, keep = list(range(len(nodes))), []
    for k, (u, v) in enumerate(index.reshape(-1, 2).tolist()):
        if u == v:
            keep.append(k)
            continue
        while parent[u] != u:
            parent[u] = u = parent[parent[u]]
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        if u != v:
            parent[max(u, v)] = min(u, v)
            keep.append(k)
    return pair[keep]


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node that it is connected with. edges: a, b.

    Alternates the large and the small star until nothing changes; the rounds grow with the logarithm of a
    component's size."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now, was = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == was or not state[0]:
            break
        was = state
        both = now.union(now.select("b", "a"))
        w = Window.partitionBy("a")
        large = both.withColumn("m", F.least(F.min("b").over(w), "a")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.withColumn("m", F.min("b").over(w))
        small = small.select("b", "m").where("b <> m").union(small.select("a", "m")).toDF("a", "b").distinct()
        now, old = written(small, "stars"), now
        gone(old)
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def with_name(docs: DataFrame, n: int, text: str, name: str) -> DataFrame:
    """docs with the name of each text's set (null without words); all columns are kept."""
    place = docs.columns.index(text)
    out = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)] + [StructField(name, LongType())])

    def run(batches):
        for batch in batches:
            made, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, buf, offsets in chunks(batch.column(place), lower=True):
                grams, at = gram_sets(buf, offsets, n)
                made.append(names(grams, at))
                size.append(np.diff(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(made), mask=np.concatenate(size) == 0)], [f"c{k}" for k in range(batch.num_columns)] + [name])

    return docs.mapInArrow(run, out).toDF(*docs.columns, name)


class Marks:
    """Which of 2^MARKS ranges of names have a node, a bit each: a filter of one size for any number of nodes, which lets some others
    through and loses none."""

    loaded: tuple[str, np.ndarray] | None = None

    @staticmethod
    def write(nodes: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                n = batch.column(0).to_numpy().view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array((n >> np.uint64(64 - MARKS)).astype(np.int64))], ["bit"])

        def slice_(group, rows):
            bits = np.zeros(1 << MARKS - SLICES, bool)
            bits[rows["bit"].to_numpy() & (len(bits) - 1)] = True
            return pa.table({"slice": pa.array([group[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

        ranges = nodes.select("node").mapInArrow(run, "bit long").distinct()
        return written(ranges.groupBy(F.shiftright("bit", MARKS - SLICES).alias("slice")).applyInArrow(slice_, "slice long, bits binary"), "marks")

    @classmethod
    def load(cls, path: str) -> np.ndarray:
        if cls.loaded is None or cls.loaded[0] != path:
            from pyarrow import fs
            from pyarrow import parquet as pq

            files, at = local_path(path)
            out = np.zeros(1 << MARKS - 3, np.uint8)
            for x in files.get_file_info(fs.FileSelector(at)):
                if x.path.endswith(".parquet"):
                    t = pq.read_table(x.path, filesystem=files)
                    for k, bits in zip(t["slice"].to_pylist(), t["bits"].to_pylist(), strict=True):
                        out[k << MARKS - SLICES - 3 : (k + 1) << MARKS - SLICES - 3] = np.frombuffer(bits, np.uint8)
            cls.loaded = path, out
        return cls.loaded[1]


def texts_of(docs: DataFrame, n: int, text: str, nodes: DataFrame) -> DataFrame:
    """node and text of the sets that nodes names, one text of each; a task sends a set's text once, and few others' texts."""
    rows = docs.select(docs[text].cast("string").alias("text"))
    path = Marks.write(nodes).folder_written

    def run(batches):
        seen, marks = np.zeros(0, np.int64), Marks.load(path)
        for batch in batches:
            for first, last, buf, offsets in chunks(batch.column(0), lower=True):
                grams, at = gram_sets(buf, offsets, n)
                own = np.flatnonzero(np.diff(at))
                fresh, at0 = np.unique(names(grams, np.append(at[own], at[-1])), return_index=True)
                bit = (fresh.view(np.uint64) >> np.uint64(64 - MARKS)).astype(np.int64)
                new = np.flatnonzero(marks[bit >> 3] >> (7 - (bit & 7)) & 1)
                new = new[~np.isin(fresh[new], seen, assume_unique=True)]
                seen = np.union1d(seen, fresh[new])
                yield pa.RecordBatch.from_arrays([pa.array(fresh[new]), batch.column(0).slice(first, last - first).take(pa.array(own[at0[new]]))], ["node", "text"])

    return rows.mapInArrow(run, "node long, text string").join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))


class Tree:
    """Bulk-loaded: points are halved along the dimension of widest spread until ``LEAF`` are left; a node's box is kept by its upper corner and least size."""

    def __init__(self, points: np.ndarray, size: np.ndarray):
        self.points, self.size = points, size
        self.top, self.least, self.most, self.kids, self.rows = [], [], [], [], []
        self.root = self.build(np.arange(len(points)))
        self.top = np.array(self.top)
        self.least, self.most = np.array(self.least), np.array(self.most)

    def build(self, rows: np.ndarray) -> int:
        at, own = len(self.top), self.points[rows]
        self.top.append(own.max(0))
        self.least.append(self.size[rows].min())
        self.most.append(self.size[rows].max())
        self.kids.append(())
        self.rows.append(rows)
        if len(rows) > LEAF:
            spread = own.max(0) - own.min(0)
            size = self.size[rows]
            by = size if size.max() - size.min() >= spread.max() else own[:, int(spread.argmax())]
            order = rows[np.argsort(by, kind="stable")]
            self.kids[at] = (self.build(order[: len(order) // 2]), self.build(order[len(order) // 2 :]))
        return at

    def partners(self, q: np.ndarray, n: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        """Query and point of each pair that the bounds can't rule out."""
        need = t / (1 + t)
        out, stack = [], [(self.root, np.arange(len(q)))]
        while stack:
            node, who = stack.pop()
            least, most = self.least[node], self.most[node]
            who = who[(n[who] >= t * least) & (n[who] * t <= most)]
            who = who[np.minimum(q[who], self.top[node]).sum(1) >= need * (n[who] + np.maximum(least, t * n[who])) - 1e-9]
            if not len(who):
                continue
            if self.kids[node]:
                stack += [(k, who) for k in self.kids[node]]
                continue
            rows = self.rows[node]
            bound = np.minimum(q[who][:, None], self.points[rows][None]).sum(2)
            i, j = np.nonzero(bound >= need * (n[who][:, None] + self.size[rows][None]) - 1e-9)
            out.append((who[i], rows[j]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def similar(grams: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, t: float, kin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i, j of sets of left and right (i before j where both are on both sides) with their similarity, t at least.

    kin: numbers of which only unlike ones are compared."""
    size = np.diff(at)
    width = int(min(128, max(8, 2 ** math.ceil(math.log2(max(1, size.max() / 6))))))
    doc = np.repeat(np.arange(len(size)), size)
    points = np.bincount(doc * width + ((grams * np.uint64(width)) >> BITS).astype(np.int64), minlength=len(size) * width).reshape(-1, width).astype(np.int32)
    i, j = Tree(points[right], size[right]).partners(points[left], size[left], t)
    i, j = left[i], right[j]
    keep = i < j if kin is None else (i < j) & (kin[i] != kin[j])
    i, j = i[keep], j[keep]
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    out = np.zeros(len(i))
    edges = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]])) if len(i) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = grams[at[i[a]] : at[i[a] + 1]]
        for a2 in range(a, b, 256):
            who = j[a2 : min(b, a2 + 256)]
            x = grams[ragged(at[who], size[who])]
            place = np.minimum(np.searchsorted(own, x), len(own) - 1)
            both = segment_sum((own[place] == x).astype(np.int64), np.concatenate([[0], np.cumsum(size[who])]))
            out[a2 : a2 + len(who)] = both / (len(own) + size[who] - both)
    ok = out >= t
    return i[ok], j[ok], out[ok]


def tiled(nodes: DataFrame, t: float, tile: int) -> DataFrame:
    """nodes with the tile of their neighbourhood, named by its size class and two numbers, those of one sub together.

    A neighbourhood of one tile's worth is one tile. nodes: node, size, root, sub; those alone in their root are left out."""
    whole = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("all"), F.min("sub").alias("low"), F.max("sub").alias("high")).where("low < high").drop("low", "high")
    nodes = nodes.join(whole, "root").withColumn("class", F.when(F.col("all") <= tile, F.lit(0)).otherwise(F.floor(4 * F.log("size") / math.log(1 / t)).cast("int")))
    nodes = nodes.join(nodes.groupBy("root", "class").agg(F.count(F.lit(1)).alias("n")), ["root", "class"]).withColumn("part", F.expr(f"cast(pmod(xxhash64(sub), greatest(1, ceil(n / {tile}))) as int)")).drop("n")
    nodes = nodes.join(nodes.groupBy("root", "class", "part").agg(F.count(F.lit(1)).alias("n")), ["root", "class", "part"])
    return nodes.withColumn("tile", F.struct("class", "part", F.expr(f"cast(pmod(xxhash64(node), ceil(n / {2 * tile})) as int)").alias("cut"))).select("node", "size", "root", "sub", "tile")


def assigned(nodes: DataFrame, t: float, tile: int) -> DataFrame:
    """g, i, j, side, node and sub: the pairs of tiles that may hold pairs of unlike subs, with their nodes (side: those of j)."""
    cut = written(tiled(nodes, t, tile), "tiles")
    of = cut.groupBy("root", "tile").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.min("sub").alias("low"), F.max("sub").alias("high"))
    x, y = of.alias("x"), of.alias("y")
    meets = x.join(y, F.expr(f"x.root = y.root AND x.tile <= y.tile AND x.most >= {t} * y.least AND y.most >= {t} * x.least AND (x.low < x.high OR y.low < y.high OR x.low <> y.low)"))
    inside = meets.select(F.col("x.root").alias("root"), F.col("x.tile").alias("i"), F.col("y.tile").alias("j")).select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    return cut.join(inside, ["root", "tile"]).select(F.col("root").alias("g"), "i", "j", (F.col("tile") == F.col("j")).alias("side"), "node", "sub")


def tile_pairs(group, rows: pa.Table, n: int, t: float) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a pair of tiles, left ones first, and of the pairs of t or more among them the rows i, j and the similarity."""
    sides = rows["side"].to_numpy(zero_copy_only=False)
    same = group[1].as_py() == group[2].as_py()
    order = np.argsort(sides, kind="stable")
    rows = rows.take(pa.array(order))
    sides, kin = sides[order], rows["sub"].to_numpy()
    sets, counts = [], [np.zeros(1, np.int64)]
    for _, _, buf, offsets in chunks(rows["text"], lower=True):
        g, at = gram_sets(buf, offsets, n)
        sets.append(g)
        counts.append(np.diff(at))
    grams, at = np.concatenate(sets), np.cumsum(np.concatenate(counts))
    everyone = np.arange(len(sides))
    return rows, *similar(grams, at, everyone if same else everyone[~sides], everyone if same else everyone[sides], t, kin)


def compared(places: DataFrame, texts: DataFrame, n: int, t: float, forest: bool) -> DataFrame:
    """node_a, node_b and jaccard of the pairs of sets that places brings together; forest: only as many as connect what is connected."""

    def join(group, rows):
        rows, i, j, s = tile_pairs(group, rows, n, t)
        node = rows["node"].to_numpy()
        if forest and len(i):
            ends = forest_of(np.stack([i, j], 1))
            i, j, s = ends[:, 0], ends[:, 1], np.full(len(ends), np.nan)
        return pa.table({"node_a": node[i], "node_b": node[j], "jaccard": s})

    rows = places.join(texts, "node").select("g", "i", "j", "side", "node", "sub", "text")
    return rows.groupBy("g", "i", "j").applyInArrow(join, "node_a long, node_b long, jaccard double")


def tallied(places: DataFrame, texts: DataFrame, n: int, t: float) -> DataFrame:
    """What all pairs of sets that places brings together come to, in rows that follow the sets: (a, a, the sum of the rows of
    its partners), (a, b, 0) as many as connect what is connected, and (a, b, null) each pair that has an odd set. texts: node, text, rows, odd."""

    def tally(group, rows):
        rows, i, j, _ = tile_pairs(group, rows, n, t)
        node, many, odd = (rows[c].to_numpy(zero_copy_only=False) for c in ("node", "rows", "odd"))
        links = np.zeros(len(node), np.int64)
        np.add.at(links, i, many[j])
        np.add.at(links, j, many[i])
        own, ends = np.flatnonzero(links), forest_of(np.stack([i, j], 1)) if len(i) else np.zeros((0, 2), np.int64)
        told = odd[i] | odd[j]
        a, b = np.concatenate([own, ends[:, 0], i[told]]), np.concatenate([own, ends[:, 1], j[told]])
        known = np.arange(len(a)) < len(own) + len(ends)
        count = np.concatenate([links[own], np.zeros(len(a) - len(own), np.int64)])
        return pa.table({"a": node[a], "b": node[b], "links": pa.array(count, mask=~known)})

    rows = places.join(texts, "node").select("g", "i", "j", "side", "node", "sub", "text", "rows", "odd")
    return rows.groupBy("g", "i", "j").applyInArrow(tally, "a long, b long, links long")


def loose(sent_: DataFrame, links: DataFrame) -> DataFrame:
    """node, size and root of the sets that links connect."""
    size = sent_.where("vector IS NOT NULL").groupBy(F.col("name").alias("node")).agg(F.first("size").alias("size"))
    return written(components(links).join(size, "node"), "roots")


def verified(docs: DataFrame, n: int = NGRAM, t: float = THRESHOLD, key: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """a, b (a below b) and jaccard of all pairs of similarity t or more."""
    about = written(sent(docs, n, t, key, text), "sets")
    nodes = loose(about, joined_by_key(about, t))
    found = compared(assigned(nodes.withColumn("sub", F.col("node")), t, tile), texts_of(docs, n, text, nodes), n, t, False)
    ids = about.where("id IS NOT NULL").select("name", "id").distinct()
    a, b = ids.toDF("node_a", "a"), ids.toDF("node_b", "b")
    apart = found.join(a, "node_a").join(b, "node_b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")
    return apart.unionByName(a.join(b, F.expr("node_a = node_b AND a < b")).select("a", "b", F.lit(1.0).alias("jaccard")))


def near_pairs(docs: DataFrame, n: int = NGRAM, t: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id_a, doc_id_b (a below b) and jaccard of all pairs of similarity t or more."""
    return verified(docs, n, t, key, text).toDF(f"{key}_a", f"{key}_b", "jaccard")


def classes(docs: DataFrame, n: int = NGRAM, t: float = THRESHOLD, key: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """A row for each id: key, class_id, the least id that pairs of similarity t or more connect it with, and links, the other ids that it pairs with.

    Every pair of unlike sets is compared, but summed up where it is found; pairs of ids are made of ids with several sets only."""
    docs = docs.where(docs[key].isNotNull())
    about = written(sent(docs, n, t, key, text), "sets")
    ids = written(about.where("id IS NOT NULL").select("name", "id").distinct(), "ids")
    several = written(ids.join(ids.groupBy("id").count().where("count > 1").select("id"), "id").select("id", "name"), "several")
    plain = several.isEmpty()
    joined = joined_by_key(about, t)
    nodes = loose(about, joined)
    rows = ids.groupBy(F.col("name").alias("node")).agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("least"))
    weight = rows.select("node", "rows", F.lit(False).alias("odd")) if plain else rows.join(several.select(F.col("name").alias("node"), F.lit(True).alias("odd")).distinct(), "node", "left").select("node", "rows", F.coalesce("odd", F.lit(False)).alias("odd"))
    found = written(tallied(assigned(nodes.withColumn("sub", F.col("node")), t, tile), texts_of(docs, n, text, nodes).join(weight, "node"), n, t), "tallied")
    gone(about, joined, nodes)
    edges = found.select("a", "b")
    if not plain:  # an id connects its sets
        edges = edges.union(several.join(several.groupBy("id").agg(F.min("name").alias("first")), "id").select("first", "name"))
    sums = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    sets = rows.join(components(edges), "node", "left").join(sums, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"), (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    sets = sets.join(sets.groupBy("root").agg(F.min("least").alias("class")), "root").select(F.col("node").alias("name"), "class", "links")
    of = ids.join(sets, "name").groupBy("id").agg(F.min("class").alias("class"), F.max("links").alias("links"))
    if not plain:  # pairs of ids that several of their sets make count once
        near = found.where("links IS NULL").select("a", "b")
        near = near.union(near.select("b", "a")).union(several.select("name", "name")).distinct()
        pairs = several.toDF("x", "a").join(near, "a").join(ids.toDF("b", "y"), "b").where("x <> y").groupBy("x", "y").count()
        whole = several.select("id").distinct().join(pairs.groupBy(F.col("x").alias("id")).agg(F.count(F.lit(1)).alias("whole")), "id", "left").select("id", F.coalesce("whole", F.lit(0)).alias("whole"))
        over = pairs.groupBy(F.col("y").alias("id")).agg(F.sum(F.col("count") - 1).alias("over"))
        of = of.join(whole, "id", "left").join(over, "id", "left").select("id", "class", F.coalesce("whole", F.col("links") - F.coalesce("over", F.lit(0))).alias("links"))
    everyone = docs.select(docs[key].alias("id")).distinct().join(of, "id", "left")
    return everyone.select(F.col("id").alias(key), F.coalesce("class", "id").alias("class_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def connected(docs: DataFrame, about: DataFrame, n: int, t: float, text: str, tile: int = TILE) -> DataFrame:
    """node and root of the sets that pairs of similarity t or more connect with others.

    A set is compared with the least that it is linked to first; of the rest only sets that this leaves unconnected are."""
    links = joined_by_key(about, t)
    nodes = loose(about, links)
    texts = written(texts_of(docs, n, text, nodes), "texts")
    first = links.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).groupBy("b").agg(F.min("a").alias("g"))
    first = first.join(first.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g").withColumn("j", F.expr(f"cast(pmod(xxhash64(b), ceil(n / {tile})) + 1 as int)"))
    heads, under = first.select("g", F.lit(0).alias("i"), "j", F.lit(False).alias("side"), F.col("g").alias("node")).distinct(), first.select("g", F.lit(0).alias("i"), "j", F.lit(True).alias("side"), F.col("b").alias("node"))
    near = written(compared(heads.unionByName(under).withColumn("sub", F.col("node")), texts, n, t, False).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), "first")
    subs = components(near)
    nodes_ = nodes.join(subs.withColumnRenamed("root", "sub"), "node", "left").withColumn("sub", F.coalesce("sub", "node"))
    rest = compared(assigned(nodes_, t, tile), texts, n, t, True).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    edges = written(near.union(rest), "forest")
    out = written(components(edges), "groups")
    gone(links, nodes, texts, near, edges)
    return out


def distinct_texts(docs: DataFrame, n: int = NGRAM, t: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without copies: of the rows that pairs connect, the one of the least id stays. All columns are kept.

    The rows move once, by their set's name, and only if the copies are too many to broadcast."""
    p = free(docs, "_near")
    about = written(sent(docs, n, t, key, text), "sets")
    roots = connected(docs, about, n, t, text)
    ids = about.where("id IS NOT NULL").groupBy(F.col("name").alias("node")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"))
    of = ids.join(roots, "node", "left")
    lead = of.where("root IS NOT NULL").groupBy("root").agg(F.min_by("node", F.struct("id", "node")).alias("lead"))
    of = of.join(lead, "root", "left").withColumn("stays", F.coalesce(F.col("lead") == F.col("node"), F.lit(True))).where("rows > 1 OR NOT stays")
    copies = written(of.select(F.col("node").alias(f"{p}node"), F.when(F.col("stays"), F.col("id")).alias(f"{p}id")), "copies")
    repeated = not about.where("id IS NOT NULL").groupBy("name", "id").count().where("count > 1").isEmpty()
    gone(roots, about)
    rows = with_name(docs, n, text, p)
    rows = rows.join(copies, (F.col(p) == F.col(f"{p}node")) & F.col(key).isNotNull(), "left")
    if not repeated:
        return rows.where(F.col(f"{p}node").isNull() | (F.col(key) == F.col(f"{p}id"))).select(*docs.columns)
    w = Window.partitionBy(p, key).orderBy(*[F.col(f.name) for f in docs.schema.fields if isinstance(f.dataType, AtomicType)])
    first = rows.where(F.col(key) == F.col(f"{p}id")).withColumn(f"{p}o", F.row_number().over(w)).where(F.col(f"{p}o") == 1)
    return rows.where(F.col(f"{p}node").isNull()).select(*docs.columns).union(first.select(*docs.columns))
