"""Approximate nearest neighbours by balanced posting lists. Every row is indexed; every row is a query too, or those that ``asked`` names.

Vectors are cut into lists of about ``LIST`` by bisection: each cut runs through the point, along the line
between two means, that leaves both sides their share, so lists are balanced. It is done in two levels:
about sqrt(lists) cells from a bounded sample, then each cell's lists in a task of their own. The lists'
centroids and a graph that links each to its ``LINKS`` nearest (and back) are one file in the shared folder,
which a worker loads into memory. More than ``MOST`` centroids are never made: lists get longer instead, which
loses no neighbours.

A vector goes to the list of the nearest centroid and, at a boundary, to those within ``CLOSE`` times
that distance, ``REPLICAS`` at most, leaving out a centroid that lies nearer to one already chosen than ``APART`` times
its distance to the vector (all of it would leave no replicas where vectors point in all directions).
A query walks the graph from the nearest cells and expands all centroids within a ratio of the
least distance found; the lists that remain are searched, however many they are. Distances to points in all directions
differ by about 1 / sqrt(dimensions) of themselves, so the ratio is 1 + ``SPREAD`` / sqrt(dimensions), 1.07 in 64. Distances are Euclidean.

Defined results: vectors that are null, empty, not finite or of another length than most, and rows without
an id, are neither queries nor neighbours. A row is not its own neighbour, nor are others of its id; equal distances
go by id; equal vectors are at distance 0. With fewer than k others there are fewer rows. Only ids and vectors are
kept, so other columns can't clash; ids may be of any type that can be ordered.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, local_path, written

K, LIST, LINKS, CLOSE, REPLICAS, APART, SPREAD, MOST, SEED = 10, 512, 24, 1.1, 8, 0.35, 0.56, 2_000_000, 3


def bisect(x: np.ndarray, parts: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Rows of each of so many balanced parts."""
    todo, out = [(np.arange(len(x)), parts)], []
    while todo:
        rows, k = todo.pop()
        if k == 1 or len(rows) <= 1:
            out.append(rows)
            continue
        own = x[rows]
        a, b = own[rng.choice(len(own), 2, replace=False)]
        left = k // 2
        for _ in range(6):
            order = np.argsort(own @ (b - a), kind="stable")
            cut = len(own) * left // k
            a, b = own[order[:cut]].mean(0) if cut else a, own[order[cut:]].mean(0)
        todo += [(rows[order[:cut]], left), (rows[order[cut:]], k - left)]
    return [r for r in out if len(r)]


def centroids(x: np.ndarray, parts: int, seed: int) -> np.ndarray:
    return np.stack([x[r].mean(0) for r in bisect(x, max(1, parts), np.random.default_rng(seed))]).astype(np.float32)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def links(c: np.ndarray, cell: np.ndarray, tops: np.ndarray, count: int = LINKS) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ends of the graph's links. Links are sought in a centroid's cell and the eight cells next to it."""
    near = np.argsort(squared(tops, tops), 1)[:, :9]
    members = [np.flatnonzero(cell == k) for k in range(len(tops))]
    edges = []
    for k, own in enumerate(members):
        if not len(own):
            continue
        pool = np.concatenate([members[j] for j in near[k]])
        for a in range(0, len(own), 512):
            d = squared(c[own[a : a + 512]], c[pool])
            best = np.argsort(d, 1)[:, : count + 1]
            edges.append(np.stack([np.repeat(own[a : a + 512], best.shape[1]), pool[best.ravel()]], 1))
    for k in range(len(tops)):  # cells stay reachable from each other
        for j in near[k][1:]:
            if len(members[k]) and len(members[j]):
                edges.append(np.array([[members[k][0], members[j][0]]]))
    e = np.concatenate(edges)
    e = np.unique(np.concatenate([e, e[:, ::-1]]), axis=0)
    e = e[e[:, 0] != e[:, 1]]
    return np.searchsorted(e[:, 0], np.arange(len(c) + 1)), e[:, 1].copy()


class Graph:
    """Centroids and their links, in a worker's memory."""

    loaded: tuple[str, Graph] | None = None

    def __init__(self, c: np.ndarray, offsets: np.ndarray, ends: np.ndarray, tops: np.ndarray, doors: np.ndarray):
        self.c, self.offsets, self.ends, self.tops, self.doors = c, offsets, ends, tops, doors
        self.norm = (c * c).sum(1)

    def save(self, path: str) -> None:
        files, at = local_path(path)
        files.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(at) as out:
            for x in (self.c, self.offsets, self.ends, self.tops, self.doors):
                np.save(Sink(out), x)

    @classmethod
    def load(cls, path: str) -> Graph:
        if cls.loaded is None or cls.loaded[0] != path:
            import io

            files, at = local_path(path)
            with files.open_input_stream(at) as f:
                data = io.BytesIO(f.read())
            cls.loaded = path, cls(*(np.load(data) for _ in range(5)))
        return cls.loaded[1]

    def within(self, q: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, centroid and distance of all centroids found within ratio times each query's least distance."""
        found = []
        step = max(1, min(len(q), (1 << 25) // len(self.c)))
        for a in range(0, len(q), step):
            own = q[a : a + step]
            seen = np.zeros((len(own), len(self.c)), bool)
            doors = np.argsort(squared(own, self.tops), 1, kind="stable")[:, :4]
            who, node = np.repeat(np.arange(len(own)), doors.shape[1]), self.doors[doors].ravel()
            pair = np.unique(who * len(self.c) + node)
            who, node = np.divmod(pair, len(self.c))
            norm = (own * own).sum(1)
            best = np.full(len(own), np.inf)
            waiting = np.zeros(0, np.int64)
            everyone = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
            while True:
                if len(who):
                    seen[who, node] = True
                    d = np.sqrt(np.maximum(norm[who] + self.norm[node] - 2 * np.einsum("ij,ij->i", own[who], self.c[node]), 0))
                    np.minimum.at(best, who, d)
                    everyone = [np.concatenate([e, x]) for e, x in zip(everyone, (who, node, d), strict=True)]
                    waiting = np.concatenate([waiting, np.arange(len(everyone[0]) - len(who), len(everyone[0]))])
                near = everyone[2][waiting] <= ratio * best[everyone[0][waiting]]
                now, waiting = waiting[near], waiting[~near]
                if not len(now):
                    break
                w, n = everyone[0][now], everyone[1][now]
                size = self.offsets[n + 1] - self.offsets[n]
                w2 = np.repeat(w, size)
                n2 = self.ends[np.repeat(self.offsets[n] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                pair = np.unique((w2 * len(self.c) + n2)[~seen[w2, n2]])
                who, node = np.divmod(pair, len(self.c))
            w, n, d = everyone
            ok = d <= ratio * best[w]
            found.append((w[ok] + a, n[ok], d[ok]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # type: ignore[return-value]

    def homes(self, x: np.ndarray, close: float = CLOSE, most: int = REPLICAS) -> tuple[np.ndarray, np.ndarray]:
        """Vector and centroid of each replica."""
        w, n, d = self.within(x, close)
        order = np.lexsort((n, d, w))
        w, n, d = w[order], n[order], d[order]
        first = np.searchsorted(w, np.arange(len(x) + 1))
        keep = np.zeros(len(w), bool)
        chosen = np.full((len(x), most), -1)
        count = np.zeros(len(x), np.int64)
        place = np.arange(len(w)) - first[w]
        for k in range(int(place.max()) + 1 if len(w) else 0):  # the k-th nearest of all vectors at once
            at = np.flatnonzero((place == k) & (count[w] < most))
            if not len(at):
                continue
            own, ok = w[at], np.ones(len(at), bool)
            for j in range(int(count[own].max())):
                other = chosen[own, j]
                has = other >= 0
                gap = np.sqrt(((self.c[n[at[has]]] - self.c[other[has]]) ** 2).sum(1))
                ok[has] &= gap >= APART * d[at[has]]
            at, own = at[ok], own[ok]
            keep[at] = True
            chosen[own, count[own]] = n[at]
            count[own] += 1
        return w[keep], n[keep]


class Sink:
    """What numpy needs of a file to write to."""

    def __init__(self, out):
        self.out = out

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, d)


def search(vectors: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding", length: int = LIST, close: float = CLOSE, ratio: float | None = None, seed: int = SEED, asked: Callable[[Column], Column] | None = None) -> DataFrame:
    """key, rank, neighbour and distance: the k nearest found, among all rows, for every row or those whose id meets asked."""
    kind = vectors.schema[key].dataType.simpleString()
    given = vectors.select(vectors[key].alias("id"), vectors[vector].cast("array<float>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
    shape = given.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    result = f"{key} {kind}, rank int, neighbour {kind}, distance double"
    if shape is None:
        return vectors.sparkSession.createDataFrame([], result)
    d = shape["d"]
    ratio = 1 + SPREAD / math.sqrt(d) if ratio is None else ratio

    def pack(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            null = np.flatnonzero(np.isnan(x.reshape(-1, d)).any(1) | np.isinf(x.reshape(-1, d)).any(1)) if len(x) == d * batch.num_rows else np.zeros(0, int)
            keep = np.ones(batch.num_rows, bool)
            keep[null] = False
            data = [r.tobytes() for r in x.reshape(-1, d)[keep]]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.array(data, pa.binary())], ["id", "v"])

    rows = written(given.where(F.size("v") == d).mapInArrow(pack, f"id {kind}, v binary"), "vectors")
    n = rows.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], result)
    lists = min(MOST, math.ceil(n / length))
    cells = max(1, round(math.sqrt(lists)))
    share = min(1.0, 128 * cells * 4 / n)  # of the sample that the cells are cut from
    hashed = F.pmod(F.xxhash64(F.lit(seed), F.col("id").cast("string")), F.lit(1 << 30))
    drawn = rows.where(hashed < int(share * (1 << 30)) + 1).orderBy("id").select("v").toArrow()["v"].to_pylist() or [rows.first()["v"]]
    tops = centroids(np.frombuffer(b"".join(drawn), np.float32).reshape(-1, d), cells, seed)

    def celled(batches):
        for batch in batches:
            x = matrix(batch.column(1), d)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(squared(x, tops).argmin(1).astype(np.int32))], ["id", "v", "cell"])

    def cut(group, table):
        x = matrix(table.sort_by([("id", "ascending")])["v"].combine_chunks(), d)
        c = centroids(x, max(1, round(len(x) * lists / n)), seed)
        return pa.table({"cell": pa.array(np.full(len(c), group[0].as_py(), np.int32)), "c": pa.array([r.tobytes() for r in c], pa.binary())})

    made = written(rows.mapInArrow(celled, f"id {kind}, v binary, cell int").groupBy("cell").applyInArrow(cut, "cell int, c binary"), "centroids").orderBy("cell", "c").toArrow()
    c, cell = matrix(made["c"].combine_chunks(), d), made["cell"].to_numpy().astype(np.int64)
    doors = np.array([int(squared(tops[j : j + 1], c).argmin()) for j in range(len(tops))])
    path = fresh_path(vectors.sparkSession, "graph")
    Graph(c, *links(c, cell, tops), tops, doors).save(path)

    def assign(batches):
        graph = Graph.load(path)
        for batch in batches:
            w, at = graph.homes(matrix(batch.column(1), d), close)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(w)), batch.column(1).take(pa.array(w)), pa.array(at.astype(np.int32))], ["id", "v", "list"])

    def select(batches):
        graph = Graph.load(path)
        for batch in batches:
            w, at, _ = graph.within(matrix(batch.column(1), d), ratio)
            for a in range(0, len(w), 20_000):
                own = pa.array(w[a : a + 20_000])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(at[a : a + 20_000].astype(np.int32))], ["id", "v", "list"])

    schema = f"id {kind}, v binary, list int"
    ask = rows if asked is None else rows.where(asked(F.col("id")))
    postings, asking = rows.mapInArrow(assign, schema), ask.mapInArrow(select, schema)

    def scan(_, ask, post):
        if not len(ask) or not len(post):
            return pa.table({"id": pa.array([], ask["id"].type), "ids": pa.array([], pa.list_(ask["id"].type)), "d": pa.array([], pa.list_(pa.float32()))})
        post = post.sort_by([("id", "ascending")])
        x, who, own = matrix(post["v"].combine_chunks(), d), post["id"].to_numpy(), ask["id"].to_numpy()
        ids, dists = [], []
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))  # rows of one id count once, by the nearest
        unlike, who = who, who[first]
        take = min(k, len(who))
        for a in range(0, len(own), 1024):
            dist = squared(matrix(ask["v"].slice(a, 1024).combine_chunks(), d), x)
            dist[own[a : a + 1024][:, None] == unlike[None]] = np.inf
            if len(first) < len(unlike):
                dist = np.minimum.reduceat(dist, first, 1)
            if take < len(who):
                limit = np.partition(dist, take - 1, 1)[:, take - 1 : take]
                order = np.argsort(np.where(dist <= limit, dist, np.inf), 1, kind="stable")[:, :take]
            else:
                order = np.argsort(dist, 1, kind="stable")
            ids.append(who[order])
            dists.append(np.take_along_axis(dist, order, 1))
        ids_, dists_ = np.concatenate(ids), np.concatenate(dists).astype(np.float32)
        offsets = pa.array(np.arange(len(own) + 1) * take, pa.int32())
        return pa.table({"id": ask["id"], "ids": pa.ListArray.from_arrays(offsets, pa.array(ids_.ravel())), "d": pa.ListArray.from_arrays(offsets, pa.array(dists_.ravel()))})

    found = asking.groupBy("list").cogroup(postings.groupBy("list")).applyInArrow(scan, f"id {kind}, ids array<{kind}>, d array<float>")

    def merge(batches):  # sorted by id, so that a few ids at a time are held
        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= 1 << 14:
                table = pa.Table.from_batches(held).combine_chunks()
                cut = count - pc.sum(pc.equal(table["id"], table["id"][-1])).as_py()  # the last id may have more
                if cut:
                    yield merged(table.slice(0, cut).combine_chunks())
                held, count = table.slice(cut).to_batches(), count - cut
        if count:
            yield merged(pa.Table.from_batches(held).combine_chunks())

    def merged(table):
        n = table["ids"].combine_chunks().value_lengths().to_numpy()
        q = np.repeat(table["id"].to_numpy(), n)
        other, dist = (table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("ids", "d"))
        ok = np.isfinite(dist)
        q, other, dist = q[ok], other[ok], dist[ok]
        order = np.lexsort((dist, other, q))  # replicas once
        q, other, dist = q[order], other[order], dist[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (other[1:] != other[:-1])
        q, other, dist = q[new], other[new], dist[new]
        order = np.lexsort((other, dist, q))
        q, other, dist = q[order], other[order], dist[order]
        start = np.ones(len(q), bool)
        start[1:] = q[1:] != q[:-1]
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
        keep = rank < k
        return pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array((rank[keep] + 1).astype(np.int32)), pa.array(other[keep]), pa.array(np.round(np.sqrt(dist[keep].astype(float)), 5))], ["key", "rank", "neighbour", "distance"])

    return found.repartition("id").sortWithinPartitions("id").mapInArrow(merge, result.replace(f"{key} ", "key ", 1)).withColumnRenamed("key", key)
