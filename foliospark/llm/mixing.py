"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a whole number of rows, T: its weight's share of the total, by largest remainders. A
row of a source of n rows then has T / n expected copies: every row gets T // n, and a fraction
(T mod n) / n is left. Fractions are kept as integers, in units of 1 / n, so no mass is lost to rounding.

Two rows with fractions a and b meet; where a + b <= n one of them takes all (the first with chance
a / (a + b)), else one is filled up to n and the other keeps a + b - n (the first is filled with chance
(n - b) / (2n - a - b)). One of the two is then settled, and the other meets the next. Each leaf, a hash
range of a source's rows, leaves at most one unsettled row; the leaves' rows meet in groups of
``FAN`` in a reduction tree until one is left, whose fraction is 0 or n as T is whole. So each source
has exactly T rows, and each row its expected copies on average.

Chances come from a hash of the seed, the tree's level and the rows' ids, never from a task's state, so
a task that runs again settles alike. Leaves hold about ``LEAF`` rows each, of any number.

Defined results: rows whose source is null form a source of their own; a source without a weight gets
no rows, and a weight without rows is left out before shares are made. Repeated rows are rows like any
other; of unlike rows of one id those of the least content hashes are filled. An empty table gives an empty one. All columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, mix, written

ALPHA, LEAF, FAN, SEED = 0.7, 50_000, 64, 17


def shares(counts: Mapping[str | None, int], weights: Mapping[str | None, float], total: int) -> dict[str | None, int]:
    """Whole numbers that add up to total, in proportion to the weights of the sources that have rows."""
    own = {s: float(weights.get(s, 0)) for s, n in counts.items() if n and weights.get(s, 0) > 0}
    whole = sum(own.values())
    if not own:
        return {}
    exact = {s: total * w / whole for s, w in own.items()}
    out = {s: math.floor(x) for s, x in exact.items()}
    for s in sorted(own, key=lambda s: (out[s] - exact[s], str(s)))[: total - sum(out.values())]:
        out[s] += 1
    return out


def tempered(counts: Mapping[str | None, int], alpha: float) -> tuple[dict[str | None, float], int]:
    """Weights n^alpha, and the least total at which no source's rows have less than one expected copy."""
    weights = {s: n**alpha for s, n in counts.items() if n}
    whole = sum(weights.values())
    return weights, math.ceil(max((counts[s] * whole / w for s, w in weights.items()), default=0))


def pivot(ids: np.ndarray, mass: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, int, int]:
    """Settles rows in their order. Returns which are filled, and the unsettled row and its mass (-1 and 0 if none)."""
    full = np.zeros(len(ids), bool)
    draws = (mix(ids.astype(np.uint64) ^ mix(np.full(1, salt, np.uint64))) >> np.uint64(11)).astype(float) / 2.0**53
    held, a = -1, 0
    for k, (b, u) in enumerate(zip(mass.tolist(), draws.tolist(), strict=True)):
        if not a:
            held, a = k, b
        elif a + b <= n:
            if u * (a + b) >= a:
                held = k
            a += b
        elif u * (2 * n - a - b) < n - b:
            full[held] = True
            held, a = k, a + b - n
        else:
            full[k] = True
            a = a + b - n
        if a == n:
            full[held] = True
            held, a = -1, 0
    return full, held if a else -1, a


def _settler(level: int, seed: int):
    """Lets the rows of a group meet in the order of their hashes."""

    def run(_, rows):
        rows = rows.sort_by([("h", "ascending")])
        h, count, mass = (rows[c].to_numpy() for c in ("h", "rows", "mass"))
        at = np.repeat(np.arange(len(h)), count)
        full, open_, rest = pivot(mix(h.view(np.uint64)[at] + np.arange(len(at), dtype=np.uint64)), mass[at], int(rows["n"][0].as_py()), seed * 1000 + level)
        filled = np.bincount(at[full], minlength=len(h)).astype(np.int64)
        left = np.zeros(len(h), np.int64)
        if open_ >= 0:
            left[at[open_]] = rest
        return pa.table({"source": rows["source"], "leaf": rows["leaf"], "h": rows["h"], "n": rows["n"], "filled": filled, "rest": left})

    return run


def settle(units: DataFrame, leaves: int, seed: int) -> DataFrame:
    """source, h and how many of the rows of that hash are filled. units: source, leaf, h, rows, mass, n."""
    schema = "source string, leaf long, h long, n long, filled long, rest long"
    done = now = written(units.groupBy("source", "leaf").applyInArrow(_settler(0, seed), schema), "mixing")
    level = 0
    while leaves > 1:
        leaves, level = -(-leaves // FAN), level + 1
        meet = now.where("rest > 0").select("source", F.expr(f"leaf div {FAN}").alias("leaf"), "h", F.lit(1).cast("long").alias("rows"), F.col("rest").alias("mass"), "n")
        now = written(meet.groupBy("source", "leaf").applyInArrow(_settler(level, seed), schema), "mixing")
        done = done.unionByName(now)
    return done.where("filled > 0").groupBy("source", "h").agg(F.sum("filled").alias("filled"))


def copies(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: int | None = None, alpha: float = ALPHA, source: str = "source", key: str = "doc_id", seed: int = SEED, leaf: int = LEAF, name: str = "copies") -> DataFrame:
    """The rows of docs with the number of times each is drawn, 0 or more, in a column of the given name.

    Without weights they are n^alpha of each source's n rows, and the total is then the least that keeps
    every row at least once. With weights, the total is the number of rows unless it is given."""
    counts = {r[0]: r[1] for r in docs.groupBy(docs[source].cast("string")).count().collect()}  # a row for each source
    if weights is None:
        weights, least = tempered(counts, alpha)
        total = least if total is None else total
    want = shares(counts, weights, sum(counts.values()) if total is None else total)
    p = free(docs, "_mix")
    plan = docs.sparkSession.createDataFrame([(s, want.get(s, 0) // n, want.get(s, 0) % n, n, math.ceil(n / leaf)) for s, n in counts.items()] or [(None, 0, 0, 1, 1)], f"{p}s string, {p}base long, {p}mass long, {p}n long, {p}leaves long")
    rows = docs.join(F.broadcast(plan) if len(counts) <= 100_000 else plan, docs[source].cast("string").eqNullSafe(plan[f"{p}s"]))
    rows = rows.withColumn(f"{p}h", F.xxhash64(F.lit(seed), docs[key].cast("string"), docs[source].cast("string")))
    units = rows.where(f"{p}mass > 0").groupBy(F.col(f"{p}s").alias("source"), F.expr(f"pmod(xxhash64({p}h, 1), {p}leaves)").alias("leaf"), F.col(f"{p}h").alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.first(f"{p}mass").alias("mass"), F.first(f"{p}n").alias("n"))
    units = written(units, "mixing")
    drawn = settle(units, max([math.ceil(n / leaf) for n in counts.values()], default=1), seed).select(F.col("source").alias(f"{p}d"), F.col("h").alias(f"{p}k"), "filled").withColumnRenamed("filled", f"{p}filled")
    rows = rows.join(drawn.hint("shuffle_hash"), F.col(f"{p}s").eqNullSafe(F.col(f"{p}d")) & (F.col(f"{p}h") == F.col(f"{p}k")), "left")
    filled = F.coalesce(F.col(f"{p}filled"), F.lit(0))
    if units.where("rows > 1").take(1):  # rows of one id: the first of them, by their content's hash, are filled
        content = F.xxhash64(*[docs[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
        rows = rows.withColumn(f"{p}o", F.row_number().over(Window.partitionBy(f"{p}s", f"{p}h").orderBy(content)))
        filled = (F.col(f"{p}o") <= filled).cast("long")
    return rows.select(*[docs[c] for c in docs.columns], (F.col(f"{p}base") + filled).alias(name))


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as ``copies`` says."""
    name = free(docs, "_copies")
    return copies(docs, name=name, **how).where(F.col(name) > 0).withColumn(name, F.explode(F.expr(f"sequence(1L, {name})"))).drop(name)
