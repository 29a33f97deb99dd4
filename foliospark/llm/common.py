"""Shared helpers: reading tables, the shared folder, and whole-batch text handling in numpy.

Texts reach Python as Arrow batches. A *chunk* is a run of rows of a batch, of about ``CHUNK`` bytes
(one longer text is a chunk of its own, never cut) and ``TEXTS`` texts at most; all functions below work on a chunk's raw UTF-8
bytes at once, so no Python object is made for a word.

A *word* is a maximal run of bytes other than ASCII white space (space, \\t, \\n, \\v, \\f, \\r).
A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK, TEXTS = 1 << 20, 1 << 14
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROOT = np.uint64(0x9E3779B97F4A7C15)
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return lambda _: 0


def give_back() -> None:
    """Returns freed arrays to the system, as a worker lives through many tasks beside others."""
    _trim()(0)
    pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession) -> None:
    """Batches of 1,000 texts at most reach Python, so a worker's memory stays small. The setting stays, as plans read it when they run."""
    if not 0 < int(spark.conf.get(BATCH, "10000")) <= 1000:  # 0 and less: no limit
        spark.conf.set(BATCH, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else the session's checkpoint folder. Where neither is
    set, a folder of this machine will do only if all tasks run on it, in local mode as in tests; on a cluster it's an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
        at = at.rsplit("/", 1)[0] if at else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="foliospark-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, from a table in the shared folder: lineage ends there, and lost executors lose nothing."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    small_batches(spark)
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # nothing reads this plan's shuffles again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder_written = path
    return out


def gone(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made; nothing may read them any more."""
    for df in tables:
        path = df.folder_written
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and len + 1 offsets into them."""
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[o[0] : o[-1]], o - o[0]


def chunks(column: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields first row, last row + 1, bytes, offsets."""
    texts = strings(column)
    if lower:
        texts = pc.utf8_lower(texts)
    buf, o = raw(texts)
    a = 0
    while a < len(texts):
        b = min(a + TEXTS, max(a + 1, int(np.searchsorted(o, o[a] + size, "right")) - 1))
        yield a, b, buf[o[a] : o[b]], o[a : b + 1] - o[a]
        a = b
    if len(buf) > CHUNK:
        give_back()


#: ASCII but letters and digits; with it, a word is a run of letters and digits of any script.
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


@lru_cache(4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd number and of its inverse modulo 2^64."""
    r = 0x5851F42D4C957F2D
    out = []
    for x in (r, pow(r, -1, 1 << 64)):
        p = np.ones(n + 1, np.uint64)
        p[1:] = np.uint64(x)
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, by prefix sums of a polynomial."""
    n = 1 << max(20, int(len(buf)).bit_length())
    p, q = powers(n)
    s = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=s[1:])
    return mix((s[ends] - s[starts]) * q[starts])


def words(buf: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and len + 1 offsets of each text's first word. between: the bytes that part words."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~between[buf]
    first = np.ones(len(buf), bool)
    first[1:] = ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(buf)]
    first[inner] = True
    starts = np.flatnonzero(solid & first)
    last = np.ones(len(buf), bool)
    last[:-1] = first[1:] | ~solid[1:]
    ends = np.flatnonzero(solid & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hash(words_: list[str]) -> np.ndarray:
    """Hashes of single words, as ``span_hash`` gives them."""
    data = [w.encode() for w in words_]
    ends = np.cumsum([len(d) for d in data], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(data) else ends
    return span_hash(np.frombuffer(b"".join(data), np.uint8), starts, ends) if data else np.zeros(0, np.uint64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.cumsum(lengths) - lengths
    return np.repeat(starts - skip, lengths) + np.arange(total)


def local_path(uri: str):
    """File system and path of a folder or file of the shared folder."""
    from pyarrow import fs

    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    if uri.startswith("file:"):
        uri = uri[5:]
    return fs.LocalFileSystem(), os.path.abspath(uri)


def parts(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a batch grows into stays small too."""
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def sample(docs: DataFrame, rows: int, seed: int, key: str = "doc_id") -> DataFrame:
    """About so many rows, chosen by their ids' hashes (rows without an id by those of their content), so that a task that runs again takes the same."""
    n = docs.count()
    if n <= rows:
        return docs
    by = F.coalesce(docs[key].cast("string"), F.xxhash64(*[docs[c] for c in docs.columns]).cast("string"))
    return docs.where(F.pmod(F.xxhash64(F.lit(seed), by), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int, key: str = "doc_id", text: str = "text") -> tuple[pa.Array, np.ndarray]:
    """Texts and labels (0 or 1) of up to per_class documents of each class, in the order of their ids' hashes.

    Labels of one id are averaged; null ids and labels are left out; of an id's rows the least text counts. So the driver
    holds per_class texts of each class at most."""
    votes = labels.where(labels[key].isNotNull() & labels[label].isNotNull()).groupBy(labels[key].alias("k")).agg((F.avg(labels[label]) >= 0.5).cast("int").alias("label"))
    order = F.xxhash64(F.lit(seed), F.col("k").cast("string"))
    chosen = votes.where("label = 0").orderBy(order).limit(per_class).unionByName(votes.where("label = 1").orderBy(order).limit(per_class))
    rows = docs.join(F.broadcast(chosen), docs[key] == chosen["k"]).select("k", docs[text].cast("string").alias("text"), "label")
    found = rows.groupBy("k", "label").agg(F.min("text").alias("text")).select("k", "text", "label").toArrow().sort_by([("k", "ascending"), ("text", "ascending")])
    return strings(found["text"]), found["label"].to_numpy().astype(np.int64)


def free(df: DataFrame, name: str) -> str:
    """A name that no column of df begins with."""
    low = [c.lower() for c in df.columns]
    while any(c.startswith(name) for c in low):
        name += "_"
    return name
