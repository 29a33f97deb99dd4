"""WARC files, index first: records are found in an index and fetched by coalesced byte ranges.

``write`` puts each partition's records into one file of uncompressed WARC/1.1 response records in a folder
that all executors share, and returns the index: file, offset, length, URL and SHA-1 digest of the payload, with
the record's key. The index is made while the records are written; ``build_index`` makes the same one from files
of any origin, reading each file from front to end.

``read`` takes rows of an index. They are brought together by file, sorted by offset, and ranges with
gaps of ``GAP`` bytes or less are read as one, of ``SPAN`` bytes at most unless one record is longer. Each record's
digest is checked against the index. A file's ranges are split among tasks by ``STRIPE`` bytes of offset.

Files of other origin may be gzip files (``.warc.gz``) of a member a record, which ranges fetch alike: offset and length
count compressed bytes. Their index has no keys, and ``read`` then gives file and offset instead. Records that carry no
digest, or one of another kind than SHA-1, get that of their payload when the index is built, and are checked against that.

Defined results of foreign files: an empty file has no records; records of all types are indexed; white space between
records is passed over; bytes of a payload that are not UTF-8 become U+FFFD in ``html``; a header that is not UTF-8 is read as
Latin-1; a file that ends within a record, or a gzip file that isn't cut into a member a record, raises ValueError.

Defined results: a null page is written as an empty payload, flagged so that it is read back as null; null
URLs are read back as null; repeated rows are records of their own; an empty table writes no file and gives an empty
index; a digest that differs raises ValueError. Only key, URL and page are kept, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, local_path, written

GAP, SPAN, STRIPE = 64 << 10, 8 << 20, 64 << 20
DATE = "2020-01-01T00:00:00Z"  # no clock: a task that runs again writes the same bytes
INDEX = "file string, offset long, length long, url string, digest string"


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: str, url: str | None, payload: bytes | None, occurrence: int) -> tuple[bytes, str]:
    """A response record and its digest."""
    body = payload or b""
    name = digest(body)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n"
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {occurrence} {url}')}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: {name}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {' '.join(url.split())}")
    if payload is None:
        head.append("X-Payload: null")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n", name


def parse(data: bytes | memoryview) -> tuple[dict[str, str], bytes | None]:
    """Header and payload of one record."""
    data = bytes(data)
    end = data.index(b"\r\n\r\n")
    lines = header(data[:end]).split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = data[end + 4 : end + 4 + int(head["content-length"])]
    if head.get("x-payload") == "null":
        return head, None
    start = block.find(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else -4
    return head, block[start + 4 :] if start != -1 else b""


def header(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the pages and returns the index with their keys, as a table in the shared folder."""
    rows = pages.select(pages[key].alias("key"), pages[url].cast("string").alias("url"), pages[html].cast("string").alias("html"))

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get()
        files, base = local_path(folder)
        files.create_dir(base, recursive=True)
        name = f"part-{at.partitionId():06d}.warc"
        temporary, offset, index, count = f"{base}/.{name}-{at.taskAttemptId()}", 0, [], 0
        with files.open_output_stream(temporary) as out:
            for batch in batches:
                keys, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                offsets, lengths, digests = [], [], []
                for k, u, page in zip(keys, urls, batch.column(2), strict=True):
                    data, found = record(str(k), u, None if not page.is_valid else page.as_buffer().to_pybytes(), count)
                    out.write(data)
                    offsets.append(offset)
                    lengths.append(len(data))
                    digests.append(found)
                    offset, count = offset + len(data), count + 1
                index.append(pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(keys), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), batch.column(1), pa.array(digests, pa.string())], ["key", "file", "offset", "length", "url", "digest"]))
        if count:
            files.move(temporary, f"{base}/{name}")
        else:
            files.delete_file(temporary)
        yield from index

    return written(rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {INDEX}"), "index").withColumnRenamed("key", key)


def walk(stream, size: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each record of a file, read from front to end."""
    held, offset, more = b"", 0, True
    while more or held:
        skip = len(held) - len(held.lstrip(b"\r\n"))
        held, offset = held[skip:], offset + skip
        end = held.find(b"\r\n\r\n")
        need = None
        if end >= 0:
            head = header(held[:end]).lower().split("\r\n")
            length = next((x.partition(":")[2].strip() for x in head[1:] if x.startswith("content-length:")), "")
            if not head[0].startswith("warc/") or not length.isdigit():
                raise ValueError(f"no WARC record at {offset}")
            need = end + 4 + int(length)
        if need is not None and (len(held) >= need + 4 or len(held) >= need and not more):
            need += 4 if held[need : need + 4] == b"\r\n\r\n" else 0  # the end belongs to the record
            yield offset, held[:need]
            held, offset = held[need:], offset + need
        elif more:
            got = stream.read(max(size, (need or 0) + 4 - len(held)))
            held, more = held + got, bool(got)
        elif held:
            raise ValueError("a record is cut off")


def members(stream, size: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each member of a gzip file."""
    held, offset = b"", 0
    while True:
        held = held or stream.read(size)
        if not held:
            return
        one, out, used = zlib.decompressobj(31), [], 0
        while not one.eof:
            if not held and not (held := stream.read(size)):
                raise ValueError("a record is cut off")
            out.append(one.decompress(held))
            used += len(held)
            held = b""
        held = one.unused_data
        used -= len(held)
        yield offset, used, b"".join(out)
        offset += used


def records(name: str, stream) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and bytes of each record of a file."""
    if not name.endswith(".gz"):
        for offset, data in walk(stream):
            yield offset, len(data), data
        return
    for offset, length, data in members(stream):
        own = list(walk(io.BytesIO(data)))
        if len(own) > 1:
            raise ValueError(f"{name} at {offset}: a member holds more than a record")
        if own:
            yield offset, length, own[0][1]


def build_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of all WARC files in a folder, a task for each."""
    from pyarrow import fs

    files, base = local_path(folder)
    names = sorted(x.base_name for x in files.get_file_info(fs.FileSelector(base)) if x.base_name.endswith((".warc", ".warc.gz")) and not x.base_name.startswith("."))
    types = {"file": pa.string(), "offset": pa.int64(), "length": pa.int64(), "url": pa.string(), "digest": pa.string()}

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                own, at = local_path(folder)
                rows = []
                with own.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    for offset, length, data in records(name, stream):
                        head, payload = parse(data)
                        told = head.get("warc-payload-digest", "")
                        rows.append((name, offset, length, head.get("warc-target-uri"), told if told.startswith("sha1:") else digest(payload or b"")))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))
                            rows = []
                columns = list(zip(*rows, strict=True)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))

    listed = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, len(names)))
    return listed.mapInArrow(run, INDEX)


def utf8(pages: list[bytes | None]) -> pa.Array:
    try:
        return pa.array(pages, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if p is None else p.decode(errors="replace") for p in pages], pa.string())


def ranges(offsets: list[int], lengths: list[int], gap: int = GAP, span: int = SPAN) -> list[tuple[int, int, int, int]]:
    """First and last + 1 record, start and end of each coalesced range of sorted records."""
    out: list[tuple[int, int, int, int]] = []
    for i, (o, n) in enumerate(zip(offsets, lengths, strict=True)):
        if out and o - out[-1][3] <= gap and o + n - out[-1][2] <= span:
            out[-1] = (out[-1][0], i + 1, out[-1][2], max(out[-1][3], o + n))
        else:
            out.append((i, i + 1, o, o + n))
    return out


def read(index: DataFrame, folder: str, key: str = "page_id") -> DataFrame:
    """key, url, digest and html of the records of an index, or of a part of one; without keys file and offset are the key."""
    if key not in index.columns:
        found = read(index.withColumn("key", F.struct("file", "offset")), folder, "key")
        return found.select("key.file", "key.offset", "url", "digest", "html")
    rows = index.select(index[key].alias("key"), "file", "offset", "length", "url", "digest")
    rows = rows.repartition("file", F.expr(f"offset div {STRIPE}")).sortWithinPartitions("file", "offset")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        files, base = local_path(folder)
        stream, opened = None, None
        for batch in batches:
            name, offset, length, wanted = (batch.column(i).to_pylist() for i in (1, 2, 3, 5))
            a = 0
            while a < len(name):
                b = a
                while b < len(name) and name[b] == name[a]:
                    b += 1
                if opened != name[a]:
                    stream, opened = files.open_input_file(f"{base}/{name[a]}"), name[a]
                for i, j, start, end in ranges(offset[a:b], length[a:b]):
                    data, pages = memoryview(stream.read_at(end - start, start)), []
                    for k in range(a + i, a + j):
                        own = data[offset[k] - start : offset[k] - start + length[k]]
                        page = parse(own if not name[k].endswith(".gz") else zlib.decompress(own, 31).lstrip(b"\r\n"))[1]
                        if wanted[k] is not None and digest(page or b"") != wanted[k]:
                            raise ValueError(f"{name[k]} at {offset[k]}: the digest differs")
                        pages.append(page)
                    own = batch.slice(a + i, j - i)
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(4), own.column(5), utf8(pages)], ["key", "url", "digest", "html"])
                a = b

    return rows.mapInArrow(run, f"key {kind}, url string, digest string, html string").withColumnRenamed("key", key)


def first_of_each(index: DataFrame, key: str = "page_id") -> DataFrame:
    """The index rows of the least key of each digest: pages of equal content are fetched once."""
    least = index.groupBy("digest").agg(F.min(F.struct(index[key].alias("key"), "file", "offset", "length", "url")).alias("least"))
    return least.select(F.col("least.key").alias(key), *(F.col(f"least.{c}").alias(c) for c in ("file", "offset", "length", "url")), "digest")


def fetch(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Writes the pages to WARC files, selects one record of each content from the index, and reads those."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read(first_of_each(write(pages, folder, key), key), folder, key)


SQL = """
SELECT page_id, url, sha1(html) AS sha1, html FROM (
  SELECT page_id, url, html, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id) AS k FROM pages
) WHERE k = 1
"""
