"""Greedy chunks of whole elements with overlap, by bytes or tokens, without leaving the JVM.

Where a chunk ends and where the next starts depend on its start alone, so both are computed for every element
by windows over prefix sums; one fold then follows the chain of starts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP, BLOCK = 500, 150, 512


def words(text: Column) -> Column:
    """The stand-in for a tokenizer's count: runs between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


#: Limit and overlap of each kind of group, and the column that says which kind a group is.
Settings = tuple[list[tuple[int, int]], Column]


def scale(values: list[int], which: Column) -> tuple[int, Column]:
    """One distance that stands for each of the values, and the factor that brings sums of lengths to it.

    Frames of windows have fixed bounds; with the factor one window serves groups of unlike limits."""
    if len(set(values)) == 1:
        return values[0], F.lit(1)
    whole = math.lcm(*[v for v in values if v > 0] or [1])
    return whole, F.element_at(F.array(*[F.lit(whole // v if v > 0 else whole + 1).cast("long") for v in values]), (which + 1).cast("int"))


def ends(elements: DataFrame, settings: Settings, keys: list[str], size: Column, tokens: bool, carry: list[str]) -> DataFrame:
    """For each element, by its rank i among the n of its group: the end (exclusive) of a chunk that starts there, and
    the last element from which the overlap back from i is reached (at_end: back from the end)."""
    given, which = settings
    order, whole = Window.partitionBy(*keys).orderBy("doc_idx"), Window.partitionBy(*keys)
    of = lambda k: F.lit(given[0][k]) if len(given) == 1 else F.element_at(F.array(*[F.lit(x[k]).cast("long") for x in given]), (which + 1).cast("int"))
    reach, by_limit = scale([x[0] for x in given], F.col("_which"))
    step, by_overlap = scale([x[1] for x in given], F.col("_which"))
    e = elements.select(*keys, "doc_idx", *carry, size.cast("long").alias("len"), of(0).alias("_limit"), of(1).alias("_overlap"), which.alias("_which"))
    e = e.withColumn("i", F.row_number().over(order) - 1).withColumn("s", F.coalesce(F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    e = e.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("total", F.sum("len").over(whole))
    by_sum, by_back = Window.partitionBy(*keys).orderBy(F.col("s") * by_limit), Window.partitionBy(*keys).orderBy(F.col("s") * by_overlap)
    fits = F.when(F.col("total") <= F.col("s") + F.col("_limit"), F.col("n")).otherwise(F.max("i").over(by_sum.rangeBetween(0, reach)))
    if tokens:
        exact = F.coalesce(F.min("i").over(by_sum.rangeBetween(reach, reach)), F.when(F.col("total") == F.col("s") + F.col("_limit"), F.col("n")))
        end = F.greatest(F.col("i") + 1, F.least(fits, F.coalesce(exact, fits)))
    else:
        end = F.greatest(fits, F.max("i").over(by_sum.rangeBetween(0, 0)) + 1)  # past the first that isn't empty: those of one sum end with it
    back = F.when(F.col("_overlap") > 0, F.max("i").over(by_back.rangeBetween(Window.unboundedPreceding, -step)))
    at_end = F.max(F.when(F.col("s") <= F.col("total") - F.col("_overlap"), F.col("i"))).over(whole)
    return e.withColumn("end", end).withColumn("back", back).withColumn("at_end", at_end)


def followed(elements: DataFrame, settings: Settings, keys: list[str], tokens: Callable[[Column], Column] | None, carry: list[str]) -> DataFrame:
    """Each group's texts as the array rows, and its chunks as the array out of first (a) and last + 1 (b) ranks.

    Windows and grouping share their keys, so texts are moved once."""
    size = F.octet_length("text") if tokens is None else tokens(F.col("text"))
    e = ends(elements.where("kind = 'text'"), settings, keys, size, tokens is not None, carry)
    rows = e.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "end", "back", "doc_idx", *carry))).alias("rows"), F.first("n").alias("n"), F.first("at_end").alias("at_end"))
    none = lambda cur, kind: F.struct(cur.cast("long").alias("cur"), F.array().cast(kind).alias("out"))

    def step(acc, r):
        back = F.when(r.end < F.col("n"), F.element_at(F.col("rows"), (F.least(r.end, F.col("n") - 1) + 1).cast("int")).back).otherwise(F.col("at_end"))
        after = F.when(r.end >= F.col("n"), F.col("n")).when(back > r.i, F.least(back, r.end)).otherwise(r.end)
        here = r.i == acc.cur
        return F.struct(F.when(here, after).otherwise(acc.cur).cast("long").alias("cur"), F.when(here, F.array_append(acc.out, F.struct(r.i.cast("long").alias("a"), r.end.cast("long").alias("b")))).otherwise(acc.out).alias("out"))

    def block(acc, own):
        """A fold copies what it carries at each step, so rows are followed in blocks and few results are carried on."""
        done = F.aggregate(own, none(acc.cur, "array<struct<a:bigint,b:bigint>>"), step)
        return F.element_at(F.transform(F.array(done), lambda d: F.struct(d.cur.alias("cur"), F.array_append(acc.out, d.out).alias("out"))), 1)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / BLOCK).cast("int")), lambda k: F.slice("rows", k * BLOCK + 1, F.lit(BLOCK)))
    return rows.withColumn("out", F.aggregate(blocks, none(F.lit(0), "array<array<struct<a:bigint,b:bigint>>>"), block, lambda acc: F.flatten(acc.out)))


def ranges(elements: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, keys: list[str] | None = None, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """chunk, first_idx and last_idx (both inclusive, in document order) of the chunks of each group's texts."""
    keys = keys or ["doc_id"]
    idx = lambda k: F.element_at(F.col("rows"), k.cast("int")).doc_idx
    made = followed(elements, ([(limit, overlap)], F.lit(0)), keys, tokens, []).select(*keys, F.transform("out", lambda c: F.struct(idx(c.a + 1).alias("first_idx"), idx(c.b).alias("last_idx"))).alias("out"))
    return made.select(*keys, F.posexplode("out").alias("chunk", "c")).select(*keys, "chunk", "c.first_idx", "c.last_idx")


def members(elements: DataFrame, ranged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The texts of each chunk."""
    keys = keys or ["doc_id"]
    return elements.where("kind = 'text'").join(ranged, keys).where("doc_idx >= first_idx AND doc_idx <= last_idx")


def chunks(elements: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, keys: list[str] | None = None, tokens: Callable[[Column], Column] | None = None, settings: Settings | None = None) -> DataFrame:
    """Each chunk's text (elements joined by a space), pages, number of elements and bytes. settings: instead of limit and overlap.

    A chunk's main page is that with most bytes; of equal ones the page that comes last."""
    keys = keys or ["doc_id"]

    def build(c):
        own = F.slice(F.col("rows"), (c.a + 1).cast("int"), (c.b - c.a).cast("int"))
        text, pages = F.array_join(F.transform(own, lambda r: r.text), " "), F.array_distinct(F.transform(own, lambda r: r.page_number))
        weight = lambda p: F.aggregate(F.filter(own, lambda r: r.page_number == p), F.lit(0).cast("long"), lambda acc, r: acc + F.octet_length(r.text))
        main = F.array_max(F.transform(pages, lambda p, k: F.struct(weight(p).alias("w"), k.alias("k"), p.alias("p")))).p
        return F.struct(text.alias("text"), main.alias("primary_page"), F.array_sort(pages).alias("page_numbers"), F.size(own).alias("chunk_element_count"), F.element_at(own, 1).doc_idx.alias("first_idx"), F.element_at(own, -1).doc_idx.alias("last_idx"), F.octet_length(text).alias("chunk_char_count"))

    made = followed(elements, settings or ([(limit, overlap)], F.lit(0)), keys, tokens, ["text", "page_number"]).select(*keys, F.transform("out", build).alias("out"))
    return made.select(*keys, F.posexplode("out").alias("chunk", "c")).select(*keys, "chunk", "c.*")
