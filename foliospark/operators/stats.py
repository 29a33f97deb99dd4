"""Per-document statistics of fonts and sizes. Scopes of fonts and sizes are ranges of text rows; those of counts are ranges of document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAND = 2000.0


def _scope(elements: DataFrame, start: int | None, end: int | None, column: str = "text_row") -> DataFrame:
    found = elements.where("kind = 'text'")
    found = found if start is None else found.where(F.col(column) >= start)
    return found if end is None else found.where(F.col(column) < end)


def font_usage(elements: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Number and places of the texts of each font and exact size."""
    return _scope(elements, start, end).groupBy("doc_id", "font_canon", "font_size").agg(F.count(F.lit(1)).alias("uses"), F.sort_array(F.collect_list("doc_idx")).alias("idxs"))


def font_frequency(elements: DataFrame) -> DataFrame:
    """Uses of each font name, the most used first."""
    counts = elements.where("kind = 'text'").groupBy("doc_id", "font_canon").agg(F.count(F.lit(1)).alias("uses"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("uses"), "font_canon")))


def nth(sorted_sizes: Column, share: float) -> Column:
    """The value at index floor(share * n), the last at most."""
    n = F.size(sorted_sizes)
    return F.element_at(sorted_sizes, F.least(F.floor(F.lit(share) * n), n - 1).cast("int") + 1)


def size_stats(elements: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Mean, deviation and percentiles of sizes; 12, 0 and 12 for a document without texts in the scope."""
    docs = elements.select("doc_id").distinct()
    found = _scope(elements, start, end).groupBy("doc_id").agg(F.avg("font_size").alias("mean"), F.stddev_pop("font_size").alias("sd"), F.array_sort(F.collect_list("font_size")).alias("_s"))
    found = found.select("doc_id", "mean", "sd", *(nth(F.col("_s"), p / 100).alias(f"p{p}") for p in (25, 50, 75, 90, 95)))
    return docs.join(found, "doc_id", "left").na.fill({"mean": 12.0, "sd": 0.0} | {f"p{p}": 12.0 for p in (25, 50, 75, 90, 95)})


def average_size(elements: DataFrame) -> DataFrame:
    return elements.groupBy("doc_id").agg(F.coalesce(F.avg(F.when(F.col("kind") == "text", F.col("font_size"))), F.lit(12.0)).alias("mean"))


def z_fonts(elements: DataFrame, least: float, start: int | None = None, end: int | None = None) -> DataFrame:
    """Styles whose size is so many deviations above the mean; 0 deviations where all sizes are equal."""
    own = _scope(elements, start, end)
    stats = own.groupBy("doc_id").agg(F.avg("font_size").alias("mean"), F.stddev_pop("font_size").alias("sd"))
    found = font_usage(elements, start, end).join(stats, "doc_id")
    return found.withColumn("z", F.when(F.col("sd") > 0, (F.col("font_size") - F.col("mean")) / F.col("sd")).otherwise(0.0)).where(F.col("z") >= least).drop("mean", "sd")


def usage_range(elements: DataFrame, least: int, most: int | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    found = font_usage(elements, start, end).where(F.col("uses") >= least)
    return found if most is None else found.where(F.col("uses") <= most)


def text_count(elements: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Texts in a range of document order."""
    return _scope(elements, start, end, "doc_idx").groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts"))


def heading_levels(elements: DataFrame, levels: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """Styles that act as headings: larger than the mean, used twice at least, by no more than half of the texts; the largest first."""
    found = z_fonts(elements, 0.1, start, end).join(text_count(elements, start, end), "doc_id", "left")
    cap = F.when(F.coalesce("texts", F.lit(0)) > 0, F.greatest(F.lit(2), F.floor(F.col("texts") / 2)))
    found = found.where((F.col("uses") >= 2) & (cap.isNull() | (F.col("uses") <= cap)) & (F.col("z") > 0))
    w = Window.partitionBy("doc_id").orderBy(F.desc("font_size"), F.desc("uses"), "font_canon")
    return found.withColumn("level", F.row_number().over(w)).where(F.col("level") <= levels).select("doc_id", "level", "font_canon", "font_size", "uses")


def reference_counts(elements: DataFrame, destinations: DataFrame) -> DataFrame:
    """How many destinations point at each element: those on its page whose box of 10 around the point holds it.

    A destination without x stands for a band of the whole page's width. Destinations count pages from 0."""
    d = destinations.select("doc_id", (F.col("page") + 1).cast("int").alias("page_number"), F.coalesce(F.col("x") - 10, F.lit(0.0)).alias("dx0"), F.coalesce(F.col("x") + 10, F.lit(BAND)).alias("dx1"), (F.col("y") - 10).alias("dy0"), (F.col("y") + 10).alias("dy1"))
    held = elements.join(d, ["doc_id", "page_number"]).where("x0 >= dx0 AND x1 <= dx1 AND y0 >= dy0 AND y1 <= dy1").groupBy("doc_id", "doc_idx").agg(F.count(F.lit(1)).alias("refs"))
    return elements.select("doc_id", "doc_idx").join(held, ["doc_id", "doc_idx"], "left").na.fill({"refs": 0})


def chunk_pages(members: DataFrame, keys: list[str]) -> DataFrame:
    """Pages of each chunk, and the one with most bytes; of equal ones the page that comes last. members: keys, doc_idx, page_number, text."""
    pages = members.groupBy(*keys, "page_number").agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("doc_idx").alias("first"))
    return pages.groupBy(*keys).agg(F.max_by("page_number", F.struct("bytes", "first")).alias("primary_page"), F.sort_array(F.collect_list("page_number")).alias("page_numbers"))


def boxes(elements: DataFrame, keys: list[str]) -> DataFrame:
    """The rectangle around the elements of each group."""
    return elements.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
