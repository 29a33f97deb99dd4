"""Element search: predicates over positioned elements. Every filter is a plain conjunction that Catalyst fuses and pushes down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import canonical_font, similar_enough, similarity

def in_order():
    return Window.partitionBy("doc_id").orderBy("doc_idx")



def on_page(elements: DataFrame, page: int) -> DataFrame:
    return elements.where(F.col("page_number") == page)


def by_size(elements: DataFrame, low: float, high: float) -> DataFrame:
    """Texts of a size from low up to, but not, high."""
    return elements.where((F.col("kind") == "text") & (F.col("font_size") >= low) & (F.col("font_size") < high))


def by_references(elements: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """Elements that at least so many destinations point at. counts: doc_id, doc_idx, refs."""
    return elements.join(counts, ["doc_id", "doc_idx"], "left").where(F.coalesce("refs", F.lit(0)) >= least).select(elements["*"])


def inside(x0: float, y0: float, x1: float, y1: float) -> Column:
    return (F.col("x0") >= x0) & (F.col("y0") >= y0) & (F.col("x1") <= x1) & (F.col("y1") <= y1)


def in_region(elements: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Elements that lie wholly in a rectangle, on any page."""
    return elements.where(inside(x0, y0, x1, y1))


def search(elements: DataFrame, page: int | None = None, least_size: float | None = None, most_size: float | None = None, references: tuple[DataFrame, int] | None = None, region: tuple[float, float, float, float] | None = None) -> DataFrame:
    """All conditions at once; sizes include both ends and leave out images. No condition: everything."""
    out = elements
    if page is not None:
        out = on_page(out, page)
    if least_size is not None or most_size is not None:
        out = out.where("kind = 'text'")
        out = out if least_size is None else out.where(F.col("font_size") >= least_size)
        out = out if most_size is None else out.where(F.col("font_size") <= most_size)
    if region is not None:
        out = in_region(out, *region)
    return out if references is None else by_references(out, *references)


def at(elements: DataFrame, doc_id: int, doc_idx: int, kind: str | None = None) -> DataFrame:
    """One element by its id, of one kind if given."""
    found = elements.where((F.col("doc_id") == doc_id) & (F.col("doc_idx") == doc_idx))
    return found if kind is None else found.where(F.col("kind") == kind)


def texts(elements: DataFrame) -> DataFrame:
    return elements.where("kind = 'text'")


def images(elements: DataFrame) -> DataFrame:
    return elements.where("kind = 'image'")


def fuzzy(elements: DataFrame, pattern: str, threshold: float, start: int = 0, end: int | None = None, lower: bool = False) -> DataFrame:
    """Texts similar to a pattern, with their score; lower: upper and lower case are alike."""
    text, wanted = (F.lower("text"), F.lower(F.lit(pattern))) if lower else (F.col("text"), F.lit(pattern))
    found = elements.where((F.col("kind") == "text") & (F.col("doc_idx") >= start))
    found = found if end is None else found.where(F.col("doc_idx") < end)
    return found.where(similar_enough(text, wanted, threshold, len(pattern))).withColumn("score", similarity(text, wanted))


def fuzzy_lines(lines: DataFrame, pattern: str, threshold: float, lower: bool = True) -> DataFrame:
    text, wanted = (F.lower("text"), F.lower(F.lit(pattern))) if lower else (F.col("text"), F.lit(pattern))
    return lines.where(similar_enough(text, wanted, threshold, len(pattern))).withColumn("score", similarity(text, wanted))


def by_font(elements: DataFrame, font: str, size: float | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Texts of a font: within 0.1 of a size, else between bounds that are 0.9 and 1.1 of the document's mean unless given."""
    canon = canonical_font(F.lit(font))
    found = elements.where("kind = 'text'")
    if size is not None:
        return found.where((F.col("font_canon") == canon) & (F.abs(F.col("font_size") - size) < 0.1))
    if low is None or high is None:
        found = found.withColumn("_mean", F.avg("font_size").over(Window.partitionBy("doc_id")))
        found = found.where((F.col("font_size") >= (F.lit(low) if low is not None else 0.9 * F.col("_mean"))) & (F.col("font_size") <= (F.lit(high) if high is not None else 1.1 * F.col("_mean")))).drop("_mean")
    else:
        found = found.where((F.col("font_size") >= low) & (F.col("font_size") <= high))
    return found.where(F.col("font_canon") == canon)


def boundaries(elements: DataFrame) -> DataFrame:
    """Texts at least 1.5 standard deviations larger than their document's mean size."""
    w = Window.partitionBy("doc_id")
    found = elements.where("kind = 'text'").withColumn("_mean", F.avg("font_size").over(w)).withColumn("_sd", F.stddev_pop("font_size").over(w))
    return found.where(F.col("font_size") >= F.col("_mean") + 1.5 * F.col("_sd")).drop("_mean", "_sd")


def slice_(elements: DataFrame, start: int, end: int) -> DataFrame:
    return elements.where((F.col("doc_idx") >= start) & (F.col("doc_idx") < end))


def between(elements: DataFrame, markers: DataFrame) -> DataFrame:
    """Elements from each document's start marker up to its end marker. markers: doc_id, start, end (null or unknown: to the end)."""
    known = elements.select("doc_id", "doc_idx")
    m = markers.join(known.withColumnRenamed("doc_idx", "start"), ["doc_id", "start"], "left_semi")
    ends = known.select("doc_id", F.col("doc_idx").alias("end"), F.lit(True).alias("has_end"))
    m = m.join(ends, ["doc_id", "end"], "left").select("doc_id", "start", F.when(F.col("has_end"), F.col("end")).alias("stop"))
    return elements.join(m, "doc_id").where((F.col("doc_idx") >= F.col("start")) & (F.col("stop").isNull() | (F.col("doc_idx") < F.col("stop")))).select(elements["*"])


def after(elements: DataFrame, start: int) -> DataFrame:
    return elements.where(F.col("doc_idx") >= start)


def lengths(elements: DataFrame) -> DataFrame:
    return elements.groupBy("doc_id").agg((F.max("doc_idx") + 1).alias("doc_len"))


def aligned(elements: DataFrame, threshold: float = 10.0, axis: str = "x") -> DataFrame:
    """Pairs of texts of one page whose centres are closer than a threshold along an axis."""
    e = elements.where("kind = 'text'").select("doc_id", "page_number", "doc_idx", ((F.col(f"{axis}0") + F.col(f"{axis}1")) / 2).alias("centre"))
    a, b = e.alias("a"), e.alias("b")
    near = F.expr(f"a.doc_id = b.doc_id AND a.page_number = b.page_number AND a.doc_idx < b.doc_idx AND abs(a.centre - b.centre) < {threshold}")
    return a.join(b, near).select("a.doc_id", "a.page_number", F.col("a.doc_idx").alias("left_idx"), F.col("b.doc_idx").alias("right_idx"))


def hit(elements: DataFrame, page: int, x: float, y: float) -> DataFrame:
    """The first element of each document's page that holds a point."""
    found = elements.where((F.col("page_number") == page) & (F.col("x0") <= x) & (F.col("x1") >= x) & (F.col("y0") <= y) & (F.col("y1") >= y))
    return found.withColumn("_k", F.row_number().over(in_order())).where("_k = 1").drop("_k")


def of_heading_level(elements: DataFrame, font: str, size: float, skip: int = 0, take: int | None = None) -> DataFrame:
    """Elements of a heading's font and size, some skipped, in document order."""
    found = by_font(elements, font, size).withColumn("_k", F.row_number().over(in_order())).where(F.col("_k") > skip)
    return (found if take is None else found.where(F.col("_k") <= skip + take)).drop("_k")


def in_flow(start: Column, end: Column) -> Column:
    """Whether an end comes after its start."""
    return end > start
