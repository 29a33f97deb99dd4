"""Lines and blocks: a greedy fold over each page's texts in reading order, kept in the JVM by higher-order functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINE, BLOCK = 5.0, 12.0


def line_members(elements: DataFrame, threshold: float = LINE, downwards: bool = False) -> DataFrame:
    """Texts with the number of their line on the page and their place in the fold's order.

    Texts are taken by y0, from high to low unless downwards, then x0. A text opens a line if it is the threshold or
    more from the line's first text, or differs in font or by over 0.1 in size."""
    y = F.col("y0") if downwards else -F.col("y0")
    row = F.struct(y.alias("k"), "x0", "doc_idx", "y0", "x1", "y1", "text", "font_canon", "font_size")
    pages = elements.where("kind = 'text'").groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(None).cast("string").alias("font"), F.lit(0.0).alias("size"), F.lit(-1).alias("line"), F.array().cast("array<int>").alias("lines"))

    def step(acc, r):
        new = acc.y.isNull() | (F.abs(acc.y - r.y0) >= threshold) | ~acc.font.eqNullSafe(r.font_canon) | (F.abs(acc.size - r.font_size) > 0.1)
        line = acc.line + new.cast("int")
        return F.struct(F.when(new, r.y0).otherwise(acc.y).alias("y"), F.when(new, r.font_canon).otherwise(acc.font).alias("font"), F.when(new, r.font_size).otherwise(acc["size"]).alias("size"), line.alias("line"), F.array_append(acc.lines, line).alias("lines"))

    folded = pages.withColumn("lines", F.aggregate("rows", start, step, lambda acc: acc.lines))
    each = folded.select("doc_id", "page_number", F.posexplode(F.arrays_zip("rows", "lines")).alias("place", "m"))
    return each.select("doc_id", "page_number", "place", F.col("m.lines").alias("line"), "m.rows.doc_idx", "m.rows.text", "m.rows.font_canon", "m.rows.font_size", "m.rows.x0", "m.rows.y0", "m.rows.x1", "m.rows.y1")


def lines(elements: DataFrame, threshold: float = LINE, downwards: bool = False) -> DataFrame:
    """Each line's text (joined without a separator), members from left to right, font of its leftmost member and box."""
    m = line_members(elements, threshold, downwards).groupBy("doc_id", "page_number", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda r: r.text), "").alias("text"),
        F.array_sort(F.collect_list(F.struct("x0", "doc_idx", "font_canon", "font_size"))).alias("members"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    first = F.col("members")[0]
    even = F.forall("members", lambda r: r.font_canon.eqNullSafe(F.col("members")[0].font_canon) & (F.abs(r.font_size - F.col("members")[0].font_size) < 0.1))
    return m.select("doc_id", "page_number", "line", "text", first.font_canon.alias("font_canon"), first.font_size.alias("font_size"), even.alias("one_font"), F.transform("members", lambda r: r.doc_idx).alias("idxs"), "x0", "y0", "x1", "y1")


def with_blocks(lined: DataFrame, threshold: float = BLOCK) -> DataFrame:
    """Lines with the number of their block: a line opens one if its top is over the threshold from the line before."""
    w = Window.partitionBy("doc_id", "page_number").orderBy("line")
    opens = F.coalesce((F.abs(F.lag("y0").over(w) - F.col("y0")) > threshold).cast("int"), F.lit(0))
    return lined.withColumn("_open", opens).withColumn("block", F.sum("_open").over(w).cast("int")).drop("_open")


def blocks(elements: DataFrame, line: float = LINE, block: float = BLOCK) -> DataFrame:
    """Each block's lines, in their order, and box."""
    b = with_blocks(lines(elements, line), block)
    return b.groupBy("doc_id", "page_number", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda r: r.text).alias("lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def grouped_runs(elements: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Runs of a page brought together into one text each, from top to bottom of a page whose y grows upwards."""
    return lines(elements, threshold)


def flat(lined: DataFrame) -> DataFrame:
    """The elements of lines, one a row."""
    return lined.select("doc_id", "page_number", "line", F.posexplode("idxs").alias("place", "doc_idx"))
