"""Style keys: font, size, deviation, horizontal place and case of a text, in one number beside its font.

The deviation's bin is sign-extended over the bits above it, so all texts of one font and size that are
smaller than the mean share a key, whatever their place and case; such a text finds no similar ones itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 612.0


def is_caps(text: Column) -> Column:
    return ~text.rlike(r"\p{Ll}")


def is_title(text: Column) -> Column:
    """All words of more than three bytes begin with a capital."""
    return F.forall(F.filter(F.split(text, r"\s+"), lambda w: F.octet_length(w) > 3), lambda w: w.rlike(r"^\p{Lu}"))


def _spread(rows: Column) -> Column:
    """n, total, mean and squares (of the distances from the mean) of the sizes of rows (doc_idx, font_size), taken up one by one.

    Half bins are common (a title over three lines), and there the last bit of the deviation decides. So sizes are taken in
    document order, and by the steps of SQL's stddev_pop, whatever the order in which rows arrive."""

    def add(a: Column, x: Column) -> Column:
        n = a.n + 1
        mean = a.mean + (x.font_size - a.mean) / n
        return F.struct(n.alias("n"), (a.total + x.font_size).alias("total"), mean.alias("mean"), (a.squares + (x.font_size - mean) * (x.font_size - a.mean)).alias("squares"))

    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("n", "total", "mean", "squares")))
    found = F.aggregate(F.filter(rows, lambda x: x.font_size.isNotNull()), zero, add)
    return F.when(found.n > 0, found)


def styled(elements: DataFrame) -> DataFrame:
    """Texts with their bins and style_key; two texts have one style if font_canon and style_key are equal."""
    e = elements.where("kind = 'text'")
    e = e.join(e.groupBy("doc_id").agg(_spread(F.array_sort(F.collect_list(F.struct("doc_idx", "font_size")))).alias("_s")), "doc_id")
    e = e.withColumn("_mean", F.col("_s.total") / F.col("_s.n")).withColumn("_sd", F.greatest(F.sqrt(F.col("_s.squares") / F.col("_s.n")), F.lit(1e-6))).drop("_s").select(*elements.columns, "_mean", "_sd")
    size = F.least(F.round(2 * F.col("font_size")), F.lit(400)).cast("long")
    z = F.greatest(F.least(F.round(2 * (F.col("font_size") - F.col("_mean")) / F.col("_sd")), F.lit(8)), F.lit(-8)).cast("long")
    x = F.greatest(F.least(F.floor((F.col("x0") + F.col("x1")) / 2 / WIDTH * 10), F.lit(9)), F.lit(0)).cast("long")
    e = e.withColumns({"size_bin": size, "z_bin": z, "x_bin": x, "caps": is_caps(F.col("text")), "title": is_title(F.col("text"))}).drop("_mean", "_sd")
    key = F.shiftleft("size_bin", 16).bitwiseOR(F.shiftleft("z_bin", 32)).bitwiseOR(F.shiftleft("x_bin", 40)).bitwiseOR(F.shiftleft(F.col("caps").cast("long"), 48)).bitwiseOR(F.shiftleft(F.col("title").cast("long"), 49))
    return e.withColumn("style_key", key)


def buckets(elements: DataFrame) -> DataFrame:
    """Number of texts of each style."""
    return styled(elements).groupBy("doc_id", "font_canon", "style_key").agg(F.count(F.lit(1)).alias("texts"))


def similar(elements: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Up to k texts after each seed, in document order, of neighbouring bins. seeds: doc_id, seed_idx, and end_idx or null."""
    s = styled(elements).select("doc_id", "doc_idx", "font_canon", "size_bin", "z_bin", "x_bin", "caps", "title")
    a = s.join(seeds.select("doc_id", F.col("seed_idx").alias("doc_idx"), "end_idx"), ["doc_id", "doc_idx"]).where("z_bin >= 0").alias("a")
    near = "a.doc_id = b.doc_id AND a.font_canon <=> b.font_canon AND a.size_bin = b.size_bin AND b.doc_idx > a.doc_idx AND (a.end_idx IS NULL OR b.doc_idx < a.end_idx) AND abs(a.z_bin - b.z_bin) <= 1 AND (b.z_bin < 0 OR (abs(a.x_bin - b.x_bin) <= 1 AND a.caps = b.caps AND a.title = b.title))"
    found = a.join(s.alias("b"), F.expr(near)).select("a.doc_id", F.col("a.doc_idx").alias("seed_idx"), F.col("b.doc_idx").alias("doc_idx"))
    w = Window.partitionBy("doc_id", "seed_idx").orderBy("doc_idx")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).withColumn("score", F.lit(1.0))


def same_style(elements: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """Texts of exactly a seed's style, the seed itself left out after the limit. seeds: doc_id, seed_idx."""
    s = styled(elements).select("doc_id", "doc_idx", "font_canon", "style_key")
    a = s.join(seeds.select("doc_id", F.col("seed_idx").alias("doc_idx")), ["doc_id", "doc_idx"]).alias("a")
    found = a.join(s.alias("b"), F.expr("a.doc_id = b.doc_id AND a.font_canon <=> b.font_canon AND a.style_key = b.style_key")).select("a.doc_id", F.col("a.doc_idx").alias("seed_idx"), F.col("b.doc_idx").alias("doc_idx"))
    if most is not None:
        found = found.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "seed_idx").orderBy("doc_idx"))).where(F.col("_k") <= most).drop("_k")
    return found.where("seed_idx <> doc_idx")
