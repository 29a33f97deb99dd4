"""Plain texts and web pages as elements, laid out on pages of 40 lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import canonical_font

LINES = 40


def lay_out(lines: DataFrame) -> DataFrame:
    """lines: doc_id, doc_idx, text, font_size, font_name, indent. Image-free elements, one below another."""
    row = F.col("doc_idx") % LINES
    y0 = (40 + 18 * row).cast("double")
    return lines.select(
        "doc_id", "doc_idx", F.col("doc_idx").alias("text_row"), (F.expr(f"doc_idx div {LINES}") + 1).cast("int").alias("page_number"), F.lit("text").alias("kind"), "text",
        "font_name", canonical_font(F.col("font_name")).alias("font_canon"), "font_size",
        (50 + F.col("indent")).cast("double").alias("x0"), y0.alias("y0"), (50 + F.col("indent") + 8 * F.octet_length("text")).cast("double").alias("x1"), (y0 + F.col("font_size")).alias("y1"), F.lit(None).cast("binary").alias("image"),
    )


def from_documents(docs: DataFrame) -> DataFrame:
    """A row for each line: lines of under 60 characters are headings, the first line a title. No shuffle. Null texts have no elements."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("doc_idx", "text"))
    title, heading = F.col("doc_idx") == 0, F.char_length("text") < 60
    return lay_out(
        lines.select(
            "doc_id", "doc_idx", "text", F.when(title, 20.0).when(heading, 16.0).otherwise(12.0).alias("font_size"),
            F.when(title | heading, F.lit("Helvetica-Bold")).otherwise(F.lit("Arial")).alias("font_name"), F.when(title | heading, 20).otherwise(0).alias("indent"),
        )
    )


TAGS = {"h1": ("Helvetica-Bold", 24.0), "h2": ("Helvetica-Bold", 18.0), "p": ("Arial", 12.0), "li": ("Arial", 11.0), "footer": ("TimesNewRomanPSMT", 9.0)}


def from_pages(pages: DataFrame) -> DataFrame:
    """Headings, paragraphs, list items and footers of web pages, in order, with the font of their tag."""
    tag = "|".join(TAGS)
    found = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.regexp_extract_all("html", F.lit(rf"(?s)(<(?:{tag})[ >].*?</(?:{tag})>)"), F.lit(1))).alias("doc_idx", "raw"))
    found = found.select("doc_id", "doc_idx", F.regexp_extract("raw", r"^<(\w+)", 1).alias("tag"), F.trim(F.regexp_replace("raw", r"(?s)<[^>]*>", "")).alias("text"))
    font, size = F.lit("Arial"), F.lit(12.0)
    for name, (f, s) in TAGS.items():
        font, size = F.when(F.col("tag") == name, F.lit(f)).otherwise(font), F.when(F.col("tag") == name, F.lit(s)).otherwise(size)
    return lay_out(found.select("doc_id", "doc_idx", "text", size.alias("font_size"), font.alias("font_name"), F.lit(0).alias("indent")))


#: The same mapping of documents in SQL, for the checks against another engine.
SQL = f"""lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
elements AS (
  SELECT doc_id, CAST(pos AS INTEGER) AS doc_idx, CAST(pos AS INTEGER) AS text_row, CAST(pos // {LINES} + 1 AS INTEGER) AS page_number, 'text' AS kind, text,
    CASE WHEN pos = 0 OR length(text) < 60 THEN 'Helvetica-Bold' ELSE 'Arial' END AS font_name, CASE WHEN pos = 0 OR length(text) < 60 THEN 'Helvetica-Bold' ELSE 'Helvetica' END AS font_canon,
    CAST(CASE WHEN pos = 0 THEN 20 WHEN length(text) < 60 THEN 16 ELSE 12 END AS DOUBLE) AS font_size,
    CAST(CASE WHEN pos = 0 OR length(text) < 60 THEN 70 ELSE 50 END AS DOUBLE) AS x0, CAST(40 + 18 * (pos % {LINES}) AS DOUBLE) AS y0,
    CAST(CASE WHEN pos = 0 OR length(text) < 60 THEN 70 ELSE 50 END + 8 * strlen(text) AS DOUBLE) AS x1,
    CAST(40 + 18 * (pos % {LINES}) + CASE WHEN pos = 0 THEN 20 WHEN length(text) < 60 THEN 16 ELSE 12 END AS DOUBLE) AS y1
  FROM lines)"""
