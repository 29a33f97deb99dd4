"""From matches to output rows: chunks with their section, pages and parent, and images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators import align as aligning
from foliospark.operators import chunk
from foliospark.plans.docql import Element, Template, as_number, parse_template


def outputs(elements: DataFrame, template: Template | str, matches: DataFrame | None = None, tokens: Callable[[Column], Column] | None = None, references: DataFrame | None = None) -> DataFrame:
    """A row for each chunk: sections emit their own content, then their children. A child refers to the first chunk of the
    section around it; text chunks right below a root section refer to none. references: counts that alignment takes into account."""
    template = parse_template(template) if isinstance(template, str) else template
    matches = aligning.align(elements, template, references) if matches is None else matches
    nodes = list(template.walk())
    about = aligning.metadata(template)
    given: list[tuple[int, int]] = []
    which = F.lit(0)
    for k, e in enumerate(nodes):
        limit, overlap = as_number(e.attributes.get("chunkSize")), as_number(e.attributes.get("chunkOverlap"))
        own = (500 if limit is None else limit, 150 if overlap is None else overlap)
        if own not in given:
            given.append(own)
        which = F.when(F.col("node") == k, F.lit(given.index(own))).otherwise(which)
    content = elements.where("kind = 'text'").join(matches.where(F.col("type").isin("Section", "TextChunk", "Paragraph", "Table")), "doc_id").where("doc_idx >= start_idx AND doc_idx < stop_idx")
    made = chunk.chunks(content, keys=["doc_id", "seq", "node", "output_parent"], tokens=tokens, settings=(given, which))
    rows = made.withColumn("out_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "chunk")) - 1)
    by_seq = Window.partitionBy("doc_id").orderBy("seq", "chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = F.map_from_entries(F.array_distinct(F.filter(F.collect_list(F.when(F.col("chunk") == 0, F.struct("seq", "out_idx"))).over(by_seq), lambda x: x.isNotNull())))
    rows = rows.withColumn("parent_index", F.element_at(starts, F.col("output_parent")))
    section, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (s, n) in about.items():
        section, name = F.when(F.col("node") == k, F.lit(s)).otherwise(section), F.when(F.col("node") == k, F.lit(n)).otherwise(name)
    return rows.select(
        "doc_id", "out_idx", F.lit("Text").alias("type"), "text", F.col("out_idx").alias("chunk_index"), F.when(F.col("parent_index").isNotNull(), F.lit("Section")).alias("parent_name"), "parent_index",
        section.alias("section"), name.alias("section_name"), "primary_page", "page_numbers", "chunk_element_count", "chunk_char_count",
    )


def image_outputs(elements: DataFrame, matches: DataFrame, node: Element, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """The first image of each match of an Image node, with what the node's children ask for. matches: doc_id, seq, start_idx, stop_idx."""
    inside = elements.where("kind = 'image'").join(matches, "doc_id").where("doc_idx >= start_idx AND doc_idx < stop_idx")
    first = inside.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "seq").orderBy("doc_idx"))).where("_k = 1").drop("_k")
    kinds = {c.type: c for c in node.children}
    model = str(kinds["ImageSummary"].attributes.get("model", "")) if "ImageSummary" in kinds else ""
    none = F.lit(None).cast("string")
    return first.select(
        "doc_id", "seq", F.lit("Image").alias("type"), "doc_idx", "page_number", F.struct("x0", "y0", "x1", "y1").alias("bbox"),
        (F.lit("Image caption") if "ImageCaption" in kinds else none).alias("caption"), (F.base64("image") if "ImageBytes" in kinds else none).alias("bytes_base64"), (F.lit(f"Image summary ({model})") if model or "ImageSummary" in kinds else none).alias("summary"),
        ((embed or (lambda c: F.when(c.isNotNull(), F.array_repeat(F.lit(0.5).cast("float"), 512))))(F.col("image")) if "ImageEmbedding" in kinds else F.lit(None).cast("array<float>")).alias("embedding"),
    )


def as_json(rows: DataFrame, pretty: bool = False) -> DataFrame:
    """doc_id and a tagged JSON object for each output row, with its metadata nested."""
    meta = F.struct("section", "section_name", "primary_page", "page_numbers", "chunk_element_count", "chunk_char_count")
    return rows.select("doc_id", "out_idx", F.to_json(F.struct("type", "text", "chunk_index", "parent_name", "parent_index", meta.alias("metadata")), {"pretty": str(pretty).lower()}).alias("json"))


def document_json(rows: DataFrame) -> DataFrame:
    """One JSON array for each document."""
    each = as_json(rows)
    return each.groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("out_idx", "json"))), lambda x: x.json), ","), F.lit("]")).alias("json"))


def process(elements: DataFrame, template: str, tokens: Callable[[Column], Column] | None = None, references: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three results of processing: output rows, blocks of lines, and matches."""
    from foliospark.operators.layout import blocks

    parsed = parse_template(template)
    matches = aligning.align(elements, parsed, references)
    return outputs(elements, parsed, matches, tokens), blocks(elements), matches
