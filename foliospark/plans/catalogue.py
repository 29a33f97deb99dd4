"""The queries of the engine's own operators, by name, and their SQL.

All run over the lines of ``documents`` as positioned elements, or over ``conversations`` for lineage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import canonical_font, rect, rect_expand, rect_union, score_colour, similarity, transform_point
from foliospark.operators import align, chunk, layout, lineage, output, search, stats, style
from foliospark.plans import alignsql
from foliospark.plans.docql import parse_template
from foliospark.sources import pdf, text

Query = Callable[[SparkSession, str], DataFrame]
PATTERN = "And therhean is the is esndha reedes ha."
KEY = ["doc_id", "doc_idx"]
SECTION = f'Section(match="{PATTERN}", as="intro")'
NESTED = 'TextChunk(chunkSize=400, chunkOverlap=100) Section(match="The the of and.", end_match="Of the and.", as="body") { TextChunk(chunkSize=300, chunkOverlap=0) Section(match="That the is and the.") { TextChunk() } }'
ALL = "TextChunk(chunkSize=500, chunkOverlap=150)"

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def query(sql: str | None = None, raw: bool = False) -> Callable[[Callable[[DataFrame], DataFrame]], Callable]:
    """Registers a function of the elements (raw: of session and folder). sql may use the views lines and elements."""

    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f if raw else lambda spark, sf_dir: f(elements(spark, sf_dir))
        if sql is not None:
            _SQL[f.__name__] = sql if sql.lstrip().startswith("WITH") or raw else f"WITH {text.SQL} {sql}" if not sql.lstrip().startswith(",") else f"WITH {text.SQL}{sql}"
        return f

    return add


SHOWN = "doc_id, doc_idx, page_number, kind, text, font_name, font_canon, font_size, x0, y0, x1, y1"
CANON = "font_canon, font_size"


@query(f"SELECT {SHOWN} FROM elements")
def elements_scan(e):
    return e.select(*SHOWN.split(", "))


@query("SELECT doc_id, doc_idx, text FROM elements WHERE page_number = 2")
def page_filter(e):
    return search.on_page(e, 2).select("doc_id", "doc_idx", "text")


@query("SELECT doc_id, doc_idx, font_size FROM elements WHERE font_size >= 13 AND font_size < 20")
def font_size_range(e):
    return search.by_size(e, 13, 20).select(*KEY, "font_size")


@query("SELECT doc_id, doc_idx, x1 FROM elements WHERE x0 >= 60 AND y0 >= 50 AND x1 <= 400 AND y1 <= 500")
def region_contained(e):
    return search.in_region(e, 60, 50, 400, 500).select(*KEY, "x1")


@query("SELECT doc_id, doc_idx FROM elements WHERE page_number = 1 AND font_size >= 12 AND font_size <= 16 AND x0 >= 0 AND y0 >= 0 AND x1 <= 900 AND y1 <= 300")
def multi_search(e):
    return search.search(e, page=1, least_size=12, most_size=16, region=(0, 0, 900, 300)).select(*KEY)


MARKERS = "SELECT doc_id, CAST(3 AS INTEGER) AS s, CAST(CASE WHEN doc_id % 2 = 0 THEN 9 END AS INTEGER) AS e FROM elements GROUP BY doc_id"


@query(f"""SELECT x.doc_id, x.doc_idx FROM elements x JOIN ({MARKERS}) m ON x.doc_id = m.doc_id
  WHERE EXISTS (SELECT 1 FROM elements y WHERE y.doc_id = m.doc_id AND y.doc_idx = m.s) AND x.doc_idx >= m.s
    AND (m.e IS NULL OR NOT EXISTS (SELECT 1 FROM elements y WHERE y.doc_id = m.doc_id AND y.doc_idx = m.e) OR x.doc_idx < m.e)""")
def between_markers(e):
    markers = e.select("doc_id").distinct().select("doc_id", F.lit(3).alias("start"), F.when(F.col("doc_id") % 2 == 0, F.lit(9)).alias("end"))
    return search.between(e, markers).select(*KEY)


@query("SELECT doc_id, doc_idx FROM elements WHERE doc_idx >= 5")
def elements_after(e):
    return search.after(e, 5).select(*KEY)


@query("SELECT doc_id, doc_idx FROM elements WHERE doc_idx >= 2 AND doc_idx < 6")
def content_slice(e):
    return search.slice_(e, 2, 6).select(*KEY)


@query("SELECT doc_id, CAST(max(doc_idx) + 1 AS INTEGER) AS doc_len FROM elements GROUP BY doc_id")
def doc_length(e):
    return search.lengths(e)


@query("SELECT doc_id, doc_idx, text FROM elements WHERE doc_id = 7 AND doc_idx = 1")
def point_lookup(e):
    return search.at(e, 7, 1).select(*KEY, "text")


def ascii_only(e: DataFrame) -> DataFrame:
    return e.where(F.char_length("text") == F.octet_length("text"))


SIM = "1 - levenshtein(text, '{0}') / greatest(length(text), {1})"


@query(f"SELECT doc_id, doc_idx, round({SIM.format(PATTERN, len(PATTERN))}, 6) AS score FROM elements WHERE length(text) = strlen(text) AND doc_idx >= 1 AND doc_idx < 60 AND length(text) > 0 AND {SIM.format(PATTERN, len(PATTERN))} >= 0.35")
def fuzzy_text(e):
    return search.fuzzy(ascii_only(e), PATTERN, 0.35, 1, 60).select(*KEY, F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, doc_idx, round(1 - levenshtein(lower(text), '{PATTERN.lower()}') / greatest(length(text), {len(PATTERN)}), 6) AS score FROM elements WHERE length(text) = strlen(text) AND length(text) > 0 AND 1 - levenshtein(lower(text), '{PATTERN.lower()}') / greatest(length(text), {len(PATTERN)}) >= 0.35")
def fuzzy_lower(e):
    return search.fuzzy(ascii_only(e), PATTERN, 0.35, lower=True).select(*KEY, F.round("score", 6).alias("score"))


@query("SELECT doc_id, doc_idx FROM elements WHERE font_canon = 'Helvetica-Bold' AND abs(font_size - 16) < 0.1")
def by_font_size(e):
    return search.by_font(e, "Arial-Bold", 16).select(*KEY)


@query(", m AS (SELECT doc_id, avg(font_size) AS mean FROM elements GROUP BY doc_id) SELECT doc_id, doc_idx FROM elements JOIN m USING (doc_id) WHERE font_canon = 'Helvetica' AND font_size >= 0.9 * mean AND font_size <= 1.1 * mean")
def by_font_avg_band(e):
    return search.by_font(e, "Arial").select(*KEY)


@query(", m AS (SELECT doc_id, avg(font_size) AS mean, stddev_pop(font_size) AS sd FROM elements GROUP BY doc_id) SELECT doc_id, doc_idx FROM elements JOIN m USING (doc_id) WHERE font_size >= mean + 1.5 * sd")
def section_boundaries(e):
    return search.boundaries(e).select(*KEY)


@query("SELECT a.doc_id, a.page_number, a.doc_idx AS left_idx, b.doc_idx AS right_idx FROM elements a JOIN elements b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND a.doc_idx < b.doc_idx AND abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) < 10")
def aligned_pairs(e):
    return search.aligned(e, 10.0)


@query("SELECT doc_id, doc_idx FROM (SELECT doc_id, doc_idx, row_number() OVER (PARTITION BY doc_id ORDER BY doc_idx) AS k FROM elements WHERE page_number = 1 AND x0 <= 120 AND x1 >= 120 AND y0 <= 62 AND y1 >= 62) WHERE k = 1")
def hit_test(e):
    return search.hit(e, 1, 120, 62).select(*KEY)


@query("SELECT doc_id, doc_idx FROM (SELECT doc_id, doc_idx, row_number() OVER (PARTITION BY doc_id ORDER BY doc_idx) AS k FROM elements WHERE font_canon = 'Helvetica-Bold' AND abs(font_size - 16) < 0.1) WHERE k > 1 AND k <= 4")
def heading_elements(e):
    return search.of_heading_level(e, "Helvetica-Bold", 16, 1, 3).select(*KEY)


@query(f"SELECT doc_id, {CANON}, count(*) AS uses, list(doc_idx ORDER BY doc_idx) AS idxs FROM elements GROUP BY ALL")
def font_usage(e):
    return stats.font_usage(e)


@query(f"SELECT doc_id, {CANON}, count(*) AS uses FROM elements WHERE text_row >= 2 AND text_row < 12 GROUP BY ALL")
def font_scope(e):
    return stats.font_usage(e, 2, 12).drop("idxs")


@query(", c AS (SELECT doc_id, font_canon, count(*) AS uses FROM elements GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY uses DESC, font_canon) AS INTEGER) AS place FROM c")
def font_name_freq(e):
    return stats.font_frequency(e)


PCT = ", ".join(f"s[CAST(least(floor({p / 100} * len(s)), len(s) - 1) AS INTEGER) + 1] AS p{p}" for p in (25, 50, 75, 90, 95))


@query(f", g AS (SELECT doc_id, avg(font_size) AS mean, stddev_pop(font_size) AS sd, list(font_size ORDER BY font_size) AS s FROM elements GROUP BY doc_id) SELECT doc_id, round(mean, 6) AS mean, round(sd, 6) AS sd, {PCT} FROM g")
def size_stats(e):
    return stats.size_stats(e).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


Z = f"g AS (SELECT doc_id, avg(font_size) AS mean, stddev_pop(font_size) AS sd FROM elements GROUP BY doc_id), u AS (SELECT doc_id, {CANON}, count(*) AS uses FROM elements GROUP BY ALL), z AS (SELECT u.*, CASE WHEN sd > 0 THEN (font_size - mean) / sd ELSE 0 END AS z FROM u JOIN g USING (doc_id))"


@query(f", {Z} SELECT doc_id, {CANON}, uses, round(z, 6) AS z FROM z WHERE z >= 0.5")
def z_fonts(e):
    return stats.z_fonts(e, 0.5).select("doc_id", "font_canon", "font_size", "uses", F.round("z", 6).alias("z"))


@query(f"SELECT doc_id, {CANON}, count(*) AS uses FROM elements GROUP BY ALL HAVING count(*) BETWEEN 3 AND 10")
def usage_range(e):
    return stats.usage_range(e, 3, 10).drop("idxs")


@query("SELECT doc_id, count(*) AS texts FROM elements WHERE doc_idx >= 1 AND doc_idx < 20 GROUP BY doc_id")
def text_count(e):
    return stats.text_count(e, 1, 20)


@query("SELECT doc_id, avg(font_size) AS mean FROM elements GROUP BY doc_id")
def average_size(e):
    return stats.average_size(e)


@query(f", {Z}, n AS (SELECT doc_id, count(*) AS texts FROM elements GROUP BY doc_id), h AS (SELECT doc_id, {CANON}, uses, row_number() OVER (PARTITION BY doc_id ORDER BY font_size DESC, uses DESC, font_canon) AS level FROM z JOIN n USING (doc_id) WHERE z >= 0.1 AND z > 0 AND uses >= 2 AND uses <= greatest(2, floor(texts / 2))) SELECT doc_id, CAST(level AS INTEGER) AS level, {CANON}, uses FROM h WHERE level <= 2")
def heading_levels(e):
    return stats.heading_levels(e, 2)


STYLED = """g AS (SELECT doc_id, avg(font_size) AS mean, greatest(stddev_pop(font_size), 1e-6) AS sd FROM elements GROUP BY doc_id),
b AS (SELECT e.doc_id, doc_idx, font_canon, CAST(least(round(2 * font_size), 400) AS BIGINT) AS size_bin, CAST(greatest(least(round(2 * (font_size - mean) / sd), 8), -8) AS BIGINT) AS z_bin, CAST(greatest(least(floor((x0 + x1) / 2 / 612.0 * 10), 9), 0) AS BIGINT) AS x_bin,
  NOT regexp_matches(text, '\\p{Ll}') AS caps, len(list_filter(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: strlen(w) > 3), lambda w: NOT regexp_matches(w, '^\\p{Lu}'))) = 0 AS title FROM elements e JOIN g USING (doc_id)),
k AS (SELECT *, CASE WHEN z_bin < 0 THEN -4294967296 * (-z_bin) + size_bin * 65536 + 0 ELSE (size_bin << 16) | (z_bin << 32) | (x_bin << 40) | (CAST(caps AS BIGINT) << 48) | (CAST(title AS BIGINT) << 49) END AS style_key FROM b)"""
# Below the mean the bins above the deviation's sign vanish in its ones, as -2^32 has them all.


@query(f", {STYLED} SELECT doc_id, doc_idx, size_bin, z_bin, x_bin, caps, title, CASE WHEN z_bin >= 0 THEN style_key END AS style_key FROM k")
def style_key(e):
    return style.styled(e).select(*KEY, "size_bin", "z_bin", "x_bin", "caps", "title", F.when(F.col("z_bin") >= 0, F.col("style_key")).alias("style_key"))


@query(f", {STYLED} SELECT doc_id, font_canon, size_bin, z_bin, CASE WHEN z_bin >= 0 THEN style_key END AS upper_key, count(*) AS texts FROM k GROUP BY ALL")
def style_buckets(e):
    s = style.styled(e).withColumn("upper_key", F.when(F.col("z_bin") >= 0, F.col("style_key")))
    return s.groupBy("doc_id", "font_canon", "style_key").agg(F.first("size_bin").alias("size_bin"), F.first("z_bin").alias("z_bin"), F.first("upper_key").alias("upper_key"), F.count(F.lit(1)).alias("texts")).drop("style_key")


@query(f""", {STYLED}, s AS (SELECT * FROM b WHERE doc_idx = 0 AND z_bin >= 0), f AS (SELECT s.doc_id, s.doc_idx AS seed_idx, b.doc_idx, row_number() OVER (PARTITION BY s.doc_id ORDER BY b.doc_idx) AS place FROM s JOIN b ON s.doc_id = b.doc_id AND s.font_canon = b.font_canon AND s.size_bin = b.size_bin AND b.doc_idx > s.doc_idx AND abs(s.z_bin - b.z_bin) <= 1 AND (b.z_bin < 0 OR (abs(s.x_bin - b.x_bin) <= 1 AND s.caps = b.caps AND s.title = b.title)))
SELECT doc_id, seed_idx, doc_idx, CAST(place AS INTEGER) AS place, CAST(1 AS DOUBLE) AS score FROM f WHERE place <= 5""".replace("doc_idx = 0 AND", "doc_idx = 1 AND"))
def similar_topk(e):
    return style.similar(e, e.where("doc_idx = 1").select("doc_id", F.lit(1).alias("seed_idx"), F.lit(None).cast("int").alias("end_idx")), 5)


@query(f""", {STYLED}, s AS (SELECT * FROM k WHERE doc_idx = 1), f AS (SELECT s.doc_id, s.doc_idx AS seed_idx, k.doc_idx, row_number() OVER (PARTITION BY s.doc_id ORDER BY k.doc_idx) AS place FROM s JOIN k ON s.doc_id = k.doc_id AND s.font_canon = k.font_canon AND (s.style_key = k.style_key OR (s.z_bin < 0 AND s.z_bin = k.z_bin AND s.size_bin = k.size_bin)))
SELECT doc_id, seed_idx, doc_idx FROM f WHERE place <= 6 AND doc_idx <> seed_idx""")
def same_style(e):
    return style.same_style(e, e.where("doc_idx = 1").select("doc_id", F.lit(1).alias("seed_idx")), 6)


DEST = "SELECT doc_id, 'd' || doc_idx AS name, page_number - 1 AS page, CASE WHEN doc_idx % 3 = 0 THEN x0 + 5 END AS x, y0 + 2 AS y FROM elements WHERE doc_idx % 2 = 0"


@query(f""", d AS (SELECT doc_id, page + 1 AS page_number, coalesce(x - 10, 0) AS dx0, coalesce(x + 10, 2000) AS dx1, y - 10 AS dy0, y + 10 AS dy1 FROM ({DEST}))
SELECT e.doc_id, e.doc_idx, count(d.doc_id) AS refs FROM elements e LEFT JOIN d ON e.doc_id = d.doc_id AND e.page_number = d.page_number AND x0 >= dx0 AND x1 <= dx1 AND y0 >= dy0 AND y1 <= dy1 GROUP BY ALL""")
def ref_counts(e):
    return stats.reference_counts(e, destinations(e))


FONTS = ["TimesNewRomanPS-BoldMT", "TimesNewRomanPS-ItalicMT", "TimesNewRomanPSMT", "TimesNewRomanPS-BoldItalicMT", "Arial", "Arial-Bold", "Arial-BoldItalic", "Arial-Italic", "ArialMT", "Arial-BoldMT", "CourierNew", "CourierNew-Bold", "DejaVuSans-Bold"]
NAMES = ["Times-Bold", "Times-Italic", "Times-Roman", "Times-BoldItalic", "Helvetica", "Helvetica-Bold", "Helvetica-BoldItalic", "Helvetica-Oblique", "MT", "BoldMT", "Courier", "Courier-Bold", "DejaVuSans-Bold"]


@query(f"WITH f AS (SELECT doc_id, {FONTS!r}[CAST(doc_id % 13 AS INTEGER) + 1] AS font, {NAMES!r}[CAST(doc_id % 13 AS INTEGER) + 1] AS canon FROM documents) SELECT * FROM f", raw=True)
def canonical_fonts(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    font = F.element_at(F.array(*map(F.lit, FONTS)), (F.col("doc_id") % 13 + 1).cast("int"))
    return d.select("doc_id", font.alias("font"), canonical_font(font).alias("canon"))


@query("SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY doc_idx DESC) - 1 AS INTEGER) AS line, text, font_canon, font_size, true AS one_font, [doc_idx] AS idxs, x0, y0, x1, y1 FROM elements")
def lines(e):
    return layout.lines(e)


FOLD = """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0 DESC, x0, doc_idx) AS i FROM elements),
f AS (WITH RECURSIVE t AS (
  SELECT doc_id, page_number, i, doc_idx, y0 AS anchor, font_canon, font_size, 0 AS line FROM r WHERE i = 1
  UNION ALL
  SELECT r.doc_id, r.page_number, r.i, r.doc_idx, CASE WHEN n THEN r.y0 ELSE anchor END, CASE WHEN n THEN r.font_canon ELSE t.font_canon END, CASE WHEN n THEN r.font_size ELSE t.font_size END, line + CAST(n AS INTEGER)
  FROM t JOIN r ON r.doc_id = t.doc_id AND r.page_number = t.page_number AND r.i = t.i + 1, LATERAL (SELECT abs(anchor - r.y0) >= 40 OR t.font_canon <> r.font_canon OR abs(t.font_size - r.font_size) > 0.1 AS n))
SELECT * FROM t)"""


@query(f"{FOLD} SELECT doc_id, page_number, CAST(i - 1 AS INTEGER) AS place, line, doc_idx FROM f")
def line_fold(e):
    return layout.line_members(e, 40.0).select("doc_id", "page_number", "place", "line", "doc_idx")


@query(f"""{FOLD}, l AS (SELECT f.doc_id, f.page_number, f.line, string_agg(r.text, '' ORDER BY f.i) AS text, min(r.y0) AS y0, max(r.y1) AS y1, min(r.x0) AS x0, max(r.x1) AS x1 FROM f JOIN r ON r.doc_id = f.doc_id AND r.page_number = f.page_number AND r.i = f.i GROUP BY ALL),
o AS (SELECT *, coalesce(CAST(abs(lag(y0) OVER (PARTITION BY doc_id, page_number ORDER BY line) - y0) > 30 AS INTEGER), 0) AS opens FROM l), b AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY doc_id, page_number ORDER BY line) AS INTEGER) AS block FROM o)
SELECT doc_id, page_number, block, list(text ORDER BY line) AS lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b GROUP BY doc_id, page_number, block""")
def blocks(e):
    return layout.blocks(e, 40.0, 30.0)


def chunk_sql(limit: int | str, overlap: int | str, size: str = "strlen(text)", tokens: bool = False, source: str = "elements", own: tuple[str, ...] = ()) -> str:
    """Chains of starts over the prefix sums, as a recursive query. P has the sum before each place and after the last.

    own: columns of the source that are the same in all of a group, for limits that differ between groups."""
    plain, of_p, most = "".join(f", {c}" for c in own), "".join(f", p.{c}" for c in own), "".join(f", max({c})" for c in own)
    end = f"coalesce(max(q.i) FILTER (q.s - p.s <= {limit}), p.i)"
    if tokens:
        end = f"greatest(p.i + 1, least({end}, coalesce(min(q.i) FILTER (q.s - p.s = {limit} AND q.i > p.i), {end})))"
    else:
        end = f"greatest({end}, coalesce(min(q.i) FILTER (q.s > p.s), max(q.n)))"
    return f""", t AS (SELECT doc_id, doc_idx{plain}, row_number() OVER (PARTITION BY doc_id ORDER BY doc_idx) - 1 AS i, {size} AS len FROM {source}),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
p AS (SELECT t.doc_id, i, n{plain}, coalesce(sum(len) OVER (PARTITION BY t.doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM t JOIN n USING (doc_id) UNION ALL SELECT t.doc_id, max(n), max(n){most}, sum(len) FROM t JOIN n USING (doc_id) GROUP BY t.doc_id),
e AS (SELECT p.doc_id, p.i, p.n, {end} AS e FROM p JOIN p q ON p.doc_id = q.doc_id AND q.i >= p.i WHERE p.i < p.n GROUP BY p.doc_id, p.i, p.n, p.s{of_p}),
x AS (SELECT e.doc_id, e.i, e.n, e.e, coalesce(max(q.i) FILTER (z.s - q.s >= {overlap} AND q.i > e.i), e.e) AS nxt FROM e JOIN p z ON z.doc_id = e.doc_id AND z.i = e.e JOIN p q ON q.doc_id = e.doc_id AND q.i >= e.i AND q.i <= e.e GROUP BY e.doc_id, e.i, e.n, e.e),
c AS (WITH RECURSIVE w AS (SELECT doc_id, i, n, e, nxt, 0 AS chunk FROM x WHERE i = 0 UNION ALL SELECT x.doc_id, x.i, x.n, x.e, x.nxt, chunk + 1 FROM w JOIN x ON x.doc_id = w.doc_id AND x.i = w.nxt WHERE w.e < w.n) SELECT doc_id, chunk, a.doc_idx AS first_idx, b.doc_idx AS last_idx FROM w JOIN t a USING (doc_id, i) JOIN t b ON b.doc_id = w.doc_id AND b.i = w.e - 1)"""


CHUNKED = """, m AS (SELECT c.*, x.doc_idx, x.text, x.page_number FROM c JOIN elements x ON x.doc_id = c.doc_id AND x.doc_idx BETWEEN first_idx AND last_idx),
pg AS (SELECT doc_id, chunk, page_number, sum(strlen(text)) AS bytes, min(doc_idx) AS f FROM m GROUP BY ALL),
ag AS (SELECT doc_id, chunk, arg_max(page_number, bytes * 1000000 + f) AS primary_page, list(page_number ORDER BY page_number) AS page_numbers FROM pg GROUP BY ALL)
SELECT doc_id, chunk, string_agg(text, ' ' ORDER BY doc_idx) AS text, CAST(count(*) AS INTEGER) AS chunk_element_count, any_value(first_idx) AS first_idx, any_value(last_idx) AS last_idx, any_value(primary_page) AS primary_page, any_value(page_numbers) AS page_numbers, CAST(strlen(string_agg(text, ' ' ORDER BY doc_idx)) AS INTEGER) AS chunk_char_count
FROM m JOIN ag USING (doc_id, chunk) GROUP BY doc_id, chunk"""


@query(chunk_sql(500, 0) + " SELECT * FROM c")
def chunk_chars(e):
    return chunk.ranges(e, 500, 0)


@query(chunk_sql(500, 150) + CHUNKED)
def chunk_overlap(e):
    return chunk.chunks(e, 500, 150)


@query(chunk_sql(80, 20, "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))", True) + " SELECT * FROM c")
def chunk_tokens(e):
    return chunk.ranges(e, 80, 20, tokens=chunk.words)


@query(chunk_sql(1500, 300) + """, pg AS (SELECT c.doc_id, chunk, page_number, sum(strlen(text)) AS bytes, min(doc_idx) AS f FROM c JOIN elements x ON x.doc_id = c.doc_id AND x.doc_idx BETWEEN first_idx AND last_idx GROUP BY ALL)
SELECT doc_id, chunk, arg_max(page_number, bytes * 1000000 + f) AS primary_page, list(page_number ORDER BY page_number) AS page_numbers FROM pg GROUP BY ALL""")
def chunk_pages(e):
    return stats.chunk_pages(chunk.members(e, chunk.ranges(e, 1500, 300)), ["doc_id", "chunk"])


MATCHED = " SELECT doc_id, seq, node, depth, type, start_idx, stop_idx, end_idx, parent_seq, output_parent FROM matches"
END, INNER = "The the of and.", "That the is and the."
CHAPTER, CHAPTER_END = "The the of and.", "Of the and."
NESTED_SQL = f", {STYLED}" + alignsql.nested(CHAPTER, CHAPTER_END, INNER)


@query(f", {STYLED}" + alignsql.one_section(PATTERN, END) + MATCHED)
def section_simple(e):
    return align.align(e, f'Section(match="{PATTERN}", end_match="The the of and.", as="intro")')


@query(f", {STYLED}" + alignsql.one_section(PATTERN) + MATCHED)
def section_end_fallback(e):
    return align.align(e, SECTION)


@query(NESTED_SQL + MATCHED)
def section_nested(e):
    return align.align(e, NESTED.replace("match=", "match="))


@query(f", {STYLED}" + alignsql.between_chunks(PATTERN) + MATCHED)
def chunk_around_sections(e):
    return align.align(e, f'TextChunk() {SECTION} {{ TextChunk() }} TextChunk()')


DESTINED = f""", d AS (SELECT doc_id, page + 1 AS page_number, coalesce(x - 10, 0) AS dx0, coalesce(x + 10, 2000) AS dx1, y - 10 AS dy0, y + 10 AS dy1 FROM ({DEST})),
refs AS (SELECT e.doc_id, e.doc_idx, count(d.doc_id) AS refs FROM elements e LEFT JOIN d ON e.doc_id = d.doc_id AND e.page_number = d.page_number AND x0 >= dx0 AND x1 <= dx1 AND y0 >= dy0 AND y1 <= dy1 GROUP BY ALL)"""


def destinations(e: DataFrame) -> DataFrame:
    return e.where("doc_idx % 2 = 0").select("doc_id", F.concat(F.lit("d"), "doc_idx").alias("name"), (F.col("page_number") - 1).alias("page"), F.when(F.col("doc_idx") % 3 == 0, F.col("x0") + 5).alias("x"), (F.col("y0") + 2).alias("y"))


@query(f"{DESTINED}, {STYLED}" + alignsql.one_section(CHAPTER, CHAPTER_END, "refs", 0.33) + MATCHED)
def section_references(e):
    return align.align(e, f'Section(match=["{CHAPTER}", 330], end_match=["{CHAPTER_END}", 330])', stats.reference_counts(e, destinations(e)))


@query(f"{DESTINED} SELECT doc_id, doc_idx FROM refs WHERE refs >= 1")
def by_references(e):
    return search.by_references(e, stats.reference_counts(e, destinations(e)), 1).select(*KEY)


ABOUT = {0: (400, 100, None, None), 1: (500, 150, "body", "Section"), 2: (300, 0, "body", "Section"), 3: (500, 150, INNER, "Section"), 4: (500, 150, INNER, "Section")}


def about(k: int) -> str:
    return "CASE node " + " ".join(f"WHEN {n} THEN " + (repr(v[k]) if v[k] is not None else "NULL") for n, v in ABOUT.items()) + " END"


def tree_sql(matched: str) -> str:
    """The output rows of matches of the nested template."""
    src = f", src AS (SELECT e.doc_id * 8 + seq AS doc_id, doc_idx, text, page_number, {about(0)} AS lim, {about(1)} AS ovl FROM elements e JOIN matches m ON m.doc_id = e.doc_id AND doc_idx >= start_idx AND doc_idx < stop_idx)"
    made = chunk_sql("p.lim", "z.ovl", source="src", own=("lim", "ovl")) + CHUNKED.replace("elements", "src").replace("SELECT doc_id, chunk, string_agg", ", o AS (SELECT doc_id, chunk, string_agg", 1)
    return matched + src + made + f"""), y AS (SELECT x.doc_id, x.seq, x.node, x.output_parent, o.* EXCLUDE doc_id, CAST(row_number() OVER (PARTITION BY x.doc_id ORDER BY x.seq, chunk) - 1 AS INTEGER) AS out_idx FROM o JOIN matches x ON o.doc_id = x.doc_id * 8 + x.seq)
SELECT y.doc_id, y.out_idx, 'Text' AS type, y.text, y.out_idx AS chunk_index, CASE WHEN q.out_idx IS NOT NULL THEN 'Section' END AS parent_name, q.out_idx AS parent_index, {about(2).replace("node", "y.node")} AS section, {about(3).replace("node", "y.node")} AS section_name, y.primary_page, y.page_numbers, y.chunk_element_count, y.chunk_char_count
FROM y LEFT JOIN y q ON q.doc_id = y.doc_id AND q.seq = y.output_parent AND q.chunk = 0"""


#: The nested template with thresholds that many documents meet.
LOW = (0.33, 0.33, 0.3)
DEEP = NESTED.replace(f'"{CHAPTER}"', f'["{CHAPTER}", 330]').replace(f'"{CHAPTER_END}"', f'["{CHAPTER_END}", 330]').replace(f'"{INNER}"', f'["{INNER}", 300]')
DEEP_SQL = f", {STYLED}" + alignsql.nested(CHAPTER, CHAPTER_END, INNER, LOW)


@query(DEEP_SQL + MATCHED)
def section_deep(e):
    return align.align(e, DEEP)


@query(tree_sql(DEEP_SQL))
def output_deep(e):
    return output.outputs(e, DEEP)


@query(tree_sql(NESTED_SQL))
def output_tree(e):
    return output.outputs(e, NESTED)


ONE_LEVEL = CHUNKED.replace("SELECT doc_id, chunk, string_agg", ", o AS (SELECT doc_id, chunk, string_agg", 1)


@query(chunk_sql(500, 150) + ONE_LEVEL + ") SELECT doc_id, chunk AS out_idx, 'Text' AS type, text, chunk AS chunk_index, CAST(NULL AS VARCHAR) AS parent_name, CAST(NULL AS INTEGER) AS parent_index, CAST(NULL AS VARCHAR) AS section, CAST(NULL AS VARCHAR) AS section_name, primary_page, page_numbers, chunk_element_count, chunk_char_count FROM o")
def output_chunks(e):
    return output.outputs(e, ALL)


@query(chunk_sql(500, 150) + ONE_LEVEL + """), j AS (SELECT doc_id, chunk, '{"type":"Text","text":' || to_json(text) || ',"chunk_index":' || chunk || ',"metadata":{"primary_page":' || primary_page || ',"page_numbers":[' || array_to_string(page_numbers, ',') || '],"chunk_element_count":' || chunk_element_count || ',"chunk_char_count":' || chunk_char_count || '}}' AS json FROM o)
SELECT doc_id, '[' || string_agg(json, ',' ORDER BY chunk) || ']' AS json FROM j GROUP BY doc_id""")
def output_json(e):
    return output.document_json(output.outputs(e, ALL))


TAG = "|".join(text.TAGS)


@query(f"""WITH x AS (SELECT page_id, regexp_extract_all(html, '(?s)<(?:{TAG})[ >].*?</(?:{TAG})>') AS found FROM pages),
f AS (SELECT page_id AS doc_id, unnest(found) AS raw, CAST(unnest(range(len(found))) AS INTEGER) AS doc_idx FROM x),
g AS (SELECT doc_id, doc_idx, regexp_extract(raw, '^<(\\w+)', 1) AS tag, trim(regexp_replace(raw, '(?s)<[^>]*>', '', 'g')) AS text FROM f),
h AS (SELECT *, CASE tag {" ".join(f"WHEN '{k}' THEN '{f}'" for k, (f, _) in text.TAGS.items())} END AS font_name, CAST(CASE tag {" ".join(f"WHEN '{k}' THEN {z}" for k, (_, z) in text.TAGS.items())} END AS DOUBLE) AS font_size FROM g)
SELECT doc_id, doc_idx, CAST(doc_idx // 40 + 1 AS INTEGER) AS page_number, 'text' AS kind, text, font_name, CASE font_name WHEN 'Arial' THEN 'Helvetica' WHEN 'TimesNewRomanPSMT' THEN 'Times-Roman' ELSE font_name END AS font_canon, font_size, CAST(50 AS DOUBLE) AS x0, CAST(40 + 18 * (doc_idx % 40) AS DOUBLE) AS y0, CAST(50 + 8 * strlen(text) AS DOUBLE) AS x1, 40 + 18 * (doc_idx % 40) + font_size AS y1 FROM h""", raw=True)
def page_elements(spark, sf_dir):
    return text.from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(*[c for c in SHOWN.split(", ")])


def as_pdf(e: DataFrame) -> DataFrame:
    """doc_id and content: a file of one page for each document, a line for each of its lines that has letters, as ``PRINTED`` says."""
    printed = e.where(F.col("text").rlike("[A-Za-z0-9,.]")).withColumn("text", F.trim(F.regexp_replace("text", "[^A-Za-z0-9 ,.]+", "")))  # what is left is not empty
    row = F.concat(F.lit("BT /F1 "), F.col("font_size").cast("int").cast("string"), F.lit(" Tf 50 -"), (20 * F.col("doc_idx")).cast("string"), F.lit(" Td ("), "text", F.lit(") Tj ET\n"))
    body = printed.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_idx", row.alias("row")))), lambda x: x.row), "").alias("body"), (20 * F.max("doc_idx") + 100).alias("deep"))
    parts = [
        F.lit("<< /Type /Catalog /Pages 2 0 R >>"), F.lit("<< /Type /Pages /Kids [3 0 R] /Count 1 >>"),
        F.concat(F.lit("<< /Type /Page /Parent 2 0 R /MediaBox [0 -"), F.col("deep").cast("string"), F.lit(" 612 100] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>")),
        F.concat(F.lit("<< /Length "), F.octet_length("body").cast("string"), F.lit(" >>\nstream\n"), "body", F.lit("\nendstream")), F.lit("<< /Type /Font /Subtype /Type1 /BaseFont /TimesNewRomanPS-BoldMT >>"),
    ]
    objects = [x for k, p in enumerate(parts) for x in (F.lit(f"{k + 1} 0 obj\n"), p, F.lit("\nendobj\n"))]
    return body.select("doc_id", F.concat(F.lit("%PDF-1.4\n"), *objects, F.lit("trailer << /Root 1 0 R >>\n%%EOF")).cast("binary").alias("content"))


PRINTED = "SELECT doc_id, doc_idx AS line, trim(regexp_replace(text, '[^A-Za-z0-9 ,.]', '', 'g')) AS text, font_size FROM elements"


@query(f", p AS ({PRINTED}) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INTEGER) AS doc_idx, CAST(1 AS INTEGER) AS page_number, text, 'TimesNewRomanPS-BoldMT' AS font_name, 'Times-Bold' AS font_canon, font_size, CAST(50 AS DOUBLE) AS x0 FROM p WHERE text <> ''")
def pdf_elements(e):
    """Every document as a PDF file, read back."""
    return pdf.read(as_pdf(e)).select("doc_id", "doc_idx", "page_number", "text", "font_name", "font_canon", "font_size", "x0")


@query(f", p AS ({PRINTED}), q AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INTEGER) AS doc_idx, text FROM p WHERE text <> '') SELECT doc_id, doc_idx, text FROM q WHERE 1 - levenshtein(text, 'Of the and.') / greatest(length(text), 11) >= 0.4")
def pdf_search(e):
    return search.fuzzy(pdf.read(as_pdf(e)), "Of the and.", 0.4).select("doc_id", "doc_idx", "text")


@query(f"SELECT doc_id, doc_idx, round(1 - levenshtein(lower(text), '{PATTERN.lower()}') / greatest(length(text), {len(PATTERN)}), 6) AS score FROM elements WHERE length(text) = strlen(text) AND length(text) > 0 AND page_number = 1 AND 1 - levenshtein(lower(text), '{PATTERN.lower()}') / greatest(length(text), {len(PATTERN)}) >= 0.35")
def fuzzy_lines(e):
    return search.fuzzy_lines(layout.lines(search.on_page(ascii_only(e), 1)), PATTERN, 0.35).select("doc_id", F.col("idxs")[0].alias("doc_idx"), F.round("score", 6).alias("score"))


@query("SELECT doc_id, CAST(3 AS INTEGER) AS line, text, font_canon, font_size, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY doc_idx DESC) - 1 AS k FROM elements WHERE page_number = 2) WHERE k = 3")
def line_by_id(e):
    return layout.lines(search.on_page(e, 2)).where("line = 3").select("doc_id", "line", "text", "font_canon", "font_size", "x0", "y0", "x1", "y1")


@query(", g AS (SELECT doc_id, avg(font_size) AS mean, stddev_pop(font_size) AS sd FROM elements WHERE text_row >= 3 AND text_row < 30 GROUP BY doc_id) SELECT DISTINCT doc_id, round(coalesce(mean, 12), 6) AS mean, round(coalesce(sd, 0), 6) AS sd FROM elements LEFT JOIN g USING (doc_id)")
def size_scope(e):
    return stats.size_stats(e, 3, 30).select("doc_id", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(f"SELECT doc_id, doc_idx, x0 - 2.5 AS ex0, y0 - 2.5 AS ey0, least(x0, 100) AS ux0, greatest(x1, 200) AS ux1, 2 * x0 + 10 AS tx, 2 * y0 + 20 AS ty, CAST(255 * least(1.0, 2 * least(x0 / 100, 1.0)) AS INTEGER) AS green FROM elements".replace("CAST(255 * least(1.0, 2 * least(x0 / 100, 1.0)) AS INTEGER)", "CAST(floor(255 * least(1.0, 2 * least(x0 / 100, 1.0))) AS INTEGER)"))
def geometry(e):
    r = rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    grown, union, moved = rect_expand(r, 2.5), rect_union(r, rect(F.lit(100.0), F.lit(0.0), F.lit(200.0), F.lit(10.0))), transform_point([2, 0, 0, 2, 10, 20], F.col("x0"), F.col("y0"))
    return e.select(*KEY, grown.x0.alias("ex0"), grown.y0.alias("ey0"), union.x0.alias("ux0"), union.x1.alias("ux1"), moved.x.alias("tx"), moved.y.alias("ty"), score_colour(F.col("x0") / 100).g.alias("green"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is the parent of its first turn, and each turn of the next."""
    t = turns(spark, sf_dir)
    name = F.concat_ws(":", "conv_id", "turn")
    return t.select(F.when(F.col("turn") == 0, F.col("conv_id").cast("string")).otherwise(F.concat_ws(":", "conv_id", F.col("turn") - 1)).alias("parent"), name.alias("child"), F.col("turn").alias("seq"))


@query("""WITH RECURSIVE r AS (SELECT DISTINCT CASE WHEN turn = 0 THEN conv_id || '' ELSE conv_id || ':' || (turn - 1) END AS parent, conv_id || ':' || turn AS child FROM conversations),
b AS (SELECT DISTINCT conv_id || '' AS root, conv_id || '' AS entity, 0 AS level, conv_id || '' AS path FROM conversations WHERE conv_id % 5 = 0 UNION ALL SELECT root, child, level + 1, path || '/' || child FROM b JOIN r ON r.parent = b.entity WHERE level < 32) SELECT * FROM b""", raw=True)
def lineage_tree(spark, sf_dir):
    roots = turns(spark, sf_dir).where("conv_id % 5 = 0").select(F.col("conv_id").cast("string").alias("root")).distinct()
    return lineage.tree(pairs(spark, sf_dir), roots)


@query("""WITH RECURSIVE r AS (SELECT DISTINCT CASE WHEN turn = 0 THEN conv_id || '' ELSE conv_id || ':' || (turn - 1) END AS parent, conv_id || ':' || turn AS child FROM conversations),
b AS (SELECT DISTINCT conv_id || '' AS root, conv_id || '' AS entity, 0 AS level, conv_id || '' AS path FROM conversations UNION ALL SELECT root, child, level + 1, path || '/' || child FROM b JOIN r ON r.parent = b.entity) SELECT * FROM b""", raw=True)
def lineage_forest(spark, sf_dir):
    """Every conversation's tree, whatever its depth."""
    return lineage.tree(pairs(spark, sf_dir), turns(spark, sf_dir).select(F.col("conv_id").cast("string").alias("root")).distinct())


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event for each turn, and one for its conversation."""
    t = turns(spark, sf_dir)
    of_turn = t.select(F.concat_ws(":", "conv_id", "turn").alias("entity"), F.col("turn").alias("seq"), F.concat(F.lit("structure="), "role", F.lit(" bytes="), F.octet_length("text")).alias("message"))
    return of_turn.unionByName(t.where("turn = 0").select(F.col("conv_id").cast("string").alias("entity"), F.lit(-1).cast("long").alias("seq"), F.lit("opened").alias("message")))


TOLD = "WITH m AS (SELECT conv_id || ':' || turn AS entity, turn AS seq, 'structure=' || role || ' bytes=' || strlen(text) AS message FROM conversations UNION ALL SELECT conv_id || '', -1, 'opened' FROM conversations WHERE turn = 0)"


@query(TOLD + ", r AS (SELECT DISTINCT CASE WHEN turn = 0 THEN conv_id || '' ELSE conv_id || ':' || (turn - 1) END AS parent, conv_id || ':' || turn AS child FROM conversations) SELECT entity AS root, entity, seq, message FROM m UNION ALL SELECT parent, entity, m.seq, message FROM r JOIN m ON m.entity = r.child", raw=True)
def lineage_events(spark, sf_dir):
    return lineage.with_children(messages(spark, sf_dir), pairs(spark, sf_dir))


@query("SELECT '7:' || turn AS child, turn AS seq FROM conversations WHERE conv_id = 7 AND turn = 1", raw=True)
def lineage_children(spark, sf_dir):
    return lineage.children(pairs(spark, sf_dir), "7:0")


@query(TOLD + " SELECT entity, regexp_extract(message, 'structure=(\\w+)', 1) AS structure FROM m WHERE regexp_extract(message, 'structure=(\\w+)', 1) <> ''", raw=True)
def lineage_structures(spark, sf_dir):
    return lineage.structures(messages(spark, sf_dir))


@query(TOLD + " SELECT DISTINCT unnest(regexp_extract_all(message, '(\\w+)=', 1)) AS name FROM m", raw=True)
def lineage_fields(spark, sf_dir):
    return lineage.field_names(messages(spark, sf_dir))


@query("SELECT conv_id || ':' || turn AS child, min(CASE WHEN turn = 0 THEN conv_id || '' ELSE conv_id || ':' || (turn - 1) END) AS parent FROM conversations GROUP BY 1", raw=True)
def lineage_parents(spark, sf_dir):
    return lineage.parents(pairs(spark, sf_dir))


@query("WITH m AS (SELECT role AS template, conv_id AS content, strlen(text) AS score, turn AS seq FROM conversations), l AS (SELECT content, arg_max(template, seq) AS template, arg_max(score, seq) AS score FROM m GROUP BY content) SELECT template, count(*) AS matches, list(content ORDER BY score DESC, content) AS contents FROM l GROUP BY template", raw=True)
def template_match_groups(spark, sf_dir):
    return lineage.match_groups(turns(spark, sf_dir).select(F.col("role").alias("template"), F.col("conv_id").alias("content"), F.octet_length("text").alias("score"), F.col("turn").alias("seq")))


@query(f"SELECT doc_id, doc_idx, round({SIM.format('Of the and.', 11)}, 6) AS s FROM elements WHERE length(text) = strlen(text) AND length(text) > 0")
def line_similarity(e):
    return ascii_only(e).where(F.char_length("text") > 0).select(*KEY, F.round(similarity(F.col("text"), F.lit("Of the and.")), 6).alias("s"))


parse_template(NESTED)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
