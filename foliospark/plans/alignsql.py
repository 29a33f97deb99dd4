"""SQL that aligns the catalogue's templates as the engine does, level by level, for the checks against another engine.

Scores are single floats, as the engine's are. Similarity counts characters: what isn't ASCII is one byte here, which no
pattern has. ``elements`` and the style bins ``b`` are views that the caller's WITH defines.
"""

from __future__ import annotations

BASE = r""", w AS (SELECT doc_id, avg(font_size) AS mean, stddev_pop(font_size) AS sd, CAST(count(*) AS INTEGER) AS n FROM elements GROUP BY doc_id),
u AS (SELECT e.*, n, CASE WHEN sd > 0 THEN (font_size - mean) / sd ELSE 0 END AS z, regexp_replace(text, '[^\x01-\x7F]', chr(1), 'g') AS flat FROM elements e JOIN w USING (doc_id)),
none AS (SELECT doc_id, CAST(0 AS INTEGER) AS lo, n AS hi, n AS until, CAST(NULL AS INTEGER) AS cend FROM w)"""


def hits(name: str, pattern: str, threshold: float = 0.6) -> str:
    """Places of the texts that are similar to a pattern."""
    longest = f"greatest(length(text), {len(pattern)})"
    near = f"abs(length(text) - {len(pattern)}) <= {1 - threshold} * {longest} + 1e-9"
    return f", {name} AS (SELECT doc_id, doc_idx AS i, CAST(1 - levenshtein(flat, '{pattern}') / {longest} AS REAL) AS sim FROM u WHERE {near} AND 1 - levenshtein(flat, '{pattern}') / {longest} >= {threshold})"


def section(name: str, context: str, match: str, end: str | None = None, refs: str | None = None) -> str:
    """name: doc_id, start and stop (null without an end) of a section sought in a context.

    context: doc_id, lo and hi that bound its start, until that bounds texts of its style, and cend, where the context ends."""
    one = lambda test, x: f"CASE WHEN {test} THEN CAST({x} AS REAL) ELSE CAST(0 AS REAL) END"
    score = f"h.sim + {one('c.cend IS NOT NULL AND v.page_number <> p.page_number', 0.2)} + {one('v.z > 1.5', 0.3)} + {one('v.y0 < 100', 0.2)}"
    counted = ""
    if refs:
        score += " + CAST(0.2 AS REAL) * CAST(least(coalesce(r.refs, 0), 5) AS REAL) / CAST(5 AS REAL)"
        counted = f" LEFT JOIN {refs} r ON r.doc_id = h.doc_id AND r.doc_idx = h.i"
    scored = lambda source: f"FROM {source} JOIN u v ON v.doc_id = h.doc_id AND v.doc_idx = h.i LEFT JOIN u p ON p.doc_id = c.doc_id AND p.doc_idx = c.cend{counted}"
    ends = f"SELECT c.doc_id, h.i, {score} + CAST(0.5 AS REAL) AS x, CAST(0 AS REAL) AS y {scored(f'{name}_s c JOIN {end} h ON h.doc_id = c.doc_id AND h.i > c.start')} UNION ALL " if end else ""
    return f"""
, {name}_s AS (SELECT * EXCLUDE k FROM (SELECT c.*, h.i AS start, row_number() OVER (PARTITION BY c.doc_id ORDER BY {score} DESC, h.i) AS k {scored(f'{context} c JOIN {match} h ON h.doc_id = c.doc_id AND h.i >= c.lo AND h.i < c.hi')}) WHERE k = 1),
{name}_a AS (SELECT doc_id, i FROM (SELECT s.doc_id, q.doc_idx AS i, row_number() OVER (PARTITION BY s.doc_id ORDER BY q.doc_idx) AS k FROM {name}_s s JOIN b x ON x.doc_id = s.doc_id AND x.doc_idx = s.start AND x.z_bin >= 0
  JOIN b q ON q.doc_id = s.doc_id AND q.doc_idx > s.start AND q.doc_idx < s.until AND q.font_canon = x.font_canon AND q.size_bin = x.size_bin AND abs(q.z_bin - x.z_bin) <= 1 AND (q.z_bin < 0 OR (abs(q.x_bin - x.x_bin) <= 1 AND q.caps = x.caps AND q.title = x.title))) WHERE k <= 5),
{name}_e AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY max(x) + max(y) DESC, i) AS k FROM ({ends}SELECT doc_id, i, CAST(0 AS REAL), CAST(0.1 AS REAL) FROM {name}_a) t(doc_id, i, x, y) GROUP BY doc_id, i) WHERE k = 1),
{name} AS (SELECT s.doc_id, s.start, CAST(coalesce(e.i, CASE WHEN s.cend > s.start THEN s.cend END, CASE WHEN abs(nx.font_size - st.font_size) < 2 THEN s.start + 1 END) AS INTEGER) AS stop, st.n
  FROM {name}_s s LEFT JOIN {name}_e e ON e.doc_id = s.doc_id JOIN u st ON st.doc_id = s.doc_id AND st.doc_idx = s.start LEFT JOIN u nx ON nx.doc_id = s.doc_id AND nx.doc_idx = s.start + 1)"""


def inside(name: str, outer: str) -> str:
    """The context that a section is for those right below it."""
    return f", {name} AS (SELECT doc_id, start AS lo, CASE WHEN stop > start THEN stop ELSE n END AS hi, coalesce(stop, start) AS until, stop AS cend FROM {outer})"


def rows(parts: list[str]) -> str:
    """The matches in output order. parts: doc_id, place, node, depth, type, a, b, stop, and the places of the parent and of the output's parent."""
    return f"""
, parts(doc_id, place, node, depth, type, a, b, stop, up, over) AS ({' UNION ALL '.join(parts)}),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INTEGER) AS seq FROM parts WHERE type = 'Section' OR b > a),
matches AS (SELECT x.doc_id, x.seq, x.node, x.depth, x.type, CAST(x.a AS INTEGER) AS start_idx, CAST(x.b AS INTEGER) AS stop_idx, CAST(x.stop AS INTEGER) AS end_idx, p.seq AS parent_seq, o.seq AS output_parent
  FROM numbered x LEFT JOIN numbered p ON p.doc_id = x.doc_id AND p.place = x.up LEFT JOIN numbered o ON o.doc_id = x.doc_id AND o.place = x.over)"""


def part(of: str, place: int, node: int, depth: int, kind: str, a: str, b: str, stop: str = "NULL", up: str = "NULL", over: str = "NULL") -> str:
    return f"SELECT {of}.doc_id, {place}, {node}, {depth}, '{kind}', {a}, {b}, CAST({stop} AS INTEGER), CAST({up} AS INTEGER), CAST({over} AS INTEGER) FROM {of}"


def whole_section(of: str, place: int, node: int, depth: int, up: str = "NULL") -> str:
    return part(of, place, node, depth, "Section", f"{of}.start", f"coalesce({of}.stop, {of}.n)", f"{of}.stop", up, up)


def one_section(match: str, end: str | None = None, refs: str | None = None, threshold: float = 0.6) -> str:
    """A template of one section."""
    return BASE + hits("hm", match, threshold) + (hits("he", end, threshold) if end else "") + section("s", "none", "hm", "he" if end else None, refs) + rows([whole_section("s", 0, 0, 0)])


def nested(match: str, end: str, inner: str, thresholds: tuple[float, float, float] = (0.6, 0.6, 0.6)) -> str:
    """A text chunk and a section that holds a text chunk and a section that holds a text chunk."""
    sections = hits("hm", match, thresholds[0]) + hits("he", end, thresholds[1]) + hits("hi", inner, thresholds[2]) + section("s", "none", "hm", "he") + inside("within", "s") + section("deep", "within", "hi")
    return BASE + sections + rows([
        "SELECT w.doc_id, 0, 0, 0, 'TextChunk', 0, coalesce(s.start, w.n), NULL, NULL, NULL FROM w LEFT JOIN s ON s.doc_id = w.doc_id", whole_section("s", 1, 1, 0),
        "SELECT s.doc_id, 2, 2, 1, 'TextChunk', s.start, coalesce(deep.start, s.stop, s.n), NULL, 1, NULL FROM s LEFT JOIN deep ON deep.doc_id = s.doc_id", whole_section("deep", 3, 3, 1, "1"), part("deep", 4, 4, 2, "TextChunk", "deep.start", "coalesce(deep.stop, deep.n)", up="3", over="3"),
    ])


def between_chunks(match: str) -> str:
    """A text chunk, a section that holds a text chunk, and a text chunk."""
    return BASE + hits("hm", match) + section("s", "none", "hm") + rows([
        "SELECT w.doc_id, 0, 0, 0, 'TextChunk', 0, coalesce(s.start, w.n), NULL, NULL, NULL FROM w LEFT JOIN s ON s.doc_id = w.doc_id", whole_section("s", 1, 1, 0), part("s", 2, 2, 1, "TextChunk", "s.start", "coalesce(s.stop, s.n)", up="1"),
        "SELECT w.doc_id, 3, 3, 0, 'TextChunk', CASE WHEN s.doc_id IS NULL THEN 0 WHEN coalesce(s.stop, s.n) < w.n THEN s.stop + 1 ELSE w.n END, w.n, NULL, NULL, NULL FROM w LEFT JOIN s ON s.doc_id = w.doc_id",
    ])
