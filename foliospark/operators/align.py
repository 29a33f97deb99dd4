"""Alignment of a template with every document of a corpus.

The heavy part is relational and stays in the JVM: similarity of each text with each pattern (lengths compared
first), font statistics and style bins. One grouping by document then gathers a compact row for each, numbers
only, and the walk over the template's tree, which is sequential by nature, runs once per document over those.
The plan has one shuffle however many nodes a template has, and documents without a hit for any root section never reach Python.

The rules: sections of one level are searched in the template's order, each from the end of the one before
(or past its start if it has none). A section sees a context: its parent if it is the level's last, else the
section matched before it. Its start is the best-scored similar text before the context's end, the earliest of
equals. Its end is the best of the texts similar to end_match (after the start, to the document's end) and of the
five next texts of the same style (within the context); else the context's end; else the next text if its size is
within 2; else the document's end. Text chunks take what comes before the level's first section if they are
written before it, else what comes after its last.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import similar_enough, similarity
from foliospark.operators import style
from foliospark.plans.docql import Element, MatchConfig, Template, as_string, parse_template

DEPTH, SIMILAR = 10, 5
MATCHES = "doc_id {}, seq int, node int, depth int, type string, start_idx int, stop_idx int, end_idx int, parent_seq int, output_parent int"


@dataclass
class Section:
    start: int
    end: int | None


@dataclass
class Document:
    """Columns of one document's elements, by position; hits: positions and similarities for each pattern."""

    text: np.ndarray
    font: np.ndarray
    size: np.ndarray
    size_bin: np.ndarray
    z_bin: np.ndarray
    x_bin: np.ndarray
    caps: np.ndarray
    title: np.ndarray
    page: np.ndarray
    y0: np.ndarray
    z: np.ndarray
    refs: np.ndarray
    hits: list[tuple[np.ndarray, np.ndarray]]

    def score(self, at: np.ndarray, base: np.ndarray, context: Section | None) -> np.ndarray:
        one = np.float32
        s = base.astype(one)
        if context is not None and context.end is not None:
            s = s + one(0.2) * (self.page[at] != self.page[context.end])
        s = s + one(0.3) * (self.z[at] > 1.5)
        s = s + one(0.2) * (self.y0[at] < 100)
        return s + one(0.2) * np.minimum(self.refs[at], 5).astype(one) / one(5)

    def alike(self, seed: int, stop: int) -> np.ndarray:
        """The next texts of a seed's style."""
        if self.z_bin[seed] < 0:
            return np.zeros(0, np.int64)
        at = np.arange(seed + 1, max(seed + 1, min(stop, len(self.text))))
        near = self.text[at] & (self.font[at] == self.font[seed]) & (self.size_bin[at] == self.size_bin[seed]) & (np.abs(self.z_bin[at] - self.z_bin[seed]) <= 1)
        place = (np.abs(self.x_bin[at] - self.x_bin[seed]) <= 1) & (self.caps[at] == self.caps[seed]) & (self.title[at] == self.title[seed])
        return at[near & ((self.z_bin[at] < 0) | place)][:SIMILAR]


@dataclass
class Plan:
    """A template with its patterns numbered."""

    template: Template
    configs: list[tuple[str, float]] = field(default_factory=list)

    def __post_init__(self):
        for k, e in enumerate(self.template.walk()):
            for c in (e.match, e.end_match):
                if c is not None and (key := (c.pattern, c.threshold)) not in self.configs:
                    self.configs.append(key)

    def number(self, c: MatchConfig | None) -> int | None:
        return None if c is None else self.configs.index((c.pattern, c.threshold))

    def sections(self) -> list[Element]:
        return [e for e in self.template.elements if e.type == "Section"]

    def align(self, doc: Document) -> list[tuple]:
        out: list[tuple] = []
        self._level(self.template.elements, doc, None, 0, None, out)
        return out

    def _level(self, elements: list[Element], doc: Document, context: Section | None, depth: int, parent: tuple[int, bool] | None, out: list[tuple]) -> None:
        """Appends the matches of one level, each with its children's after it. parent: its place in out, and whether it has a parent itself."""
        if depth > DEPTH or not elements:
            return
        n = len(doc.text)
        lo, hi = (context.start, n if context.end is None else context.end) if context else (0, n)
        sections = [e for e in elements if e.type == "Section"]
        found: dict[int, Section] = {}
        previous, last_end, parts = None, None, []
        for e in sections:
            seen = context if e is sections[-1] else previous
            begin = lo if previous is None else previous.start + 1 if previous.end is None else previous.end
            begin = begin if last_end is None else max(begin, last_end)
            if (m := self._section(e, doc, seen, begin)) is not None:
                found[id(e)] = previous = m
                last_end = hi if m.end is None else m.end
                parts.append((m.start, last_end))
        first = next((k for k, e in enumerate(elements) if e.type == "Section"), len(elements))
        for k, e in enumerate(elements):
            if e.type == "Section" and id(e) in found:
                m, place = found[id(e)], len(out)
                out.append((e.number, depth, e.type, m.start, n if m.end is None else m.end, m.end, None if parent is None else parent[0], None if parent is None else parent[0]))
                self._level(e.children, doc, m, depth + 1, (place, parent is not None), out)
            elif e.type == "TextChunk":
                if not parts:
                    a, b = lo, hi
                elif k < first:
                    a, b = lo, parts[0][0]
                else:
                    end = parts[-1][1]
                    a, b = (end + 1 if end < hi else end), hi
                if doc.text[a:b].any():
                    out.append((e.number, depth, e.type, a, b, None, None if parent is None else parent[0], parent[0] if parent is not None and parent[1] else None))

    def _section(self, e: Element, doc: Document, context: Section | None, begin: int) -> Section | None:
        which = self.number(e.match)
        if which is None:
            return None
        stop = context.end if context is not None and context.end is not None and context.end > begin else len(doc.text)
        at, base = doc.hits[which]
        inside = (at >= begin) & (at < stop)
        if not inside.any():
            return None
        start = int(at[inside][int(np.argmax(doc.score(at[inside], base[inside], context)))])
        scores: dict[int, np.float32] = {}
        if (which := self.number(e.end_match)) is not None:
            at, base = doc.hits[which]
            for i, s in zip(at[at > start], doc.score(at[at > start], base[at > start], context), strict=True):
                scores[int(i)] = s + np.float32(0.5)
        limit = len(doc.text) if context is None else context.start if context.end is None else context.end
        for i in doc.alike(start, limit):
            scores[int(i)] = scores.get(int(i), np.float32(0)) + np.float32(0.1)
        if scores:
            return Section(start, min(scores, key=lambda i: (-scores[i], i)))
        if context is not None and context.end is not None and context.end > start:
            return Section(start, context.end)
        after = start + 1
        if after < len(doc.text) and doc.text[after] and abs(doc.size[after] - doc.size[start]) < 2.0:
            return Section(start, after)
        return Section(start, None)


def prepared(elements: DataFrame, plan: Plan, references: DataFrame | None = None) -> DataFrame:
    """doc_id and a sorted array of compact rows for each document that may match. references: doc_id, doc_idx, refs."""
    text, w = F.col("kind") == "text", Window.partitionBy("doc_id")
    e = elements if references is None else elements.join(references.select("doc_id", "doc_idx", "refs"), ["doc_id", "doc_idx"], "left")
    refs = F.lit(0) if references is None else F.coalesce("refs", F.lit(0))
    for k, (pattern, threshold) in enumerate(plan.configs):
        ok = text & similar_enough(F.col("text"), F.lit(pattern), threshold, len(pattern))
        e = e.withColumn(f"s{k}", F.when(ok, similarity(F.col("text"), F.lit(pattern))))
    roots = [plan.number(s.match) for s in plan.sections()]
    if all(x.type == "Section" for x in plan.template.elements) and None not in roots:
        hit = F.lit(False)
        for k in roots:
            hit = hit | F.col(f"s{k}").isNotNull()
        e = e.withColumn("_any", F.max(hit).over(w)).where("_any").drop("_any")
    size = F.when(text, F.col("font_size"))
    e = e.withColumn("_m", F.avg(size).over(w)).withColumn("_sd", F.stddev_pop(size).over(w))
    z = F.when(F.col("_sd") > 0, (F.col("font_size") - F.col("_m")) / F.col("_sd")).otherwise(0.0)
    zb = F.greatest(F.least(F.round(2 * (F.col("font_size") - F.col("_m")) / F.greatest("_sd", F.lit(1e-6))), F.lit(8)), F.lit(-8))
    xb = F.greatest(F.least(F.floor((F.col("x0") + F.col("x1")) / 2 / style.WIDTH * 10), F.lit(9)), F.lit(0))
    row = F.struct(
        "doc_idx", F.coalesce(text, F.lit(False)).alias("text"), F.coalesce(F.xxhash64("font_canon"), F.lit(0)).alias("font"), F.coalesce("font_size", F.lit(0.0)).alias("size"), F.coalesce(F.least(F.round(2 * F.col("font_size")), F.lit(400)).cast("int"), F.lit(-1)).alias("size_bin"),
        F.coalesce(zb.cast("int"), F.lit(-9)).alias("z_bin"), F.coalesce(xb.cast("int"), F.lit(-1)).alias("x_bin"), F.coalesce(style.is_caps(F.col("text")), F.lit(False)).alias("caps"), F.coalesce(style.is_title(F.col("text")), F.lit(False)).alias("title"), F.col("page_number").alias("page"),
        F.coalesce("y0", F.lit(1e9)).alias("y0"), F.coalesce(z, F.lit(0.0)).alias("z"), refs.cast("int").alias("refs"), *(F.coalesce(f"s{k}", F.lit(-1.0)).alias(f"s{k}") for k in range(len(plan.configs))),
    )
    return e.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))


def align(elements: DataFrame, template: Template | str, references: DataFrame | None = None) -> DataFrame:
    """Every match of every document, in output order: seq numbers a document's matches, start_idx and stop_idx bound
    its content in document order (stop_idx is exclusive), end_idx is the end marker or null."""
    plan = Plan(parse_template(template) if isinstance(template, str) else template)

    def run(batches):
        for batch in batches:
            rows, ids = batch.column(1), batch.column(0).to_pylist()
            flat = rows.flatten()
            c = {flat.type.field(k).name: flat.field(k).to_numpy(zero_copy_only=False) for k in range(flat.type.num_fields)}
            offsets = rows.offsets.to_numpy() - rows.offsets[0].as_py()
            out: list[tuple] = []
            for doc_id, a, b in zip(ids, offsets[:-1], offsets[1:], strict=True):
                own = {name: v[a:b] for name, v in c.items()}
                idx = own.pop("doc_idx")
                hits = []
                for k in range(len(plan.configs)):
                    s = own.pop(f"s{k}")
                    at = np.flatnonzero(s >= 0)
                    hits.append((at, s[at]))
                place = lambda i, idx=idx: None if i is None else int(idx[i]) if i < len(idx) else int(idx[-1]) + 1
                for seq, (node, depth, kind, start, stop, end, up, over) in enumerate(plan.align(Document(**own, hits=hits))):
                    out.append((doc_id, seq, node, depth, kind, place(start), place(stop), place(end), up, over))
            columns = list(zip(*out, strict=True)) or [()] * 10
            types = (batch.column(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), *(pa.int32(),) * 5)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], [x.split()[0] for x in MATCHES.split(", ")])

    return prepared(elements, plan, references).mapInArrow(run, MATCHES.format(elements.schema["doc_id"].dataType.simpleString()))


def metadata(template: Template) -> dict[int, tuple[str | None, str | None]]:
    """section and section_name of each node: a section's own, or those of the sections around it."""
    out: dict[int, tuple[str | None, str | None]] = {}

    def go(elements: list[Element], section: str | None, name: str | None) -> None:
        for e in elements:
            s, n = section, name
            if e.type == "Section":
                given = e.attributes.get("as", e.attributes.get("match"))
                s, n = as_string(given) if not isinstance(given, list) else str(given[0]) if given else None, e.name
            out[e.number] = (s, n)
            go(e.children, s, n)

    go(template.elements, None, None)
    return out
