import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import canonical_font, similarity, transform_rect, rect
from foliospark.operators import align, chunk, layout, lineage, output, search, stats, style
from foliospark.sources import text

from .builders import elements

INDEX = [("Hello World", 12, 50, 700), ("Section Title", 18, 50, 650, 1, "TimesNewRomanPSMT"), (None, 0, 50, 500), ("Another page", 12, 50, 700, 2)]


def idxs(df):
    return [r["doc_idx"] for r in df.orderBy("doc_idx").collect()]


def test_index_and_search(spark):
    e = elements(spark, INDEX)
    assert search.lengths(e).first()["doc_len"] == 4 and idxs(search.on_page(e, 1)) == [0, 1, 2] and idxs(search.on_page(e, 2)) == [3]
    assert [(r["font_canon"], r["uses"]) for r in stats.font_frequency(e).orderBy("place").collect()] == [("Helvetica", 2), ("Times-Roman", 1)]
    assert idxs(search.by_size(e, 12, 18)) == [0, 3] and idxs(search.search(e, least_size=12, most_size=18)) == [0, 1, 3] and idxs(search.search(e)) == [0, 1, 2, 3]
    assert idxs(search.search(e, page=1, region=(0, 600, 400, 800))) == [0, 1]
    assert idxs(search.fuzzy(e, "Hello World", 0.9)) == [0] and 0 in idxs(search.fuzzy(e, "Hello", 0.4)) and idxs(search.fuzzy(e, "Nonexistent", 0.8)) == []
    assert idxs(search.fuzzy(e, "HELLO WORLD", 0.9, lower=True)) == [0]
    assert idxs(search.images(e)) == [2] and idxs(search.texts(e)) == [0, 1, 3] and idxs(search.at(e, 1, 2, "image")) == [2]
    assert idxs(search.by_font(e, "Arial", 12)) == [0, 3] and idxs(search.hit(e, 1, 60, 655)) == [1]
    refs = spark.createDataFrame([(1, 3, 2)], "doc_id bigint, doc_idx int, refs int")
    assert idxs(search.by_references(e, refs, 1)) == [3] and idxs(search.by_references(e, refs, 0)) == [0, 1, 2, 3]


@pytest.mark.parametrize(("start", "end", "want"), [(0, 3, [0, 1, 2]), (1, None, [1, 2, 3]), (1, 1, []), (99, 3, []), (1, 99, [1, 2, 3]), (3, 1, [])])
def test_between(spark, start, end, want):
    markers = spark.createDataFrame([(1, start, end)], "doc_id bigint, start int, end int")
    assert idxs(search.between(elements(spark, INDEX), markers)) == want


def test_font_names(spark):
    names = {"TimesNewRomanPS-BoldMT": "Times-Bold", "TimesNewRomanPS-ItalicMT": "Times-Italic", "TimesNewRomanPSMT": "Times-Roman", "Arial-Bold": "Helvetica-Bold", "Arial": "Helvetica", "ArialMT": "MT", "Arial-BoldMT": "BoldMT", "CourierNew": "Courier", "DejaVuSans-Bold": "DejaVuSans-Bold"}
    d = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r[0]: r[1] for r in d.select("n", canonical_font(F.col("n"))).collect()} == names


def test_statistics(spark):
    e = elements(spark, [("a", s, 0, 0) for s in (1, 2, 3, 4)])
    s = stats.size_stats(e).first()
    assert (s["mean"], s["p50"], s["p25"], s["p95"]) == (2.5, 3, 2, 4)
    nothing = stats.size_stats(elements(spark, [(None, 0, 0, 0)])).first()
    assert (nothing["mean"], nothing["sd"], nothing["p50"]) == (12, 0, 12)
    assert stats.z_fonts(elements(spark, [("a", 12, 0, 0)] * 3), 0).first()["z"] == 0
    flat = elements(spark, [("Title", 48, 0, 0)] + [x for k in range(3) for x in (("Head", 24, 0, 10 + k), ("body text", 12, 0, 20 + k))])
    assert [(r["font_size"], r["uses"]) for r in stats.heading_levels(flat, 3).collect()] == [(24, 3)]


def test_reference_counts(spark):
    e = elements(spark, [("ab", 4, 50, 100), ("far", 4, 300, 400)])
    d = spark.createDataFrame([(1, "a", 0, 55.0, 102.0), (1, "b", 0, None, 102.0), (1, "c", 1, 55.0, 102.0)], "doc_id bigint, name string, page int, x double, y double")
    assert {r["doc_idx"]: r["refs"] for r in stats.reference_counts(e, d).collect()} == {0: 1, 1: 0}


def test_style_bins(spark):
    e = elements(spark, [("HEAD ONE", 20, 0, 0), ("Head Two", 20, 0, 0), ("small a", 10, 500, 0), ("SMALL B", 10, 0, 0)])
    s = {r["doc_idx"]: r for r in style.styled(e).collect()}
    assert s[0]["caps"] and s[1]["title"] and s[2]["style_key"] == s[3]["style_key"] and s[0]["style_key"] != s[1]["style_key"]
    seeds = spark.createDataFrame([(1, 2, None)], "doc_id bigint, seed_idx int, end_idx int")
    assert style.similar(e, seeds, 5).count() == 0 and idxs(style.same_style(e, seeds)) == [3]


def plain_chunks(lens, limit, overlap):
    out, start = [], 0
    while start < len(lens):
        size, end = 0, start
        while end < len(lens) and not (size > 0 and size + lens[end] > limit):
            size += lens[end]
            end += 1
        end = max(end, start + 1)
        out.append((start, end - 1))
        if end >= len(lens):
            break
        back, s = 0, end
        while s > start and back < overlap:
            s -= 1
            back += lens[s]
        start = s if s > start and back >= overlap else end
    return out


def plain_tokens(lens, limit, overlap):
    out, start = [], 0
    while start < len(lens):
        size, end = 0, start
        while end < len(lens):
            if size > 0 and size + lens[end] > limit:
                break
            size += lens[end]
            end += 1
            if size == limit:
                break
        out.append((start, max(end, start + 1) - 1))
        end = max(end, start + 1)
        if end >= len(lens):
            break
        back, s = 0, end
        while s > start and back < overlap:
            s -= 1
            back += lens[s]
        start = s if s > start and back >= overlap else end
    return out


@pytest.mark.parametrize(("limit", "overlap"), [(10, 0), (10, 4), (25, 12), (3, 9)])
def test_chunks_agree_with_a_plain_loop(spark, limit, overlap):
    rng, rows, want = random.Random(limit), [], {}
    for d in range(25):
        lens = [rng.choice([0, 1, 2, 3, 7, 15, 40]) for _ in range(rng.randint(1, 25))]
        rows += [(d, i, "text", "w" * n, 1) for i, n in enumerate(lens)]
        if any(lens):
            want[d] = plain_chunks(lens, limit, overlap)
    e = spark.createDataFrame(rows, "doc_id bigint, doc_idx int, kind string, text string, page_number int")
    got: dict = {}
    for r in chunk.ranges(e, limit, overlap).orderBy("doc_id", "chunk").collect():
        got.setdefault(r["doc_id"], []).append((r["first_idx"], r["last_idx"]))
    assert {d: got[d] for d in want} == want


def test_layout(spark):
    e = elements(spark, [("a", 10, 100, 200), ("b", 10, 50, 202), ("c", 10, 50, 150), ("d", 12, 90, 150), ("e", 10, 50, 149)])
    got = layout.lines(e).orderBy("line").collect()
    assert [(r["text"], r["idxs"]) for r in got] == [("ba", [1, 0]), ("c", [2]), ("d", [3]), ("e", [4])] and got[0]["x0"] == 50
    assert [r["lines"] for r in layout.blocks(e).orderBy("block").collect()] == [["ba"], ["c", "d", "e"]]
    assert search.fuzzy_lines(layout.lines(e), "BA", 0.9).count() == 1 and layout.flat(layout.lines(e)).count() == 5


def matched(spark, rows, template):
    return [(r["type"], r["depth"], r["start_idx"], r["stop_idx"], r["end_idx"]) for r in align.align(elements(spark, rows), template).orderBy("seq").collect()]


def doc(*rows):
    return [(t, s, 50, 120 + 20 * i) if t is not None else (None, 0, 50, 120 + 20 * i) for i, (t, s) in enumerate(rows)]


def test_explicit_end(spark):
    rows = doc(("Introduction here", 16), ("some words", 12), (None, 0), ("other words", 12), ("Next Heading", 16))
    assert matched(spark, rows, 'Section(match="Introduction here", end_match="Next Heading")') == [("Section", 0, 0, 4, 4)]


def test_nested_sections(spark):
    rows = doc(("Chapter One", 20), ("para", 12), ("1.1 Alpha part", 16), ("para", 12), ("1.2 Beta thing", 16), ("para", 12), ("Chapter Two", 20))
    t = 'Section(match="Chapter One", end_match="Chapter Two") { Section(match="1.1 Alpha part", end_match="1.2 Beta thing") Section(match="1.2 Beta thing", end_match="Chapter Two") }'
    assert [m[2:4] for m in matched(spark, rows, t)] == [(0, 6), (2, 4), (4, 6)]


def test_children_without_ends(spark):
    rows = doc(("Section A", 20), ("text", 12), ("A.1 First", 16), ("text", 12), ("A.2 Second", 16), ("text", 12), ("Section B", 20))
    t = 'Match<Section> A { Text("Section A", 0.95) } Match<Section> B { Text("Section B", 0.95) } Match<Section> P { Text("A.1 First", 0.9) } Match<Section> Q { Text("A.2 Second", 0.9) } Section(match=A, end_match=B) { Section(match=P) Section(match=Q) }'
    assert [m[2:4] for m in matched(spark, rows, t)] == [(0, 6), (2, 4), (4, 6)]


def test_groups_of_unlike_limits_are_chunked_at_once(spark):
    rng = random.Random(7)
    given, want, made = [(40, 10), (25, 0), (60, 45), (0, 5)], {}, []
    for d in range(12):
        lens = [rng.choice([0, 0, 1, 7, 20, 90]) for _ in range(rng.randint(1, 40))]
        made += [(d, i, "text", "x" * n, d % 4) for i, n in enumerate(lens)]
        want[d] = plain_chunks(lens, *given[d % 4])
    e = spark.createDataFrame(made, "doc_id bigint, doc_idx int, kind string, text string, which int").withColumn("page_number", F.lit(1))
    got = {}
    for r in chunk.chunks(e, settings=(given, F.col("which"))).orderBy("doc_id", "chunk").collect():
        got.setdefault(r["doc_id"], []).append((r["first_idx"], r["last_idx"]))
    alone = {d: [(r["first_idx"], r["last_idx"]) for r in chunk.chunks(e.where(F.col("doc_id") == d), *given[d % 4]).orderBy("chunk").collect()] for d in (0, 1, 2, 3)}
    assert want == got and all(got[d] == own for d, own in alone.items())


def test_chunks_of_many_lines_take_time_in_proportion(spark):
    """A frame that looks at all later lines would take over a minute here, and the follower's blocks must join up."""
    d = spark.createDataFrame([(1, "\n".join("x" * 19 for _ in range(30_000)))], "doc_id bigint, text string")
    found = [(r["first_idx"], r["last_idx"]) for r in chunk.ranges(text.from_documents(d), 500, 150).orderBy("chunk").collect()]
    assert found == plain_chunks([19] * 30_000, 500, 150)


def test_alignment_of_documents_with_names(spark):
    e = elements(spark, [("Title", 20, 50, 60), ("body", 12, 50, 90), ("more", 12, 50, 120)]).withColumn("doc_id", F.lit("a/b.pdf"))
    found = align.align(e, 'Section(match="Title")').first()
    assert found["doc_id"] == "a/b.pdf" and found["start_idx"] == 0
    assert output.outputs(e, 'Section(match="Title")').first()["doc_id"] == "a/b.pdf"


def test_chunks_around_a_section(spark):
    rows = doc(*[("intro words", 12)] * 3, ("Main Section", 16), ("body text", 12), ("body text", 12), ("The Last Line", 14), *[("closing", 12)] * 2)
    t = 'TextChunk Section(match="Main Section", end_match="The Last Line") { TextChunk } TextChunk'
    assert [(m[0], *m[2:4]) for m in matched(spark, rows, t)] == [("TextChunk", 0, 3), ("Section", 3, 6), ("TextChunk", 3, 6), ("TextChunk", 7, 9)]


def test_siblings_in_order_and_missing_ones(spark):
    rows = doc(("Section 1", 16), ("Section 2", 16), ("Section 3", 16))
    t = "".join(f'Match<S> M{k} {{ Text("Section {k}", 0.99) }} Section(match=M{k})' for k in (1, 2, 3))
    assert [m[2:] for m in matched(spark, rows, t)] == [(0, 1, 1), (1, 2, 2), (2, 3, None)]
    assert matched(spark, rows, 'Section(match="nothing like it at all")') == []


def test_end_pattern_equal_to_start(spark):
    assert matched(spark, doc(*[("Heading", 16), ("t", 12)] * 2, ("Heading", 16)), 'Section(match="Heading", end_match="Heading")')[0][3] > 0


def test_depth_is_bounded(spark):
    t = 'Section(match="Loop")'
    for _ in range(15):
        t = f'Section(match="Loop") {{ {t} }}'
    found = matched(spark, doc(*[("Loop", 16)] * 40), t)
    assert 0 < len(found) <= 11 and max(m[1] for m in found) <= 10


def test_outputs_and_parents(spark):
    rows = doc(("root words", 12), ("Main Part", 20), ("own text", 12), ("Sub Part Here", 16), ("sub text", 12), ("Finish", 20))
    t = 'TextChunk Section(match="Main Part", end_match="Finish", as="main") { TextChunk Section(match="Sub Part Here", end_match="Finish") { TextChunk } }'
    got = output.outputs(elements(spark, rows), t).orderBy("out_idx").collect()
    # the root chunk, the section, its chunk, the inner section, its chunk
    assert [(r["text"], r["parent_name"], r["parent_index"]) for r in got] == [
        ("root words", None, None), ("Main Part own text Sub Part Here sub text", None, None), ("Main Part own text", None, None), ("Sub Part Here sub text", "Section", 1), ("Sub Part Here sub text", "Section", 3),
    ]
    assert [r["section"] for r in got][0] is None and got[1]["section"] == "main" and got[1]["section_name"] == "Section" and [r["chunk_index"] for r in got] == list(range(len(got)))
    assert all(r["chunk_char_count"] == len(r["text"].encode()) for r in got)
    import json

    made = json.loads(output.document_json(output.outputs(elements(spark, rows), t)).first()["json"])
    assert len(made) == len(got) and made[1]["type"] == "Text" and made[1]["metadata"]["section"] == "main"


def test_pages_of_chunks(spark):
    rows = [("one two", 12, 50, 100, 1), ("three four five", 12, 50, 100, 2), ("six", 12, 50, 120, 3)]
    got = output.outputs(elements(spark, rows), "TextChunk(chunkSize=30, chunkOverlap=10)").orderBy("out_idx").collect()
    assert {p for r in got for p in r["page_numbers"]} == {1, 2, 3} and got[0]["primary_page"] == 2


def test_images(spark):
    from foliospark.plans.docql import parse_template

    e = elements(spark, INDEX)
    node = parse_template('Image { ImageBytes ImageCaption ImageSummary(model="m") ImageEmbedding(model="clip") }').elements[0]
    found = output.image_outputs(e, spark.createDataFrame([(1, 0, 0, 4)], "doc_id bigint, seq int, start_idx int, stop_idx int"), node).first()
    assert found["bytes_base64"] == "aW1n" and found["caption"] and "m" in found["summary"] and len(found["embedding"]) == 512 and found["page_number"] == 1


def test_lineage_has_no_last_level(spark):
    chain = spark.createDataFrame([(f"c{k}", f"c{k + 1}", k) for k in range(120)] + [("x", "y", 0), ("y", "z", 1), ("z", "x", 2), ("z", "w", 3)], "parent string, child string, seq int")
    found = lineage.tree(chain, spark.createDataFrame([("c0",), ("x",)], "root string")).collect()
    assert sorted(r["level"] for r in found if r["root"] == "c0") == list(range(121))
    assert {r["path"] for r in found if r["root"] == "x"} == {"x", "x/y", "x/y/z", "x/y/z/w"}
    assert lineage.tree(chain, spark.createDataFrame([("c0",)], "root string"), 2).count() == 3


def test_lineage(spark):
    p = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("b", "c", 3), ("x", "c", 4), ("a", "a", 5)], "parent string, child string, seq int")
    assert {(r["child"], r["parent"]) for r in lineage.parents(p).collect()} == {("b", "a"), ("c", "b")} and [r["child"] for r in lineage.children(p, "a").collect()] == ["b"]
    assert {(r["entity"], r["level"]) for r in lineage.tree(p, spark.createDataFrame([("a",)], "root string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    events = spark.createDataFrame([("a", 1, "structure=table rows=3"), ("b", 2, "plain")], "entity string, seq int, message string")
    assert lineage.with_children(events, p).where("root = 'a'").count() == 2 and {r[0] for r in lineage.field_names(events).collect()} == {"structure", "rows"}
    assert lineage.structures(events).first()["structure"] == "table"
    m = spark.createDataFrame([("t", "c1", 0.5, 1), ("t", "c2", 0.9, 2), ("u", "c1", 0.7, 3)], "template string, content string, score double, seq int")
    assert {r["template"]: r["contents"] for r in lineage.match_groups(m).collect()} == {"t": ["c2"], "u": ["c1"]}


def test_scalar_functions(spark):
    d = spark.createDataFrame([("ä", "a"), ("", ""), ("kitten", "sitting")], "a string, b string")
    assert [round(r[0], 4) for r in d.select(similarity(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 0.5714]
    r = d.limit(1).select(transform_rect([0, 1, -1, 0, 5, 0], rect(*(F.lit(float(v)) for v in (0, 0, 2, 3)))).alias("r")).first()["r"]
    assert tuple(r) == (2, 0, 5, 2)


def test_stream(spark, tmp_path):
    from foliospark.streaming import chunk_stream

    spark.createDataFrame([(1, "one\ntwo\nthree"), (2, "four")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/in")
    docs = spark.readStream.schema("doc_id bigint, text string").parquet(f"{tmp_path}/in")
    chunk_stream(docs, "TextChunk", f"{tmp_path}/out", f"{tmp_path}/ck", once=True).awaitTermination(120)
    assert {r["text"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"one two three", "four"}
