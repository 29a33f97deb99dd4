import zlib

import pytest

from foliospark.operators import search, stats
from foliospark.sources import pdf

from .builders import pdf as make

LINES = [("Title here", 48, 50, 700), ("Heading", 24, 50, 650), ("content one", 12, 50, 630), ("Heading", 24, 50, 600), ("content two", 12, 50, 580)]


@pytest.fixture
def loaded(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(make(LINES, image=True, dests=True))
    return pdf.files(spark, str(tmp_path))


def test_texts_sizes_and_places(loaded):
    rows = pdf.read(loaded).orderBy("doc_idx").collect()
    assert [r["kind"] for r in rows] == ["image"] + ["text"] * 5 and [r["text"] for r in rows[1:]] == [t for t, *_ in LINES]
    texts = rows[1:]
    assert [r["font_size"] for r in texts] == [48, 24, 12, 24, 12] and {r["font_canon"] for r in texts} == {"Helvetica"}
    for r in texts:
        assert 0 <= r["x0"] < r["x1"] <= 612 and 0 <= r["y0"] < r["y1"] <= 792 and r["y1"] - r["y0"] >= 0.8 * r["font_size"]
    assert texts[0]["y0"] < 100 and [r["y0"] for r in texts] == sorted(r["y0"] for r in texts)


def test_destinations(loaded):
    assert [tuple(r)[1:] for r in pdf.destinations(loaded).collect()] == [("start", 0, 50.0, 700.0)]


def test_headings(spark, tmp_path):
    more = [*LINES, ("Heading", 24, 50, 550), ("content three", 12, 50, 530)]
    (tmp_path / "a.pdf").write_bytes(make(more))
    e = pdf.read(pdf.files(spark, str(tmp_path)))
    level = stats.heading_levels(e, 1).first()
    assert (level["font_canon"], level["font_size"], level["uses"]) == ("Helvetica", 24, 3)
    assert search.of_heading_level(e, "Helvetica", 24).count() == 3 and search.by_font(e, "Helvetica", 48).count() == 1


def test_runs_of_one_baseline_are_joined():
    found = list(pdf.file_elements(make([("left", 12, 50, 700), ("right", 12, 90, 702), ("big", 14, 130, 700)])))
    assert [r[4] for r in found] == ["leftright", "big"]


def test_packed_streams_and_text_operators():
    body = zlib.compress(b"BT /F1 10 Tf 12 TL 50 700 Td [(a) -200 (b)] TJ T* (c\\051\\n) Tj <64> Tj ET bogus 1 2 BT ET")
    data = make([]).replace(b"4 0 obj\n<< /Length 0 >>\nstream\n\nendstream", b"4 0 obj\n<< /Filter /FlateDecode /Length %d >>\nstream\n" % len(body) + body + b"\nendstream")
    assert [r[4] for r in pdf.file_elements(data)] == ["abc)\nd"]


def test_bad_files(spark, tmp_path):
    with pytest.raises(pdf.PdfError):
        list(pdf.file_elements(b"not one"))
    (tmp_path / "a.pdf").write_bytes(b"not one")
    assert pdf.read(pdf.files(spark, str(tmp_path)), skip_broken=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        pdf.files(spark, str(tmp_path / "missing")).count()


def test_file_and_template(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(make(LINES))
    (tmp_path / "t.tmpl").write_text('Section(match="Title here") { TextChunk(chunkSize=20) }')
    assert '"content one' in pdf.process_pdf_file(spark, str(tmp_path / "a.pdf"), str(tmp_path / "t.tmpl")).replace("Heading ", "")


def test_broken_files_are_named(spark):
    good = make(LINES)
    loaded = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(b"no file")), ("c", None), ("d", bytearray(good.replace(b"/Kids [3 0 R]", b"/Kids [2 0 R]"))), ("e", bytearray(b""))], "doc_id string, content binary")
    assert {r["doc_id"] for r in pdf.read(loaded, skip_broken=True).collect()} == {"a"}
    assert {"b", "c", "e"} <= {r["doc_id"] for r in pdf.broken(loaded).collect()} and "a" not in {r["doc_id"] for r in pdf.broken(loaded).collect()}
    with pytest.raises(Exception):
        pdf.read(loaded).collect()
