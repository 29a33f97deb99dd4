"""The PDF reader's work follows the number of texts, not of letters, and boxes stay those of the glyphs one by one."""

import random
import sys

import pytest

from foliospark.sources import pdf

from .builders import pdf as make


def calls(data):
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = list(pdf.file_elements(data))
    finally:
        sys.setprofile(None)
    return n, found


def test_work_follows_texts_not_letters():
    short, long = ([("word " * k, 12, 50, -20 * i) for i in range(60)] for k in (1, 400))
    few, _ = calls(make(short))
    many, found = calls(make(long))
    assert [r[4] for r in found] == ["word " * 400] * 60 and many < 1.5 * few


@pytest.mark.parametrize("seed", range(60))
def test_boxes_are_those_of_the_glyphs(monkeypatch, seed):
    rng = random.Random(seed)
    some = lambda *x: rng.choice(x)
    ops = []
    for _ in range(12):
        text = "".join(rng.choices(["a", "W", " ", "i", "\\(", "\\)", "(x)", "\\101", "\\n", "."], k=rng.randrange(12)))
        ops += [f"q {some('1 0 0 1 0 0', '0 1 -1 0 300 0', '.5 .2 -.3 2 9 7')} cm BT /F1 {some(12, 7.5, 1, -3)} Tf {some(0, 0.5, -2)} Tc {some(0, 3, -9)} Tw {some(100, 50, -80)} Tz {some(0, 4, -4)} Ts {some('1 0 0 1 20 30', '9 0 0 9 5 5', '0 -2 2 0 0 0')} Tm [({text}) {some(-200, 300)} ({text}.)] TJ T* ({text}) Tj ET Q"]
    body = "\n".join(ops).encode()
    data = make([]).replace(b"<< /Length 0 >>\nstream\n", b"<< /Length %d >>\nstream\n" % len(body) + body)
    texts = lambda: [t for page in pdf.Pdf(data).pages() for t in pdf.Page(pdf.Pdf(data), page).texts]
    quick = texts()
    own = pdf.Font.__init__

    def slowly(self, *x):
        own(self, *x)
        self.forward = False

    monkeypatch.setattr(pdf.Font, "__init__", slowly)
    slow = texts()
    assert len(quick) == len(slow) > 0
    for a, b in zip(quick, slow, strict=True):
        assert (a["text"], a["font"], a["size"]) == (b["text"], b["font"], b["size"]) and a["box"] == pytest.approx(b["box"], rel=1e-9, abs=1e-9)


def test_text_that_looks_like_objects_is_text():
    lines = ["font 5 0 obj here", "page 3 0 obj", "the trailer 1", "trailer << /Root 9 0 R >>"]
    found = list(pdf.file_elements(make([(t, 12, 50, 700 - 40 * i) for i, t in enumerate(lines)])))
    assert [r[4] for r in found] == lines


def test_headings_of_objects_with_any_white_space():
    data = make([("kept", 12, 50, 700)]).replace(b"5 0 obj\n", b"\n05" + b" " * 3000 + b"0\r\n\tobj ").replace(b"4 0 obj\n", b"%x4 0 object\n77 4 0 obj")
    assert [r[4] for r in pdf.file_elements(data)] == ["kept"]
