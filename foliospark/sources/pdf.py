"""PDF files as elements: a reader of the file format and of page content, one task for each part of the files.

Files are read by Spark's ``binaryFile`` source. A worker parses the objects (plain and packed ones, Flate streams),
walks the page tree and interprets each page's drawing operators. One BT..ET block is one text; a page's texts are then
joined into runs by baseline, font and size, images come first, and y is turned so that it grows downwards. Pages
without resources have no elements; an operator that fails is skipped; a file that can't be read raises ``PdfError``
unless ``skip_broken`` is set.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import canonical_font
from foliospark.schema import DESTINATIONS, ELEMENT_COLUMNS

Matrix = tuple[float, float, float, float, float, float]
ONE: Matrix = (1, 0, 0, 1, 0, 0)
OPERATORS = frozenset("q Q cm BT ET Tf Tc Tw Tz TL Tr Ts Tm Td TD T* Tj TJ ' \" Do".split())

# Advance widths of the characters 32 to 126 in the base fonts, in thousandths.
_HELVETICA = "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556*10 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"
_HELVETICA_BOLD = "278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556*10 333 333 584 584 584 611 975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584"
_TIMES = "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500*10 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541"


def _widths(text: str) -> dict[int, float]:
    out: list[float] = []
    for part in text.split():
        value, _, times = part.partition("*")
        out += [float(value)] * int(times or 1)
    return dict(enumerate(out, 32))


METRICS: dict[str, tuple[float, float, dict[int, float]]] = {  # ascent, descent, widths
    "Helvetica": (718, -207, _widths(_HELVETICA)), "Helvetica-Bold": (718, -207, _widths(_HELVETICA_BOLD)), "Helvetica-Oblique": (718, -207, _widths(_HELVETICA)), "Helvetica-BoldOblique": (718, -207, _widths(_HELVETICA_BOLD)),
    "Times-Roman": (683, -217, _widths(_TIMES)), "Times-Bold": (683, -217, _widths(_TIMES)), "Times-Italic": (683, -217, _widths(_TIMES)), "Times-BoldItalic": (683, -217, _widths(_TIMES)),
    **{f"Courier{v}": (629, -157, dict.fromkeys(range(32, 127), 600.0)) for v in ("", "-Bold", "-Oblique", "-BoldOblique")},
}
CP1252 = [bytes([c]).decode("cp1252", "replace") for c in range(256)]
FALLBACK = (928.0, -236.0, dict.fromkeys(range(32, 127), 550.0))


class PdfError(ValueError):
    """The bytes are not a PDF file that can be read."""


class Ref(tuple):
    """A reference to an object: number and generation."""


class Word(str):
    """A name of the file format."""


class Stream:
    def __init__(self, head: dict, data: bytes):
        self.head, self.raw = head, data

    def data(self, pdf: Pdf) -> bytes:
        out = self.raw
        filters = pdf.get(self.head.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if pdf.get(f) in ("FlateDecode", "Fl"):
                out = zlib.decompressobj().decompress(out)
            elif pdf.get(f) in ("ASCIIHexDecode", "AHx"):
                out = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", out).decode())
        parms = pdf.get(self.head.get("DecodeParms"))
        if isinstance(parms, dict) and pdf.get(parms.get("Predictor", 1)) >= 10:
            out = unpredict(out, pdf.get(parms.get("Columns", 1)))
        return out


def unpredict(data: bytes, columns: int) -> bytes:
    """Undoes the PNG row filters none, sub, up and average of one-byte samples."""
    out, before = bytearray(), bytes(columns)
    for at in range(0, len(data), columns + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + columns])
        for i in range(len(row)):
            left = row[i - 1] if i else 0
            row[i] = (row[i] + (left if kind == 1 else before[i] if kind == 2 else (left + before[i]) // 2 if kind == 3 else 0)) & 255
        out += row
        before = bytes(row)
    return bytes(out)


LEX = re.compile(rb"[\x00\t\n\f\r ]*(?:%[^\r\n]*[\x00\t\n\f\r ]*)*(?:(?P<num>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<name>/[^\x00\t\n\f\r ()<>\[\]{}/%]*)|(?P<open><<|>>|\[|\]|[{}])|(?P<hex><[0-9A-Fa-f\x00\t\n\f\r ]*>)|\((?P<plain>[^()\\]*)\)|(?P<str>\()|(?P<word>[^\x00\t\n\f\r ()<>\[\]{}/%]+))")
REFERENCE = re.compile(rb"\s+(\d+)\s+R(?![A-Za-z])")
ESCAPED = re.compile(rb"[0-7]{1,3}|\r\n|[\s\S]")
UNESCAPED = re.compile(rb"[^()\\]*")
STREAM = re.compile(rb"\s*stream\r?\n")
HEADING = re.compile(rb"(?<![0-9])(\d+)\s+\d+\s+\Z")
NOT_HEADING = re.compile(rb"[^0-9\s]")
TRAILER = re.compile(rb"\btrailer\b")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Lexer:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def token(self) -> tuple[str, Any]:
        m = LEX.match(self.data, self.at)
        if not m:
            return "end", None
        self.at, kind = m.end(), m.lastgroup or ""
        text = m.group(kind)
        if kind == "num":
            return kind, float(text) if b"." in text else int(text)
        if kind == "plain":
            return "value", text
        if kind == "name":
            name = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), text[1:]) if b"#" in text else text[1:]
            return kind, Word(name.decode("latin-1"))
        if kind == "hex":
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", text)
            return "value", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if kind == "str":
            return "value", self.string()
        return kind, text.decode("latin-1")

    def string(self) -> bytes:
        out, depth = bytearray(), 1
        while depth and self.at < len(self.data):
            m = UNESCAPED.match(self.data, self.at)
            out += m[0]
            c = self.data[m.end() : m.end() + 1]
            self.at = m.end() + len(c)
            if c == b"\\":
                m = ESCAPED.match(self.data, self.at)
                if m:
                    self.at = m.end()
                    out += bytes([int(m[0], 8) & 255]) if m[0][:1].isdigit() and m[0][:1] < b"8" else b"" if m[0][:1] in b"\r\n" else ESCAPES.get(m[0], m[0])
                continue
            depth += (c == b"(") - (c == b")")
            if depth:
                out += c
        return bytes(out)

    def value(self, kind: str | None = None, x: Any = None) -> Any:
        if kind is None:
            kind, x = self.token()
        if kind == "num" and isinstance(x, int) and (m := REFERENCE.match(self.data, self.at)):
            self.at = m.end()
            return Ref((x, int(m[1])))
        if kind == "open" and x == "[":
            out = []
            while (t := self.token())[1] != "]" or t[0] != "open":
                if t[0] == "end":
                    break
                out.append(self.value(*t))
            return out
        if kind == "open" and x == "<<":
            head: dict[str, Any] = {}
            while (t := self.token())[0] == "name":
                head[t[1]] = self.value()
            return head
        if kind == "word":
            return {"true": True, "false": False}.get(x)
        return x


def heading(data: bytes, at: int) -> re.Match | None:
    """The number and generation before an "obj" at a place."""
    if data[at - 1 : at].strip() or not at or data[at + 3 : at + 4].isalnum() or data[at + 3 : at + 4] == b"_":
        return None
    begin = max(0, at - 32)
    while begin and not NOT_HEADING.search(data, begin, at):
        begin = max(0, begin - 1024)
    return HEADING.search(data, begin, at)


class Pdf:
    """The objects of a file. They are found by their own headings, so a damaged cross-reference table does no harm."""

    def __init__(self, data: bytes):
        if b"%PDF" not in data[:1024]:
            raise PdfError("no PDF heading")
        self.objects: dict[int, Any] = {}
        trailer: dict[str, Any] = {}
        bare, at = [0], 0  # where parts outside streams begin and end
        while (i := data.find(b"obj", at)) >= 0:
            at = i + 3
            if not (m := heading(data, i)):
                continue
            lexer = Lexer(data, at)
            value = lexer.value()
            if isinstance(value, dict) and (s := STREAM.match(data, lexer.at)):
                n = value.get("Length")
                end = s.end() + n if isinstance(n, int) and data[s.end() + n : s.end() + n + 20].lstrip()[:9] == b"endstream" else data.find(b"endstream", s.end())
                value = Stream(value, data[s.end() : end])
                if value.head.get("Type") == "XRef":
                    trailer |= value.head
                if end >= s.end():  # what a stream holds is no object, whatever it looks like
                    at = end
                    bare += [s.end(), end]
            self.objects[int(m[1])] = value
        bare.append(len(data))
        for x in [v for v in self.objects.values() if isinstance(v, Stream) and v.head.get("Type") == "ObjStm"]:
            body = x.data(self)
            numbers = list(map(int, body[: self.get(x.head["First"])].split()))
            for number, offset in zip(numbers[::2], numbers[1::2], strict=True):
                self.objects.setdefault(number, Lexer(body, self.get(x.head["First"]) + offset).value())
        for begin, end in zip(bare[::2], bare[1::2], strict=True):
            for m in TRAILER.finditer(data, begin, end):
                t = Lexer(data, m.end()).value()
                trailer |= t if isinstance(t, dict) else {}
        self.root = self.get(trailer.get("Root")) or next((v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        if not isinstance(self.root, dict):
            raise PdfError("no catalogue")

    def get(self, x: Any) -> Any:
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(x[0])
        return None

    def pages(self) -> Iterator[dict]:
        """Pages in order, with what they inherit."""
        stack, seen = [(self.root.get("Pages"), {})], set()
        while stack:
            ref, given = stack.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or ref in seen:
                continue
            if isinstance(ref, Ref):
                seen.add(ref)
            own = given | {k: node[k] for k in ("Resources", "MediaBox", "Rotate") if k in node}
            if "Kids" in node:
                stack += [(k, own) for k in reversed(self.get(node["Kids"]))]
            else:
                yield own | node

    def destinations(self) -> Iterator[tuple[str, int, float | None, float | None]]:
        """Named places: name, page (from 0), x and y. Only a table that the catalogue refers to is read."""
        if not isinstance(self.root.get("Dests"), Ref):
            return
        for name, d in (self.get(self.root["Dests"]) or {}).items():
            d = self.get(d)
            d = self.get(d.get("D")) if isinstance(d, dict) else d
            if isinstance(d, list) and len(d) >= 4 and isinstance(self.get(d[0]), int):
                x, y = self.get(d[2]), self.get(d[3])
                yield name, self.get(d[0]), None if x is None else float(x), None if y is None else float(y)


def times(a: Matrix, b: Matrix) -> Matrix:
    """The map that applies a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def box_of(m: Matrix, x0: float, y0: float, x1: float, y1: float) -> tuple[float, float, float, float]:
    xs = [m[0] * x + m[2] * y + m[4] for x in (x0, x1) for y in (y0, y1)]
    ys = [m[1] * x + m[3] * y + m[5] for x in (x0, x1) for y in (y0, y1)]
    return min(xs), min(ys), max(xs), max(ys)


class Font:
    def __init__(self, pdf: Pdf, head: dict):
        self.name = str(pdf.get(head.get("BaseFont")) or "Unknown").partition("+")[2] or str(pdf.get(head.get("BaseFont")) or "Unknown")
        self.ascent, self.descent, base = METRICS.get(self.name, FALLBACK)
        self.wide = pdf.get(head.get("Subtype")) == "Type0"
        first, widths = pdf.get(head.get("FirstChar")) or 0, pdf.get(head.get("Widths"))
        self.widths = {first + i: float(pdf.get(w)) for i, w in enumerate(widths)} if isinstance(widths, list) else base
        self.codes = to_unicode(pdf.get(head["ToUnicode"]).data(pdf)) if isinstance(pdf.get(head.get("ToUnicode")), Stream) else {}
        self.forward = all(w >= 0 for w in self.widths.values())
        self.letters = [self.letter(c) for c in range(256)] if self.codes and not self.wide else []
        self.advances = [] if self.wide else [self.widths.get(c, 0.0) for c in range(256)]

    def letter(self, code: int) -> str:
        return self.codes.get(code) or (CP1252[code] if code < 256 else "")

    def measure(self, data: bytes) -> tuple[str, int, float, int]:
        """Text, number of codes, total of their advances, and the number of spaces."""
        if self.wide:
            codes = [int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data) - 1, 2)]
            return "".join(map(self.letter, codes)), len(codes), sum(self.widths.get(c, 0.0) for c in codes), 0
        text = "".join(map(self.letters.__getitem__, data)) if self.codes else data.decode("cp1252", "replace")
        return text, len(data), sum(map(self.advances.__getitem__, data)), data.count(b" ")

    def glyphs(self, data: bytes) -> Iterator[tuple[str, float, bool]]:
        """Text, advance and whether it is a space, of each code."""
        step = 2 if self.wide else 1
        for i in range(0, len(data) - step + 1, step):
            code = int.from_bytes(data[i : i + step], "big")
            yield self.letter(code), self.widths.get(code, 0.0), step == 1 and code == 32


def to_unicode(data: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out |= {k: chr(int(c, 16) + k - int(a, 16)) for k in range(int(a, 16), min(int(b, 16), int(a, 16) + 65535) + 1)}
    return out


class Page:
    """Interprets a page's content. advance: each glyph is placed after the one before it."""

    def __init__(self, pdf: Pdf, page: dict, advance: bool = True):
        self.pdf, self.advance = pdf, advance
        resources = pdf.get(page.get("Resources")) or {}
        self.fonts = {k: Font(pdf, pdf.get(v)) for k, v in (pdf.get(resources.get("Font")) or {}).items() if isinstance(pdf.get(v), dict)}
        self.objects = {k: pdf.get(v) for k, v in (pdf.get(resources.get("XObject")) or {}).items()}
        self.texts: list[dict] = []
        self.images: list[dict] = []
        box = [float(pdf.get(v)) for v in pdf.get(page.get("MediaBox")) or (0, 0, 612, 792)]
        self.height = box[3] - box[1]
        turn = int(pdf.get(page.get("Rotate")) or 0) % 360
        w, h = box[2] - box[0], self.height
        shift: Matrix = (1, 0, 0, 1, -box[0], -box[1])
        self.ctm = times(shift, {90: (0, -1, 1, 0, 0, w), 180: (-1, 0, 0, -1, w, h), 270: (0, 1, -1, 0, h, 0)}.get(turn, ONE))
        self.height = w if turn in (90, 270) else h
        self.stack: list[tuple] = []
        self.font, self.size, self.char, self.word, self.scale, self.lead, self.rise = None, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0
        self.tm = self.line = ONE
        self.run: list[tuple[str, tuple]] = []
        if resources:
            content = pdf.get(page.get("Contents"))
            for x in content if isinstance(content, list) else [content]:
                if isinstance(x := pdf.get(x), Stream):
                    self.interpret(x.data(pdf))

    def interpret(self, data: bytes) -> None:
        lexer, operands = Lexer(data), []
        while (t := lexer.token())[0] != "end":
            if t[0] == "word" and t[1] not in ("true", "false", "null"):
                if t[1] == "BI":
                    end = data.find(b"EI", lexer.at)
                    lexer.at = end + 2 if end >= 0 else len(data)
                if t[1] in OPERATORS:
                    try:
                        self.apply(t[1], operands)
                    except (IndexError, TypeError, ValueError, KeyError, AttributeError):
                        pass  # as a viewer does, go on with the next operator
                operands = []
            else:
                operands.append(lexer.value(*t))

    def apply(self, op: str, x: list) -> None:
        if op == "q":
            self.stack.append((self.ctm, self.font, self.size, self.char, self.word, self.scale, self.lead, self.rise))
        elif op == "Q":
            if self.stack:
                self.ctm, self.font, self.size, self.char, self.word, self.scale, self.lead, self.rise = self.stack.pop()
        elif op == "cm":
            self.ctm = times(tuple(map(float, x[-6:])), self.ctm)
        elif op == "BT":
            self.tm = self.line = ONE
            self.run = []
        elif op == "ET":
            self.finish()
        elif op == "Tf":
            self.font, self.size = self.fonts.get(x[0]), float(x[1])
        elif op in ("Tc", "Tw", "TL", "Ts"):
            setattr(self, {"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise"}[op], float(x[0]))
        elif op == "Tz":
            self.scale = float(x[0]) / 100
        elif op == "Tm":
            self.tm = self.line = tuple(map(float, x[-6:]))
        elif op in ("Td", "TD", "T*"):
            a, b = (0.0, -self.lead) if op == "T*" else (float(x[0]), float(x[1]))
            if op == "TD":
                self.lead = -b
            self.tm = self.line = times((1, 0, 0, 1, a, b), self.line)
        elif op in ("Tj", "'", '"'):
            if op == '"':
                self.word, self.char = float(x[0]), float(x[1])
            self.show(x[-1])
        elif op == "TJ":
            for part in x[0]:
                if isinstance(part, bytes):
                    self.show(part)
                elif self.advance:
                    self.tm = times((1, 0, 0, 1, -part / 1000 * self.size * self.scale, 0), self.tm)
        elif op == "Do":
            self.draw(self.objects.get(x[0]))

    def draw(self, x: Any) -> None:
        if not isinstance(x, Stream):
            return
        if self.pdf.get(x.head.get("Subtype")) == "Image":
            a, b = self.ctm[4], self.ctm[5]
            self.images.append({"box": (a, b, a + 100, b + 100), "image": x.raw})

    def show(self, data: bytes) -> None:
        if self.font is None or not isinstance(data, bytes):
            return
        if self.advance and self.font.forward and min(self.size, self.scale, self.char, self.char + self.word) >= 0:  # boxes follow each other, so the first and last are the ends
            text, n, total, spaces = self.font.measure(data)
            if n:
                ahead = (total / 1000 * self.size + n * self.char + spaces * self.word) * self.scale
                end = ahead - (self.char + (self.word if spaces and data[-1:] == b" " else 0)) * self.scale
                low, high = sorted((self.font.descent / 1000 * self.size + self.rise, self.font.ascent / 1000 * self.size + self.rise))
                self.run.append((text, box_of(times(self.tm, self.ctm), 0, low, end, high)))
                self.tm = times((1, 0, 0, 1, ahead, 0), self.tm)
            return
        for text, width, space in self.font.glyphs(data):
            at = times((self.size * self.scale, 0, 0, self.size, 0, self.rise), times(self.tm, self.ctm))
            self.run.append((text, box_of(at, 0, self.font.descent / 1000, width / 1000, self.font.ascent / 1000)))
            if self.advance:
                self.tm = times((1, 0, 0, 1, (width / 1000 * self.size + self.char + (self.word if space else 0)) * self.scale, 0), self.tm)

    def finish(self) -> None:
        if self.run and self.font is not None:
            boxes = [b for _, b in self.run]
            self.texts.append({"text": "".join(t for t, _ in self.run), "font": self.font.name, "size": self.size, "box": (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))})
        self.run = []

    def runs(self, near: float = 5.0) -> list[dict]:
        """Texts joined along their baselines: near in y to the first, of one font, and of a size within 0.1."""
        groups: list[list[dict]] = []
        for t in sorted(self.texts, key=lambda t: (-t["box"][1], t["box"][0])):
            g = groups[-1][0] if groups else None
            if g is not None and abs(g["box"][1] - t["box"][1]) < near and g["font"] == t["font"] and abs(g["size"] - t["size"]) < 0.1:
                groups[-1].append(t)
            else:
                groups.append([t])
        out = []
        for g in groups:
            g.sort(key=lambda t: t["box"][0])
            box = [t["box"] for t in g]
            out.append({"text": "".join(t["text"] for t in g), "font": g[0]["font"], "size": g[0]["size"], "box": (min(b[0] for b in box), min(b[1] for b in box), max(b[2] for b in box), max(b[3] for b in box))})
        return out

    def elements(self) -> Iterator[dict]:
        """Images, then texts, with y growing downwards from the page's top."""
        for e in [*self.images, *self.runs()]:
            x0, y0, x1, y1 = e["box"]
            yield e | {"box": (x0, self.height - y1, x1, self.height - y0)}


def file_elements(data: bytes, advance: bool = True) -> Iterator[tuple]:
    """doc_idx, text_row, page_number, kind, text, font_name, font_size, x0, y0, x1, y1 and image of a file's elements."""
    pdf = Pdf(data)
    idx = row = 0
    for number, page in enumerate(pdf.pages(), 1):
        for e in Page(pdf, page, advance).elements():
            if "text" in e:
                yield idx, row, number, "text", e["text"], e["font"], float(e["size"]), *e["box"], None
                row += 1
            else:
                yield idx, None, number, "image", None, None, None, *e["box"], e["image"]
            idx += 1


RAW = "doc_id bigint, doc_idx int, text_row int, page_number int, kind string, text string, font_name string, font_size double, x0 double, y0 double, x1 double, y1 double, image binary"


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """doc_id (a hash of the path), path and content of each file. A path that doesn't exist raises an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(F.xxhash64("path").alias("doc_id"), "path", "content")


MOST_ROWS, MOST_BYTES = 4096, 1 << 23  # of a batch of elements; one file's elements stay together


def _arrow(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def read(loaded: DataFrame, advance: bool = True, skip_broken: bool = False) -> DataFrame:
    """The elements of loaded files (doc_id and content). A broken file, or one without content, is an error, or with skip_broken
    has no elements and is named by ``broken``."""
    kind = loaded.schema["doc_id"].dataType.simpleString()
    ddl = RAW.replace("doc_id bigint", f"doc_id {kind}")

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = content.as_py()
                try:
                    rows += [(doc_id, *r) for r in file_elements(content, advance)]
                    held += len(content)
                except Exception:  # whatever a malformed file leads to
                    if not skip_broken:
                        raise
                if len(rows) >= MOST_ROWS or held >= MOST_BYTES:
                    yield _arrow(rows, ddl)
                    rows, held = [], 0
        yield _arrow(rows, ddl)

    return loaded.select("doc_id", "content").mapInArrow(run, ddl).withColumn("font_canon", canonical_font(F.col("font_name"))).select(*ELEMENT_COLUMNS)


def broken(loaded: DataFrame) -> DataFrame:
    """doc_id and error of the loaded files that can't be read."""
    ddl = f"doc_id {loaded.schema['doc_id'].dataType.simpleString()}, error string"

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    for _ in file_elements(content, True):
                        pass
                except Exception as e:
                    rows.append((doc_id, f"{type(e).__name__}: {e}"))
            yield _arrow(rows, ddl)

    return loaded.select("doc_id", "content").mapInArrow(run, ddl)


def destinations(loaded: DataFrame) -> DataFrame:
    """The named places of loaded files."""

    def run(batches):
        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _arrow([(doc_id, *d) for d in Pdf(content).destinations()], DESTINATIONS)

    return loaded.select("doc_id", "content").mapInArrow(run, DESTINATIONS)


def process_pdf_file(spark: SparkSession, path: str, template_path: str) -> str:
    """The JSON output of one file and a template file."""
    from foliospark.operators import output

    with open(template_path, encoding="utf-8") as f:
        template = f.read()
    rows = output.document_json(output.outputs(read(files(spark, path, "*")), template)).select("json").first()
    return rows[0] if rows else "[]"
