"""Small documents for tests: texts of a given size and place, images, and PDF files."""

from __future__ import annotations

from foliospark.functions import canonical_font
from foliospark.schema import ELEMENT_COLUMNS, ELEMENTS

RAW = ELEMENTS.replace("font_canon string, ", "")


def elements(spark, rows, doc_id=1):
    """rows: text (None for an image), size, x, y, and page and font if not 1 and Arial."""
    out, row = [], 0
    for idx, (text, size, x, y, *rest) in enumerate(rows):
        page, font = (*rest, *(1, "Arial")[len(rest) :])
        if text is None:
            out.append((doc_id, idx, None, page, "image", None, None, None, float(x), float(y), x + 200.0, y + 100.0, bytearray(b"img")))
        else:
            out.append((doc_id, idx, row, page, "text", text, font, float(size), float(x), float(y), float(x + 8 * len(text.encode())), float(y + size), None))
            row += 1
    df = spark.createDataFrame(out, RAW)
    return df.withColumn("font_canon", canonical_font(df["font_name"])).select(*ELEMENT_COLUMNS)


def pdf(lines, font="Helvetica", image=False, media="0 0 612 792", dests=False):
    """One page with a BT..ET block for each (text, size, x, y)."""
    body = b"".join(f"BT /F1 {size} Tf {x} {y} Td ({text}) Tj ET\n".encode() for text, size, x, y in lines) + (b"q 1 0 0 1 50 500 cm /I1 Do Q\n" if image else b"")
    parts = [
        b"<< /Type /Catalog /Pages 2 0 R" + (b" /Dests 7 0 R" if dests else b"") + b" >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [" + media.encode() + b"] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> /XObject << /I1 6 0 R >> >> >>",
        b"<< /Length %d >>\nstream\n" % len(body) + body + b"\nendstream", b"<< /Type /Font /Subtype /Type1 /BaseFont /" + font.encode() + b" >>",
        b"<< /Type /XObject /Subtype /Image /Length 3 >>\nstream\nxyz\nendstream", b"<< /start [0 /XYZ 50 700 0] >>",
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % (i + 1) + p + b"\nendobj\n" for i, p in enumerate(parts)) + b"trailer << /Root 1 0 R >>\n%%EOF"
