"""Scalar functions as Columns: text similarity, font names, rectangles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def similarity(a: Column, b: Column) -> Column:
    """Normalised Levenshtein similarity over characters; 1 for two empty texts."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def similar_enough(a: Column, b: Column, threshold: float, length: int | None = None) -> Column:
    """Whether the similarity is at least the threshold; lengths are compared first, which rules out most rows cheaply.

    length: that of b, if it is known; then distances are only followed as far as they matter."""
    la, lb = F.char_length(a), F.char_length(b)
    near = F.abs(la - lb) <= (1 - threshold) * F.greatest(la, lb) + 1e-9
    if length is None or not 0 < threshold <= 1:
        return near & (similarity(a, b) >= threshold)
    longest, most = F.greatest(la, lb), math.floor((1 - threshold) * math.ceil(length / threshold) + 1e-9) + 1
    distance = F.levenshtein(a, b, most)
    return near & ((longest == 0) | (distance >= 0) & (1 - distance / longest >= threshold))


_TIMES = {"Bold": "Times-Bold", "BoldItalic": "Times-BoldItalic", "Italic": "Times-Italic", "": "Times-Roman"}
_ARIAL = {"Bold": "Helvetica-Bold", "BoldItalic": "Helvetica-BoldItalic", "Italic": "Helvetica-Oblique", "": "Helvetica"}


def _variants(rest: Column, names: dict[str, str]) -> Column:
    out = rest
    for key, name in names.items():
        out = F.when(rest == key, F.lit(name)).otherwise(out)
    return out


def canonical_font(name: Column) -> Column:
    """Standard name of a font; a null name has none."""
    times = F.regexp_replace(F.regexp_replace(F.substring(name, 16, 1 << 30), "MT$", ""), "^-+", "")
    arial = F.regexp_replace(F.substring(name, 6, 1 << 30), "^-+", "")
    return (
        F.when(name.startswith("TimesNewRomanPS"), _variants(times, _TIMES))
        .when(name.startswith("Arial"), _variants(arial, _ARIAL))
        .when(name == "CourierNew", F.lit("Courier"))
        .when(name == "CourierNew-Bold", F.lit("Courier-Bold"))
        .otherwise(name)
    )


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def rect_union(a: Column, b: Column) -> Column:
    return rect(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))


def rect_expand(r: Column, by: Column | float) -> Column:
    return rect(r.x0 - by, r.y0 - by, r.x1 + by, r.y1 + by)


def transform_point(m: list[Column | float], x: Column, y: Column) -> Column:
    """m: the six numbers a, b, c, d, e, f of an affine map."""
    a, b, c, d, e, f = (F.lit(v) if not isinstance(v, Column) else v for v in m)
    return F.struct((a * x + c * y + e).alias("x"), (b * x + d * y + f).alias("y"))


def transform_rect(m: list[Column | float], r: Column) -> Column:
    """The box around a mapped rectangle."""
    corners = [transform_point(m, x, y) for x in (r.x0, r.x1) for y in (r.y0, r.y1)]
    xs, ys = [c.x for c in corners], [c.y for c in corners]
    return rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def score_colour(score: Column) -> Column:
    """From red over yellow to green, as r, g, b of 0 to 255."""
    s = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return F.struct((255 * F.least(F.lit(1.0), 2 * (1 - s))).cast("int").alias("r"), (255 * F.least(F.lit(1.0), 2 * s)).cast("int").alias("g"), F.lit(0).alias("b"))
