"""Column layouts shared by sources and operators.

An element is one positioned run of text or one image of a document. Every operator carries ``doc_id`` in its
keys, so one plan serves a whole corpus.
"""

ELEMENTS = (
    "doc_id bigint, doc_idx int, text_row int, page_number int, kind string, text string, font_name string, font_canon string, "
    "font_size double, x0 double, y0 double, x1 double, y1 double, image binary"
)
DESTINATIONS = "doc_id bigint, name string, page int, x double, y double"
ELEMENT_COLUMNS = [c.split()[0] for c in ELEMENTS.split(", ")]
