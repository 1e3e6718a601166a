"""Plain text of selected HTML elements of stored web pages.

The default elements, which do not nest, go through native regex expressions; any other list goes
through an HTML parser in Arrow batches. An element inside another selected one counts both for
itself and in the outer one's text.

Native steps per page (all JVM-side, map-only): drop comments/scripts/styles; make implied paragraph
ends explicit (a ``<p>``/heading/block end closes an open ``<p>``); extract every selected
element in document order; per element turn tags into spaces, decode entities (``&amp;``
last), collapse whitespace and trim; drop empty texts; join with one space.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default element list and the entities decoded (``&amp;`` must be last).
DEFAULT_ELEMENTS = ("h1", "h2", "p")
ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"),
            ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))

# HTML elements without content, without text, that end an open paragraph, that
# end their like, and that such ends do not reach out of.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr"}
SILENT = {"script", "style"}
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form",
          "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre",
          "section", "table", "ul"}
BLOCK_ENDS = ("p",)
IMPLIED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
              "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"ul", "ol", "table", "div", "article", "section", "body", "dl", "select"}

DROP_PATTERN = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
IMPLIED_END = r"(?i)(<p[\s>]|<h[1-6][\s>]|</(?:article|div|body|section|main)>|<footer[\s>])"


def element_pattern(elements=DEFAULT_ELEMENTS) -> str:
    names = "|".join(elements)
    return rf"(?is)<(?:{names})(?:\s[^>]*)?>.*?</(?:{names})>"


def decode_entities(c: Column) -> Column:
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def element_texts(html, elements=DEFAULT_ELEMENTS) -> Column:
    """``array<string>``: text of every matched element, in document order."""
    html = F.col(html) if isinstance(html, str) else html
    cleaned = F.regexp_replace(html, DROP_PATTERN, "")
    closed = F.concat(F.regexp_replace(cleaned, IMPLIED_END, "</p>$1"), F.lit("</p>"))
    matches = F.regexp_extract_all(closed, F.lit(element_pattern(elements)), 0)
    texts = F.transform(matches, lambda m: F.trim(F.regexp_replace(
        decode_entities(F.regexp_replace(m, r"<[^>]*>", " ")), r"\s+", " ")))
    return F.filter(texts, lambda t: t != F.lit(""))


def html_text_col(html, elements=DEFAULT_ELEMENTS) -> Column:
    return F.array_join(element_texts(html, elements), " ")


class _Texts(HTMLParser):
    """Texts of the selected elements of one page, in the order in which they begin."""

    def __init__(self, elements):
        super().__init__(convert_charrefs=True)
        self.wanted = {e.lower() for e in elements}
        self.open: list[tuple[str, int | None]] = []    # name, number of its text
        self.texts: list[list[str]] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            self._add(" ")
            return
        ends = IMPLIED_BY.get(tag, BLOCK_ENDS if tag in BLOCKS else ())
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in ends:
                del self.open[k:]
                break
            if self.open[k][0] in SCOPES:
                break
        self._add(" ")
        number = None
        if tag in self.wanted:
            number = len(self.texts)
            self.texts.append([])
        self.open.append((tag, number))
        self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.silent -= sum(name in SILENT for name, _ in self.open[k:])
                del self.open[k:]
                break
        self._add(" ")

    def handle_data(self, data):
        if not self.silent:
            self._add(data)

    def _add(self, data):
        for _, number in self.open:
            if number is not None:
                self.texts[number].append(data)


def parsed_texts(html: str | None, elements) -> list[str]:
    """Non-empty texts of the selected elements of a page, white space collapsed."""
    parser = _Texts(elements)
    parser.feed(html or "")
    parser.close()
    return [t for t in (" ".join("".join(x).split()) for x in parser.texts) if t]


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
              elements=DEFAULT_ELEMENTS) -> DataFrame:
    """(id, text) for every stored page."""
    elements = tuple(elements)
    if elements == DEFAULT_ELEMENTS:
        return pages.select(id_col, html_text_col(html_col, elements).alias("text"))

    def run(batches):
        for batch in batches:
            texts = [" ".join(parsed_texts(h, elements)) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())],
                                             names=["id", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), html_col).mapInArrow(
        run, f"id {kind}, text string").withColumnRenamed("id", id_col)
