"""The one Arrow pass over HTML.

``html.parser`` events are folded into the fields the jobs need; no tree is built. Tags nest as they are
written: an end tag closes the nearest open element of its name and everything inside it, an end tag
without one is ignored, void elements never stay open.
"""

import html.entities
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from yomisaku.functions.text import map_texts

# Elements without content, elements whose text is no text, and the selectors of each field
# in order of priority. A selector is (tag, class, id, inside tag).
VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr "
                 "basefont bgsound command frame image isindex nextid spacer".split())
SILENT = frozenset(("script", "style", "noscript", "rt", "rp"))  # the last two annotate characters
NOT_BODY = SILENT | {"nav", "header", "footer", "aside"}
TITLE_SELECTORS = (("h1", "c--entry-title", None, None), ("h1", "entry-title", None, None),
                   ("h1", None, None, "article"), ("h1", None, None, None), ("title", None, None, None))
BODY_SELECTORS = (("article", "jinr-article", None, None), ("article", None, None, None),
                  ("main", None, None, None), (None, "entry-content", None, None),
                  (None, None, "content", None), ("body", None, None, None))
NOT_WIDGET = (("main", None, None, None), ("article", None, None, None), (None, "entry-content", None, None),
              (None, None, "content", None), (None, "post-content", None, None), (None, "entry", None, None),
              (None, None, "main", None))

PAGE_FIELDS = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("widget_text", T.StringType()),
    T.StructField("json_ld", T.ArrayType(T.StringType())),
    T.StructField("meta_published", T.StringType()),
    T.StructField("meta_modified", T.StringType()),
    T.StructField("time_published", T.StringType()),
    T.StructField("hrefs", T.ArrayType(T.StringType())),
])


def squeeze(pieces: list[str]) -> str:
    return " ".join(" ".join(pieces).split())


class TextEvents(HTMLParser):
    """Turns markup into text nodes; subclasses watch the open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open = []       # tag names
        self.buffer = []     # pieces of the text node being read
        self.silent = 0      # open elements whose text is dropped
        self.foreign = 0     # open templates, whose text belongs to no element around them

    def read(self, markup: str):
        self.feed(markup)
        self.close()
        self.end_text()
        return self

    def end_text(self):
        if self.buffer:
            node = "".join(self.buffer).strip()
            self.buffer = []
            if node and not self.foreign:
                self.on_text(node)

    def handle_starttag(self, tag, attrs):
        self.end_text()
        self.on_open(tag, {k: v or "" for k, v in attrs})
        if tag in VOID:
            self.on_close(tag)
            return
        self.open.append(tag)
        self.silent += tag in SILENT
        self.foreign += tag == "template"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.end_text()
        if tag not in self.open:
            return
        while True:
            closed = self.open.pop()
            self.silent -= closed in SILENT
            self.foreign -= closed == "template"
            self.on_close(closed)
            if closed == tag:
                return

    def handle_data(self, data):
        self.buffer.append(data)

    def handle_charref(self, name):
        try:
            code = int(name[1:], 16) if name[:1] in "xX" else int(name)
            char = bytes([code]).decode("windows-1252") if code < 256 else chr(code)
        except UnicodeDecodeError:  # one of the few codes that windows-1252 leaves open
            char = chr(code)
        except (ValueError, OverflowError):
            char = "�"
        self.buffer.append(char)

    def handle_entityref(self, name):
        self.buffer.append(html.entities.html5.get(name + ";") or "&" + name)

    def handle_comment(self, data):
        self.end_text()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self.end_text()
        if data.upper().startswith("CDATA["):
            self.buffer.append(data[len("CDATA["):])
            self.end_text()

    def on_open(self, tag, attrs):
        pass

    def on_close(self, tag):
        pass

    def on_text(self, node):
        raise NotImplementedError


class PlainText(TextEvents):
    def __init__(self):
        super().__init__()
        self.pieces = []

    def on_text(self, node):
        if not self.silent:
            self.pieces.append(node)


def selected(selector, tag, classes, element_id, open_tags) -> bool:
    want_tag, want_class, want_id, inside = selector
    return ((want_tag is None or tag == want_tag)
            and (want_class is None or want_class in classes)
            and (want_id is None or element_id == want_id)
            and (inside is None or inside in open_tags))


class PageFields(TextEvents):
    """Collects every field of ``PAGE_FIELDS`` in one reading."""

    def __init__(self):
        super().__init__()
        self.marks = []                           # per open element: (bodies, titles, hides body, hides widget)
        self.titles = [None] * len(TITLE_SELECTORS)
        self.bodies = [None] * len(BODY_SELECTORS)
        self.open_titles, self.open_bodies = [], []
        self.whole, self.widget = [], []
        self.body_hidden = self.widget_hidden = 0
        self.json_ld, self.hrefs = [], []
        self.ld_text = None
        self.meta = {}
        self.time = None

    def on_open(self, tag, attrs):
        classes, element_id = attrs.get("class", "").split(), attrs.get("id")
        if tag == "a" and "href" in attrs:
            self.hrefs.append(attrs["href"])
        elif tag == "meta" and "property" in attrs:
            self.meta.setdefault(attrs["property"], attrs.get("content", ""))
        elif tag == "time" and self.time is None and "datetime" in attrs:
            self.time = attrs["datetime"]
        titles = self._claim(self.titles, TITLE_SELECTORS, tag, classes, element_id)
        hides_body = tag in NOT_BODY
        self.body_hidden += hides_body
        bodies = [] if self.body_hidden else self._claim(
            self.bodies, BODY_SELECTORS, tag, classes, element_id)
        hides_widget = any(selected(s, tag, classes, element_id, self.open) for s in NOT_WIDGET)
        self.widget_hidden += hides_widget
        if tag == "script" and attrs.get("type") == "application/ld+json":
            self.ld_text = []
        self.open_titles += titles
        self.open_bodies += bodies
        self.marks.append((len(bodies), len(titles), hides_body, hides_widget))

    def _claim(self, found, selectors, tag, classes, element_id):
        """Start a text list for every selector whose first hit this element is."""
        claimed = []
        for i, selector in enumerate(selectors):
            if found[i] is None and selected(selector, tag, classes, element_id, self.open):
                found[i] = []
                claimed.append(found[i])
        return claimed

    def on_close(self, tag):
        n_bodies, n_titles, hides_body, hides_widget = self.marks.pop()
        if n_bodies:
            del self.open_bodies[-n_bodies:]
        if n_titles:
            del self.open_titles[-n_titles:]
        self.body_hidden -= hides_body
        self.widget_hidden -= hides_widget
        if tag == "script" and self.ld_text is not None:
            self.json_ld.append("".join(self.ld_text))
            self.ld_text = None

    def on_text(self, node):
        if self.ld_text is not None:
            self.ld_text.append(node)
        if "script" not in self.open and "style" not in self.open:
            for pieces in self.open_titles:
                pieces.append(node)
        if not self.body_hidden:
            self.whole.append(node)
            for pieces in self.open_bodies:
                pieces.append(node)
        if not self.silent and not self.widget_hidden:
            self.widget.append(node)

    def row(self):
        title = next((t for t in self.titles if t is not None), [])
        body = next((b for b in self.bodies if b is not None), self.whole)
        return ("".join(title), squeeze(body), squeeze(self.widget), self.json_ld,
                self.meta.get("article:published_time"), self.meta.get("article:modified_time"),
                self.time, self.hrefs)


@arrow_udf(T.StringType())
def _plain_text(markup: pa.Array) -> pa.Array:
    return map_texts(markup, lambda m: squeeze(PlainText().read(m).pieces))


@pandas_udf(PAGE_FIELDS)
def _page_fields(markup: pd.Series) -> pd.DataFrame:
    rows = [PageFields().read(m or "").row() for m in markup]
    return pd.DataFrame(rows, columns=PAGE_FIELDS.names)


def html_to_text(markup: Column) -> Column:
    """Text of an HTML fragment: script, style and noscript dropped, whitespace squeezed; NULL gives ''.

    Fragments without a tag or an entity never leave the JVM.
    """
    plain = F.trim(F.regexp_replace(markup, r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+", " "))
    return F.coalesce(_plain_text(F.when(markup.rlike("[<&]"), markup)), plain, F.lit(""))


def page_fields(markup: Column) -> Column:
    """All fields of a page, as a struct, from one reading of its HTML."""
    return _page_fields(markup)
