"""Pages read once: title, visible text and anchors from one pass of a scanner over the markup.

The scanner has few states (text, tag, dropped element) and never goes back, so a page of
any size and shape costs one pass.  The column functions run over Arrow batches.
"""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from recordweave.functions.slices import by_slices

#: Elements whose content is no text of the page; those in RAW hold no tags but their own end.
DROPPED, RAW = {"script", "style", "noscript", "svg"}, {"script", "style"}
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_HREF = re.compile(r"""(?:^|[\s"'/])href\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", re.I)


def _space(parts: list[str]) -> str:
    return " ".join(unescape(" ".join(parts)).split())


class Scan:
    """title, text and anchors (raw href and label, in order) of a page.

    Comments, declarations and dropped elements are no text; entities are characters; a tag
    parts words.  An anchor's label goes on to its end tag, to the next anchor or to the end
    of the page, whatever tags lie in it.  The title is the first that isn't empty, else the
    first heading's text.  A tag without its end is text to the end of the page.
    """

    def __init__(self, html: str):
        self.text: list[str] = []
        self.anchors: list[tuple[str, str]] = []
        self._open: tuple[str, int] | None = None
        #: Of a title or first heading that is being read, where its text begins.
        self._from: dict[str, int] = {}
        self._found: dict[str, str] = {}
        self._read(html)
        self._end_anchor()
        for name in list(self._from):
            self._end_heading(name)

    @property
    def title(self) -> str:
        return self._found.get("title") or self._found.get("h1") or ""

    def _end_anchor(self) -> None:
        if self._open:
            href, start = self._open
            self.anchors.append((href, _space(self.text[start:]).lower()))
            self._open = None

    def _end_heading(self, name: str) -> None:
        if name in self._from:
            self._found[name] = self._found.get(name) or _space(self.text[self._from.pop(name) :])

    def _read(self, html: str) -> None:
        at, dropped, depth, quotes = 0, "", 0, True
        while at < len(html):
            tag = html.find("<", at)
            if tag < 0:
                tag = len(html)
            if tag > at and not dropped:
                self.text.append(html[at:tag])
            if tag == len(html):
                return
            if html.startswith("<!--", tag):
                end = html.find("-->", tag + 4)
                at = len(html) if end < 0 else end + 3
                continue
            name = _NAME.match(html, tag)
            if not name:
                if html[tag + 1 : tag + 2] in ("!", "?"):
                    end = html.find(">", tag)
                    at = len(html) if end < 0 else end + 1
                else:
                    if not dropped:
                        self.text.append("<")
                    at = tag + 1
                continue
            end = _QUOTED.match(html, name.end()) if quotes else None
            if end is None:
                # A quote that never ends: from here on quotes mean nothing, and no part is read twice.
                quotes = False
                close = html.find(">", name.end())
                if close < 0:
                    if not dropped:
                        self.text.append(html[tag:])
                    return
                stop = close + 1
            else:
                stop = end.end()
            closing, word, at = html[tag + 1] == "/", name[1].lower(), stop
            if dropped:
                if word == dropped:
                    depth += -1 if closing else 1
                    if not depth:
                        dropped = ""
                continue
            if word in DROPPED and not closing and html[stop - 2] != "/":
                if word in RAW:
                    end = re.compile(f"</{word}", re.I).search(html, stop)
                    at = html.find(">", end.end()) + 1 if end else len(html)
                    at = at or len(html)
                else:
                    dropped, depth = word, 1
                continue
            if word == "a":
                self._end_anchor()
                href = _HREF.search(html, name.end(), stop - 1) if not closing else None
                if href:
                    self._open = unescape(href[1].strip("\"'")).strip(), len(self.text)
            elif word in ("title", "h1"):
                if closing:
                    self._end_heading(word)
                elif word not in self._from and not self._found.get(word):
                    self._from[word] = len(self.text)


def _resolved(href: str, base: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:
        return href


_ANCHORS = ArrayType(StructType([StructField("href", StringType()), StructField("label", StringType())]))
_PAIR = pa.struct([("href", pa.string()), ("label", pa.string())])
_READ = StructType([StructField("title", StringType()), StructField("text", StringType())])


def _of(html: pa.Scalar) -> Scan:
    return Scan(html.as_py() or "")


@F.arrow_udf(StringType())
def _title(html: pa.Array) -> pa.Array:
    return by_slices(lambda part: pa.array([_of(h).title for h in part], pa.string()), html)


@F.arrow_udf(StringType())
def _text(html: pa.Array) -> pa.Array:
    return by_slices(lambda part: pa.array([_space(_of(h).text) for h in part], pa.string()), html)


@F.arrow_udf(_READ)
def _read(html: pa.Array) -> pa.Array:
    def made(part: pa.Array) -> pa.Array:
        title, text = [], []
        for h in part:
            scan = _of(h)
            title.append(scan.title)
            text.append(_space(scan.text))
        return pa.StructArray.from_arrays([pa.array(title, pa.string()), pa.array(text, pa.string())], ["title", "text"])

    return by_slices(made, html)


@F.arrow_udf(_ANCHORS)
def _linked(html: pa.Array, base: pa.Array) -> pa.Array:
    def made(html: pa.Array, base: pa.Array) -> pa.Array:
        rows = [[{"href": _resolved(x, b.as_py() or ""), "label": y} for x, y in _of(h).anchors] for h, b in zip(html, base, strict=True)]
        return pa.array(rows, pa.list_(_PAIR))

    return by_slices(made, html, base)


_PAGE = StructType([StructField("title", StringType()), StructField("text", StringType()), StructField("anchors", _ANCHORS)])


@F.arrow_udf(_PAGE)
def _page(html: pa.Array, base: pa.Array) -> pa.Array:
    def made(html: pa.Array, base: pa.Array) -> pa.Array:
        scans = list(map(_of, html))
        links = [[{"href": _resolved(x, b.as_py() or ""), "label": y} for x, y in scan.anchors] for scan, b in zip(scans, base, strict=True)]
        return pa.StructArray.from_arrays([pa.array([x.title for x in scans], pa.string()), pa.array([_space(x.text) for x in scans], pa.string()), pa.array(links, pa.list_(_PAIR))], ["title", "text", "anchors"])

    return by_slices(made, html, base)


def title(html: Column) -> Column:
    """The title of a page, else its first heading; empty if it has neither or is null."""
    return _title(html)


def text(html: Column) -> Column:
    """The visible text of a page; that of a null page is empty."""
    return _text(html)


def read(html: Column) -> Column:
    """struct(title, text) of a page from one scan."""
    return _read(html)


def anchors(html: Column, base: Column) -> Column:
    """array<struct<href, label>> of a page, hrefs resolved against base."""
    return _linked(html, base)


def page(html: Column, base: Column | None = None) -> Column:
    """struct(title, text, anchors array<struct<href, label>>) of a page; hrefs are resolved against base.  A null page is empty."""
    return _page(html, F.lit("") if base is None else base)
