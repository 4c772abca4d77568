"""Main text of web pages by the line-block distribution.

Markup is stripped into lines, one for each block of the page. Elements that never hold main text go with the markup: scripts,
styles, forms, navigation, asides, footers, headers outside an article, and elements whose class, id or role says as much. Every
line that is left has a mass: the length of its text that is not linked. Where a page has content containers (``article``,
``main``) with text, their lines weigh ``threshold`` more, so that a short one is enough, and lines outside weigh nothing.

Over the masses the distribution is drawn, the sums over sliding windows of ``window`` lines. It surges where a window that
begins with a line of mass exceeds ``threshold``, and dives where a window holds nothing. The text is what lies between each
surge and its dive, and the headings that lead to a surge; lines without mass between two containers are not part of it. If
nothing surges, the few lines of the page are its text.

A null or empty page, and one without text, gives an empty text. Comments, scripts and styles that never end go on to the end
of the page; a tag that never ends is text. Repeated rows give repeated results; a page is read whole, in time that grows with its length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, text string, n_chars long"
_RAW = frozenset("script style noscript template textarea iframe svg math object select title".split())
_BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that close themselves where another of their kind begins; they never nest, and their end tags are optional.
_OPEN_ENDED = frozenset("p li dd dt td th tr option".split())
_NEVER = frozenset("nav aside footer form menu dialog button label select option fieldset".split())
_CONTENT = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class names: of things that are never main text, also around an article of their own; of parts of the layout,
#: which an article may lie in; and words beside which neither says anything.
_THINGS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr popup modal overlay comment comments reply replies disqus share sharing social related recommended recommendations newsletter subscribe signup breadcrumb breadcrumbs pagination pager".split())
_LAYOUT = frozenset("nav navbar navigation menu header masthead footer sidebar side banner widget widgets alert notice notices search login toolbar complementary contentinfo".split())
_NEITHER = frozenset("no not non has have with without is by level free".split())
_PART = re.compile(r"[a-z0-9]+")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in _RAW}
_HEAD_END = re.compile(r"</head\b[^>]*>|(?=<body\b)", re.I)


def marked(value: str) -> str:
    """"thing" or "layout" if a class, id or role names one of those in a whole word: alone, last, or first of two parts."""
    found = ""
    for token in value.lower().split():
        parts = _PART.findall(token)
        if not parts or _NEITHER & set(parts):
            continue
        named = {parts[-1]} | ({parts[0]} if len(parts) == 2 else set())
        if named & _THINGS:
            return "thing"
        if parts[-1] in _LAYOUT or named & {"nav", "navbar", "menu", "sidebar", "footer", "widget"}:
            found = "layout"
    return found


@dataclass
class Line:
    text: str
    inside: bool
    linked: int
    heading: bool


class _Lines:
    """The lines of a page that may be main text, from its tags in order. The open elements are a stack with the places of each name
    beside it, so that a tag costs no more than what it opens or closes."""

    def __init__(self):
        self.rows: list[Line] = []
        self.parts: list[str] = []
        self.linked = 0
        self.stack: list[tuple[str, str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.barriers: list[int] = []  # places of content and noise
        self.hard = self.soft = self.content = self.links = self.titles = 0

    def text(self, piece: str) -> None:
        if not self.hard and not self.soft:
            self.parts.append(piece)
            if self.links:
                self.linked += len(piece.strip())

    def end(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                self.rows.append(Line(text, self.content > 0, min(self.linked, len(text)), self.titles > 0))
            self.parts, self.linked = [], 0

    def _kind(self, name: str, attributes: str) -> str:
        if name in _NEVER or name == "header" and not self.content:
            return "hard"
        found, hidden = "", False
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "role"):
                found = max(found, marked(value), key=("", "layout", "thing").index)
            elif key == "hidden" and value.lower() != "false":
                hidden = True
        if name in _CONTENT:
            return "hard" if found == "thing" or hidden else "content"
        if name in ("body", "html"):
            return ""
        if found == "layout" and self.content and _words(attributes) <= {"header", "masthead"}:
            found = ""  # the header of an article
        return "hard" if found == "thing" or hidden else "soft" if found else ""

    def open(self, name: str, attributes: str) -> None:
        if name in _OPEN_ENDED and self.stack and self.stack[-1][0] == name:
            self._pop()
        kind = self._kind(name, attributes) if attributes or name in _NEVER or name == "header" or name in _CONTENT else ""
        if name in _VOID or attributes.endswith("/"):
            return
        self.places.setdefault(name, []).append(len(self.stack))
        if kind:
            self.barriers.append(len(self.stack))
        self.stack.append((name, kind, self.soft))
        self.links += name == "a"
        self.titles += name in _HEADINGS
        self.hard += kind == "hard"
        self.soft = 0 if kind == "content" else self.soft + (kind == "soft")
        self.content += kind == "content"

    def _pop(self) -> None:
        name, kind, soft = self.stack.pop()
        self.places[name].pop()
        if kind:
            self.barriers.pop()
        self.links -= name == "a"
        self.titles -= name in _HEADINGS
        self.hard -= kind == "hard"
        self.content -= kind == "content"
        if kind in ("content", "soft"):
            self.soft = soft

    def close(self, name: str) -> None:
        places = self.places.get(name)
        if places and not (name in _OPEN_ENDED and self.barriers and self.barriers[-1] > places[-1]):
            while len(self.stack) > places[-1] + 1:
                self._pop()
            self._pop()


def _words(attributes: str) -> set[str]:
    """The layout words of an element's class, id and role."""
    values = [m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id", "role")]
    return {p for v in values for t in v.lower().split() for p in _PART.findall(t) if p in _LAYOUT}


def tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of a page's tags, the name with a slash before it at an end; what a raw element, a comment or the
    head holds is part of its tag, whose name is empty."""
    at, open_quotes = 0, set()
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", ""
            at = end
            continue
        slash = page.startswith("/", at + 1)
        m = _NAME.match(page, at + 1 + slash)
        if not m:
            if page[at + 1 : at + 2] not in ("!", "?", "/"):
                at += 1
                continue
            cdata = page.startswith("<![CDATA[", at)
            end = page.find("]]>" if cdata else ">", at)
            if end < 0 and not cdata:
                return
            end = len(page) if end < 0 else end + (3 if cdata else 1)
            yield at, end, "", ""
            at = end
            continue
        end = m.end()
        while stop := _STOP.search(page, end):
            quote = stop[0]
            if quote == ">":
                break
            other = -1 if quote in open_quotes else page.find(quote, stop.end())
            if other < 0:
                open_quotes.add(quote)  # without a partner, here and after
                end = stop.end()
            else:
                end = other + 1
        if not stop:  # it ends within quotes or never
            first = page.find(">", m.end())
            if first < 0:
                return
            open_quotes |= {"'", '"'}
            end = first + 1
        else:
            end = stop.end()
        name, attributes = m[0].lower(), page[m.end() : end - 1].strip()
        if not slash and name in _RAW or name == "head" and not slash:
            close = (_ENDS[name] if name in _RAW else _HEAD_END).search(page, end)
            end = close.end() if close else len(page)
            yield at, end, "", ""
        else:
            yield at, end, "/" * slash + name, attributes
        at = end


def lines(page: str) -> list[Line]:
    out, last = _Lines(), 0
    for start, end, name, attributes in tags(page):
        if start > last:
            out.text(page[last:start])
        last = end
        base = name.lstrip("/")
        if base in _BLOCKS:
            out.end()
        if name.startswith("/"):
            out.close(base)
        elif name:
            out.open(name, attributes)
        else:
            out.text(" ")
    out.text(page[last:])
    out.end()
    return out.rows


def regions(masses: list[int], window: int, threshold: int) -> list[tuple[int, int]]:
    """(first, end) of the stretches between a surge and the dive that follows."""
    n, out, start = len(masses), [], None
    total = sum(masses[:window])
    for i in range(n):
        if start is None and masses[i] and total > threshold:
            start = i
        elif start is not None and not total:
            out.append((start, i))
            start = None
        total += (masses[i + window] if i + window < n else 0) - masses[i]
    if start is not None:
        out.append((start, n))
    return out


def main_text(page, window: int = 3, threshold: int = 60) -> str:
    rows = lines(page or "")
    contained = any(r.inside for r in rows)
    masses = [(len(r.text) + threshold) * r.inside if contained else len(r.text) - r.linked for r in rows]
    keep: list[int] = []
    for a, b in regions(masses, window, threshold):
        while a and rows[a - 1].heading and not contained and (not keep or keep[-1] < a - 1):
            a -= 1
        keep += [i for i in range(a, b) if masses[i] or not contained]
    return "\n".join(rows[i].text for i in keep or range(len(rows)))


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = 3, threshold: int = 60) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, window, threshold) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    cols = F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")
    return pages.select(*cols).mapInArrow(run, SCHEMA)
