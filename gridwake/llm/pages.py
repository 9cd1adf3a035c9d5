"""Main text of web pages by line-block distribution.

A page becomes lines, one for each block of text, after markup is stripped with everything that is
marked as something else than an article: menus, page headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments. The lengths of the lines (without link text) are summed over
sliding windows; the text surges where a sum first passes a threshold and dives after the last one
that does. What lies between is kept whole, short lines too. The element that holds the text between surge and
dive gives the region its edges: its short first and last lines stay, and lines of links that the windows
reach beside it go; of an article or main element, all beside it. A class or id that names something else doesn't count on an element that holds the page's
articles or most of its text, nor does an element without its end tag.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_small_batches

#: Lines of a window, and the text in it that makes a surge.
WINDOW, SURGE = 3, 80

_RAW = frozenset("script style textarea title noscript template iframe svg math canvas object xmp".split())
_SKIP = frozenset("head nav footer aside form button select dialog menu".split()) | _RAW
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OPEN_ENDED = frozenset("p li dt dd td th tr option".split())
_KEPT = frozenset("html body article main".split())
#: Elements of a page's head, whose end tag may be left out.
_HEAD = frozenset("title meta link base script style noscript template".split())
#: Elements that are left out for a part of a class or id; on others (a paragraph, a word) the whole class must match.
_PARTS = frozenset("div section ul ol dl table tr td details center figure".split())
#: Elements that can hold a region; a paragraph can't.
_HOLDERS = frozenset("article main div section td center".split())
#: Share of a region's text that makes an element its container; of an article or main element.
HOLDS, ARTICLE_HOLDS = 0.9, 0.5
#: Words in a class, id or role that name something other than the article.
_OTHER = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|adbox|adslot|sponsor(?:ed|s)?|promos?|promotions?|banners?|sidebars?|sidenav|"
    r"menus?|nav(?:bar|igation|s)?|breadcrumbs?|footers?|masthead|comments?|commentlist|disqus|repl(?:y|ies)|respond|notices?|notifications?|cookies?|consent|gdpr|"
    r"alerts?|disclaimers?|popups?|modals?|overlays?|newsletters?|subscribe|subscriptions?|signup|login|search|share|sharing|social|related|recommend(?:ed|ations?)?|"
    r"widgets?|pagination|pager|toolbars?|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
#: Of these, words for what readers or other pages say; such lists can hold article elements of their own.
_REMARK = re.compile(r"(?:^|[_-])(?:comments?|commentlist|disqus|repl(?:y|ies)|respond|related|recommend(?:ed|ations?)?)(?:$|[_-])", re.I)
#: A class that tells the state of a wrapper, as has-sidebar or menu-open.
_STATE = re.compile(r"^(?:has|no|not|with|without|is)[_-]|[_-](?:open|opened|closed|enabled|disabled|visible|active)$", re.I)
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""",
    re.S,
)
_MARK = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Line(NamedTuple):
    """A block's text, its length without links, and the token that its text stands before."""

    text: str
    weight: int
    at: int


class Token(NamedTuple):
    start: int
    end: int
    name: str
    closing: bool
    attributes: str


def _other(name: str, attributes: str) -> str:
    """How an element's attributes say that it isn't part of an article: "hidden", "remark", "layout" or not at all."""
    found = ""
    if not attributes or name in _KEPT:
        return found
    for mark in _MARK.finditer(attributes):
        key, value = mark[1].lower(), next((v for v in mark.groups()[1:] if v is not None), "")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "hidden"
        for word in value.split() if key in ("class", "id", "role") else ():
            match = _OTHER.search(word)
            if match and not _STATE.search(word) and (name in _PARTS or match[0] == word):
                found = "remark" if found == "remark" or _REMARK.search(word) else "layout"
    return found


def _tokens(page: str) -> list[Token]:
    """Tags, comments etc. of a page in order; a raw element is one token with all that it holds."""
    out, at = [], 0
    while (token := _TOKEN.search(page, at)) is not None:
        at = token.end()
        name, closing, attributes = (token[2] or token[5] or "").lower(), bool(token[1] or token[4]), token[3] or token[6] or ""
        if name in _RAW and not closing and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
        out.append(Token(token.start(), at, name, closing, attributes))
    return out


class _Spans:
    """Ends of a page's elements, and what they hold."""

    def __init__(self, page: str, tokens: list[Token]) -> None:
        n = len(tokens)
        self.page, self.tokens, self.ends = page, tokens, [n] * n
        self.text, self.articles, self.mains = [0], [0], [0]
        opened: dict[str, list[int]] = {}
        at = links = 0
        for i, t in enumerate(tokens):
            self.text.append(self.text[-1] + (0 if links else len(page[at : t.start].strip())))
            self.articles.append(self.articles[-1] + (t.name == "article" and not t.closing))
            self.mains.append(self.mains[-1] + (t.name == "main" and not t.closing))
            at = t.end
            if t.name == "a":
                links = max(0, links - 1) if t.closing else links + 1
            if t.closing:
                if opened.get(t.name):
                    self.ends[opened[t.name].pop()] = i
            elif not t.attributes.endswith("/"):
                opened.setdefault(t.name, []).append(i)
        self.text.append(self.text[-1] + (0 if links else len(page[at:].strip())))
        for i in opened.get("head", []):
            self.ends[i] = next((j for j in range(i + 1, n) if tokens[j].name and tokens[j].name not in _HEAD), n)
        following = n
        for i in range(n - 1, -1, -1):
            if tokens[i].name in _OPEN_ENDED and not tokens[i].closing:
                self.ends[i] = following
            if tokens[i].name in _BLOCK or tokens[i].name in _OPEN_ENDED:
                following = i

    def behind(self, i: int) -> tuple[int, int]:
        """The first token behind element i, and the place in the page where it ends."""
        end = self.ends[i]
        if end == len(self.tokens):
            return end, len(self.page)
        own = self.tokens[end].closing and self.tokens[end].name == self.tokens[i].name
        return (end + 1, self.tokens[end].end) if own else (end, self.tokens[end].start)

    def closed(self, i: int) -> bool:
        """Whether element i has an end; one that is still open at the page's end marks nothing."""
        return self.ends[i] < len(self.tokens) or self.tokens[i].name in _RAW

    def holds_article(self, i: int, kind: str) -> bool:
        """Whether element i, of a kind from _other, holds a main element, all articles or most of the text outside of links."""
        end = self.ends[i]
        last = end + 1 if end < len(self.tokens) else -1
        most = 2 * (self.text[last] - self.text[i + 1]) > self.text[-1]
        articles = self.articles[end] - self.articles[i]
        every = articles > 0 and articles == self.articles[-1]
        return self.mains[end] > self.mains[i] or (every and most if kind == "remark" else every or most)


def lines_of(page: str) -> tuple[list[Line], _Spans]:
    """Text blocks of a page in order, without what is marked as something else, and the page's elements."""
    lines: list[Line] = []
    parts: list[tuple[str, bool]] = []
    tokens = _tokens(page)
    spans = _Spans(page, tokens)
    at = i = inside = links = first = 0

    def add(text: str, place: int) -> None:
        nonlocal first
        if not parts or not any(p.strip() for p, _ in parts):
            first = place
        parts.append((text, links > 0))

    def flush() -> None:
        text = " ".join(unescape("".join(p for p, _ in parts)).split())
        if text:
            linked = sum(len(p) for p, link in parts if link)
            lines.append(Line(text, max(0, len(text) - linked), first))
        parts.clear()

    while i < len(tokens):
        start, end, name, closing, attributes = tokens[i]
        if start > at:
            add(page[at:start], i)
        at, i = end, i + 1
        if not name:
            continue
        if name in _BLOCK:
            flush()
        if closing:
            inside -= name in ("article", "main") and inside > 0
            links -= name == "a" and links > 0
            continue
        if name in _VOID or attributes.endswith("/") and name not in _BLOCK:
            if name == "br":
                add(" ", i - 1)
            continue
        if name in _RAW:
            continue
        kind = "always" if name in _SKIP or name == "header" and not inside else _other(name, attributes)
        if kind and spans.closed(i - 1) and (kind in ("always", "hidden") or not spans.holds_article(i - 1, kind)):
            i, at = spans.behind(i - 1)
            continue
        inside += name in ("article", "main")
        links += name == "a"
    if at < len(page):
        add(page[at:], len(tokens))
    flush()
    return lines, spans


def region(lines: list[Line]) -> tuple[int, int]:
    """First and last + 1 of the lines between surge and dive; all of them if none surges."""
    upto = list(accumulate((line.weight for line in lines), initial=0))
    high = [i for i in range(max(1, len(lines) - WINDOW + 1)) if upto[min(i + WINDOW, len(lines))] - upto[i] >= SURGE]
    if not high:
        return 0, len(lines)
    return high[0], min(len(lines), high[-1] + WINDOW)


def container(lines: list[Line], spans: _Spans, a: int, b: int) -> tuple[int, int, bool] | None:
    """Lines of the innermost article or main element, else of another, that holds the text of lines a to b - 1, and whether it is an article or main element."""
    upto = list(accumulate((line.weight for line in lines), initial=0))
    total, places = upto[b] - upto[a], [line.at for line in lines]
    found: dict[bool, tuple[int, int]] = {}
    for i, token in enumerate(spans.tokens if total else ()):
        if token.closing or token.name not in _HOLDERS:
            continue
        low, high = bisect_right(places, i), bisect_right(places, spans.ends[i])
        held = upto[max(min(high, b), a)] - upto[min(max(low, a), b)]
        article = token.name in ("article", "main")
        if held > ARTICLE_HOLDS * total if article else held >= HOLDS * total:
            if article not in found or high - low <= found[article][1] - found[article][0]:
                found[article] = low, high
    return next(((*found[kind], kind) for kind in (True, False) if kind in found), None)


def main_text(page: str | None) -> str:
    """The article's blocks, joined by one newline."""
    lines, spans = lines_of(page or "")
    a, b = region(lines)
    held = container(lines, spans, a, b)
    if held:
        low, high, article = held
        beside = lambda line: article or 2 * line.weight < len(line.text)
        while a < low and beside(lines[a]):
            a += 1
        while b > high and beside(lines[b - 1]):
            b -= 1
        a, b = min(a, low), max(b, high)
    return "\n".join(line.text for line in lines[a:b])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"page_id": batch["page_id"], "url": batch["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text and its code points for every row.

    A null or empty page, and one with no text outside of what is stripped, gives an empty text. Pages
    cut off in the middle keep what they have. Rows are independent: repeated rows give repeated results,
    null ids and urls stay null, an empty table gives an empty one; other columns are not read.
    """
    rows = in_small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
