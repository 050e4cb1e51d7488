"""HTML sanitizing by an allow-list."""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from feedweave.functions.markup import CDATA, CLOSE, OPEN, RAW, STRAY, tokens

#: What is kept, and how elements nest.
TAGS = frozenset((
    "a", "abbr", "acronym", "b", "blockquote", "br", "caption", "cite", "code", "dd", "div", "dl", "dt", "em", "h1", "h2", "h3", "h4", "h5", "h6",
    "hr", "i", "img", "kbd", "li", "mark", "ol", "p", "pre", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "u", "ul", "var",
))
ATTRIBUTES = frozenset((
    "alt", "cite", "class", "href", "id", "src", "title",
))
TAG_ATTRIBUTES = {
    "a": ("href", "hreflang"),
    "blockquote": ("cite",),
    "hr": ("align", "size", "width"),
    "img": ("align", "alt", "height", "src", "width"),
    "ol": ("start",),
    "q": ("cite",),
    "table": ("align", "char", "charoff", "summary"),
    "tbody": ("align", "char", "charoff"),
    "td": ("align", "char", "charoff", "colspan", "headers", "rowspan"),
    "tfoot": ("align", "char", "charoff"),
    "th": ("align", "char", "charoff", "colspan", "headers", "rowspan", "scope"),
    "thead": ("align", "char", "charoff"),
    "tr": ("align", "char", "charoff"),
}
SCHEMES = ("http", "https", "mailto")
URL_ATTRIBUTES = frozenset(("href", "src", "cite"))
REL = "nofollow noopener noreferrer"
VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
))
AUTO_CLOSE = frozenset((
    "li", "option", "p", "td", "th", "tr",
))
BARRIERS = frozenset((
    "table", "td", "th", "caption", "object", "marquee", "applet",
))
FORMATTING = frozenset((
    "a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u",
))
MOST_TAGS = 10_000

_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_MARKED = re.compile(r"[<>&\xa0]")
_LONE = re.compile(r"<(?![A-Za-z/!?])")


class TooDeep(Exception):
    """A fragment nests deeper than is allowed, or has too many tags."""


class _Cleaner:
    """Rewrites a fragment with balanced allowed tags only.

    Open elements of either kind count for the depth, but for those of mere formatting.
    """

    def __init__(self, most: int):
        self.out: list[str] = []
        self.open: list[str] = []
        self.others: Counter[str] = Counter()
        #: Places of the open elements by tag, and of those that shield what is around them.
        self.places: dict[str, list[int]] = defaultdict(list)
        self.barriers: list[int] = []
        self.most, self.depth, self.tags = most, 0, 0

    def read(self, text: str) -> None:
        for kind, _, _, name, source in tokens(text, RAW):
            if kind == OPEN:
                self.start(name.lower(), source)
            elif kind == CLOSE:
                self.end(name.lower())
            else:
                data = "<" if kind == STRAY else name if kind == CDATA else html.unescape(name)
                self.out.append(html.escape(data, quote=False).replace("\xa0", "&nbsp;"))
        while self.open:
            self.out.append(f"</{self.open.pop()}>")

    def deeper(self, tag: str) -> None:
        self.depth += tag not in FORMATTING
        if self.depth > self.most:
            raise TooDeep

    def start(self, tag: str, source: str) -> None:
        self.tags += 1
        if self.tags > MOST_TAGS:
            raise TooDeep
        if tag not in TAGS:
            if tag not in VOID and tag not in RAW and not source.endswith("/"):
                self.others[tag] += 1
                self.deeper(tag)
            return
        places = self.places[tag]
        if tag in AUTO_CLOSE and places and not (self.barriers and self.barriers[-1] > places[0]):
            self.close_to(tag)
        kept: dict[str, str] = {}
        own = ATTRIBUTES | frozenset(TAG_ATTRIBUTES.get(tag, ()))
        for m in _ATTRIBUTE.finditer(source):
            name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
            if name in own and name not in kept and (name not in URL_ATTRIBUTES or _allowed_url(value)):
                kept[name] = html.escape(value, quote=False).replace('"', "&quot;")
        if tag == "a":
            kept["rel"] = REL
        self.out.append(f"<{tag}{''.join(f' {name}={chr(34)}{value}{chr(34)}' for name, value in kept.items())}>")
        if tag not in VOID:
            places.append(len(self.open))
            if tag in BARRIERS:
                self.barriers.append(len(self.open))
            self.open.append(tag)
            self.deeper(tag)

    def end(self, tag: str) -> None:
        if self.places.get(tag):
            self.close_to(tag)
        elif self.others[tag]:
            self.others[tag] -= 1
            self.depth -= tag not in FORMATTING

    def close_to(self, tag: str) -> None:
        while self.open:
            last = self.open.pop()
            self.places[last].pop()
            if last in BARRIERS:
                self.barriers.pop()
            self.depth -= last not in FORMATTING
            self.out.append(f"</{last}>")
            if last == tag:
                return


def _allowed_url(value: str) -> bool:
    scheme = re.match(r"\s*([A-Za-z][A-Za-z0-9+.-]*):", re.sub(r"[\x00-\x20]+", "", value))
    return scheme is None or scheme[1].lower() in SCHEMES


def clean(text: str, most: int = 100) -> str:
    """The text with allowed markup only; its structure is balanced.

    Raises :class:`TooDeep` if elements nest deeper than ``most``.
    """
    if not _MARKED.search(text):
        return text
    # a lone < that opens no tag is text
    text = _LONE.sub("&lt;", text)
    if "<" not in text:
        return html.escape(html.unescape(text), quote=False).replace("\xa0", "&nbsp;")
    cleaner = _Cleaner(most)
    cleaner.read(text)
    return "".join(cleaner.out)


def sanitize(text: str, depth: int = 100) -> str:
    """As :func:`clean`; text that nests too deep is escaped as a whole."""
    try:
        return clean(text, depth)
    except TooDeep:
        return html.escape(text, quote=True)


@lru_cache
def sanitizing(depth: int):
    """:func:`sanitize` to a depth, for columns."""

    @F.pandas_udf(StringType())
    def sanitize_html(text: pd.Series) -> pd.Series:
        """Markup reduced to an allow-list of tags, attributes and schemes."""
        return pd.Series([None if t is None else sanitize(t, depth) for t in text], dtype=object)

    return sanitize_html


sanitize_html = sanitizing(100)


def _stripped(text: str) -> str:
    parts = ["<" if kind == STRAY else name for kind, _, _, name, _ in tokens(_LONE.sub("&lt;", text), RAW) if kind not in (OPEN, CLOSE)]
    return html.escape(html.unescape("".join(parts)), quote=False)


@F.pandas_udf(StringType())
def strip_tags(text: pd.Series) -> pd.Series:
    """The text without any markup."""
    return pd.Series([None if t is None else _stripped(t) for t in text], dtype=object)


@F.pandas_udf(StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    """Character references as the characters they stand for."""
    return pd.Series([None if t is None else html.unescape(t) for t in text], dtype=object)
