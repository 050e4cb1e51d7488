"""Tokens of XML and HTML, in time that is linear whatever the text."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: A tag without ``<`` inside; no attempt looks beyond the next one.
_TAG = re.compile(r"<(/?)([^\s/>=<!?][^\s/>=<]*+)((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>")
_NAME = re.compile(r"<(/?)([^\s/>=<!?][^\s/>=<]*+)")
TEXT, CDATA, STRAY, OPEN, CLOSE = range(5)
#: Elements of HTML that hold no markup, and where they end.
RAW = frozenset(("script", "style"))
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

Token = tuple[int, int, int, str, str]


class Tokens:
    """The tokens of a text, each taken at a place that is not before the last one's.

    What was searched for and lies ahead is not searched for again, so all tokens
    together take linear time. Comments, instructions and declarations are left out; one that never ends
    takes the rest of the text. A ``<`` that begins nothing is STRAY. Attribute
    values may hold any character; once a tag is found whose quotes never end,
    quotes do not count for tags behind it. Elements in ``raw`` hold no markup:
    what is inside them is left out.
    """

    def __init__(self, text: str, raw: frozenset[str] = frozenset()):
        self.text, self.raw, self.size = text, raw, len(text)
        self.last, self.quoted = text.rfind(">"), True
        self.ahead: dict[str, int] = {}
        #: Whether a construct lacks its end.
        self.unfinished = False

    def next(self, mark: str, at: int) -> int:
        """The first place of a character from ``at`` on; the text's size if it has none."""
        found = self.ahead.get(mark, -1)
        if found < at:
            found = self.text.find(mark, at)
            found = self.ahead[mark] = self.size if found < 0 else found
        return found

    def tag_end(self, at: int) -> int:
        """Where a tag ends whose values hold ``<``; the text's size if nowhere."""
        i = at
        while self.quoted:
            end = self.next(">", i)
            mark = min(('"', "'"), key=lambda q: self.next(q, i))
            quote = self.next(mark, i)
            if end == self.size or quote > end:
                return end
            i = self.next(mark, quote + 1) + 1
            # no end outside quotes from here: then none for the tags behind either
            self.quoted = i <= self.last
        self.unfinished = True
        self.ahead.pop(">", None)  # it may lie behind
        return self.next(">", at)

    def declaration_end(self, at: int) -> int:
        """Where a declaration ends, brackets inside included; the text's size if nowhere."""
        i = at
        while i <= self.last:
            end = self.next(">", i)
            bracket = self.next("[", i)
            if bracket > end:
                return end + 1
            i = self.next("]", bracket)
        self.unfinished = True
        return self.size

    def until(self, mark: str, at: int) -> int:
        """The place of a mark; without one the text's size."""
        found = self.text.find(mark, at)
        if found < 0:
            self.unfinished = True
            return self.size
        return found

    def take(self, at: int) -> Token | None:
        """(kind, start, end, name or text, attributes) of the token at or behind a place."""
        text, size = self.text, self.size
        while at < size:
            start = text.find("<", at)
            if start < 0:
                start = size
            if start > at:
                return TEXT, at, start, text[at:start], ""
            m = _TAG.match(text, start)
            if m is not None:
                at = m.end()
                if m[1]:
                    return CLOSE, start, at, m[2], ""
                if self.raw and m[2].lower() in self.raw:
                    end = _RAW_END[m[2].lower()].search(text, at)
                    at = end.start() if end else size
                return OPEN, start, at, m[2], m[3]
            at = start + 1
            if text.startswith("<!--", start):
                at = self.until("-->", start + 4) + 3
            elif text.startswith("<![CDATA[", start):
                end = self.until("]]>", start + 9)
                return CDATA, start, min(end + 3, size), text[start + 9 : end], ""
            elif text.startswith("<?", start):
                at = self.until("?>", start + 2) + 2
            elif text.startswith("<!", start):
                at = self.declaration_end(start)
            elif start > self.last:
                self.unfinished = True
                return STRAY, start, at, "", ""
            elif (m := _NAME.match(text, start)) is None:
                return STRAY, start, at, "", ""
            elif (end := self.tag_end(m.end())) == size:
                return STRAY, start, at, "", ""
            else:
                return CLOSE if m[1] else OPEN, start, end + 1, m[2], text[m.end() : end]
        return None


def tokens(text: str, raw: frozenset[str] = frozenset()) -> Iterator[Token]:
    """All tokens of a text, in order; see :class:`Tokens`."""
    found, at = Tokens(text, raw), 0
    while (token := found.take(at)) is not None:
        at = token[2]
        yield token
