"""Large documents in pieces that are lexed side by side.

A document is cut before entries. Whether such a place is one, and not part of a
comment, a CDATA section or a quoted value, depends on all text before it. So every piece
tells, for each lexical state that it may begin in, the state that it ends in; these
functions are composed from left to right. A piece that does not begin in text
belongs to its left neighbour. Each is then lexed behind the part of the document that
precedes the first entry, and tells whether it ended where the next one may begin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

from feedweave.options import Options
from feedweave.sources.encoding import decode
from feedweave.sources.lexer import Document, Names, arrow_names, columns, taken

#: Lexical states at the start of a piece.
TEXT, COMMENT, CDATA, INSTRUCTION, DECLARATION, BRACKET, TAG, DOUBLE, SINGLE = range(9)
#: What ends a state, and the state behind it.
ENDS = {COMMENT: ("-->", TEXT), CDATA: ("]]>", TEXT), INSTRUCTION: ("?>", TEXT), BRACKET: ("]", DECLARATION), DOUBLE: ('"', TAG), SINGLE: ("'", TAG)}
#: States at a document's end that say that some tag never ends: then others are not where they seem.
OPEN_TAG = (TAG, DOUBLE, SINGLE)

_NAME = r"</?[^\s/>=<!?][^\s/>=<]*+"
_IN_TAG, _IN_DECLARATION = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+", r"(?:[^>\[]++|\[[^\]]*+\])*+"
_SKIP = re.compile(rf"(?:[^<]++|{_NAME}{_IN_TAG}>|<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!(?!--|\[CDATA\[){_IN_DECLARATION}>|<(?![!?])(?!/?[^\s/>=<!?]))*+", re.S)
_OPENED = re.compile(rf"(<!--)|(<!\[CDATA\[)|(<\?)|(<!)|({_NAME})")
_INSIDE = {TAG: re.compile(_IN_TAG), DECLARATION: re.compile(_IN_DECLARATION)}
_AFTER = {">": TEXT, '"': DOUBLE, "'": SINGLE, "[": BRACKET}
_ITEM, _ENTRY = re.compile(r"<(?:[^\s<>/=!?:]+:)?item(?=[\s/>])"), re.compile(r"<entry(?=[\s/>])")
_BEHIND_ITEM, _BEHIND_ENTRY = re.compile(rf"</(?:[^\s<>/=!?:]+:)?item\s*+>\s*+(?={_ITEM.pattern})"), re.compile(rf"</entry\s*+>\s*+(?={_ENTRY.pattern})")


def end_state(text: str, state: int, at: int = 0) -> int:
    """The state in which a text ends that begins in a state at a place."""
    size = len(text)
    while True:
        if state == TEXT:
            at = _SKIP.match(text, at).end()
            if at == size:
                return TEXT
            m = _OPENED.match(text, at)
            at, state = m.end(), (COMMENT, CDATA, INSTRUCTION, DECLARATION, TAG)[m.lastindex - 1]
        elif state in ENDS:
            mark, then = ENDS[state]
            found = text.find(mark, at)
            if found < 0:
                return state
            at, state = found + len(mark), then
        else:
            at = _INSIDE[state].match(text, at).end()
            if at == size:
                return state
            at, state = at + 1, _AFTER[text[at]]


def leaves(text: str, state: int) -> int:
    """Where a text that begins in a state is back in plain text; -1 if nowhere."""
    at, size = 0, len(text)
    while state != TEXT:
        if state in ENDS:
            mark, then = ENDS[state]
            found = text.find(mark, at)
            if found < 0:
                return -1
            at, state = found + len(mark), then
        else:
            at = _INSIDE[state].match(text, at).end()
            if at == size:
                return -1
            at, state = at + 1, _AFTER[text[at]]
    return at


def transfer(text: str) -> list[int]:
    """The end state for each state at the start.

    From where another state is back in text, all goes as from the start in text,
    if that finds a token at the next ``<`` too.
    """
    plain = end_state(text, TEXT)
    found = [plain]
    for state in range(1, 9):
        at = leaves(text, state)
        if at < 0:
            found.append(end_state(text, state))
            continue
        mark = text.find("<", at)
        if mark < 0:
            found.append(TEXT)
        elif _SKIP.match(text, 0, mark).end() == mark:
            found.append(plain)
        else:
            found.append(end_state(text, TEXT, at))
    return found


def cut(data: bytes | None, options: Options, size: int) -> tuple[str, str, list[str]] | None:
    """Encoding, what precedes the first entry, and pieces of about ``size`` characters.

    Null for documents that are better lexed as a whole: short ones, JSON, unknown
    formats, and those where more than a quarter of a piece precedes the entries.
    """
    if data is None or not size < len(data) <= options.limits.feed_size:
        return None
    text, encoding = decode(data)
    head = text[: size // 4 + 1]
    if head.lstrip().startswith("{"):
        return None
    first = min((m.start() for m in (_ITEM.search(head), _ENTRY.search(head)) if m), default=-1)
    if first < 0:
        return None
    document = Document(text[:first], options, (frozenset(), frozenset()))
    document.read(whole=False)
    atom = document.version.startswith("atom")
    if not document.version or document.level is None or document.level[0] != (1 if atom or document.version == "rss10" else 2):
        return None
    start, behind, marks = (_ENTRY if atom else _ITEM), (_BEHIND_ENTRY if atom else _BEHIND_ITEM), [first]
    # a start behind an end is seldom one in a comment or CDATA, which would have to be undone
    while (at := marks[-1] + size) < len(text) and (m := behind.search(text, at, at + size) or start.search(text, at)):
        marks.append(m.end() if m.re is behind else m.start())
    return encoding, text[:first], [text[a:b] for a, b in zip(marks, [*marks[1:], len(text)])]


def cutting(options: Options, keep: list[str], column: str, size: int):
    """A map over Arrow batches: a row for each piece, or one for a document that is not cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                found = cut(row.column(column)[0].as_py(), options, size)
                own = [row.column(n) for n in keep]
                names = [*keep, "_no", "_last", "_encoding", "_prolog", "_text", column]
                if found is None:
                    yield pa.RecordBatch.from_arrays([*own, pa.array([0], pa.int32()), pa.array([True]), *[pa.array([None], pa.string())] * 3, row.column(column).cast(pa.binary())], names=names)
                    continue
                encoding, prolog, texts = found
                for k, text in enumerate(texts):
                    yield pa.RecordBatch.from_arrays([*own, pa.array([k], pa.int32()), pa.array([k + 1 == len(texts)]), pa.array([encoding]), pa.array([prolog]), pa.array([text]), pa.array([None], pa.binary())], names=names)

    return run


def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_doc``, ``_no`` and the transfer function of each piece."""
    for batch in batches:
        found = [transfer(t) for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_doc"), batch.column("_no"), pa.array(found, pa.list_(pa.int32()))], names=["_doc", "_no", "_f"])


def _read(row: dict, options: Options, names: Names) -> Document:
    document = Document(row["_prolog"] + row["_text"], options, names)
    document.read(whole=row["_last"])
    return document


def judging(options: Options):
    """A map to ``_doc``, ``_no`` and ``_judged``: the number of entries, and 1 if the piece ended where
    the next may begin and holds nothing of the feed, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(_read(r, options, (frozenset(), frozenset())), r["_last"]) for r in batch.select(["_prolog", "_text", "_last"]).to_pylist()]
            ok = [not d.late and d.entry_level is not None and (last or d.level == d.entry_level) for d, last in rows]
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), batch.column("_no"), pa.array([[len(d.items), int(fine)] for (d, _), fine in zip(rows, ok)], pa.list_(pa.int32()))], names=["_doc", "_no", "_judged"])

    return run


def lexing_pieces(options: Options, keep: list[str], names: Names):
    """A map over pieces: the columns ``keep`` and those of lexing, a row a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r in enumerate(batch.select(["_prolog", "_text", "_last", "_encoding"]).to_pylist()):
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(row.column(n) for n in keep), *columns([taken(_read(r, options, names), r["_encoding"])], names)], names=[*keep, *arrow_names()])

    return run
