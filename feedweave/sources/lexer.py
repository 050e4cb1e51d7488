"""A tolerant XML lexer: documents to nodes grouped by name.

It knows nothing of what elements mean. It finds the document's format, cuts it
into the feed and its entries, and gives the elements of each by canonical name;
rules over columns (``feedweave.operators``) make fields of them.

Elements that hold nothing but text are most of any feed, and are taken at once; only
the others go tag by tag. Elements that no wanted field refers to are checked, since a broken one
breaks its entry, but no node is made of them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from feedweave.functions.html import sanitize
from feedweave.functions.markup import CDATA, CLOSE, OPEN, STRAY, Tokens, tokens
from feedweave.functions.urls import join, join_safe
from feedweave.options import Options
from feedweave.sources.encoding import decode

KID = "struct<up:int,name:string,attrs:map<string,string>,text:string>"
NODE = f"struct<pos:int,name:string,attrs:map<string,string>,text:string,clean:string,safe:string,xml:string,base:string,lang:string,empty:boolean,kids:array<{KID}>>"

#: Names of the elements that are wanted of the feed and of its entries (null: all).
Names = tuple[frozenset[str] | None, frozenset[str] | None]


def scope_ddl(names: frozenset[str] | None) -> str:
    """The type of a scope: a field for each wanted name, or a map of all."""
    nodes = f"map<string,array<{NODE}>>" if names is None else f"struct<{','.join(f'`{field_of(n)}`:array<{NODE}>' for n in columns_of(names))}>"
    return f"struct<attrs:map<string,string>,base:string,lang:string,nodes:{nodes}>"


def columns_of(names: frozenset[str]) -> list[str]:
    return sorted(names) or ["title"]


def field_of(name: str) -> str:
    """A name as that of a field; Spark's do not differ by case, so capitals are marked."""
    return re.sub("[A-Z]", lambda m: f"^{m[0].lower()}", name)


def lexed_ddl(names: Names = (None, None)) -> str:
    """The columns that lexing gives."""
    return f"version string, encoding string, bozo boolean, bozo_exception string, error string, namespaces map<string,string>, head {scope_ddl(names[0])}, items array<{scope_ddl(names[1])}>, json string"

#: Namespaces whose own prefixes are recognised, and the formats' names.
ALIASES = {"http://purl.org/dc/elements/1.1/": "dc", "http://search.yahoo.com/mrss/": "media", "http://search.yahoo.com/mrss": "media", "http://www.itunes.com/dtds/podcast-1.0.dtd": "itunes"}
RSS_VERSIONS = {"0.90": "rss090", "0.91": "rss091u", "0.92": "rss092", "2.0": "rss20", "": "rss20"}
ATOM_03, ATOM_10 = "http://purl.org/atom/ns#", "http://www.w3.org/2005/Atom"
JSON_VERSIONS = {"https://jsonfeed.org/version/1": "json10", "https://jsonfeed.org/version/1.1": "json11"}
ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "apos": "'", "quot": '"'}
TRUNCATED = "Feed is truncated or has unclosed XML elements"
MALFORMED = "Malformed XML attributes"
#: Sources of tags' attributes that are remembered at once.
MOST_SOURCES = 1024
#: Attributes and elements that hold URLs.
URL_ATTRIBUTES_IN_ORDER = ("href", "url", "src", "uri")
URL_ATTRIBUTES = frozenset(URL_ATTRIBUTES_IN_ORDER)
URL_TEXTS = frozenset(("link", "url", "icon", "logo", "guid", "comments", "docs", "id"))

_ATTRIBUTE = re.compile(r"\s*([^\s=/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')|\s*([^\s]+)")
_PAIR = re.compile(r"\s*([^\s=/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_WELL_FORMED = re.compile(r"(?:\s*+[^\s=/>]++\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'))*+\s*+")
_REFERENCE = re.compile(r"&(?:#[xX]([0-9A-Fa-f]+);|#([0-9]+);|([^;&<\s]+);|)")
#: An element that holds text or one CDATA section only.
_LEAF = re.compile(r"[^<]*+<([^\s/>=<!?][^\s/>=<]*+)((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)(?<!/)>(?:([^<]*+)|\s*+<!\[CDATA\[((?:[^\]]++|\](?!\]>))*+)\]\]>\s*+)</\1>")


class Broken(Exception):
    """A construct that ends the field, or the entry, that it is in."""


@dataclass
class Element:
    name: str
    attrs: dict[str, str]
    base: str | None
    lang: str | None
    empty: bool
    start: int
    inner: int = 0
    text: list[str] = field(default_factory=list)
    sealed: bool = False
    kids: list[tuple[int, str, dict, list[str], list[bool]]] = field(default_factory=list)
    path: list[int] = field(default_factory=list)


@dataclass
class Part:
    """The feed or an entry: its nodes by canonical name, as tuples in the order of :data:`NODE`."""

    attrs: dict[str, str]
    base: str | None
    lang: str | None
    nodes: dict[str, list[tuple]] = field(default_factory=dict)


class Document:
    """One document's nodes; ``read`` finds them."""

    def __init__(self, text: str, options: Options, names: Names = (None, None)):
        self.text, self.options, self.limits = text, options, options.limits
        self.names = names
        self.version, self.bozo, self.error = "", None, None
        self.namespaces: dict[str, str] = {}
        self.known: dict[str, str] = {}
        #: Attributes by their source; entries repeat them.
        self.read_attributes: dict[str, dict[str, str]] = {}
        self.head, self.items = Part({}, None, None), []
        #: How deep reading ended (null: inside something), how deep the first entry is, and
        #: whether something of the feed stands behind it.
        self.level: tuple | None = None
        self.entry_level: tuple | None = None
        self.late = False

    def complain(self, reason: str) -> None:
        self.bozo = self.bozo or reason

    # names and values -------------------------------------------------------

    def canonical(self, name: str) -> str:
        found = self.known.get(name)
        if found is None:
            prefix, _, local = name.rpartition(":")
            found = self.known[name] = f"{ALIASES.get(self.namespaces.get(prefix, ''), prefix)}:{local}" if prefix else local
        return found

    def resolved(self, text: str, strict: bool) -> str:
        """Character references replaced; unknown names stay, a bare ampersand breaks."""
        if "&" not in text:
            return text

        def put(m: re.Match) -> str:
            if m[3] in ENTITIES:
                return ENTITIES[m[3]]
            if m[1] or m[2]:
                code = int(m[1], 16) if m[1] else int(m[2])
                if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000:
                    return chr(code)
            elif m[3] is None:
                if strict:
                    raise Broken("unescaped ampersand")
                return m[0]
            if strict:
                self.complain(f"Unknown entity reference: {m[0]}")
            return m[0]

        return _REFERENCE.sub(put, text)

    def attributes(self, source: str) -> dict[str, str]:
        """The attributes of a tag; not to be changed, as tags of the same source share them."""
        found = self.read_attributes.get(source)
        if found is None:
            if len(self.read_attributes) >= MOST_SOURCES:
                self.read_attributes.clear()
            found = self.read_attributes[source] = self.made_attributes(source)
        return found

    def made_attributes(self, source: str) -> dict[str, str]:
        found: dict[str, str] = {}
        if "&" not in source and len(source) <= self.limits.attribute_length and _WELL_FORMED.fullmatch(source):
            for name, value, other in _PAIR.findall(source):
                if name not in found:
                    found[name] = value or other
            return found
        for m in _ATTRIBUTE.finditer(source):
            if m[1] is None or m[4]:
                if m[0].strip():
                    self.complain(MALFORMED)
                continue
            value = self.resolved(m[2] if m[2] is not None else m[3], strict=False)
            if m[1] not in found:
                # a namespace keeps a character more, which tells that it is too long
                found[m[1]] = value[: self.limits.attribute_length + m[1].startswith("xmlns")]
        return found

    def declare(self, attrs: dict[str, str]) -> None:
        for name, uri in attrs.items():
            if name == "xmlns" or name.startswith("xmlns:"):
                if len(uri.encode()) > self.limits.attribute_length:
                    self.complain(f"Namespace URI exceeds maximum attribute length of {self.limits.attribute_length} bytes")
                    continue
                if len(self.namespaces) >= self.limits.namespaces:
                    self.complain("Namespace limit exceeded")
                    return
                self.namespaces[name[6:]] = uri
        self.known.clear()

    # nodes ------------------------------------------------------------------

    def checked(self, text: str) -> str:
        """Text without the space around it, unless it is too long."""
        text = text.strip()
        if "\0" in text:
            text = text.replace("\0", "")
        if 4 * len(text) > self.limits.text_length and len(text.encode()) > self.limits.text_length:
            raise Broken("text is too long")
        return text

    def with_urls(self, attrs: dict[str, str], base: str | None) -> list[tuple[str, str]]:
        """Attributes, and those that are URLs once more, made absolute where that is safe."""
        if not attrs:
            return []
        found = list(attrs.items())
        if not URL_ATTRIBUTES.isdisjoint(attrs):
            for key in URL_ATTRIBUTES_IN_ORDER:
                if key in attrs:
                    found.append((f"@{key}", join_safe(attrs[key].strip(), base, self.options.resolve_relative_uris)))
        return found

    def add(self, part: Part, pos: int, e: Element, inner: str | None) -> None:
        text = self.checked("".join(e.text))
        names = self.names[part is not self.head]
        if names is not None and e.name not in names:
            return
        kids = [(up, name, self.with_urls(own, e.base), "".join(parts).strip().replace("\0", "")) for up, name, own, parts, _ in e.kids]
        self.put(part, pos, e.name, e.attrs, text, e.base, e.lang, e.empty, inner, kids)

    def put(self, part: Part, pos: int, name: str, attrs: dict[str, str], text: str, base: str | None, lang: str | None, empty: bool, inner: str | None, kids: list[tuple]) -> None:
        clean = safe = None
        if name.rpartition(":")[2] in URL_TEXTS:
            safe = join_safe(text, base, self.options.resolve_relative_uris)
        if self.options.sanitize_html:
            depth = self.limits.html_nesting_depth
            if text:
                clean = sanitize(text, depth)
                if clean == text:
                    clean = None
            if inner is not None:
                inner = sanitize(inner, depth)
        part.nodes.setdefault(name, []).append((pos, name, self.with_urls(attrs, base), text, clean, safe, inner, base, lang, empty, kids))

    def inner_markup(self, attrs: dict[str, str], start: int, end: int) -> str | None:
        """The children's markup of an XHTML construct, without the element around them."""
        if not attrs or (attrs.get("type") or "").lower() not in ("xhtml", "application/xhtml+xml"):
            return None
        source = self.text[start:end]
        body = source.strip()
        first, last = body.find(">"), body.rfind("</")
        if body.startswith("<") and 0 <= first < last and body.endswith(">"):
            whole = body[first + 1 : last]
        else:
            whole = "" if "<" not in body or body.startswith("<") and body.endswith("/>") and first == len(body) - 1 else source
        return re.sub(r"&(apos|quot);", lambda x: ENTITIES[x[1]], whole).strip()

    # tokens -----------------------------------------------------------------

    def read(self, whole: bool = True) -> None:
        """One pass over the text. The path holds the open elements' roles.

        ``whole`` is false for a piece that other entries follow: that it ends is no fault of it.
        """
        path: list[str] = []  # root, channel or feed
        entry, node, broken = None, None, None
        bases, langs = [None], [None]
        pos, depth, skipping = 0, 0, 0
        atom = rdf = False
        found, at, leaf, text = Tokens(self.text), 0, _LEAF.match, self.text
        deepest = self.limits.nesting_depth
        while True:
            # an element of the feed or of an entry that holds only text
            if node is None and path and depth < deepest and (broken is None or entry is not None) and (m := leaf(text, at)) is not None and not (m[1] == "entry" if atom else m[1].rpartition(":")[2] in ("item", "channel")):
                name, source, at = m[1], m[2], m.end()
                pos += 1
                if skipping:
                    continue
                if entry is None:
                    self.late |= self.entry_level is not None
                part = self.head if entry is None else entry
                name = self.canonical(name)
                names = self.names[entry is not None]
                wanted = names is None or name in names
                attrs: dict[str, str] = {}
                if source and (wanted or not _WELL_FORMED.fullmatch(source)):
                    attrs = self.attributes(source)
                if broken is not None:
                    continue
                value = ""
                try:
                    value = m[4] if m[3] is None else self.resolved(m[3], strict=True)
                except Broken as e:
                    broken = str(e)
                    self.complain(f"XML error: {e}")
                if broken is None:
                    try:
                        value = self.checked(value)
                        if wanted:
                            base, lang = bases[-1], langs[-1]
                            if attrs:
                                base = join(b, base) if (b := attrs.get("xml:base")) is not None else base
                                lang = attrs["xml:lang"] or None if "xml:lang" in attrs else lang
                            inner = self.inner_markup(attrs, m.end(2) + 1, at - len(m[1]) - 3)
                            self.put(part, pos, name, attrs, value, base, lang, False, inner, [])
                    except Broken as e:
                        broken = str(e)
                        self.complain(str(e))
                if entry is None:
                    broken = None
                    if name == "link" and not atom and self.head.base is None and value:
                        # later relative references resolve against the channel's link
                        self.head.base = bases[-1] = value.strip() or None
                continue
            token = found.take(at)
            if token is None:
                break
            kind, start, at, name, source = token
            if kind <= STRAY:
                if node is None or broken:
                    continue
                try:
                    if kind == STRAY:
                        raise Broken("malformed markup")
                    part = name if kind == CDATA else self.resolved(name, strict=True)
                except Broken as e:
                    broken = str(e)
                    self.complain(f"XML error: {e}")
                    continue
                target = node.kids[node.path[-1]][3] if node.path else node.text
                if not (node.kids[node.path[-1]][4] if node.path else [node.sealed])[0]:
                    target.append(part)
                if not node.sealed and node.path:
                    node.text.append(part)
                continue
            closing, empty = kind == CLOSE, source.endswith("/")
            local = name.rpartition(":")[2]
            if not closing:
                depth += 1
                if depth > deepest and not broken:
                    self.complain(f"Maximum nesting depth {deepest} exceeded")
                    broken = "nesting depth"
                attrs = self.attributes(source[:-1] if empty else source) if source else {}
                if not path:
                    self.declare(attrs)
                    self.version = self.format_of(local, attrs)
                    if not self.version:
                        return
                    atom, rdf = self.version.startswith("atom"), self.version == "rss10"
                    bases.append(join(b, None) if (b := attrs.get("xml:base") or attrs.get("base")) else None)
                    langs.append(attrs.get("xml:lang") or attrs.get("lang"))
                    path.append("root")
                    if atom:
                        self.head.attrs, self.head.base, self.head.lang = attrs, bases[-1], langs[-1]
                    if empty:
                        path.pop()
                    continue
                base = join(b, bases[-1]) if (b := attrs.get("xml:base")) is not None else bases[-1]
                lang = attrs["xml:lang"] or None if "xml:lang" in attrs else langs[-1]
                if node is not None:
                    node.kids.append((node.path[-1] if node.path else -1, self.canonical(name), attrs, [], [False]))
                    node.path.append(len(node.kids) - 1)
                    if empty:
                        node.path.pop()
                        depth -= 1
                    continue
                if entry is None and local == "channel" and len(path) == 1 and not atom:
                    self.late |= self.entry_level is not None
                    if not rdf:
                        self.declare(attrs)
                    self.head.attrs, self.head.base, self.head.lang = attrs, base, lang
                    if not empty:
                        path.append("channel")
                        bases.append(base)
                        langs.append(lang)
                    continue
                where = len(path) if not atom else 2
                if entry is None and (name == "entry" if atom else local == "item" and where == (1 if rdf else 2)):
                    self.entry_level = self.entry_level or (len(path), depth - 1, len(bases))
                    if len(self.items) >= self.limits.entries:
                        self.complain(f"Entry limit exceeded: {self.limits.entries}")
                        skipping = depth
                    entry = Part(attrs, base, lang)
                    broken = None
                    if empty:
                        depth -= 1
                        if not rdf and not skipping:
                            self.items.append(entry)
                        entry, skipping = None, 0
                    else:
                        bases.append(base)
                        langs.append(lang)
                    continue
                pos += 1
                if entry is None:
                    self.late |= self.entry_level is not None
                node = Element(self.canonical(name), attrs, base, lang, empty, start, at)
                if not empty:
                    continue
            elif node is not None:
                depth -= 1
                node.sealed = True
                if node.path:
                    node.kids[node.path.pop()][4][0] = True
                    continue
            elif entry is not None and (name == "entry" if atom else local == "item"):
                depth -= 1
                if broken is None and not skipping:
                    self.items.append(entry)
                entry, broken, skipping = None, None, 0
                bases.pop()
                langs.pop()
                continue
            else:
                depth = max(0, depth - 1)
                if path and (atom or local in ("channel", "rss", "RDF")):
                    path.pop()
                    if len(bases) > 1:
                        bases.pop()
                        langs.pop()
                continue
            # a direct child of the feed or of an entry is complete
            if empty:
                depth -= 1
            done, node = node, None
            try:
                if broken is None and not skipping:
                    self.add(entry if entry is not None else self.head, pos, done, self.inner_markup(done.attrs, done.inner, start) if not empty else None)
            except Broken as e:
                broken = str(e)
                self.complain(str(e))
            if entry is None:
                broken = None
                if done.name == "link" and not atom and self.head.base is None and done.text:
                    # later relative references resolve against the channel's link
                    self.head.base = "".join(done.text).strip() or None
                    bases[-1] = self.head.base
        if entry is None and node is None and not found.unfinished:
            self.level = (len(path), depth, len(bases))
        if not whole:
            return
        if path or node is not None or entry is not None:
            self.complain(TRUNCATED)
            if node is not None and broken is None:
                try:
                    self.add(entry if entry is not None else self.head, pos, node, None)
                except Broken as e:
                    self.complain(str(e))
            if entry is not None and broken is None and not skipping:
                self.items.append(entry)

    def format_of(self, local: str, attrs: dict[str, str]) -> str:
        if local == "rss":
            version = RSS_VERSIONS.get(attrs.get("version", "").strip(), "")
            return "rss091n" if version == "rss091u" and "Netscape Communications" in self.text[:512] else version
        if local == "RDF":
            return "rss10"
        return ("atom03" if attrs.get("xmlns") == ATOM_03 else "atom10") if local == "feed" else ""


def json_version(text: str) -> str:
    """The version that a JSON document names at its top; of a long one, or one that
    is no JSON, its first megabyte tells."""
    if len(text) <= 1 << 20:
        try:
            named = json.loads(text)
            return JSON_VERSIONS.get(str(named.get("version")), "") if isinstance(named, dict) else ""
        except (ValueError, RecursionError):
            pass
    head = text.encode()[: 1 << 20].decode("utf-8", "replace").replace("\\/", "/")
    return "json11" if "https://jsonfeed.org/version/1.1" in head else "json10" if "https://jsonfeed.org/version/1" in head else ""


def version_of(data: bytes) -> str:
    """The format of a document, the empty text if it is none that is known."""
    text, _ = decode(data)
    body = text.lstrip()
    if body.startswith("{"):
        return json_version(body)
    document = Document(text, Options())
    for kind, _, _, name, source in tokens(text):
        if kind == OPEN:
            return document.format_of(name.rpartition(":")[2], document.attributes(source.removesuffix("/")))
    return ""


@dataclass
class Lexed:
    """A document's row, in the order of :func:`lexed_ddl`."""

    version: str = ""
    encoding: str = "utf-8"
    bozo: bool = False
    bozo_exception: str | None = None
    error: str | None = None
    namespaces: dict[str, str] = field(default_factory=dict)
    head: Part | None = None
    items: list[Part] = field(default_factory=list)
    json: str | None = None


def lex(data: bytes | None, options: Options, names: Names = (None, None)) -> Lexed:
    """A document's version, nodes and faults."""
    if data is None or len(data) > options.limits.feed_size:
        return Lexed(bozo=True, error="No document" if data is None else f"Feed size exceeds maximum of {options.limits.feed_size}")
    text, encoding = decode(data)
    if text.lstrip().startswith("{"):
        return Lexed(json_version(text.lstrip()), encoding, json=text)
    document = Document(text, options, names)
    document.read()
    return taken(document, encoding)


def taken(document: Document, encoding: str) -> Lexed:
    if not document.version:
        return Lexed(encoding=encoding, bozo=True, bozo_exception="Feed format not recognized")
    return Lexed(document.version, encoding, document.bozo is not None, document.bozo, None, document.namespaces, document.head, document.items)


# Arrow: nodes of all documents of a batch, column by column ---------------------


def arrow_type(ddl: str) -> pa.Schema:
    """The Arrow schema of a schema in DDL."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def _ends(sizes: Iterable[int], n: int) -> np.ndarray:
    found = np.zeros(n + 1, np.int32)
    np.cumsum(np.fromiter(sizes, np.int32, n), out=found[1:])
    return found


def _maps(rows: list[list[tuple[str, str]]]) -> pa.MapArray:
    flat = [x for r in rows for x in r]
    return pa.MapArray.from_arrays(pa.array(_ends(map(len, rows), len(rows))), pa.array([k for k, _ in flat], pa.string()), pa.array([v for _, v in flat], pa.string()))


def _lists(sizes: list[int], values: pa.Array, gaps: bool = False) -> pa.ListArray:
    """Lists of the given sizes; with ``gaps`` empty ones are null."""
    mask = pa.array(np.array(sizes) == 0) if gaps and len(sizes) else None
    return pa.ListArray.from_arrays(pa.array(_ends(sizes, len(sizes))), values, mask=mask)


def _nodes(nodes: list[tuple]) -> pa.StructArray:
    pos, name, attrs, text, clean, safe, xml, base, lang, empty, kids = zip(*nodes) if nodes else ((),) * 11
    flat = [k for own in kids for k in own]
    up, kid, kid_attrs, kid_text = zip(*flat) if flat else ((),) * 4
    string = lambda x: pa.array(x, pa.string())
    inside = pa.StructArray.from_arrays([pa.array(up, pa.int32()), string(kid), _maps(list(kid_attrs)), string(kid_text)], names=["up", "name", "attrs", "text"])
    return pa.StructArray.from_arrays(
        [pa.array(pos, pa.int32()), string(name), _maps(list(attrs)), string(text), string(clean), string(safe), string(xml), string(base), string(lang), pa.array(empty, pa.bool_()), _lists(list(map(len, kids)), inside)],
        names=["pos", "name", "attrs", "text", "clean", "safe", "xml", "base", "lang", "empty", "kids"],
    )


def _parts(parts: list[Part | None], names: frozenset[str] | None) -> pa.StructArray:
    """Feeds or entries as an array of the type of :func:`scope_ddl`."""
    held = [p or Part({}, None, None) for p in parts]
    if names is None:
        lists = [x for p in held for x in p.nodes.items()]
        inside = _lists([len(v) for _, v in lists], _nodes([n for _, v in lists for n in v]))
        nodes = pa.MapArray.from_arrays(pa.array(_ends((len(p.nodes) for p in held), len(held))), pa.array([k for k, _ in lists], pa.string()), inside)
    else:
        wanted, none = columns_of(names), []
        there, nothing = set().union(*(p.nodes for p in held)), pa.nulls(len(held), _lists([], _nodes([])).type)
        by_name = [[p.nodes.get(n, none) for p in held] if n in there else None for n in wanted]
        nodes = pa.StructArray.from_arrays([nothing if lists is None else _lists([len(x) for x in lists], _nodes([n for x in lists for n in x]), gaps=True) for lists in by_name], names=[field_of(n) for n in wanted])
    fields = [_maps([list(p.attrs.items()) for p in held]), pa.array([p.base for p in held], pa.string()), pa.array([p.lang for p in held], pa.string()), nodes]
    return pa.StructArray.from_arrays(fields, names=["attrs", "base", "lang", "nodes"], mask=pa.array([p is None for p in parts], pa.bool_()))


def columns(rows: list[Lexed], names: Names) -> list[pa.Array]:
    """The columns of :func:`lexed_ddl`."""
    string = lambda of: pa.array([of(r) for r in rows], pa.string())
    return [
        string(lambda r: r.version), string(lambda r: r.encoding), pa.array([r.bozo for r in rows], pa.bool_()), string(lambda r: r.bozo_exception), string(lambda r: r.error),
        _maps([list(r.namespaces.items()) for r in rows]), _parts([r.head for r in rows], names[0]),
        _lists([len(r.items) for r in rows], _parts([p for r in rows for p in r.items], names[1])), string(lambda r: r.json),
    ]


#: Documents are lexed until their rows come from about this many bytes, then sent.
BATCH_BYTES = 1 << 20


def lexing(options: Options, keep: pa.Schema, column: str, names: Names = (None, None)):
    """A map over Arrow batches: the columns ``keep`` and :func:`lexed_ddl`; of elements those in ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, rows = 0, 0, []
            for i in range(batch.num_rows):
                data = batch.column(column)[i].as_py()
                rows.append(lex(data, options, names))
                size += len(data or b"")
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(first, len(rows))
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep.names), *columns(rows, names)], names=[*keep.names, *arrow_names()])
                    first, size, rows = i + 1, 0, []

    return run


def arrow_names() -> list[str]:
    return ["version", "encoding", "bozo", "bozo_exception", "error", "namespaces", "head", "items", "json"]
