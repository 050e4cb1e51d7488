"""Columns over lexed nodes: the vocabulary that the format rules are written in.

A scope is the feed or one entry: its nodes by canonical name, each list in
document order. Rules pick the first or last node of a name, or all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.functions.columns import let
from feedweave.functions.dates import parse_date
from feedweave.functions.values import flat_person, parse_person, text_type
from feedweave.options import Limits
from feedweave.plans import schema as S
from feedweave.sources.lexer import NODE, field_of

Fields = dict[str, Column]


def null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def build(kind: str, **values: Column) -> Column:
    """A struct of a type in DDL; fields without a value are null."""
    return F.struct(*[values.get(n, F.lit(None)).alias(n) for n in _names(kind)]).cast(kind)


def _names(kind: str) -> list[str]:
    """The field names of a struct type in DDL."""
    names, depth, word = [], 0, ""
    for c in kind[len("struct<") : -1]:
        if c == ":" and depth == 0:
            names.append(word.strip("`"))
        if c in "<(":
            depth += 1
        elif c in ">)":
            depth -= 1
        word = "" if c == "," and depth == 0 else word + c
    return [n.rpartition(",")[2] for n in names]


class Scope:
    """The feed or an entry as columns."""

    def __init__(self, column: Column, limits: Limits, prefix: str = ""):
        self.c, self.limits, self.prefix = column, limits, prefix
        self.nodes, self.base, self.lang = column["nodes"], column["base"], column["lang"]
        self.staged: dict[str, Column] = {}
        self.asked: set[str] = set()
        self.fields: dict[str, list[str]] = {}

    def stage(self, name: str, make: Callable[[], Column]) -> Column:
        """A value that several rules use, as a column of its own, made once for all formats."""
        name = self.prefix + name
        if name not in self.staged:
            self.staged[name] = make()
        return F.col(name)

    def attr(self, name: str) -> Column:
        return F.element_at(self.c["attrs"], name)

    def element(self, name: str) -> Column:
        """The nodes of a name, null if there are none."""
        self.asked.add(name)
        return self.nodes[field_of(name)]

    def wanted(self, text: str) -> frozenset[str]:
        """Which of the names that were asked for are in the text of some columns."""
        return frozenset(n for n in self.asked if self.nodes[field_of(n)]._jc.toString() in text)

    def all(self, *names: str) -> Column:
        """All nodes of the names, in document order; an empty array if there are none."""
        none = F.array().cast(_nodes_type())
        found = [F.coalesce(self.element(n), none) for n in names]
        return found[0] if len(found) == 1 else F.array_sort(F.concat(*found), lambda a, b: a["pos"] - b["pos"])

    def first(self, name: str) -> Column:
        return F.get(self.element(name), F.lit(0))

    def last(self, *names: str) -> Column:
        if len(names) == 1:
            return F.try_element_at(self.element(names[0]), F.lit(-1))
        return F.try_element_at(self.all(*names), F.lit(-1))

    def text(self, *names: str) -> Column:
        """The last node's text, null if it is empty."""
        return blank(self.last(*names)["text"])

    def first_text(self, name: str) -> Column:
        """The first text of a name that is not empty."""
        return F.get(F.filter(F.transform(self.all(name), lambda n: n["text"]), lambda t: t != ""), F.lit(0))

    def date(self, *names: str) -> Column:
        return self.stage(f"date_{names[0]}", lambda: parse_date(self.text(*names)))


def _nodes_type() -> str:
    return f"array<{NODE}>"


def blank(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def shown(node: Column) -> Column:
    """The text of a node, sanitized if that is wanted."""
    return F.coalesce(node["clean"], node["text"])


def url_of(node: Column, name: str = "url") -> Column:
    """A URL attribute, made absolute where that is safe."""
    return F.element_at(node["attrs"], f"@{name}")


def at(node: Column, name: str) -> Column:
    return F.element_at(node["attrs"], name)


def kids(node: Column, *names: str) -> Column:
    return F.filter(node["kids"], lambda k: k["name"].isin(*names))


def kid(node: Column, name: str) -> Column:
    """The text of the last direct child of a name."""
    found = F.filter(node["kids"], lambda k: (k["name"] == name) & (k["up"] == -1))
    return blank(F.try_element_at(found, F.lit(-1))["text"])


def text_construct(node: Column, kind: str = "html") -> Column:
    """An RSS text with its language and base; null without a node."""
    return let(node, lambda n: F.when(n.isNotNull(), build(S.TEXT, value=shown(n), content_type=F.lit(kind), language=n["lang"], base=n["base"])))


def atom_text(node: Column) -> Column:
    """An Atom text construct: the markup of XHTML, plain text as it is, else HTML."""

    def made(n: Column) -> Column:
        kind = F.when(at(n, "type").isNull(), "html").otherwise(text_type(at(n, "type")))
        value = F.when(kind == "xhtml", F.coalesce(n["xml"], shown(n))).when(kind == "text", n["text"]).otherwise(shown(n))
        return F.when(n.isNotNull(), build(S.TEXT, value=value, content_type=kind, language=n["lang"], base=n["base"]))

    return let(node, made)


def link(href: Column, rel: str | Column | None, **more: Column) -> Column:
    return build(S.LINK, href=href, rel=F.lit(rel) if isinstance(rel, str) else rel if rel is not None else null(), **more)


def capped(items: Column, most: int) -> Column:
    return F.slice(items, 1, most)


def some(items: Column, keep: Callable[[Column], Column]) -> Column:
    return F.filter(items, keep)


def person_field(s: Scope, name: str) -> tuple[Column, Column]:
    """The raw text of the last node of a name, and the person that it names."""
    raw = s.text(name)
    return raw, s.stage(f"person_{name}", lambda: F.when(raw.isNotNull(), parse_person(raw)))


def atom_person(node: Column) -> Column:
    return let(node, lambda n: F.when(n.isNotNull(), build(S.PERSON, name=kid(n, "name"), email=kid(n, "email"), uri=F.coalesce(kid(n, "uri"), kid(n, "url")))))


def flat(person: Column) -> Column:
    return F.when(person.isNotNull(), flat_person(person))


def struct_if(values: Fields, kind: str) -> Column:
    """A struct of a type, null unless one of its values is there (arrays: not empty)."""
    def made(held: Column) -> Column:
        there = F.lit(False)
        for name in values:
            there |= held[name].isNotNull()
        return F.when(there, build(kind, **{name: held[name] for name in values}))

    return let(F.struct(*[v.alias(name) for name, v in values.items()]), made)


def listed(items: Column) -> Column:
    """An array, null if it is empty."""
    return F.when(F.size(items) > 0, items)


def number(text: Column, kind: str = "bigint") -> Column:
    return F.trim(text).try_cast(kind)


def words_of(text: Column) -> Column:
    """Comma-separated words, trimmed, without empty ones."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))

