"""Documents to feeds and entries."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from feedweave.operators import atom, jsonfeed, rss
from feedweave.operators.extensions import bad_gml
from feedweave.operators.nodes import Fields, Scope
from feedweave.options import Options, bounded
from feedweave.plans.large import lex_large
from feedweave.plans.schema import ENTRY, FEED
from feedweave.sources.lexer import Names, lexed_ddl, lexing, scope_ddl

ATOM, RDF, JSON = ("atom03", "atom10"), ("rss10",), ("json10", "json11")
GML_MISMATCH = "GML coordinate list length is not a multiple of resolved srsDimension"
STATUS = ("bozo", "bozo_exception", "encoding", "version", "namespaces", "error")


def lex(docs: DataFrame, content: str = "content", options: Options = Options(), names: Names = (None, None)) -> DataFrame:
    """``docs`` without the content, with the columns of :func:`lexed_ddl`: one pass, no shuffle.

    ``names`` are the elements wanted of the feed and of entries (default: all).
    """
    bounded(docs.sparkSession)
    keep = StructType([f for f in docs.schema.fields if f.name != content])
    out = StructType([*keep.fields, *StructType.fromDDL(lexed_ddl(names)).fields])
    return docs.mapInArrow(lexing(options, to_arrow_schema(keep), content, names), out)


def _pick(fields: dict[str, str], wanted: Iterable[str] | None, by_format: dict[str, Fields], version: Column) -> list[Column]:
    """One column per field: what the rules of the document's format say."""
    kinds = {"atom": version.isin(*ATOM), "rdf": version.isin(*RDF), "json": version.isin(*JSON), "rss": version.startswith("rss") & ~version.isin(*RDF)}
    out = []
    for name, ddl in fields.items():
        if wanted is not None and name not in wanted:
            continue
        column = F.lit(None).cast(ddl)
        for kind, rules in by_format.items():
            if name in rules:
                column = F.when(kinds[kind], rules[name].cast(ddl)).otherwise(column)
        if ddl.startswith("array") and name not in ("skiphours", "skipdays"):
            column = F.coalesce(column, F.array().cast(ddl))
        out.append(column.alias(name))
    return out


def _limited(v: Column, options: Options) -> Column:
    return F.slice(jsonfeed.items(v, "items"), 1, options.limits.entries)


def _with_json(lexed: DataFrame) -> DataFrame:
    return lexed.withColumn("_v", F.try_parse_json("json"))


@dataclass
class Rules:
    """The rules of all formats, and the staged columns that they refer to."""

    by_format: dict[str, Fields]
    staged: dict[str, Column]
    status: dict[str, Column]
    head: Scope
    own: Scope | None

    def used(self, columns: list[Column]) -> tuple[dict[str, Column], Names]:
        """The staged columns that some columns refer to, and the elements that all refer to."""
        text = " ".join(c._jc.toString() for c in columns)
        staged = {n: c for n, c in self.staged.items() if n in text}
        text = " ".join([text, *(c._jc.toString() for c in staged.values())])
        return staged, (self.head.wanted(text), self.own.wanted(text) if self.own else frozenset(("georss:where",)))


@lru_cache(maxsize=32)
def _rules(options: Options, session: SparkSession, entries: bool) -> Rules:
    """The rules as columns; they name columns only, so one making serves all documents."""
    head = Scope(F.col("head"), options.limits, "_f_")
    jsonfeed.prepare(session, options)
    if entries:
        own = Scope(F.col("_e.item"), options.limits, "_e_")
        full = rss.entry(own, head)
        made = {"rss": full, "rdf": rss.rdf_entry(own, full), "atom": atom.entry(own, head), "json": jsonfeed.entry(F.col("_e.element"), F.col("_v"), options)}
        return Rules(made, head.staged | own.staged, {}, head, own)
    full = rss.feed(head)
    made = {"rss": full, "rdf": rss.rdf_feed(head, full), "atom": atom.feed(head), "json": jsonfeed.feed(F.col("_v"), options)}
    status = _status(head, options)
    return Rules(made, head.staged, status, head, None)


def _status(head: Scope, options: Options) -> dict[str, Column]:
    """What went wrong, where the lexer cannot tell."""
    is_json = F.col("json").isNotNull()
    bad_json = is_json & F.col("_v").isNull()
    missing = is_json & F.col("_v").isNotNull() & jsonfeed.get(F.col("_v"), "version", "variant").isNull()
    unknown = is_json & ~missing & ~bad_json & (F.col("version") == "")
    dates = F.when(F.col("version").startswith("rss") & ~F.col("version").isin(*RDF), F.coalesce(rss.bad_dates(head), rss.bad_image(head)))
    # nodes of entries, too, for what only their values tell
    shapes = F.when(bad_gml(head) | F.coalesce(F.exists("items", lambda x: bad_gml(Scope(x, options.limits))), F.lit(False)), GML_MISMATCH)
    many = is_json & (F.size(jsonfeed.items(F.col("_v"), "items")) > options.limits.entries)
    reason = F.coalesce(F.col("bozo_exception"), F.when(bad_json, "JSON parse error").when(unknown, "Unknown JSON Feed version").when(many, f"Entry limit exceeded: {options.limits.entries}"), dates, shapes)
    return {"bozo": F.col("bozo") | reason.isNotNull() | missing, "bozo_exception": reason, "error": F.coalesce(F.col("error"), F.when(missing, "Missing version field"))}


def _checked(df: DataFrame, options: Options) -> DataFrame:
    if options.mode != "FAILFAST":
        return df
    return df.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).cast("string"))


def parse_feeds(docs: DataFrame, content: str = "content", options: Options = Options(), feed_fields: Iterable[str] | None = None) -> DataFrame:
    """One row per document: its columns, ``feed``, ``n_entries`` and how parsing went.

    ``feed_fields`` names the fields of the feed to extract (default: all), which
    spares the rules of the others. Status columns are ``bozo``, ``bozo_exception``,
    ``encoding``, ``version``, ``namespaces`` and ``error``.
    """
    keep = [c for c in docs.columns if c != content]
    rules = _rules(options, docs.sparkSession, False)
    fields, status = _pick(FEED, feed_fields, rules.by_format, F.col("version")), rules.status
    staged, names = rules.used([*fields, *status.values()])
    lexed = _with_json(lex(docs, content, options, names))
    n = F.when(F.col("json").isNotNull(), F.size(_limited(F.col("_v"), options))).otherwise(F.coalesce(F.size("items"), F.lit(0)))
    out = lexed.withColumns(staged).select(*keep, F.struct(*fields).alias("feed"), n.alias("n_entries"), *[status.get(c, F.col(c)).alias(c) for c in STATUS])
    return _checked(out, options)


@dataclass
class EntryRules:
    """What makes rows of lexed documents: entries as ``_e``, staged columns, fields, and the elements they refer to."""

    entries: Column
    staged: dict[str, Column]
    fields: list[Column]
    names: Names


def entry_rules(session: SparkSession, options: Options, wanted: Iterable[str] | None) -> EntryRules:
    rules = _rules(options, session, True)
    fields = _pick(ENTRY, wanted, rules.by_format, F.col("version"))
    staged, names = rules.used(fields)
    scope = scope_ddl(names[1])
    scopes = F.coalesce(F.transform("items", lambda x: F.struct(x.alias("item"), F.lit(None).cast("variant").alias("element"))), F.array().cast(f"array<struct<item:{scope},element:variant>>"))
    elements = F.transform(_limited(F.col("_v"), options), lambda x: F.struct(F.lit(None).cast(scope).alias("item"), x.alias("element")))
    return EntryRules(F.when(F.col("json").isNotNull() & (F.col("version") != ""), elements).otherwise(scopes), staged, fields, names)


def parse_entries(docs: DataFrame, content: str = "content", options: Options = Options(), entry_fields: Iterable[str] | None = None, piece: int | None = None) -> DataFrame:
    """One row per entry: the document's columns, ``version``, ``entry_idx`` and the fields.

    Documents without entries give no rows. Entries are exploded before rules
    are applied, so that each is a row of plain columns. Documents of more than ``piece``
    bytes are dealt out and lexed in pieces of about that size (default: each by one task, without a shuffle).
    """
    keep = [c for c in docs.columns if c != content]
    rules = entry_rules(docs.sparkSession, options, entry_fields)
    lexed = _with_json(lex(docs, content, options, rules.names).withColumn("_first", F.lit(0)) if piece is None else lex_large(docs, content, options, rules.names, piece))
    rows = lexed.select(*keep, "version", "head", "_v", "_first", F.posexplode(rules.entries).alias("entry_idx", "_e"))
    rows = rows.withColumn("entry_idx", (F.col("entry_idx") + F.col("_first")).cast("int"))
    if piece is not None:
        rows = rows.where(F.col("entry_idx") < options.limits.entries)
    return rows.withColumns(rules.staged).select(*keep, "version", "entry_idx", *rules.fields)


def parse(docs: DataFrame, key: str, content: str = "content", options: Options = Options()) -> DataFrame:
    """One row per document with its entries nested, as :func:`parse_feeds` and ``entries``.

    ``key`` identifies documents; entries are gathered by it, in order.
    """
    feeds = parse_feeds(docs, content, options)
    entries = parse_entries(docs.select(key, content), content, options)
    body = F.struct("entry_idx", *[F.col(n) for n in ENTRY])
    ordered = lambda a, b: a["entry_idx"] - b["entry_idx"]
    grouped = entries.groupBy(key).agg(F.array_sort(F.collect_list(body), ordered).alias("entries"))
    return feeds.join(grouped.hint("merge"), key, "left")
