"""Parsing in SQL text: a table function that lexes, and one that makes entries of it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, StructField, StructType

from feedweave.functions.sql import create_table_function, sql_of
from feedweave.options import Options
from feedweave.plans.parse import entry_rules
from feedweave.plans.schema import ENTRY
from feedweave.sources.lexer import Names, Part, columns_of, field_of, lex, lexed_ddl


def _names(feed: str | None, entry: str | None) -> Names:
    return tuple(None if x is None else frozenset(x.split()) for x in (feed, entry))


def _row(part: Part | None, names: frozenset[str] | None) -> tuple | None:
    """A feed or an entry as a value of the type that the names give it."""
    if part is None:
        return None

    def node(n: tuple) -> tuple:
        return (*n[:2], dict(n[2]), *n[3:10], [(up, name, dict(attrs), text) for up, name, attrs, text in n[10]])

    found = {name: [node(n) for n in nodes] for name, nodes in part.nodes.items()}
    return part.attrs, part.base, part.lang, found if names is None else tuple(found.get(n) for n in columns_of(names))


def lexer(options: Options) -> type:
    """The table function ``lex_feed(content, feed_names, entry_names)``: a row per document.

    Its columns depend on the names, element names with spaces between them, that are wanted of the feed
    and of its entries: nodes have a field for each (null: a map of all).
    """

    every = StructType.fromDDL(lexed_ddl())
    scope = every["head"].dataType

    def narrowed(names: frozenset[str] | None) -> StructType:
        if names is None:
            return scope
        nodes = StructType([StructField(field_of(n), scope["nodes"].dataType.valueType) for n in columns_of(names)])
        return StructType([*scope.fields[:3], StructField("nodes", nodes)])

    class LexFeed:
        @staticmethod
        def analyze(content: AnalyzeArgument, feed_names: AnalyzeArgument, entry_names: AnalyzeArgument) -> AnalyzeResult:
            head, entry = map(narrowed, _names(feed_names.value, entry_names.value))
            changed = {"head": head, "items": ArrayType(entry)}
            return AnalyzeResult(StructType([StructField(f.name, changed.get(f.name, f.dataType)) for f in every.fields]))

        def eval(self, content: bytes | None, feed_names: str | None, entry_names: str | None) -> Iterator[tuple]:
            names = _names(feed_names, entry_names)
            r = lex(None if content is None else bytes(content), options, names)
            yield r.version, r.encoding, r.bozo, r.bozo_exception, r.error, r.namespaces, _row(r.head, names[0]), [_row(p, names[1]) for p in r.items], r.json

    return LexFeed


def create_entry_function(spark: SparkSession, name: str = "parse_feed_entries", options: Options = Options(), entry_fields: Iterable[str] | None = None) -> None:
    """A table function of a document: a row per entry with ``version``, ``entry_idx`` and the fields.

    In SQL: ``SELECT d.path, e.title FROM docs d, LATERAL parse_feed_entries(d.content) e``. Only
    lexing is Python; the rules are the same columns as in :func:`parse_entries`, and those of fields
    that a query leaves out are not computed. ``entry_fields`` (default: all) says what is lexed.

    Spark calls it for each different document and joins the rows back by the whole content, by a
    broadcast if it takes them to be few. For many documents, :func:`create_entry_view` has no join.
    """
    kinds = [(n, ENTRY[n]) for n in ENTRY if entry_fields is None or n in entry_fields]
    body = _entries(spark, name, options, entry_fields, [], lambda call: f"FROM {call}")
    create_table_function(spark, name, "content BINARY", [("version", "STRING"), ("entry_idx", "INT"), *kinds], body)


def create_entry_view(spark: SparkSession, name: str, docs: str, content: str = "content", options: Options = Options(), entry_fields: Iterable[str] | None = None) -> None:
    """A temporary view of a table of documents: its columns but the content, and those of the table function, a row per entry.

    Each document is lexed where it is and its rows keep its columns: there is no shuffle and no join.
    """
    kept = [c for c in spark.table(docs).columns if c != content]
    body = _entries(spark, name, options, entry_fields, kept, lambda call: f"FROM {docs}, LATERAL {call}", content)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{name}` AS {body}")


def _entries(spark: SparkSession, name: str, options: Options, entry_fields: Iterable[str] | None, kept: list[str], source: Callable[[str], str], content: str = "content") -> str:
    """The query that lexes and applies the rules; ``kept`` are columns of the source's table."""
    spark.udtf.register(f"{name}_lex", udtf(lexer(options)).asDeterministic())
    rules = entry_rules(spark, options, entry_fields)
    feed_names, entry_names = (" ".join(sorted(x)) for x in rules.names)
    own = f"struct({', '.join(f'`{c}`' for c in kept)})" if kept else "null"
    lexed = f"SELECT {own} AS _own, _l.*, try_parse_json(_l.json) AS _v {source(f"{name}_lex(`{content}`, '{feed_names}', '{entry_names}')")} _l"
    rows = f"SELECT _own, version, head, _v, entry_idx, _e FROM ({lexed}) LATERAL VIEW posexplode({sql_of(rules.entries)}) _t AS entry_idx, _e"
    staged = "".join(f", {sql_of(c)} AS `{n}`" for n, c in rules.staged.items())
    fields = ", ".join([*(f"_own.`{c}`" for c in kept), "version", "entry_idx", *(sql_of(c) for c in rules.fields)])
    return f"SELECT {fields} FROM (SELECT *{staged} FROM ({rows}))"
