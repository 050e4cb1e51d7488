"""Feeds written from tables, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMESPACES = 'xmlns:atom="http://www.w3.org/2005/Atom" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:georss="http://www.georss.org/georss" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" xmlns:media="http://search.yahoo.com/mrss/" xmlns:podcast="https://podcastindex.org/namespace/1.0" xmlns:slash="http://purl.org/rss/1.0/modules/slash/" xmlns:sy="http://purl.org/rss/1.0/modules/syndication/" xmlns:thr="http://purl.org/syndication/thread/1.0"'


def escaped(value: Column) -> Column:
    """A value as XML text; null as nothing."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    for mark, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(reference))
    return text


def element(name: str, value: Column | str = "", /, **attrs: Column | str) -> Column:
    """An element with a text; ``_`` in attribute names stands for a colon."""
    parts = [F.lit(f"<{name}")]
    for k, v in attrs.items():
        parts += [F.lit(f' {k.rstrip("_").replace("_", ":")}="'), escaped(F.lit(v) if isinstance(v, str) else v), F.lit('"')]
    return F.concat(*parts, F.lit(">"), escaped(F.lit(value) if isinstance(value, str) else value), F.lit(f"</{name}>"))


def wrapped(name: str, /, *parts: Column, **attrs: Column | str) -> Column:
    """An element around others."""
    inside = [F.lit(f' {k.rstrip("_").replace("_", ":")}="') if i == 0 else (escaped(F.lit(v) if isinstance(v, str) else v) if i == 1 else F.lit('"')) for k, v in attrs.items() for i in range(3)]
    return F.concat(F.lit(f"<{name}"), *inside, F.lit(">"), *parts, F.lit(f"</{name}>"))


def gathered(rows: DataFrame, keys: list[str], item: Column, order: str) -> DataFrame:
    """One row per group: its items' markup in order, as ``items``."""
    pairs = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x")))).alias("_p"))
    return pairs.withColumn("items", F.array_join(F.transform("_p", lambda p: p["x"]), "")).drop("_p")


def rss(head: Column, items: Column = None) -> Column:
    """A whole RSS 2.0 document."""
    items = F.col("items") if items is None else items
    return F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" {NAMESPACES}><channel>'), head, items, F.lit("</channel></rss>")).cast("binary")


def atom(head: Column, items: Column = None) -> Column:
    """A whole Atom 1.0 document."""
    items = F.col("items") if items is None else items
    return F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom" {NAMESPACES}>'), head, items, F.lit("</feed>")).cast("binary")


def rdf(head: Column, items: Column = None) -> Column:
    """A whole RSS 1.0 document."""
    items = F.col("items") if items is None else items
    return F.concat(F.lit(f'<?xml version="1.0"?><rdf:RDF xmlns="http://purl.org/rss/1.0/" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" {NAMESPACES}><channel rdf:about="urn:channel">'), head, F.lit("</channel>"), items, F.lit("</rdf:RDF>")).cast("binary")
