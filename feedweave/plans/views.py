"""Flat tables of parsed entries, and views under the usual field names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Views of one row per element of an array field, by name.
ARRAYS = {
    "entry_links": "links",
    "entry_tags": "tags",
    "entry_authors": "authors",
    "entry_contributors": "contributors",
    "entry_enclosures": "enclosures",
    "entry_content": "content",
    "entry_media": "media_content",
    "entry_thumbnails": "media_thumbnail",
    "entry_credits": "media_credit",
    "entry_replies": "in_reply_to",
    "entry_podcast_transcripts": "podcast_transcripts",
    "entry_podcast_persons": "podcast_persons",
}
#: Other names of fields, each for the first of the fields that is there.
FEED_ALIASES = {
    "description": ("subtitle", "summary"), "description_detail": ("subtitle_detail", "summary_detail"), "tagline": ("subtitle",), "tagline_detail": ("subtitle_detail",),
    "info": ("subtitle",), "info_detail": ("subtitle_detail",), "copyright": ("rights",), "copyright_detail": ("rights_detail",), "modified": ("updated",), "date": ("updated", "published"), "url": ("link",),
}
ENTRY_ALIASES = {"guid": ("id",), "description": ("summary",), "description_detail": ("summary_detail",), "issued": ("published",), "modified": ("updated",), "date": ("updated", "published")}


def elements(entries: DataFrame, keys: list[str], array: str) -> DataFrame:
    """One row per element of an array field: ``keys``, ``entry_idx``, ``pos`` and its fields."""
    rows = entries.select(*keys, "entry_idx", F.posexplode(array).alias("pos", "_x"))
    return rows.select(*keys, "entry_idx", "pos", "_x.*")


def geo(entries: DataFrame, keys: list[str]) -> DataFrame:
    """One row per coordinate of the entries' places."""
    rows = entries.where(F.col("where").isNotNull()).select(*keys, "entry_idx", "where.geo_type", "where.srs_name", "where.elev", F.posexplode("where.coordinates").alias("pos", "_x"))
    return rows.select(*keys, "entry_idx", "geo_type", "srs_name", "elev", "pos", "_x.lat", "_x.lon")


def feeds(parsed: DataFrame) -> DataFrame:
    """Parsed documents with the fields of the feed as columns."""
    return parsed.select(*[c for c in parsed.columns if c not in ("feed", "entries")], "feed.*")


def with_aliases(rows: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """``rows`` with other names of its fields, where those are there and the name is free."""
    more = {name: F.coalesce(*[F.col(f) for f in fields if f in rows.columns]) for name, fields in aliases.items() if name not in rows.columns and any(f in rows.columns for f in fields)}
    return rows.withColumns(more)


def flat_itunes(rows: DataFrame) -> DataFrame:
    """``rows`` with the iTunes and syndication structs also as flat columns."""
    more = {}
    for struct, prefix in (("itunes", "itunes_"), ("syndication", "sy_")):
        if struct in rows.columns:
            for f in rows.schema[struct].dataType.names:
                more[prefix + (f.replace("_", "") if prefix == "sy_" else f)] = F.col(struct)[f]
    return rows.withColumns(more)


def register(entries: DataFrame, keys: list[str], prefix: str = "") -> list[str]:
    """Temporary views of all flat tables; returns their names."""
    entries.createOrReplaceTempView(f"{prefix}entries")
    for name, array in ARRAYS.items():
        elements(entries, keys, array).createOrReplaceTempView(prefix + name)
    geo(entries, keys).createOrReplaceTempView(f"{prefix}entry_geo")
    return [f"{prefix}{n}" for n in ("entries", *ARRAYS, "entry_geo")]
