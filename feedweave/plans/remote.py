"""Addresses to parsed feeds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.functions.values import content_type_charset
from feedweave.options import Options
from feedweave.plans.parse import parse_feeds
from feedweave.sources.fetch import fetch_feeds


def parse_urls(urls: DataFrame, url: str = "url", options: Options = Options(), feed_fields: Iterable[str] | None = None, **request) -> DataFrame:
    """Fetch the addresses of a table and parse what comes back.

    As ``fetch_feeds`` (whose options ``request`` takes) and ``parse_feeds``; an
    unchanged document (status 304) has an empty feed, no error, and the etag and
    date of the request; a failed request has an ``error``. A charset in the
    answer's content type replaces the name of the encoding, not the decoding.
    """
    got = fetch_feeds(urls, url, most=options.limits.feed_size, **request)
    parsed = parse_feeds(got, "body", options, feed_fields)
    same = F.col("status") == 304
    return parsed.withColumns(
        {
            "error": F.when(same, F.lit(None).cast("string")).otherwise(F.coalesce("fetch_error", "error")),
            "bozo": F.col("bozo") & ~F.coalesce(same, F.lit(False)),
            "encoding": F.coalesce(F.lower(content_type_charset(F.col("content_type"))), F.col("encoding")),
        }
    )
