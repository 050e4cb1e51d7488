"""Resource limits and parsing options."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

KIB, MIB = 1 << 10, 1 << 20


def bounded(spark: SparkSession, most: int = 8 * MIB) -> None:
    """Keep what goes to Python at once to about ``most`` bytes: batches are by rows else, however long these are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(spark.conf.get(key))
    except ValueError:
        now = -1
    if not 0 < now <= most:
        spark.conf.set(key, str(most))


@dataclass(frozen=True)
class Limits:
    """How much of a document is kept; items beyond a limit are left out."""

    entries: int = 10_000
    links_per_feed: int = 100
    links_per_entry: int = 50
    authors: int = 20
    contributors: int = 20
    tags: int = 100
    content_blocks: int = 10
    enclosures: int = 20
    namespaces: int = 100
    nesting_depth: int = 100
    html_nesting_depth: int = 100
    text_length: int = 10 * MIB
    feed_size: int = 100 * MIB
    attribute_length: int = 64 * KIB
    soundbites: int = 10
    transcripts: int = 20
    funding: int = 20
    persons: int = 50
    value_recipients: int = 20
    alternate_enclosures: int = 20
    alternate_enclosure_sources: int = 10
    podroll: int = 50
    social_interact: int = 20
    txt: int = 20
    follow: int = 20
    chat: int = 20
    value_time_splits: int = 20
    json_extensions: int = 100

    @classmethod
    def strict(cls) -> Limits:
        return cls(1000, 20, 10, 5, 5, 20, 3, 5, 20, 50, 50, MIB, 10 * MIB, 8 * KIB, 5, 5, 5, 10, 5, 5, 3, 10, 5, 5, 5, 5, 5, 20)

    @classmethod
    def permissive(cls) -> Limits:
        return cls(100_000, 500, 200, 100, 100, 500, 50, 100, 500, 200, 200, 50 * MIB, 500 * MIB, 256 * KIB, 50, 100, 50, 200, 50, 100, 50, 200, 100, 100, 100, 100, 50, 500)


@dataclass(frozen=True)
class Options:
    """What parsing does beside extraction. ``mode`` is PERMISSIVE, where a document
    that cannot be parsed has an ``error``, or FAILFAST, where it ends the job."""

    resolve_relative_uris: bool = True
    sanitize_html: bool = True
    limits: Limits = field(default_factory=Limits)
    mode: str = "PERMISSIVE"

    @classmethod
    def strict(cls) -> Options:
        return cls(resolve_relative_uris=False, limits=Limits.strict())

    @classmethod
    def permissive(cls) -> Options:
        return cls(sanitize_html=False, limits=Limits.permissive())

    def with_limits(self, limits: Limits) -> Options:
        return replace(self, limits=limits)
