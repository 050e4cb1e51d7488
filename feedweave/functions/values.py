"""Small scalar rules on columns: persons, flags, versions, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The versions that parsing reports, and namespaces by prefix.
VERSIONS = ("rss090", "rss091n", "rss091u", "rss092", "rss10", "rss20", "atom03", "atom10", "json10", "json11", "")
KNOWN_VERSIONS = ("", "rss090", "rss091", "rss092", "rss10", "rss20", "atom03", "atom10", "json10", "json11")
NAMESPACES = {
    "dc": "http://purl.org/dc/elements/1.1/",
    "content": "http://purl.org/rss/1.0/modules/content/",
    "media": "http://search.yahoo.com/mrss/",
    "itunes": "http://www.itunes.com/dtds/podcast-1.0.dtd",
    "podcast": "https://podcastindex.org/namespace/1.0",
    "atom": "http://www.w3.org/2005/Atom",
    "sy": "http://purl.org/rss/1.0/modules/syndication/",
    "slash": "http://purl.org/rss/1.0/modules/slash/",
    "wfw": "http://wellformedweb.org/CommentAPI/",
    "georss": "http://www.georss.org/georss",
    "gml": "http://www.opengis.net/gml",
    "geo": "http://www.w3.org/2003/01/geo/wgs84_pos#",
    "thr": "http://purl.org/syndication/thread/1.0",
    "creativeCommons": "http://backend.userland.com/creativeCommonsRssModule",
    "cc": "http://web.resource.org/cc/",
}
PERSON = "struct<name:string,email:string,uri:string,avatar:string>"


def blank_to_null(text: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def parse_person(text: Column) -> Column:
    """A person of ``email (Name)``, ``Name <email>``, an address, or a name."""
    s = F.regexp_replace(text, r"^\s+|\s+$", "")
    one, two = r"^([^(]*)\((.*)\)[^)]*$", r"^([^<]*)<([^>]*)>"
    part = lambda p, k: blank_to_null(F.regexp_extract(s, p, k))
    null = F.lit(None).cast("string")
    build = lambda name, mail: F.struct(name.alias("name"), mail.alias("email"), null.alias("uri"), null.alias("avatar"))
    before = F.trim(F.regexp_extract(s, one, 1))
    return (
        F.when(s == "", F.lit(None).cast(PERSON))
        .when(s.rlike(one) & before.contains("@"), build(part(one, 2), part(one, 1)))
        .when(s.rlike(two), build(part(two, 1), part(two, 2)))
        .when(s.contains("@"), build(null, s))
        .otherwise(build(s, null))
    )


def flat_person(person: Column) -> Column:
    """``name (email)``, or the one of them that is there."""
    name, mail = person["name"], person["email"]
    return F.when(name.isNotNull() & mail.isNotNull(), F.concat(name, F.lit(" ("), mail, F.lit(")"))).otherwise(F.coalesce(name, mail))


def parse_explicit(text: Column) -> Column:
    """True for yes, true or explicit, else null; never false."""
    return F.when(F.lower(F.trim(text)).isin("yes", "true", "explicit"), F.lit(True))


def text_type(kind: Column) -> Column:
    """text, html or xhtml; an unknown type counts as html."""
    k = F.lower(F.trim(kind))
    return F.when(k.isin("text", "text/plain"), "text").when(k.isin("xhtml", "application/xhtml+xml"), "xhtml").otherwise("html")


def mime_type(kind: Column) -> Column:
    """The media type of an Atom content type; plain text if there is none."""
    return F.when(kind.isNull() | (kind == "text"), "text/plain").when(kind == "html", "text/html").when(kind == "xhtml", "application/xhtml+xml").otherwise(kind)


def format_duration(seconds: Column) -> Column:
    """Seconds as H:MM:SS."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def is_valid_version(version: Column) -> Column:
    """Whether this is the name of a known format."""
    return version.isin(*[v for v in KNOWN_VERSIONS if v])


def normalize_version(version: Column) -> Column:
    """A version's name in lower case, without spaces, dots, marks or dashes."""
    return F.regexp_replace(F.lower(F.trim(version)), r"[\s._-]+", "")


def update_period(text: Column) -> Column:
    """hourly, daily, weekly, monthly or yearly in any case, else null."""
    k = F.lower(F.trim(text))
    return F.when(k.isin("hourly", "daily", "weekly", "monthly", "yearly"), k)


def namespace_prefix(uri: Column) -> Column:
    """The usual prefix of a namespace, null if it is not known."""
    return F.element_at(F.create_map(*[F.lit(x) for p, u in NAMESPACES.items() for x in (u, p)]), uri)


def namespace_uri(prefix: Column) -> Column:
    """The namespace of a usual prefix, null if it is not known."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in NAMESPACES.items() for x in pair]), prefix)


def truncate(text: Column, most: int | Column) -> Column:
    """Text of over ``most`` bytes cut to as many characters."""
    return F.when(F.octet_length(text) <= most, text).otherwise(F.left(text, F.lit(most)))


def content_type_charset(header: Column) -> Column:
    """The charset of a Content-Type header, quoted or not, else null."""
    found = F.regexp_extract(header, r"(?i)charset\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^;\s\"']+))", 0)
    value = F.regexp_replace(found, r"(?i)^charset\s*=\s*", "")
    return blank_to_null(F.regexp_replace(value, "[\"']", ""))
