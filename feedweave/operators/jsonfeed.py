"""Rules of JSON Feed 1.0 and 1.1, over a variant column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from feedweave.functions.dates import parse_date
from feedweave.functions.html import sanitizing
from feedweave.functions.values import truncate
from feedweave.operators.nodes import Fields, blank, build, capped, link, null, some
from feedweave.options import Limits, Options
from feedweave.plans import schema as S

_LINKS, _PERSONS = f"array<{S.LINK}>", f"array<{S.PERSON}>"


def get(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def text(v: Column, name: str) -> Column:
    """A string member; other types count as absent."""
    found = get(v, name, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", get(v, name))


def items(v: Column, name: str) -> Column:
    return F.coalesce(get(v, name, "array<variant>"), F.array().cast("array<variant>"))


def authors(v: Column) -> Column:
    """The authors, or the one author of version 1.0."""
    person = lambda a: build(S.PERSON, name=text(a, "name"), uri=text(a, "url"), avatar=text(a, "avatar"))
    several = F.transform(items(v, "authors"), person)
    one = get(v, "author", "variant")
    return F.when(F.size(several) > 0, several).when(one.isNotNull(), F.array(person(one))).otherwise(F.array().cast(_PERSONS))


def extensions(v: Column, limits: Limits) -> Column:
    """Members whose names begin with ``_`` and a letter, as JSON texts."""
    every = F.try_variant_get(v, "$", "map<string,variant>")
    own = F.map_filter(every, lambda k, x: k.rlike("^_[A-Za-z]"))
    written = F.map_filter(F.transform_values(own, lambda k, x: F.to_json(x)), lambda k, x: F.octet_length(x) <= limits.text_length)
    return F.map_from_entries(F.slice(F.array_sort(F.map_entries(written)), 1, limits.json_extensions))


def _detail(value: Column, language: Column) -> Column:
    """A text with its details. Texts are shown as markup by many readers, so they count as such."""
    return F.when(value.isNotNull(), build(S.TEXT, value=value, content_type=F.lit("html"), language=language))


def _short(value: Column, limits: Limits) -> Column:
    """An address, null if it is too long."""
    return F.when(F.octet_length(value) <= limits.text_length, value)


def prepare(session: SparkSession, options: Options) -> None:
    """Make what the rules call known to a session."""
    if options.sanitize_html:
        depth = options.limits.html_nesting_depth
        session.udf.register(_clean_name(depth), sanitizing(depth))


def _clean_name(depth: int) -> str:
    return f"feedweave_sanitized_{depth}"


def cleaner(options: Options) -> Callable[[Column], Column]:
    """What makes a text safe to show, if that is wanted; only texts with markup go through it."""
    if not options.sanitize_html:
        return lambda value: value
    name = _clean_name(options.limits.html_nesting_depth)
    return lambda value: F.when(value.rlike("[<>&\\xa0]"), F.call_function(name, value)).otherwise(value)


def _one(value: Column, made: Column, kind: str = _LINKS) -> Column:
    return F.when(value.isNotNull(), F.array(made)).otherwise(F.array().cast(kind))


def feed(v: Column, options: Options) -> Fields:
    """Fields of a JSON Feed."""
    limits, clean = options.limits, cleaner(options)
    shown = lambda name: clean(truncate(text(v, name), limits.text_length))
    title, subtitle = shown("title"), shown("description")
    language = text(v, "language")
    home, own = _short(text(v, "home_page_url"), limits), text(v, "feed_url")
    people = capped(authors(v), limits.authors)
    hubs = F.transform(items(v, "hubs"), lambda h: link(text(h, "url"), "hub", link_type=text(h, "type")))
    links = F.concat(_one(home, link(home, "alternate")), _one(own, link(own, "self", link_type=F.lit("application/feed+json"))), some(hubs, lambda h: h["href"].isNotNull()))
    return {
        "title": title,
        "title_detail": _detail(title, null()),
        "link": home,
        "links": capped(links, limits.links_per_feed),
        "subtitle": subtitle,
        "subtitle_detail": _detail(subtitle, null()),
        "icon": _short(text(v, "icon"), limits),
        "logo": _short(text(v, "favicon"), limits),
        "author": F.get(people, F.lit(0))["name"],
        "author_detail": F.get(people, F.lit(0)),
        "authors": people,
        "language": language,
        "ttl": F.when(get(v, "expired", "boolean"), "0"),
        "next_url": text(v, "next_url"),
        "json_extensions": extensions(v, limits),
    }


def entry(e: Column, v: Column, options: Options) -> Fields:
    """Fields of a JSON item ``e`` in the feed ``v``."""
    limits, clean = options.limits, cleaner(options)
    cut = lambda name: truncate(text(e, name), limits.text_length)
    title = clean(cut("title"))
    language = F.coalesce(text(e, "language"), text(v, "language"))
    url, other, image, banner = text(e, "url"), text(e, "external_url"), text(e, "image"), text(e, "banner_image")
    html, plain, summary = clean(cut("content_html")), cut("content_text"), clean(cut("summary"))
    kind = f"array<{S.CONTENT}>"
    content = F.concat(
        _one(html, build(S.CONTENT, value=html, content_type=F.lit("text/html"), language=language), kind),
        _one(plain, build(S.CONTENT, value=plain, content_type=F.lit("text/plain"), language=language), kind),
    )
    own = authors(e)
    people = capped(F.when(F.size(own) > 0, own).otherwise(authors(v)), limits.authors)
    files = F.transform(items(e, "attachments"), lambda a: build(S.ENCLOSURE, url=text(a, "url"), length=get(a, "size_in_bytes"), enclosure_type=text(a, "mime_type"), title=text(a, "title"), duration=get(a, "duration_in_seconds")))
    links = F.concat(_one(url, link(url, "alternate")), _one(other, link(other, "related")), _one(image, link(image, "enclosure", link_type=F.lit("image/*"))), _one(banner, link(banner, "banner")))
    terms = F.transform(items(e, "tags"), lambda t: build(S.TAG, term=F.try_variant_get(t, "$", "string")))
    return {
        "id": text(e, "id"),
        "title": title,
        "title_detail": _detail(title, language),
        "link": url,
        "links": capped(links, limits.links_per_entry),
        "summary": F.coalesce(summary, null()),
        "summary_detail": _detail(summary, language),
        "content": capped(content, limits.content_blocks),
        "published": parse_date(text(e, "date_published")),
        "published_str": text(e, "date_published"),
        "updated": parse_date(text(e, "date_modified")),
        "updated_str": text(e, "date_modified"),
        "author": F.get(people, F.lit(0))["name"],
        "author_detail": F.get(people, F.lit(0)),
        "authors": people,
        "tags": capped(some(terms, lambda t: blank(t["term"]).isNotNull()), limits.tags),
        "enclosures": capped(some(files, lambda x: x["url"].isNotNull()), limits.enclosures),
        "language": language,
        "external_url": other,
        "json_extensions": extensions(e, limits),
    }
