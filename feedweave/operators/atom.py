"""Rules of Atom 0.3 and 1.0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.functions.dates import parse_date
from feedweave.functions.values import mime_type
from feedweave.operators import extensions as X
from feedweave.operators.nodes import Fields, Scope, at, atom_person, atom_text, blank, build, capped, flat, kid, kids, link, number, shown, some, struct_if, url_of
from feedweave.plans import schema as S

_LINKS, _PERSONS = f"array<{S.LINK}>", f"array<{S.PERSON}>"


def _links(s: Scope) -> Column:
    return s.stage("links", lambda: _made_links(s))


def _made_links(s: Scope) -> Column:
    def made(n: Column) -> Column:
        rel = F.coalesce(at(n, "rel"), F.lit("alternate"))
        kind = F.coalesce(at(n, "type"), F.when(rel == "self", "application/atom+xml").otherwise("text/html"))
        return build(S.LINK, href=url_of(n, "href"), rel=rel, link_type=kind, title=at(n, "title"), length=at(n, "length"), hreflang=at(n, "hreflang"), thr_count=number(at(n, "thr:count")), thr_updated=parse_date(at(n, "thr:updated")))

    return some(F.transform(s.all("link"), made), lambda x: x["href"].isNotNull())


def _first(links: Column, rel: str) -> Column:
    return F.get(some(links, lambda x: x["rel"] == rel), F.lit(0))["href"]


def _tags(s: Scope) -> Column:
    tag = lambda n: build(S.TAG, term=blank(at(n, "term")), scheme=F.coalesce(at(n, "scheme"), at(n, "domain")), label=at(n, "label"))
    return some(F.transform(s.all("category"), tag), lambda t: t["term"].isNotNull())


def _text(s: Scope, *names: str) -> Column:
    return s.stage(f"text_{names[0]}", lambda: atom_text(s.last(*names)))


def persons(s: Scope, name: str) -> Column:
    return s.stage(f"{name}s", lambda: F.transform(s.all(name), atom_person))


def feed(s: Scope) -> Fields:
    """Fields of an Atom feed."""
    limits = s.limits
    links = _links(s)
    href, ident = _first(links, "alternate"), s.text("id")
    people = persons(s, "author")
    creator, dc = s.text("dc:creator"), X.dc_date(s)
    it = X.itunes_feed(s)
    title, subtitle, rights = _text(s, "title"), _text(s, "subtitle", "tagline"), _text(s, "rights", "copyright")
    generator = s.last("generator")
    updated, published = s.date("updated", "modified"), s.date("published", "issued")
    promoted = lambda v: build(S.TEXT, value=v, content_type=F.lit("text"), language=s.lang, base=s.base)
    author = F.coalesce(creator, flat(F.get(people, F.lit(0))), it["author"])
    image = F.when(it["image"].isNotNull(), build(S.IMAGE, url=it["image"]))
    return (
        {
            "title": F.coalesce(title["value"], s.text("dc:title")),
            "title_detail": title,
            "link": F.coalesce(href, ident),
            "links": capped(links, limits.links_per_feed),
            "subtitle": F.coalesce(it["subtitle"], subtitle["value"], s.text("dc:description")),
            "subtitle_detail": F.when(it["subtitle"].isNotNull(), promoted(it["subtitle"])).otherwise(subtitle),
            "summary": it["summary"],
            "summary_detail": F.when(it["summary"].isNotNull(), promoted(it["summary"])),
            "updated": F.coalesce(dc, updated),
            "updated_str": F.coalesce(F.when(dc.isNotNull(), s.text("dc:date")), s.text("updated", "modified")),
            "published": F.coalesce(published, dc),
            "published_str": s.text("published", "issued"),
            "author": author,
            "author_detail": F.coalesce(F.get(people, F.lit(0)), F.when(author.isNotNull(), build(S.PERSON, name=author))),
            "authors": capped(F.concat(people, X.creators(s)), limits.authors),
            "contributors": capped(F.concat(persons(s, "contributor"), X.contributors(s)), limits.contributors),
            "publisher": F.coalesce(s.text("dc:publisher"), it["owner"]["name"]),
            "language": F.coalesce(s.lang, s.text("dc:language")),
            "rights": F.coalesce(rights["value"], s.text("dc:rights")),
            "rights_detail": rights,
            "generator": blank(generator["text"]),
            "generator_detail": F.when(generator.isNotNull(), build(S.GENERATOR, name=blank(generator["text"]), href=F.coalesce(url_of(generator, "uri"), url_of(generator)), version=at(generator, "version"))),
            "image": image,
            "icon": blank(s.last("icon")["safe"]),
            "logo": blank(s.last("logo")["safe"]),
            "tags": capped(F.concat(_tags(s), X.itunes_tags(s), X.dc_tags(s), X.media_tags(s)), limits.tags),
            "id": F.coalesce(ident, s.text("dc:identifier")),
            "itunes": struct_if(it, S.ITUNES_FEED),
            "dc_creator": creator,
            "dc_publisher": s.text("dc:publisher"),
            "dc_rights": s.text("dc:rights"),
            "license": _first(links, "license"),
            "next_url": _first(links, "next"),
        }
        | X.media_feed(s)
        | X.places(s)
    )


def content(n: Column) -> Column:
    kind = mime_type(at(n, "type"))
    src = url_of(n, "src")
    value = F.when(src.isNotNull(), "").when(kind == "application/xhtml+xml", F.coalesce(n["xml"], shown(n))).when(kind == "text/plain", n["text"]).otherwise(shown(n))
    return build(S.CONTENT, value=value, content_type=kind, language=n["lang"], base=n["base"], src=src)


def _source(n: Column) -> Column:
    """The feed that an entry was copied from."""
    own = F.transform(F.filter(n["kids"], lambda k: (k["name"] == "link") & (k["up"] == -1)), lambda k: link(F.element_at(k["attrs"], "@href"), F.coalesce(F.element_at(k["attrs"], "rel"), F.lit("alternate")), link_type=F.element_at(k["attrs"], "type")))
    own = some(own, lambda x: x["href"].isNotNull())
    href, ident = F.coalesce(_first(own, "alternate"), F.get(own, F.lit(0))["href"]), kid(n, "id")
    is_link = ident.rlike(r"^(?i)(https?|ftp)://") & href.isNull()
    name = F.try_element_at(kids(n, "name"), F.lit(-1))["text"]
    return F.when(n.isNotNull(), build(S.SOURCE, title=kid(n, "title"), link=F.coalesce(href, F.when(is_link, ident)), author=blank(name), id=ident, links=own, updated=parse_date(kid(n, "updated")), updated_str=kid(n, "updated"), rights=kid(n, "rights"), guidislink=F.when(ident.isNotNull(), is_link)))


def entry(s: Scope, feed_scope: Scope) -> Fields:
    """Fields of an Atom entry; authors come from the feed if it has none."""
    limits = s.limits
    links = _links(s)
    href, ident = _first(links, "alternate"), F.coalesce(s.text("id"), s.text("dc:identifier"))
    it, media = X.itunes_entry(s), X.media_entry(s)
    title, rights = _text(s, "title"), _text(s, "rights", "copyright")
    subtitle, summary = _text(s, "subtitle", "tagline"), _text(s, "summary")
    blocks = s.stage("blocks", lambda: some(F.transform(s.all("content"), content), lambda c: (c["value"] != "") | c["src"].isNotNull()))
    blocks = capped(F.concat(blocks, X.encoded(s)), limits.content_blocks)
    first = F.get(blocks, F.lit(0))
    people = persons(s, "author")
    own = F.size(people) > 0
    inherited = F.when(own, people).otherwise(persons(feed_scope, "author"))
    creator, dc = s.text("dc:creator"), X.dc_date(s)
    files = some(links, lambda x: x["rel"] == "enclosure")
    published = F.coalesce(s.date("published", "issued"), dc)
    updated = F.coalesce(dc, s.date("updated", "modified"))
    promoted = lambda v: build(S.TEXT, value=v, content_type=F.lit("text"), language=s.lang, base=s.base)
    written = F.coalesce(summary["value"], s.text("dc:description"), media["media_description"], first["value"])
    is_link = href.isNull() & ident.isNotNull()
    return (
        media
        | X.discussion(s)
        | X.places(s)
        | {
            "id": ident,
            "title": F.coalesce(title["value"], s.text("dc:title"), media["media_title"]),
            "title_detail": title,
            "link": F.coalesce(href, ident),
            "links": capped(links, limits.links_per_entry),
            "subtitle": F.coalesce(it["subtitle"], subtitle["value"]),
            "subtitle_detail": F.when(it["subtitle"].isNotNull(), promoted(it["subtitle"])).otherwise(subtitle),
            "rights": F.coalesce(rights["value"], s.text("dc:rights")),
            "rights_detail": rights,
            "summary": F.coalesce(it["summary"], written),
            "summary_detail": F.when(it["summary"].isNotNull(), promoted(it["summary"])).otherwise(F.coalesce(summary, F.when(written.isNotNull(), build(S.TEXT, value=written, content_type=F.lit("html"), language=s.lang, base=s.base)))),
            "content": blocks,
            "published": published,
            "published_str": F.coalesce(s.text("published", "issued"), s.text("dc:date")),
            "updated": F.coalesce(updated, published),
            "updated_str": F.coalesce(F.when(dc.isNotNull(), s.text("dc:date")), s.text("updated", "modified"), s.text("published", "issued")),
            "created": s.date("created"),
            "created_str": s.text("created"),
            "author": F.coalesce(flat(F.get(people, F.lit(0))), creator, it["author"], flat(F.get(persons(feed_scope, "author"), F.lit(0)))),
            "author_detail": F.get(inherited, F.lit(0)),
            "authors": capped(F.concat(inherited, X.creators(s)), limits.authors),
            "contributors": capped(F.concat(persons(s, "contributor"), X.contributors(s)), limits.contributors),
            "tags": capped(F.concat(_tags(s), X.dc_tags(s), X.media_tags(s)), limits.tags),
            "enclosures": capped(F.transform(files, lambda x: build(S.ENCLOSURE, url=x["href"], length=x["length"], enclosure_type=x["link_type"], title=x["title"])), limits.enclosures),
            "source": _source(s.last("source")),
            "itunes": it,
            "dc_creator": creator,
            "dc_date": dc,
            "dc_subject": F.transform(X.dc_tags(s), lambda t: t["term"]),
            "dc_rights": s.text("dc:rights"),
            "license": _first(links, "license"),
            "guidislink": F.when(ident.isNotNull(), is_link),
            "language": s.lang,
        }
    )
