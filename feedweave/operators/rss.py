"""Rules of RSS 0.9x, 1.0 (RDF) and 2.0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.functions.dates import parse_date
from feedweave.operators import extensions as X
from feedweave.operators.nodes import Fields, Scope, at, blank, build, capped, flat, kid, kids, link, number, person_field, shown, some, struct_if, text_construct, url_of
from feedweave.plans import schema as S


def categories(s: Scope) -> Column:
    return s.stage("categories", lambda: _categories(s))


def _categories(s: Scope) -> Column:
    tag = lambda n: build(S.TAG, term=blank(shown(n)), scheme=at(n, "domain"))
    return some(F.transform(s.all("category"), tag), lambda t: t["term"].isNotNull() | t["scheme"].isNotNull())


def _image(node: Column, width: str = "width", height: str = "height") -> Column:
    made = build(S.IMAGE, url=kid(node, "url"), title=kid(node, "title"), link=kid(node, "link"), width=number(kid(node, width)), height=number(kid(node, height)), description=kid(node, "description"))
    return F.when(made["url"].isNotNull(), made)


def _atom_links(s: Scope) -> Column:
    """Links of atom:link elements, which need an href and get no defaults."""
    return s.stage("atom_links", lambda: _made_atom_links(s))


def _made_atom_links(s: Scope) -> Column:
    made = F.transform(s.all("atom:link", "atom10:link"), lambda n: build(S.LINK, href=url_of(n, "href"), rel=at(n, "rel"), link_type=at(n, "type"), title=at(n, "title"), length=at(n, "length"), hreflang=at(n, "hreflang")))
    return some(made, lambda x: x["href"].isNotNull())


def _date(s: Scope, name: str) -> tuple[Column, Column]:
    """The date of the last element that has one, and its text; bad dates leave no text."""
    made = s.stage(f"dates_{name}", lambda: F.transform(s.all(name), lambda n: F.struct(parse_date(n["text"]).alias("d"), n["text"].alias("t"))))
    good = F.try_element_at(some(made, lambda x: x["d"].isNotNull()), F.lit(-1))
    return good["d"], good["t"]


def bad_dates(s: Scope) -> Column:
    """Why a channel's dates are wrong, or null."""
    _date(s, "pubDate"), _date(s, "lastBuildDate")
    bad = lambda name: F.exists(F.col(f"{s.prefix}dates_{name}"), lambda x: (x["t"] != "") & x["d"].isNull())
    return F.when(bad("pubDate"), "Invalid pubDate format").when(bad("lastBuildDate"), "Invalid lastBuildDate format")


def bad_image(s: Scope) -> Column:
    """Why an image of the channel is none, or null."""
    return F.when(F.exists(s.all("image"), lambda n: ~n["empty"] & kid(n, "url").isNull()), "Invalid feed format: Image missing url")


def feed(s: Scope) -> Fields:
    """Fields of an RSS channel."""
    limits = s.limits
    published, published_str = _date(s, "pubDate")
    built, built_str = _date(s, "lastBuildDate")
    dc = X.dc_date(s)
    href = s.first_text("link")
    it = X.itunes_feed(s)
    itunes = struct_if(it, S.ITUNES_FEED)
    author_raw, author = person_field(s, "managingEditor")
    web_raw, web = person_field(s, "webMaster")
    creator, publisher = s.text("dc:creator"), s.text("dc:publisher")
    owner = it["owner"]
    owned = F.when(owner.isNotNull(), build(S.PERSON, name=owner["name"], email=owner["email"]))
    named = F.coalesce(creator, author_raw)
    fallback = F.coalesce(owner["name"], it["author"])
    plain = F.when(s.last("title").isNotNull(), shown(s.last("title")))
    links = F.concat(F.transform(some(s.all("link"), lambda n: n["text"] != ""), lambda n: link(n["text"], "alternate")), _atom_links(s))
    following = F.get(some(_atom_links(s), lambda x: x["rel"] == "next"), F.lit(0))
    description = s.last("description")
    subtitle = F.coalesce(it["subtitle"], blank(shown(description)), s.text("dc:description"))
    generator = s.text("generator")
    image = F.coalesce(F.when(it["image"].isNotNull(), build(S.IMAGE, url=it["image"])), _image(s.last("image")))
    hours = F.array_distinct(some(F.transform(kids(s.last("skipHours"), "hour"), lambda k: number(k["text"], "int")), lambda h: h.between(0, 23)))
    ti = s.last("textInput", "textinput")
    cloud = s.last("cloud")
    return (
        {
            "title": F.coalesce(plain, s.text("dc:title")),
            "title_detail": text_construct(s.last("title")),
            "link": href,
            "links": capped(links, limits.links_per_feed),
            "subtitle": subtitle,
            "subtitle_detail": F.when(it["subtitle"].isNotNull(), build(S.TEXT, value=it["subtitle"], content_type=F.lit("text"), language=s.lang, base=s.base)).otherwise(text_construct(description)),
            "summary": it["summary"],
            "summary_detail": F.when(it["summary"].isNotNull(), build(S.TEXT, value=it["summary"], content_type=F.lit("text"), language=s.lang, base=s.base)),
            "published": F.coalesce(published, dc),
            "published_str": F.coalesce(published_str, F.when(dc.isNotNull(), s.text("dc:date"))),
            "updated": F.coalesce(dc, built, published),
            "updated_str": F.coalesce(F.when(dc.isNotNull(), s.text("dc:date")), built_str, published_str),
            "author": F.coalesce(named, fallback),
            "author_detail": F.coalesce(F.when(creator.isNotNull(), build(S.PERSON, name=creator)), author, F.when(fallback.isNotNull(), build(S.PERSON, name=fallback, email=F.when(owner["name"].isNotNull(), owner["email"])))),
            "authors": capped(F.concat(F.when(author.isNotNull(), F.array(author)).otherwise(F.array().cast(f"array<{S.PERSON}>")), X.creators(s)), limits.authors),
            "contributors": capped(X.contributors(s), limits.contributors),
            "publisher": F.coalesce(web_raw, flat(owned), publisher),
            "publisher_detail": F.coalesce(web, owned),
            "language": F.coalesce(s.text("language"), s.text("dc:language")),
            "rights": F.coalesce(blank(shown(s.last("copyright"))), s.text("dc:rights")),
            "generator": generator,
            "generator_detail": F.when(generator.isNotNull(), build(S.GENERATOR, name=generator)),
            "image": image,
            "tags": capped(F.concat(categories(s), X.itunes_tags(s), X.dc_tags(s), X.media_tags(s)), limits.tags),
            "id": s.text("dc:identifier"),
            "ttl": s.text("ttl"),
            "docs": s.text("docs"),
            "itunes": itunes,
            "podcast": X.podcast_feed(s),
            "dc_creator": creator,
            "dc_publisher": publisher,
            "dc_rights": s.text("dc:rights"),
            "license": X.license_of(s),
            "syndication": X.syndication(s),
            "next_url": following["href"],
            "cloud": F.when(cloud.isNotNull(), build(S.CLOUD, domain=at(cloud, "domain"), port=at(cloud, "port"), path=at(cloud, "path"), register_procedure=at(cloud, "registerProcedure"), protocol=at(cloud, "protocol"))),
            "textinput": F.when(ti.isNotNull(), build(S.TEXTINPUT, title=kid(ti, "title"), description=kid(ti, "description"), name=kid(ti, "name"), link=kid(ti, "link"))),
            "skiphours": F.coalesce(hours, F.array().cast("array<int>")),
            "skipdays": F.coalesce(F.array_distinct(F.transform(kids(s.last("skipDays"), "day"), lambda k: k["text"])), F.array().cast("array<string>")),
        }
        | X.media_feed(s)
        | X.places(s)
    )


def _entry_text(s: Scope, it: Column, feed_lang: Column) -> Fields:
    """Title, summary and content of an item."""
    content = capped(X.encoded(s), s.limits.content_blocks)
    title, description = s.last("title"), s.last("description")
    media = X.media_entry(s)
    plain = F.coalesce(F.when(title.isNotNull(), shown(title)), s.text("dc:title"), media["media_title"])
    own = F.when(description.isNotNull(), shown(description))
    written = F.coalesce(own, s.text("dc:description"), media["media_description"], F.get(content, F.lit(0))["value"])
    return {
        "title": plain,
        "title_detail": F.coalesce(text_construct(title), F.when(plain.isNotNull(), build(S.TEXT, value=plain, content_type=F.lit("text"), language=s.lang, base=s.base))),
        "subtitle": it["subtitle"],
        "subtitle_detail": F.when(it["subtitle"].isNotNull(), build(S.TEXT, value=it["subtitle"], content_type=F.lit("text"), language=s.lang, base=s.base)),
        "summary": F.coalesce(it["summary"], written),
        "summary_detail": F.when(it["summary"].isNotNull(), build(S.TEXT, value=it["summary"], content_type=F.lit("text"), language=s.lang, base=s.base)).otherwise(F.coalesce(text_construct(description), F.when(written.isNotNull(), build(S.TEXT, value=written, content_type=F.lit("html"), language=s.lang, base=s.base)))),
        "content": content,
        "language": F.coalesce(s.lang, feed_lang),
    } | media


def entry(s: Scope, feed_scope: Scope) -> Fields:
    """Fields of an RSS item."""
    limits = s.limits
    it = X.itunes_entry(s)
    guid, last_link = s.last("guid"), s.last("link")
    permanent = F.lower(F.coalesce(at(guid, "isPermaLink"), F.lit("true"))) == "true"
    guid_url = F.when(permanent, blank(guid["safe"]))
    own_links = F.transform(some(s.all("link"), lambda n: n["text"] != ""), lambda n: link(n["safe"], "alternate"))
    # a permalink is a link too, unless a link stands before it
    before = s.first("link")["pos"]
    guid_links = F.when(guid_url.isNotNull() & (before.isNull() | (guid["pos"] < before)), F.array(link(guid_url, "alternate"))).otherwise(F.array().cast(f"array<{S.LINK}>"))
    files = s.stage("files", lambda: some(F.transform(s.all("enclosure"), lambda n: build(S.ENCLOSURE, url=url_of(n), length=at(n, "length"), enclosure_type=at(n, "type"))), lambda e: e["url"].isNotNull()))
    file_links = F.transform(files, lambda e: link(e["url"], "enclosure", link_type=e["enclosure_type"], length=e["length"]))
    raw, detail = person_field(s, "author")
    creator, dc = s.text("dc:creator"), X.dc_date(s)
    pub = s.date("pubDate")
    source = s.last("source")
    podcast = X.podcast_entry(s)
    author = F.coalesce(creator, raw, it["author"])
    people = F.concat(X.creators(s), F.when(raw.isNull() & creator.isNull() & it["author"].isNotNull(), F.array(build(S.PERSON, name=it["author"]))).otherwise(F.array().cast(f"array<{S.PERSON}>")))
    return (
        _entry_text(s, it, F.coalesce(feed_scope.lang, feed_scope.text("language")))
        | X.discussion(s)
        | X.places(s)
        | podcast
        | {
            "id": F.coalesce(blank(guid["text"]), s.text("dc:identifier")),
            "link": F.coalesce(blank(last_link["safe"]), guid_url),
            "links": capped(F.concat(guid_links, own_links, file_links, _atom_links(s)), limits.links_per_entry),
            "rights": s.text("dc:rights"),
            "published": F.coalesce(pub, dc),
            "published_str": F.coalesce(s.text("pubDate"), s.text("dc:date")),
            "updated": F.coalesce(dc, pub),
            "updated_str": F.coalesce(F.when(dc.isNotNull(), s.text("dc:date")), F.when(pub.isNotNull(), s.text("pubDate"))),
            "author": author,
            "author_detail": F.coalesce(detail, F.when(author.isNotNull(), build(S.PERSON, name=author))),
            "authors": capped(people, limits.authors),
            "contributors": capped(X.contributors(s), limits.contributors),
            "tags": capped(F.concat(categories(s), X.dc_tags(s), X.media_tags(s)), limits.tags),
            "enclosures": capped(files, limits.enclosures),
            "comments": s.text("comments"),
            "source": F.when(source.isNotNull(), build(S.SOURCE, title=blank(source["text"]), href=url_of(source), links=F.array().cast(f"array<{S.LINK}>"))),
            "itunes": it,
            "dc_creator": creator,
            "dc_date": dc,
            "dc_subject": F.transform(X.dc_tags(s), lambda t: t["term"]),
            "dc_rights": s.text("dc:rights"),
            "license": X.license_of(s),
            "guidislink": F.when(guid.isNotNull(), permanent & last_link.isNull()),
        }
    )


# RSS 1.0: items stand beside the channel, ids are rdf:about, links stay as they are


def rdf_feed(s: Scope, full: Fields) -> Fields:
    image = s.last("image")
    made = build(S.IMAGE, url=kid(image, "url"), title=kid(image, "title"), link=kid(image, "link"))
    kept = "title title_detail link links subtitle subtitle_detail published published_str updated updated_str author author_detail authors contributors publisher language rights tags dc_creator dc_publisher dc_rights syndication where geo_lat geo_long".split()
    return {n: full[n] for n in kept} | {
        "id": F.coalesce(s.attr("rdf:about"), s.attr("about"), s.text("dc:identifier")),
        "image": F.when(made["url"].isNotNull(), made),
        "media_thumbnail": F.array().cast(f"array<{S.THUMBNAIL}>"),
        "media_content": F.array().cast(f"array<{S.MEDIA}>"),
    }


def rdf_entry(s: Scope, full: Fields) -> Fields:
    href = s.text("link")
    links = F.transform(some(s.all("link"), lambda n: n["text"] != ""), lambda n: link(n["text"], "alternate"))
    kept = "title title_detail summary summary_detail content rights published published_str updated updated_str author author_detail authors contributors tags dc_creator dc_date dc_subject dc_rights where geo_lat geo_long in_reply_to thr_total language".split()
    return {n: full[n] for n in kept} | {"id": F.coalesce(s.attr("rdf:about"), s.attr("about"), s.text("dc:identifier")), "link": href, "links": capped(links, s.limits.links_per_entry)}

