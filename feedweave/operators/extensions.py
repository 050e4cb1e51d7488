"""Rules of the namespaces that feeds and entries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.functions.dates import parse_date
from feedweave.functions.values import parse_explicit, update_period
from feedweave.operators.nodes import Fields, Scope, at, blank, build, capped, kid, kids, let, listed, number, shown, some, struct_if, url_of, words_of
from feedweave.plans import schema as S

ITUNES_SCHEME = "http://www.itunes.com/"
#: Ranges of EPSG codes that are of geographic systems, latitude first.
GEOGRAPHIC = (
    (3819, 3819), (3821, 3821), (3824, 3824), (3889, 3889), (3906, 3906), (4001, 4016), (4018, 4025), (4027, 4036), (4041, 4047), (4052, 4055),
    (4075, 4075), (4081, 4081), (4120, 4176), (4178, 4185), (4188, 4216), (4218, 4289), (4291, 4304), (4306, 4319), (4322, 4322), (4324, 4324),
    (4326, 4326), (4463, 4463), (4470, 4470), (4475, 4475), (4483, 4483), (4490, 4490), (4555, 4555), (4558, 4558), (4600, 4646), (4657, 4765),
    (4801, 4811), (4813, 4821), (4823, 4824), (4901, 4904), (4979, 4979),
)
_COORDINATES = "array<struct<lat:double,lon:double>>"


def staged(rule: Callable[[Scope], Column | Fields]) -> Callable[[Scope], Column | dict[str, Column]]:
    """A rule whose result is a column of its own; of several fields, a struct of them."""

    def one(s: Scope):
        fields: list[str] = []

        def make() -> Column:
            made = rule(s)
            if isinstance(made, Column):
                return made
            fields.extend(made)
            return F.struct(*[c.alias(n) for n, c in made.items()])

        column = s.stage(rule.__name__, make)
        if fields:
            s.fields[rule.__name__] = fields
        return {n: column[n] for n in s.fields[rule.__name__]} if rule.__name__ in s.fields else column

    one.__doc__ = rule.__doc__
    return one


def itunes(s: Scope, name: str, plain: bool = True) -> Column:
    """The last node of an iTunes element, prefixed or, where nothing else claims it, bare."""
    return F.coalesce(s.last(f"itunes:{name}"), s.last(name)) if plain else s.last(f"itunes:{name}")


def itunes_image(s: Scope) -> Column:
    node = s.last("itunes:image")
    return F.coalesce(blank(url_of(node, "href")), blank(node["text"]))


@staged
def itunes_feed(s: Scope) -> Fields:
    """The iTunes fields of a feed."""
    owner = itunes(s, "owner", False)
    top = s.all("itunes:category")
    pairs = F.flatten(F.transform(top, lambda n: let(kids(n, "itunes:category"), lambda k: F.when(F.size(k) > 0, F.transform(k, lambda x: build(S.ITUNES_CATEGORY, text=at(n, "text"), subcategory=at(x, "text")))).otherwise(F.array(build(S.ITUNES_CATEGORY, text=at(n, "text")))))))
    return {
        "author": blank(itunes(s, "author", False)["text"]),
        "owner": F.when(owner.isNotNull(), F.struct(kid(owner, "itunes:name").alias("name"), kid(owner, "itunes:email").alias("email"))),
        "categories": listed(some(pairs, lambda c: c["text"].isNotNull())),
        "explicit": parse_explicit(itunes(s, "explicit")["text"]),
        "image": itunes_image(s),
        "keywords": listed(words_of(itunes(s, "keywords")["text"])),
        "podcast_type": blank(itunes(s, "type")["text"]),
        "complete": blank(itunes(s, "complete")["text"]),
        "new_feed_url": blank(itunes(s, "new-feed-url")["text"]),
        "subtitle": blank(shown(itunes(s, "subtitle", False))),
        "summary": blank(shown(itunes(s, "summary"))),
        "block": F.when(itunes(s, "block").isNotNull(), F.when(F.lower(itunes(s, "block")["text"]) == "yes", 1).otherwise(0)),
    }


@staged
def itunes_tags(s: Scope) -> Column:
    """Both levels of the iTunes categories as tags."""
    tag = lambda x: build(S.TAG, term=at(x, "text"), scheme=F.lit(ITUNES_SCHEME))
    terms = F.flatten(F.transform(s.all("itunes:category"), lambda n: F.concat(F.array(tag(n)), F.transform(kids(n, "itunes:category"), tag))))
    return some(terms, lambda t: t["term"].isNotNull())


@staged
def itunes_entry(s: Scope) -> Column:
    text = lambda name, plain=True: blank(itunes(s, name, plain)["text"])
    return struct_if(
        {
            "title": blank(shown(itunes(s, "title", False))),
            "author": text("author", False),
            "duration": text("duration"),
            "explicit": parse_explicit(itunes(s, "explicit")["text"]),
            "image": itunes_image(s),
            "episode": text("episode"),
            "season": text("season"),
            "episode_type": text("episodeType"),
            "subtitle": blank(shown(itunes(s, "subtitle"))),
            "summary": blank(shown(itunes(s, "summary", False))),
        },
        S.ITUNES_ENTRY,
    )


# Dublin Core, syndication, comments, threads ---------------------------------


@staged
def dc_tags(s: Scope) -> Column:
    return some(F.transform(s.all("dc:subject"), lambda n: build(S.TAG, term=blank(n["text"]))), lambda t: t["term"].isNotNull())


@staged
def contributors(s: Scope) -> Column:
    return F.transform(some(s.all("dc:contributor"), lambda n: n["text"] != ""), lambda n: build(S.PERSON, name=n["text"]))


@staged
def creators(s: Scope) -> Column:
    return F.transform(some(s.all("dc:creator"), lambda n: n["text"] != ""), lambda n: build(S.PERSON, name=n["text"]))


@staged
def syndication(s: Scope) -> Column:
    text = lambda n: F.coalesce(s.text(f"sy:{n}"), s.text(f"syn:{n}"))
    return struct_if({"update_period": update_period(text("updatePeriod")), "update_frequency": text("updateFrequency"), "update_base": text("updateBase")}, S.SYNDICATION)


@staged
def encoded(s: Scope) -> Column:
    """content:encoded blocks."""
    return F.transform(some(s.all("content:encoded"), lambda n: n["text"] != ""), lambda n: build(S.CONTENT, value=shown(n), content_type=F.lit("text/html"), language=n["lang"], base=n["base"]))


@staged
def discussion(s: Scope) -> Fields:
    """Comment counts and feeds, and what an entry replies to."""
    reply = lambda n: build(S.REPLY, ref=blank(F.trim(at(n, "ref"))), href=blank(F.trim(at(n, "href"))), type=blank(F.trim(at(n, "type"))), source=blank(F.trim(at(n, "source"))))
    return {
        "slash_comments": number(s.text("slash:comments")),
        "slash_hit_parade": s.text("slash:hit_parade"),
        "wfw_comment_rss": F.coalesce(s.text("wfw:commentRss"), s.text("wfw:commentrss")),
        "in_reply_to": some(F.transform(s.all("thr:in-reply-to"), reply), lambda r: F.coalesce(r["ref"], r["href"], r["type"], r["source"]).isNotNull()),
        "thr_total": number(s.text("thr:total")),
    }


# Media -------------------------------------------------------------------------


def _media_nodes(s: Scope, name: str) -> Column:
    """Media elements in the scope, inside groups and inside content, as (attrs, text)."""
    flat = lambda k: F.struct(k["attrs"].alias("attrs"), k["text"].alias("text"))
    own = F.transform(s.all(f"media:{name}"), flat)
    inner = F.flatten(F.transform(s.all("media:group", "media:content"), lambda g: F.transform(kids(g, f"media:{name}"), flat)))
    return F.concat(own, inner)


def thumbnail(n: Column) -> Column:
    return build(S.THUMBNAIL, url=url_of(n), width=at(n, "width"), height=at(n, "height"), time=at(n, "time"))


def media_content(n: Column) -> Column:
    same = "medium width height duration bitrate lang channels codec expression".split()
    return build(S.MEDIA, url=url_of(n), content_type=at(n, "type"), filesize=at(n, "fileSize"), isdefault=at(n, "isDefault"), samplingrate=at(n, "samplingrate"), framerate=at(n, "framerate"), **{k: at(n, k) for k in same})


@staged
def media_feed(s: Scope) -> Fields:
    return _media(s)


def _media(s: Scope) -> Fields:
    rating = F.get(F.filter(_media_nodes(s, "rating"), lambda n: n["text"] != ""), F.lit(0))
    has = lambda x: blank(x["url"]).isNotNull()
    return {
        "media_thumbnail": some(F.transform(_media_nodes(s, "thumbnail"), thumbnail), has),
        "media_content": some(F.transform(_media_nodes(s, "content"), media_content), has),
        "media_rating": F.when(rating.isNotNull(), build(S.RATING, scheme=at(rating, "scheme"), content=rating["text"])),
        "media_keywords": blank(F.try_element_at(_media_nodes(s, "keywords"), F.lit(-1))["text"]),
    }


@staged
def media_tags(s: Scope) -> Column:
    """Keywords, one tag each, and categories."""
    words = F.flatten(F.transform(_media_nodes(s, "keywords"), lambda n: words_of(n["text"])))
    categories = F.transform(_media_nodes(s, "category"), lambda n: build(S.TAG, term=blank(n["text"]), scheme=at(n, "scheme"), label=at(n, "label")))
    return F.concat(F.transform(words, lambda w: build(S.TAG, term=w)), some(categories, lambda t: t["term"].isNotNull()))


def _plain(s: Scope, name: str) -> Column:
    """The last media text of a name, if it is of plain type."""
    found = F.filter(s.all(f"media:{name}"), lambda n: F.coalesce(at(n, "type"), F.lit("plain")) == "plain")
    return blank(shown(F.try_element_at(found, F.lit(-1))))


@staged
def media_entry(s: Scope) -> Fields:
    credit = lambda n: build(S.CREDIT, role=at(n, "role"), scheme=at(n, "scheme"), content=blank(n["text"]))
    copying = F.try_element_at(_media_nodes(s, "copyright"), F.lit(-1))
    return _media(s) | {
        "media_credit": some(F.transform(_media_nodes(s, "credit"), credit), lambda c: c["content"].isNotNull()),
        "media_copyright": F.when(at(copying, "url").isNotNull(), build(S.COPYRIGHT, url=at(copying, "url"))),
        "media_title": _plain(s, "title"),
        "media_description": _plain(s, "description"),
    }


# Places ------------------------------------------------------------------------


def _numbers(text: Column) -> Column:
    """The numbers of a coordinate list, as texts."""
    return F.filter(F.split(F.trim(F.regexp_replace(text, ",", " ")), r"\s+"), lambda x: x != "")


def coordinates(text: Column, dimensions: Column | int = 2, swapped: Column | None = None) -> Column:
    """Number pairs of a text as latitudes and longitudes; null if any is out of range."""
    d = F.lit(dimensions) if isinstance(dimensions, int) else dimensions
    numbers = F.transform(_numbers(text), lambda x: x.try_cast("double"))

    def pairs(n: Column) -> Column:
        count = F.floor(F.size(n) / d).cast("int")
        pair = lambda i: let(F.struct(F.get(n, (i - 1) * d).alias("a"), F.get(n, (i - 1) * d + 1).alias("b")), lambda p: F.struct((p["a"] if swapped is None else F.when(swapped, p["b"]).otherwise(p["a"])).alias("lat"), (p["b"] if swapped is None else F.when(swapped, p["a"]).otherwise(p["b"])).alias("lon")))
        points = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), pair)
        fits = lambda p: p["lat"].isNotNull() & p["lon"].isNotNull() & (F.lit(swapped is not None) | (p["lat"].between(-90, 90) & p["lon"].between(-180, 180)))
        return F.when((count > 0) & (F.size(n) % d == 0) & F.forall(points, fits), points)

    return F.when(text.isNotNull(), let(numbers, pairs)).cast(_COORDINATES)


def lon_first(srs: Column) -> Column:
    """Whether a reference system names longitude first: CRS84, and EPSG codes that are not geographic."""
    name = F.upper(F.trim(srs))
    code = F.when(name.contains("EPSG"), F.regexp_extract(name, r"(?:^|[:/#])\s*(\d+)\s*[:/#]*$", 1).try_cast("int"))
    ranges = F.array(*[F.struct(F.lit(first).alias("first"), F.lit(last).alias("last")) for first, last in GEOGRAPHIC])
    geographic = let(code, lambda c: F.exists(ranges, lambda r: c.between(r["first"], r["last"])))
    return F.coalesce(name.contains("CRS84") | (code.isNotNull() & ~geographic), F.lit(False))


def bad_gml(s: Scope) -> Column:
    """Whether a geometry's numbers do not fill its dimensions."""
    return F.coalesce(F.exists(s.element("georss:where"), lambda node: _gml_of(node, lambda x: F.coalesce(F.size(_numbers(x["text"])) % x["size"] != 0, F.lit(False)))), F.lit(False))


def _gml(s: Scope) -> Column:
    """The last GML geometry of a georss:where."""
    def made(x: Column) -> Column:
        points = F.when(x["swap"], coordinates(x["text"], x["size"], F.lit(True))).otherwise(coordinates(x["text"], x["size"]))
        return let(points, lambda p: F.when(p.isNotNull(), build(S.GEO, geo_type=x["kind"], coordinates=p, srs_name=x["srs"])))

    return let(s.last("georss:where"), lambda node: _gml_of(node, made))


def _gml_of(node: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of a geometry: kind, srs, swap, size and text."""
    inner = lambda node, *names: F.try_element_at(kids(node, *names), F.lit(-1))
    kinds = F.create_map(*[F.lit(x) for x in ("gml:Point", "point", "gml:LineString", "line", "gml:Polygon", "polygon", "gml:Envelope", "box")])

    def found(node: Column) -> Column:
        corner = F.concat_ws(" ", inner(node, "gml:lowerCorner")["text"], inner(node, "gml:upperCorner")["text"])
        return F.struct(inner(node, "gml:Point", "gml:LineString", "gml:Polygon", "gml:Envelope").alias("shape"), inner(node, "gml:pos", "gml:posList").alias("held"), corner.alias("corner"))

    def told(x: Column) -> Column:
        size = F.coalesce(number(at(x["held"], "srsDimension"), "int"), number(at(x["shape"], "srsDimension"), "int"))
        kind = F.element_at(kinds, x["shape"]["name"])
        srs = at(x["shape"], "srsName")
        return F.struct(kind.alias("kind"), srs.alias("srs"), lon_first(srs).alias("swap"), F.when(size.isin(2, 3), size).otherwise(2).alias("size"), F.when(kind == "box", x["corner"]).otherwise(x["held"]["text"]).alias("text"))

    return let(found(node), lambda x: let(told(x), made))


@staged
def places(s: Scope) -> Fields:
    """GeoRSS Simple and GML geometry, its attributes, and W3C latitude and longitude."""
    fits = {"point": lambda n: n == 1, "line": lambda n: n >= 2, "polygon": lambda n: n >= 3, "box": lambda n: n == 2}

    def simple(kind: str) -> Column:
        points = coordinates(s.last(f"georss:{kind}")["text"])
        return let(points, lambda p: F.when(fits[kind](F.size(p)), build(S.GEO, geo_type=F.lit(kind), coordinates=p)))

    lat, lon = number(s.text("geo:lat"), "double"), number(F.coalesce(s.text("geo:long"), s.text("geo:lon")), "double")
    lat, lon = F.when(lat.between(-90, 90), lat), F.when(lon.between(-180, 180), lon)
    both = F.when(lat.isNotNull() & lon.isNotNull(), build(S.GEO, geo_type=F.lit("point"), coordinates=F.array(F.struct(lat.alias("lat"), lon.alias("lon")))))
    shape = F.coalesce(both, *map(simple, fits), _gml(s))
    more = {"elev": number(s.text("georss:elev"), "double"), "feature_type_tag": s.text("georss:featuretypetag"), "feature_name": s.text("georss:featurename"), "relationship_tag": s.text("georss:relationshiptag")}

    def made(x: Column) -> Column:
        any_of = x["shape"].isNotNull()
        for name in more:
            any_of |= x[name].isNotNull()
        return F.when(any_of, build(S.GEO, geo_type=F.coalesce(x["shape"]["geo_type"], F.lit("point")), coordinates=F.coalesce(x["shape"]["coordinates"], F.array().cast(_COORDINATES)), srs_name=x["shape"]["srs_name"], **{name: x[name] for name in more}))

    where = let(F.struct(shape.alias("shape"), *[v.alias(name) for name, v in more.items()]), made)
    return {"where": where, "geo_lat": lat, "geo_long": lon}


@staged
def license_of(s: Scope) -> Column:
    node = F.coalesce(s.last("creativeCommons:license"), s.last("cc:license"), s.last("license"))
    return F.coalesce(blank(at(node, "rdf:resource")), blank(node["text"]))


# Podcast 2.0 -------------------------------------------------------------------


def _person(n: Column) -> Column:
    return build(S.PODCAST_PERSON, name=blank(n["text"]), role=F.coalesce(at(n, "role"), F.lit("host")), group=at(n, "group"), img=at(n, "img"), href=url_of(n, "href"))


def remote_item(n: Column) -> Column:
    return build(S.REMOTE_ITEM, feed_guid=at(n, "feedGuid"), feed_url=at(n, "feedUrl"), item_guid=at(n, "itemGuid"), medium=at(n, "medium"), title=at(n, "title"))


def _value(s: Scope) -> Column:
    node = s.last("podcast:value")
    fee = lambda r: F.when(F.lower(at(r, "fee")).isin("true", "yes", "1"), F.lit(True)).when(at(r, "fee").isNotNull(), F.lit(False))
    recipient = lambda r: build(S.RECIPIENT, name=at(r, "name"), type=at(r, "type"), address=at(r, "address"), split=F.coalesce(number(at(r, "split")), F.lit(0)), fee=fee(r))
    numbered = F.transform(node["kids"], lambda k, i: F.struct(i.alias("i"), k.alias("k")))
    under = lambda i, name: F.transform(F.filter(numbered, lambda x: (x["k"]["up"] == i) & (x["k"]["name"] == name)), lambda x: x["k"])
    most = s.limits.value_recipients

    def split(x: Column) -> Column:
        k = x["k"]
        real = lambda name: let(number(at(k, name), "double"), lambda d: F.when(~F.isnan(d) & (F.abs(d) < F.lit("Infinity").cast("double")), d))
        share = F.least(F.greatest(F.coalesce(real("remotePercentage"), F.lit(100.0)), F.lit(0.0)), F.lit(100.0))
        first = F.get(under(x["i"], "podcast:remoteItem"), F.lit(0))
        return build(S.TIME_SPLIT, start_time=real("startTime"), duration=real("duration"), remote_start_time=real("remoteStartTime"), remote_percentage=share, recipients=capped(F.transform(under(x["i"], "podcast:valueRecipient"), recipient), most), remote_item=F.when(first.isNotNull(), remote_item(first)))

    splits = F.transform(F.filter(numbered, lambda x: x["k"]["name"] == "podcast:valueTimeSplit"), split)
    splits = some(splits, lambda t: t["start_time"].isNotNull() & t["duration"].isNotNull())
    own = F.transform(F.filter(node["kids"], lambda k: (k["up"] == -1) & (k["name"] == "podcast:valueRecipient")), recipient)
    return F.when(node.isNotNull(), build(S.VALUE, type=at(node, "type"), method=at(node, "method"), suggested=at(node, "suggested"), recipients=capped(own, most), time_splits=capped(splits, s.limits.value_time_splits)))


def _shared_podcast(s: Scope) -> Fields:
    text = lambda name: s.text(f"podcast:{name}")
    limits = s.limits
    nodes = lambda name, make, keep, most: listed(capped(some(F.transform(s.all(f"podcast:{name}"), make), keep), most))
    place = s.last("podcast:location")
    return {
        "persons": nodes("person", _person, lambda p: p["name"].isNotNull(), limits.persons),
        "medium": text("medium"),
        "value": _value(s),
        "location": F.when(place.isNotNull(), build(S.LOCATION, name=blank(place["text"]), geo=at(place, "geo"), osm=at(place, "osm"), rel=at(place, "rel"), country=at(place, "country"))),
        "txt": nodes("txt", lambda n: build(S.TXT, purpose=at(n, "purpose"), value=blank(n["text"])), lambda t: t["value"].isNotNull(), limits.txt),
        "follow": nodes("follow", lambda n: build(S.FOLLOW, url=F.coalesce(blank(url_of(n)), blank(n["text"]))), lambda f: f["url"].isNotNull(), limits.follow),
        "chat": nodes("chat", lambda n: build(S.CHAT, server=at(n, "server"), protocol=at(n, "protocol"), account_id=at(n, "accountId"), space=at(n, "space")), lambda c: c["server"].isNotNull() & c["protocol"].isNotNull(), limits.chat),
    }


@staged
def podcast_feed(s: Scope) -> Column:
    limits = s.limits
    locked = s.last("podcast:locked")
    often = s.last("podcast:updateFrequency")
    funding = some(F.transform(s.all("podcast:funding"), lambda n: build(S.FUNDING, url=url_of(n), message=blank(n["text"]))), lambda f: blank(f["url"]).isNotNull())
    roll = F.flatten(F.transform(s.all("podcast:podroll"), lambda n: F.transform(kids(n, "podcast:remoteItem"), remote_item)))
    roll = some(roll, lambda r: F.coalesce(r["feed_guid"], r["feed_url"]).isNotNull())
    ping = F.get(F.filter(F.transform(s.all("podcast:podping"), lambda n: F.lower(at(n, "usesPodping"))), lambda x: x.isin("true", "false")), F.lit(0))
    fields = _shared_podcast(s) | {
        "funding": listed(capped(funding, limits.funding)),
        "guid": s.text("podcast:guid"),
        "locked": F.when(locked.isNotNull(), F.lower(locked["text"]).isin("yes", "true")),
        "locked_owner": at(locked, "owner"),
        "podroll": listed(capped(roll, limits.podroll)),
        "update_frequency": F.when(often.isNotNull(), build(S.UPDATE_FREQUENCY, complete=F.lower(at(often, "complete")) == "true", dtstart=at(often, "dtstart"), rrule=at(often, "rrule"), label=blank(often["text"]))),
        "podping_uses_podping": ping == "true",
    }
    return struct_if(fields, S.PODCAST_FEED)


def transcripts(s: Scope) -> Column:
    made = F.transform(s.all("podcast:transcript"), lambda n: build(S.TRANSCRIPT, url=url_of(n), type=at(n, "type"), language=at(n, "language"), rel=at(n, "rel")))
    return capped(some(made, lambda t: blank(t["url"]).isNotNull()), s.limits.transcripts)


@staged
def podcast_entry(s: Scope) -> Fields:
    """The podcast struct, the transcripts and the persons of an entry."""
    limits = s.limits
    chapters = s.last("podcast:chapters")
    number_of = lambda name: F.coalesce(s.text(f"podcast:{name}"), at(s.last(f"podcast:{name}"), "number"))
    bites = F.transform(s.all("podcast:soundbite"), lambda n: build(S.SOUNDBITE, start_time=number(at(n, "startTime"), "double"), duration=number(at(n, "duration"), "double"), title=blank(n["text"])))
    check = lambda n: F.try_element_at(kids(n, "podcast:integrity"), F.lit(-1))
    sources = lambda n: capped(some(F.transform(kids(n, "podcast:source"), lambda k: F.struct(F.element_at(k["attrs"], "@uri").alias("uri"), at(k, "contentType").alias("content_type"))), lambda x: blank(x["uri"]).isNotNull()), limits.alternate_enclosure_sources)
    alternate = lambda n: build(S.ALTERNATE, type=at(n, "type"), length=number(at(n, "length"), "decimal(20,0)"), bitrate=number(at(n, "bitrate"), "double"), height=number(at(n, "height")), lang=at(n, "lang"), title=at(n, "title"), rel=at(n, "rel"), codecs=at(n, "codecs"), is_default=F.when(at(n, "default").isNotNull(), F.lower(at(n, "default")) == "true"), sources=sources(n), integrity=F.when(check(n).isNotNull(), F.struct(at(check(n), "type").alias("type"), F.coalesce(at(check(n), "value"), blank(check(n)["text"])).alias("value"))))
    others = F.transform(some(s.all("podcast:alternateEnclosure"), lambda n: at(n, "type").isNotNull() & ~n["empty"]), alternate)
    social = F.transform(s.all("podcast:socialInteract"), lambda n: build(S.SOCIAL, uri=url_of(n, "uri"), protocol=at(n, "protocol"), account_id=at(n, "accountId"), account_url=at(n, "accountUrl"), priority=number(at(n, "priority"))))
    shared = _shared_podcast(s)
    fields = shared | {
        "transcript": listed(transcripts(s)),
        "chapters": F.when(blank(url_of(chapters)).isNotNull(), build(S.CHAPTERS, url=url_of(chapters), type=at(chapters, "type"))),
        "soundbite": listed(capped(some(bites, lambda b: b["start_time"].isNotNull() & b["duration"].isNotNull()), limits.soundbites)),
        "season": number_of("season"),
        "episode": number_of("episode"),
        "alternate_enclosures": listed(capped(others, limits.alternate_enclosures)),
        "social_interact": listed(capped(some(social, lambda x: blank(x["uri"]).isNotNull()), limits.social_interact)),
    }
    return {"podcast": struct_if(fields, S.PODCAST_ENTRY), "podcast_transcripts": transcripts(s), "podcast_persons": F.coalesce(shared["persons"], F.array().cast(f"array<{S.PODCAST_PERSON}>"))}


@staged
def dc_date(s: Scope) -> Column:
    return parse_date(s.text("dc:date"))

