import json
import time
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedweave.functions.html import sanitize
from feedweave.options import Limits, Options
from feedweave.plans import views
from feedweave.plans.parse import parse, parse_entries, parse_feeds
from feedweave.sources.lexer import Document, lex

NS = 'xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" xmlns:dublin="http://purl.org/dc/elements/1.1/" xmlns:mrss="http://search.yahoo.com/mrss/" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:podcast="https://podcastindex.org/namespace/1.0" xmlns:georss="http://www.georss.org/georss" xmlns:gml="http://www.opengis.net/gml" xmlns:geo="http://www.w3.org/2003/01/geo/wgs84_pos#" xmlns:thr="http://purl.org/syndication/thread/1.0" xmlns:atom="http://www.w3.org/2005/Atom"'


def rss(body, head=""):
    return f'<rss version="2.0" {NS}><channel>{head}{body}</channel></rss>'


DOCS = {
    "basic": rss(
        '<item><title>One</title><link>/1</link><guid isPermaLink="false">g1</guid><author>a@b.c (Ann)</author><category domain="d">c</category><pubDate>Sat, 14 Dec 2024 10:00:00 +0200</pubDate><enclosure url="http://e.com/a.mp3" length="9" type="audio/mpeg"/><source url="http://s.com/">Src</source><comments>http://e.com/c</comments></item><item><guid>http://e.com/2</guid><description>&lt;b&gt;x&lt;/b&gt;&lt;script&gt;1&lt;/script&gt;</description></item>',
        '<title>T</title><link>http://e.com/</link><description>D</description><ttl>60</ttl><managingEditor>m@b.c (Max)</managingEditor><pubDate>nonsense</pubDate><lastBuildDate>2024-01-02T03:04:05Z</lastBuildDate><image><url>http://e.com/i.png</url><title>I</title><width>8</width></image><cloud domain="d" port="80" path="/" registerProcedure="r" protocol="p"/><textInput><title>t</title><name>n</name></textInput><skipHours><hour>1</hour><hour>1</hour><hour>99</hour></skipHours><skipDays><day>Monday</day></skipDays><atom:link rel="next" href="http://e.com/?p=2"/>',
    ),
    "amp": rss("<item><title>ok</title></item><item><title>a & b</title></item><item><title>&bogus; x</title></item>", "<title>Fish & Chips</title><description>kept</description>"),
    "cut": '<rss version="2.0"><channel><title>T</title><item><title>A</title></item><item><title>B</title>',
    "podcast": rss(
        '<item><title>E</title><itunes:duration>1:00</itunes:duration><itunes:explicit>yes</itunes:explicit><itunes:summary>S</itunes:summary><description>D</description><podcast:transcript url="http://e.com/t" type="text/vtt"/><podcast:person role="guest">P</podcast:person><podcast:soundbite startTime="1.5" duration="2">b</podcast:soundbite><podcast:chapters url="http://e.com/c" type="j"/><podcast:value type="l" method="k"><podcast:valueRecipient name="n" type="t" address="a" split="x" fee="true"/><podcast:valueTimeSplit startTime="1" duration="2" remotePercentage="120"><podcast:remoteItem feedGuid="fg"/></podcast:valueTimeSplit></podcast:value><podcast:alternateEnclosure type="video/mp4" length="5"><podcast:source uri="http://e.com/v"/><podcast:integrity type="sri" value="v"/></podcast:alternateEnclosure></item>',
        '<title>T</title><itunes:owner><itunes:name>O</itunes:name><itunes:email>o@e</itunes:email></itunes:owner><itunes:category text="A"><itunes:category text="B"/></itunes:category><itunes:image href="http://e.com/i"/><itunes:explicit>no</itunes:explicit><itunes:block>Yes</itunes:block><podcast:locked owner="x">yes</podcast:locked><podcast:podroll><podcast:remoteItem feedGuid="r"/><podcast:remoteItem/></podcast:podroll>',
    ),
    "extras": rss(
        '<item><dublin:creator>DC</dublin:creator><author>raw</author><dublin:date>2024-05-06</dublin:date><dublin:subject>s</dublin:subject><content:encoded>&lt;p&gt;c&lt;/p&gt;</content:encoded><mrss:group><mrss:content url="http://e.com/v" type="video/mp4"><mrss:thumbnail url="http://e.com/t"/></mrss:content></mrss:group><mrss:keywords>a, b</mrss:keywords><mrss:credit role="r">C</mrss:credit><mrss:rating scheme="s">adult</mrss:rating><georss:where><gml:Point srsName="urn:ogc:def:crs:OGC:1.3:CRS84"><gml:pos>10 20</gml:pos></gml:Point></georss:where><georss:elev>5</georss:elev><thr:total>3</thr:total></item><item><georss:polygon>1 2 3 4 5 6</georss:polygon></item><item><geo:lat>1.5</geo:lat><geo:long>2.5</geo:long></item><item><georss:point>99 0</georss:point></item>'
    ),
    "atom": '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:thr="http://purl.org/syndication/thread/1.0" xml:lang="de" xml:base="http://e.com/b/"><title type="text">A &amp; B</title><id>urn:f</id><updated>2024-01-01T00:00:00Z</updated><author><name>N</name><email>n@e</email></author><generator uri="http://g/" version="1">G</generator><link rel="next" href="?p=2"/><category term="t" label="l"/><icon>i.ico</icon><entry xml:lang="fr"><id>http://e.com/1</id><title type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><b>X</b> y</div></title><published>2024-02-03T00:00:00Z</published><link rel="enclosure" href="a.mp3" type="audio/mpeg" length="many"/><content src="http://e.com/c" type="image/png"/><thr:in-reply-to ref="urn:r"/><source><title>S</title><id>http://s.com/</id></source></entry><entry><author><name>Own</name></author><summary>s</summary><link href="2"/></entry></feed>',
    "atom03": '<feed version="0.3" xmlns="http://purl.org/atom/ns#"><title>T</title><tagline>L</tagline><modified>2024-01-01T00:00:00Z</modified><entry><title>E</title><issued>2024-01-02T00:00:00Z</issued><created>2024-01-03T00:00:00Z</created></entry></feed>',
    "rdf": '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:sy="http://purl.org/rss/1.0/modules/syndication/"><channel rdf:about="urn:c"><title>T</title><items><x/></items><image rdf:resource="r"/><sy:updatePeriod>HOURLY</sy:updatePeriod></channel><item rdf:about="urn:1"><title>I</title><link>rel</link></item></rdf:RDF>',
    "json": json.dumps({"version": "https://jsonfeed.org/version/1.1", "title": "J", "home_page_url": "http://e.com/", "authors": [{"name": "A"}], "language": "en", "expired": True, "_x": {"a": 1}, "items": [{"id": "1", "url": "http://e.com/1", "content_html": "<p>h</p>", "content_text": "t", "tags": ["a", "b"], "image": "http://e.com/i", "banner_image": "http://e.com/b", "external_url": "http://o/", "date_published": "2024-01-01T00:00:00Z", "attachments": [{"url": "http://e.com/a", "mime_type": "audio/mpeg", "size_in_bytes": 5}], "_y": True}, {"id": 2, "author": {"name": "B"}}]}),
    "badjson": '{"version": ',
    "noversion": "{}",
    "unknown": "<html/>",
    "bomb": '<!DOCTYPE lolz [<!ENTITY lol "lol"><!ENTITY l2 "&lol;&lol;">]><rss version="2.0"><channel><title>&l2;</title></channel></rss>',
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, bytearray(v.encode())) for k, v in DOCS.items()] + [("null", None)], "name string, content binary").cache()


@pytest.fixture(scope="module")
def feeds(docs):
    return {r.name: r for r in parse_feeds(docs).collect()}


@pytest.fixture(scope="module")
def entries(docs):
    out = {}
    for r in parse_entries(docs).orderBy("name", "entry_idx").collect():
        out.setdefault(r.name, []).append(r)
    return out


def test_status(feeds):
    got = {n: (r.version, r.bozo, r.n_entries) for n, r in feeds.items()}
    assert got == {
        "basic": ("rss20", True, 2), "amp": ("rss20", True, 2), "cut": ("rss20", True, 2), "podcast": ("rss20", False, 1), "extras": ("rss20", False, 4), "atom": ("atom10", False, 2),
        "atom03": ("atom03", False, 1), "rdf": ("rss10", False, 1), "json": ("json11", False, 2), "badjson": ("", True, 0), "noversion": ("", True, 0), "unknown": ("", True, 0), "bomb": ("rss20", True, 0), "null": ("", True, 0),
    }
    assert feeds["basic"].bozo_exception == "Invalid pubDate format" and feeds["badjson"].bozo_exception == "JSON parse error"
    assert feeds["noversion"].error == "Missing version field" and feeds["null"].error and feeds["unknown"].error is None
    assert feeds["basic"].namespaces["dublin"] == "http://purl.org/dc/elements/1.1/"


def test_rss_channel(feeds):
    f = feeds["basic"].feed
    assert (f.title, f.link, f.subtitle, f.ttl, f.author, f.author_detail.name, f.next_url) == ("T", "http://e.com/", "D", "60", "m@b.c (Max)", "Max", "http://e.com/?p=2")
    assert f.published is None and f.published_str is None and f.updated == datetime(2024, 1, 2, 3, 4, 5)
    assert (f.image.url, f.image.width, f.cloud.register_procedure, f.textinput.name, f.skiphours, f.skipdays) == ("http://e.com/i.png", 8, "r", "n", [1], ["Monday"])
    assert feeds["amp"].feed.title is None and feeds["amp"].feed.subtitle == "kept"
    assert feeds["bomb"].feed.title == "&amp;l2;"


def test_rss_items(entries):
    a, b = entries["basic"]
    assert (a.id, a.link, a.guidislink, a.author, a.author_detail.email, a.tags[0].scheme, a.comments) == ("g1", "http://e.com/1", False, "a@b.c (Ann)", "a@b.c", "d", "http://e.com/c")
    assert a.published == datetime(2024, 12, 14, 8) and a.updated == a.published
    assert (a.enclosures[0].length, [x.rel for x in a.links], a.source.href, a.source.title) == ("9", ["alternate", "enclosure"], "http://s.com/", "Src")
    assert (b.link, b.guidislink, b.summary) == ("http://e.com/2", True, "<b>x</b>")
    assert [e.title for e in entries["amp"]] == ["ok", "&amp;bogus; x"] and [e.title for e in entries["cut"]] == ["A", "B"]


def test_podcasts(feeds, entries):
    f, e = feeds["podcast"].feed, entries["podcast"][0]
    assert (f.itunes.owner.name, f.itunes.explicit, f.itunes.block, f.image.url, f.author) == ("O", None, 1, "http://e.com/i", "O")
    assert [(c.text, c.subcategory) for c in f.itunes.categories] == [("A", "B")] and [t.term for t in f.tags] == ["A", "B"]
    assert (f.podcast.locked, f.podcast.locked_owner, len(f.podcast.podroll)) == (True, "x", 1)
    assert (e.itunes.duration, e.itunes.explicit, e.summary, e.podcast_transcripts[0].type, e.podcast_persons[0].role) == ("1:00", True, "S", "text/vtt", "guest")
    p = e.podcast
    assert (p.soundbite[0].start_time, p.chapters.url, p.value.recipients[0].split, p.value.recipients[0].fee) == (1.5, "http://e.com/c", 0, True)
    assert (p.value.time_splits[0].remote_percentage, p.value.time_splits[0].remote_item.feed_guid) == (100.0, "fg")
    assert (p.alternate_enclosures[0].sources[0].uri, p.alternate_enclosures[0].integrity.value) == ("http://e.com/v", "v")


def test_extensions(entries):
    a, b, c, d = entries["extras"]
    assert (a.author, a.dc_creator, a.published, a.dc_subject, a.content[0].value, a.summary) == ("DC", "DC", datetime(2024, 5, 6), ["s"], "<p>c</p>", "<p>c</p>")
    assert (a.media_content[0].content_type, a.media_thumbnail[0].url, a.media_credit[0].role, a.media_rating.content) == ("video/mp4", "http://e.com/t", "r", "adult")
    assert [t.term for t in a.tags] == ["s", "a", "b"] and a.thr_total == 3
    assert (a.where.geo_type, a.where.elev, a.where.coordinates[0].lat, a.where.coordinates[0].lon) == ("point", 5.0, 20.0, 10.0)
    assert (b.where.geo_type, len(b.where.coordinates)) == ("polygon", 3)
    assert (c.geo_lat, c.where.coordinates[0].lon) == (1.5, 2.5) and d.where is None


def test_atom(feeds, entries):
    f = feeds["atom"].feed
    assert (f.title, f.language, f.link, f.next_url, f.icon, f.author, f.generator_detail.version, f.tags[0].label) == ("A & B", "de", "urn:f", "http://e.com/b/?p=2", "http://e.com/b/i.ico", "N (n@e)", "1", "l")
    a, b = entries["atom"]
    assert (a.title, a.title_detail.content_type, a.title_detail.language, a.link, a.guidislink) == ("<b>X</b> y", "xhtml", "fr", "http://e.com/1", True)
    assert (a.updated, a.author, a.enclosures[0].length, a.content[0].src, a.in_reply_to[0].ref) == (a.published, "N (n@e)", "many", "http://e.com/c", "urn:r")
    assert (a.source.title, a.source.link, a.source.guidislink) == ("S", "http://s.com/", True)
    assert (b.author, b.link, b.language, [p.name for p in b.authors]) == ("Own", "http://e.com/b/2", "de", ["Own"])
    old, e = feeds["atom03"].feed, entries["atom03"][0]
    assert (old.subtitle, old.updated, e.published, e.created) == ("L", datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 3))


def test_rdf(feeds, entries):
    f, e = feeds["rdf"].feed, entries["rdf"][0]
    assert (f.id, f.title, f.image, f.syndication.update_period) == ("urn:c", "T", None, "hourly")
    assert (e.id, e.title, e.link) == ("urn:1", "I", "rel")


def test_json_feed(feeds, entries):
    f, (a, b) = feeds["json"].feed, entries["json"]
    assert (f.title, f.link, f.author, f.ttl, f.json_extensions) == ("J", "http://e.com/", "A", "0", {"_x": '{"a":1}'})
    assert ([c.content_type for c in a.content], [t.term for t in a.tags], [x.rel for x in a.links]) == (["text/html", "text/plain"], ["a", "b"], ["alternate", "related", "enclosure", "banner"])
    assert (a.author, a.enclosures[0].length, a.external_url, a.json_extensions, a.published) == ("A", "5", "http://o/", {"_y": "true"}, datetime(2024, 1, 1))
    assert (b.id, b.author) == (None, "B")


def test_options(spark, docs):
    raw = parse_entries(docs.where("name = 'basic'"), options=Options(sanitize_html=False, resolve_relative_uris=False)).orderBy("entry_idx").collect()
    assert raw[1].summary == "<b>x</b><script>1</script>" and raw[0].link == "/1"
    few = parse_feeds(docs.where("name = 'extras'"), options=Options(limits=Limits(entries=2))).first()
    assert (few.n_entries, few.bozo_exception) == (2, "Entry limit exceeded: 2")
    big = parse_feeds(docs.where("name = 'basic'"), options=Options(limits=Limits(feed_size=10))).first()
    assert big.error.startswith("Feed size exceeds")
    with pytest.raises(Exception, match="No document"):
        parse_feeds(docs.where("name = 'null'"), options=Options(mode="FAILFAST")).collect()
    deep = spark.createDataFrame([(bytearray(rss("<item><x>" + "<y>" * 200 + "</y>" * 200 + "</x></item>").encode()),)], "content binary")
    assert "nesting depth" in parse_feeds(deep).first().bozo_exception
    assert Limits.strict().entries == 1000 and Limits.permissive().json_extensions == 500 and not Options.permissive().sanitize_html


def test_nested_and_flat(docs):
    whole = {r.name: r for r in parse(docs.where("name in ('basic', 'json', 'unknown')"), "name").collect()}
    assert [e.id for e in whole["basic"].entries] == ["g1", "http://e.com/2"] and whole["unknown"].entries is None
    entries = parse_entries(docs)
    assert views.elements(entries, ["name"], "links").where("name = 'json'").count() == 4
    assert views.geo(entries, ["name"]).count() == 5
    aliased = views.with_aliases(views.feeds(parse_feeds(docs)), views.FEED_ALIASES).where("name = 'basic'").first()
    assert aliased.description == "D" and aliased.url == "http://e.com/"
    assert "itunes_duration" in views.flat_itunes(entries).columns
    names = views.register(entries, ["name"], "t_")
    assert docs.sparkSession.sql("select count(*) c from t_entry_tags").first().c > 0 and "t_entry_geo" in names


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<rss version='2.0'>", "<channel>", "<item>", "<title>", "</title>", "</item>", "</channel>", "</rss>", "&", "&amp;", "&#0;", "&x;", "<a b=c d='e'>", "<![CDATA[", "]]>", "<!--", "-->", "<", ">", "text", "<feed>", "<entry/>", "<br/>", "\0"]), max_size=40))
def test_lexing_never_fails(parts):
    got = lex("".join(parts).encode(), Options())
    assert got.version in ("", "rss20", "atom10") and len(got.items) <= 40


HOSTILE = [(unit, "", tail) for unit in ("<!x", "<a b ", "<a '", "<a \"'", "<!x[", "<![CDATA[", "<!--", "<?x ", "<b>", "</b", "<script>", "&", " \t") for tail in ("", ">", "'>'", "]>")]
HOSTILE += [('"<', "<a ", ">"), ("'<\"<", "<a ", ">"), ("[]", "<!x", ">"), ("<b>", "", "<li>" * 100_000), ("<li><b>", "", ""), ("<i><p>", "", "</p>" * 10_000)]


@pytest.mark.parametrize("unit, before, after", HOSTILE)
def test_hostile_text_takes_linear_time(unit, before, after):
    def seconds(work, size):
        text = before + unit * (size // len(unit)) + after
        took = []
        for _ in range(2):
            began = time.process_time()
            work(text)
            took.append(time.process_time() - began)
        return min(took)

    for work in (lambda text: lex(f"<rss><channel><item><title>{text}".encode(), Options(sanitize_html=False)), sanitize):
        small = seconds(work, 250_000)
        assert seconds(work, 500_000) < 2.6 * small + 0.1 and small < 2


def test_json_is_sanitized_and_its_own_version_counts(spark):
    hostile = "<p onclick='x'>h</p><script>bad()</script>"
    feed = {"items": [{"id": "1", "version": "https://jsonfeed.org/version/9", "title": hostile, "summary": hostile, "content_html": hostile, "content_text": "<b>"}], "version": "https://jsonfeed.org/version/1.1", "title": hostile, "description": hostile}
    docs = spark.createDataFrame([(bytearray(json.dumps(feed).encode()),)], "content binary")
    f = parse_feeds(docs).first()
    assert (f.version, f.bozo, f.feed.title, f.feed.subtitle) == ("json11", False, "<p>h</p>", "<p>h</p>")
    e = parse_entries(docs).first()
    assert (e.title, e.summary, [c.value for c in e.content]) == ("<p>h</p>", "<p>h</p>", ["<p>h</p>", "<b>"])
    assert parse_entries(docs, options=Options(sanitize_html=False)).first().title == hostile


def test_permalinks(spark):
    body = rss('<item><guid isPermaLink="1">http://e.com/1</guid></item><item><guid isPermaLink="TRUE">http://e.com/2</guid><link>http://e.com/l</link></item><item><link>http://e.com/l</link><guid>http://e.com/3</guid></item>')
    docs = spark.createDataFrame([(bytearray(body.encode()),)], "content binary")
    got = [(r.guidislink, r.link, [x.href for x in r.links]) for r in parse_entries(docs, entry_fields=("guidislink", "link", "links")).orderBy("entry_idx").collect()]
    assert got == [(False, None, []), (False, "http://e.com/l", ["http://e.com/2", "http://e.com/l"]), (False, "http://e.com/l", ["http://e.com/l"])]


def test_elements_that_no_field_needs_are_not_lexed():
    data = rss("<item><title>a</title><description>d</description></item>", "<title>t</title><link>http://e.com/</link>").encode()
    got = lex(data, Options(), (frozenset(), frozenset({"title"})))
    assert got.head.nodes == {} and list(got.items[0].nodes) == ["title"]


def test_entries_repeat_work_that_is_done_once(monkeypatch):
    """Attributes of the same source, and the empty reference to a base, are not read again for each entry."""
    from feedweave.functions import urls

    made, joined = [], []
    whole, join = Document.made_attributes, urls.join
    monkeypatch.setattr(Document, "made_attributes", lambda self, source: made.append(source) or whole(self, source))
    monkeypatch.setattr(urls, "join", lambda href, base: joined.append(href) or join(href, base))
    entry = '<entry><title type="text">a &lt;5&gt; &amp; b</title><link href="x/y"></link></entry>'
    found = lex(f'<feed xmlns="http://www.w3.org/2005/Atom" xml:base="https://once.example.com/s/">{entry * 50}</feed>'.encode(), Options())
    assert len(made) == len(set(made)) == 3 and joined.count("") <= 1
    assert [(p.nodes["title"][0][3], p.nodes["title"][0][4], dict(p.nodes["link"][0][2])["@href"]) for p in found.items] == [("a <5> & b", "a &lt;5&gt; &amp; b", "https://once.example.com/s/x/y")] * 50
