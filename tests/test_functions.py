from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from feedweave.functions import html, urls, values
from feedweave.functions.dates import parse_date
from feedweave.sources.encoding import decode, detect
from feedweave.sources.lexer import version_of

DATES = {
    "2024-12-14T10:30:45Z": (2024, 12, 14, 10, 30, 45),
    "2024-12-14T10:30:45.123+02:00": (2024, 12, 14, 8, 30, 45),
    "2024-12-14T10:30:45": (2024, 12, 14, 10, 30, 45),
    "2024-12-14 10:30:45": (2024, 12, 14, 10, 30, 45),
    "2024-12-14 10:30:45-05:00": (2024, 12, 14, 15, 30, 45),
    "2024-12-14": (2024, 12, 14, 0, 0, 0),
    "2024/12/14 10:30:45": (2024, 12, 14, 10, 30, 45),
    "2024/12/14": (2024, 12, 14, 0, 0, 0),
    "Sat, 14 Dec 2024 10:30:00 +0000": (2024, 12, 14, 10, 30, 0),
    "Mon, 14 Dec 2024 10:30:00 GMT": (2024, 12, 14, 10, 30, 0),
    "14 Dec 2024 10:30:00 EST": (2024, 12, 14, 15, 30, 0),
    "14 Dec 24 10:30 +0100": (2024, 12, 14, 9, 30, 0),
    "14 Dec 99 10:30:00 Z": (1999, 12, 14, 10, 30, 0),
    "14 December 2024 10:30:45": (2024, 12, 14, 10, 30, 45),
    "14 Dec 2024": (2024, 12, 14, 0, 0, 0),
    "December 14, 2024 10:30:45": (2024, 12, 14, 10, 30, 45),
    "Dec 14, 2024": (2024, 12, 14, 0, 0, 0),
    "12/14/2024 10:30:45": (2024, 12, 14, 10, 30, 45),
    "12/11/2024": (2024, 12, 11, 0, 0, 0),
    "14/12/2024": (2024, 12, 14, 0, 0, 0),
    "12-14-2024": (2024, 12, 14, 0, 0, 0),
    "14.12.2024 10:30:45": (2024, 12, 14, 10, 30, 45),
    "14.12.2024": (2024, 12, 14, 0, 0, 0),
    "14-Dec-2024": (2024, 12, 14, 0, 0, 0),
    "14-December-2024": (2024, 12, 14, 0, 0, 0),
    "Mon Jan  6 12:30:00 2025": (2025, 1, 6, 12, 30, 0),
    "2024": (2024, 1, 1, 0, 0, 0),
    "2024-12": (2024, 12, 1, 0, 0, 0),
    "  2024-12-14\n": (2024, 12, 14, 0, 0, 0),
    "not a date": None,
    "": None,
    "32 Dec 2024": None,
    "2024-13-01": None,
    None: None,
}


def test_dates(spark):
    rows = spark.createDataFrame([(d,) for d in DATES], "d string").select("d", F.date_format(parse_date(F.col("d")), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()
    want = {d: v and datetime(*v, tzinfo=timezone.utc).strftime("%Y-%m-%d %H:%M:%S") for d, v in DATES.items()}
    assert {r.d: r.t for r in rows} == want


@pytest.mark.parametrize(
    "text,name,email",
    [("a@b.c (Ann)", "Ann", "a@b.c"), ("Ann <a@b.c>", "Ann", "a@b.c"), ("a@b.c", None, "a@b.c"), ("Ann", "Ann", None), ("", None, None), ("  ", None, None)],
)
def test_persons(spark, text, name, email):
    got = spark.createDataFrame([(text,)], "t string").select(values.parse_person(F.col("t")).alias("p")).first().p
    assert (got and got.name, got and got.email) == (name, email)


def test_small_values(spark):
    one = spark.range(1)
    got = one.select(
        values.parse_explicit(F.lit(" YES ")).alias("yes"), values.parse_explicit(F.lit("no")).alias("no"), values.format_duration(F.lit(3661)).alias("d"),
        values.update_period(F.lit("Hourly")).alias("p"), values.text_type(F.lit("weird")).alias("t"), values.truncate(F.lit("éé"), 3).alias("cut"),
        values.content_type_charset(F.lit("text/xml; charset='UTF-8'")).alias("c"), values.is_valid_version(F.lit("rss091n")).alias("v"),
    ).first()
    assert tuple(got) == (True, None, "1:01:01", "hourly", "html", "éé", "UTF-8", False)


SAFE = ["http://example.com/", "https://8.8.8.8/x", "http://[2606:4700::1]/", "http://home.example/"]
UNSAFE = [
    "ftp://example.com/", "http://localhost/", "http://localhost./", "http://127.0.0.1/", "http://127.1/", "http://0x7f000001/", "http://2130706433/", "http://10.1.2.3/",
    "http://172.20.0.1/", "http://192.168.1.1/", "http://169.254.169.254/latest", "http://metadata.google.internal/", "http://printer.lan/", "http://a.corp/", "http://100.64.0.1/",
    "http://[::1]/", "http://[::ffff:10.0.0.1]/", "http://[64:ff9b::a9fe:a9fe]/", "http://[fd00::1]/", "http://[fe80::1]/", "http://[2001:db8::1]/", "http://224.0.0.1/", "http:///x", "nonsense",
]


def test_which_urls_are_safe():
    assert [u for u in SAFE if not urls.is_safe(u)] == []
    assert [u for u in UNSAFE if urls.is_safe(u)] == []


@pytest.mark.parametrize(
    "href,base,want",
    [
        ("#section", "http://example.com/page.html", "http://example.com/page.html#section"),
        ("?query=value", "http://example.com/page.html", "http://example.com/page.html?query=value"),
        ("", "http://example.com/page.html", "http://example.com/page.html"),
        ("../x", "http://example.com/a/b/c", "http://example.com/a/x"),
        ("//cdn.example.com/x", "https://example.com/", "https://cdn.example.com/x"),
        ("mailto:a@b.c", "http://example.com/", "mailto:a@b.c"),
        ("x", None, "x"),
        ("x", "not a url", "x"),
    ],
)
def test_joining(href, base, want):
    assert urls.join(href, base) == want


def test_safe_joining():
    assert urls.join_safe("x", "http://10.0.0.1/") == "x"
    assert urls.join_safe("http://127.0.0.1/", "http://example.com/") == ""
    assert urls.join_safe("javascript:alert(1)", "http://example.com/") == "javascript:alert(1)"
    assert urls.join_safe("secret", "file:///etc/") == "secret"
    assert urls.join_safe("x", "http://example.com/", resolve=False) == "x"


@pytest.mark.parametrize(
    "text,want",
    [
        ("<p>Hello</p><script>alert('XSS')</script>", "<p>Hello</p>"),
        ("<div><p><b>bold</b></p></div>", "<div><p><b>bold</b></p></div>"),
        ("Rust & C++: a <comparison>", "Rust &amp; C++: a "),
        ('<a href="javascript:x" onclick="y">t</a>', '<a rel="nofollow noopener noreferrer">t</a>'),
        ('<a href="http://e.com/">t</a>', '<a href="http://e.com/" rel="nofollow noopener noreferrer">t</a>'),
        ("<form><b>x</form>", "<b>x</b>"),
        ("1 < 2", "1 &lt; 2"),
        ("plain", "plain"),
    ],
)
def test_sanitizing(text, want):
    assert html.sanitize(text) == want
    assert html.sanitize(want) == want


def test_deep_html_is_escaped():
    assert html.sanitize("<div>" * 200 + "x").startswith("&lt;div&gt;")
    assert html.sanitize("<li>a" * 200).startswith("<li>")
    assert html.sanitize("<b>" * 300).startswith("<b>")


def test_html_helpers(spark):
    row = spark.createDataFrame([("<p>Hello <i>world</i></p>", "&#39;&#x3C;")], "a string, b string").select(html.strip_tags("a").alias("a"), html.decode_entities("b").alias("b")).first()
    assert tuple(row) == ("Hello world", "'<")


def test_encodings():
    head = '<?xml version="1.0" encoding="iso-8859-1"?>é'
    assert decode(head.encode("latin-1")) == (head, "windows-1252")
    assert decode(b'<?xml encoding="windows-1252"?>\x80\x81')[0].endswith("€\x81")
    assert decode("é".encode("utf-16-le").join([b"\xff\xfe", b""])) == ("é", "utf-16le")
    assert decode(b"\xef\xbb\xbfx") == ("x", "utf-8")
    assert detect(b"x", "utf-16be") == "utf-16be" and detect(b"x", "no-such") == "utf-8"
    assert decode(b"\xff\xfeA") != (None, None) and decode(b"a\xe9")[0] == "a�"


@pytest.mark.parametrize(
    "text,want",
    [
        ('<rss version="2.0"/>', "rss20"), ("<rss/>", "rss20"), ('<rss version="0.92"/>', "rss092"), ('<rss version="0.91"/>', "rss091u"),
        ('<!DOCTYPE rss PUBLIC "-//Netscape Communications//DTD RSS 0.91//EN" "x"><rss version="0.91"/>', "rss091n"), ('<rss version="2.0.1"/>', ""), ("<rdf:RDF/>", "rss10"),
        ('<feed xmlns="http://purl.org/atom/ns#"/>', "atom03"), ("<feed/>", "atom10"), ('{"version": "https://jsonfeed.org/version/1"}', "json10"),
        ('  {"version": "https:\\/\\/jsonfeed.org\\/version\\/1.1"}', "json11"), ("{}", ""), ("<html/>", ""), ("", ""),
    ],
)
def test_formats(text, want):
    assert version_of(text.encode()) == want


def test_axis_order(spark):
    from feedweave.operators.extensions import lon_first

    names = {"EPSG:4326": False, "urn:ogc:def:crs:EPSG::4326": False, "http://www.opengis.net/def/crs/EPSG/0/3857": True, "http://www.opengis.net/gml/srs/epsg.xml#4258": False, "urn:ogc:def:crs:OGC:1.3:CRS84": True, "EPSG:4017": True, "other": False, None: False}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", lon_first(F.col("n")).alias("x")).collect()
    assert {r.n: r.x for r in rows} == names
