"""Functions and table functions of SQL, and the URL rules as columns."""

import random

import pytest
from pyspark.sql import functions as F

from feedweave.functions import urls
from feedweave.functions.register import EXPRESSIONS, register
from feedweave.plans.parse import parse_entries
from feedweave.plans.tables import create_entry_function

HOSTS = ["e.com", "10.0.0.1", "127.1", "0x7f.1", "[::1]", "[::ffff:10.0.0.1]", "[2001:db8::1]", "[2606:4700::1111]", "localhost", "a.LOCAL", "1.1.1.1", "0300.0250.1.1", "[fe80::1%25eth0]", "user@e.com", "e.com:80", "", "[::", "8.8.8.8.", "999", "4294967295", "08.1.1.1", "[64:ff9b::0808:0808]", "[64:ff9b::a00:1]", "[::8.8.8.8]", "metadata", "1.2.3.4.5", "256.1.1.1", "[1:2:3:4:5:6:7:8]", "[1:2:3:4:5:6:7::]", "[1::2::3]", "[::1.2.3]", "[::01.2.3.4]", "0x", "1..2", "a\\@b", "e\t.com"]
PATHS = ["", "/", "/a/b", "/a/../b", "/./", "/a/b/..", "/a//b", "?q=1", "#f", "/x;p?q#f", "a", "../x", "./", "..", "a/./b/../../c", "?", "#", "\\x\\y", "a b", "/ü"]


def made(n, seed):
    rng = random.Random(seed)
    url = lambda: rng.choice(["http://", "https://", "HTTP://", "ftp://", "//", "", "mailto:", "file://", "http:", "javascript:", " http://"]) + rng.choice(HOSTS) + rng.choice(PATHS)

    def v6():
        groups = [format(rng.randrange(65536), "x") for _ in range(rng.randrange(9))]
        k = rng.randrange(len(groups) + 1)
        return f"http://[{rng.choice([':'.join(groups), ':'.join(groups[:k]) + '::' + ':'.join(groups[k:])])}{rng.choice(['', ':1.2.3.4'])}]/"

    edge = lambda: f"http://{'.'.join(str(rng.choice([0, 1, 10, 31, 32, 63, 64, 100, 127, 128, 169, 172, 192, 198, 203, 224, 240, 255])) for _ in range(4))}/"
    near = lambda: f"http://[{rng.choice(['64:ff9b', '64:ff9b:1', '100', '2001', '2620:4f:8000', '3fff', '5f00', 'fc00', 'fe7f', 'fe80', 'fec0', 'ff00'])}:{rng.randrange(65536):x}::{rng.randrange(65536):x}]"
    return [rng.choice((url, v6, edge, near))() for _ in range(n)], [(rng.choice([*PATHS, url()]), rng.choice([url(), "http://a.b/c/d?q#f", "https://e.com", "file:///etc/x", "urn:x:y", "http://10.0.0.1/q", None])) for _ in range(n)]


def test_url_rules_are_the_same_as_columns(spark):
    hosts, pairs = made(3000, 1)
    got = spark.createDataFrame([(u,) for u in hosts], "u string").select("u", urls.is_safe_url(F.col("u")).alias("s")).collect()
    assert [r.u for r in got if r.s != urls.is_safe(r.u)] == [] and 200 < sum(r.s for r in got) < 2800
    rows = spark.createDataFrame(pairs, "h string, b string")
    columns = rows.select("h", "b", urls.resolve_url(F.col("h"), F.col("b")).alias("j"), urls.resolve_safe(F.col("h"), F.col("b")).alias("s"))
    assert "Python" not in columns._jdf.queryExecution().toString()
    got = columns.collect()
    assert [r for r in got if r.j != urls.join(r.h, r.b)] == []
    assert [r for r in got if r.s != urls.join_safe(r.h, r.b)] == []
    assert len({r.j for r in got}) > 300


def test_nulls(spark):
    row = spark.createDataFrame([(None, None)], "u string, b string").select(urls.is_safe_url(F.col("u")).alias("s"), urls.resolve_url(F.col("u"), F.lit("http://e.com/")).alias("j"), urls.resolve_url(F.lit("x"), F.col("b")).alias("k")).first()
    assert (row.s, row.j, row.k) == (None, None, "x")


#: Examples of the general syntax of references (RFC 3986, 5.4), against http://a/b/c/d;p?q.
NORMAL = {"g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g/", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y", "g?y/../x": "http://a/b/c/g?y/../x"}


def test_references_of_the_standard(spark):
    rows = spark.createDataFrame(list(NORMAL.items()), "href string, want string")
    got = rows.select("href", "want", urls.resolve_url(F.col("href"), F.lit("http://a/b/c/d;p?q")).alias("j")).collect()
    assert [(r.href, r.j) for r in got if r.j != r.want] == []


def test_functions_of_sql_have_no_python(spark):
    assert set(EXPRESSIONS) < set(register(spark))
    spark.createDataFrame([("Mon, 06 May 2024 07:08:09 GMT", "a@b.c (N)", 3700, "../x", "http://e.com/a/b/c")], "d string, p string, s bigint, h string, b string").createOrReplaceTempView("sql_values")
    found = spark.sql("""select cast(parse_date(d) as string) d, parse_person(p).email e, flat_person(parse_person(p)) f, parse_explicit('yes') x, text_type('html') t, mime_type('html') m, format_duration(s) s,
        is_valid_version('rss20') v, normalize_version('RSS 2.0') n, update_period('Daily') u, namespace_prefix('http://www.w3.org/2005/Atom') np, namespace_uri('dc') nu, truncate_text('abcdef', 3) c,
        content_type_charset("text/xml; charset='x'") ch, resolve_url(h, b) r, resolve_safe('javascript:1', b) rs, is_safe_url('http://127.0.0.1/') ok from sql_values""")
    assert "Python" not in found._jdf.queryExecution().toString()
    assert tuple(found.first()) == ("2024-05-06 07:08:09", "a@b.c", "N (a@b.c)", True, "html", "text/html", "1:01:40", True, "rss20", "daily", "atom", "http://purl.org/dc/elements/1.1/", "abc", "x", "http://e.com/a/x", "javascript:1", False)


FEEDS = [
    b"<rss><channel><title>T</title><language>en</language><item><title>a &lt;b&gt;</title><guid>g1</guid><category>c</category></item><item><title>2</title></item></channel></rss>",
    b'<feed xmlns="http://www.w3.org/2005/Atom"><author><name>N</name></author><entry><id>i</id><title type="html">&lt;script&gt;x&lt;/script&gt;ok</title><link href="http://e.com/"/></entry></feed>',
    b'{"version":"https://jsonfeed.org/version/1.1","items":[{"id":"j","title":"<b onclick=1>x</b>","tags":["t"]},{"id":"k"}]}',
    b"not a feed", None,
]


@pytest.mark.parametrize("fields", [("id", "title", "tags", "author", "link"), None])
def test_the_table_function_gives_the_same_entries(spark, fields):
    docs = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in enumerate(FEEDS)], "doc int, content binary")
    docs.createOrReplaceTempView("udtf_docs")
    create_entry_function(spark, "test_entries", entry_fields=fields)
    got = spark.sql("select d.doc, e.* from udtf_docs d, lateral test_entries(d.content) e")
    want = parse_entries(docs, entry_fields=fields)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 5
