"""Large documents in pieces: the same rows as in one go."""

import random
from dataclasses import replace

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedweave.functions.markup import Tokens
from feedweave.options import Limits, Options
from feedweave.plans.parse import parse_entries
from feedweave.sources import pieces as P

FIELDS = ("id", "title", "link", "summary", "tags", "author", "authors", "language", "content")
ODD = ["<!-- <item><title>no</title></item> -->", "<title><![CDATA[<item><title>in</title></item>]]></title>", '<link rel="<item >" href="r"/>', "<title>a & b</title>", "<title>t &amp; t</title>", "<link>../rel</link>", "<description>plain</description>", "<category domain='d'>c</category>", "<guid>g</guid>", "<a><b>c</b></a>", "<title>unclosed", "<?pi <item> ?>", "<!x [ <item> ]>", "<dc:creator>me</dc:creator>", "<item>inner</item>", "<content:encoded>x</content:encoded>"]


def feed(kind, n, seed, odd=0.1, tail=""):
    rng = random.Random(seed)
    tag = "entry" if kind == "atom" else "item"
    body = []
    for i in range(n):
        extra = "".join(rng.choice(ODD) for _ in range(3)) if rng.random() < odd else ""
        link = f'<link href="p/{i}"/>' if kind == "atom" else f"<link>p/{i}</link>"
        body.append(f"<{tag}><title>Title {i}</title>{link}{extra}<summary>{'s' * rng.randrange(40)}</summary></{tag}>\n")
    items = "".join(body)
    if kind == "atom":
        return f'<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xml:base="http://a.b/" xml:lang="en"><title>T</title><author><name>A</name></author>{items}{tail}</feed>'
    if kind == "rdf":
        return f'<rdf:RDF xmlns="http://purl.org/rss/1.0/"><channel><title>T</title></channel>{items}{tail}</rdf:RDF>'
    return f'<rss version="2.0"><channel><title>T</title><link>http://a.b/c/</link><language>fr</language>{items}{tail}</channel></rss>'


def documents():
    out = [feed(kind, 120, seed, odd) for kind in ("rss", "atom", "rdf") for seed, odd in ((1, 0), (2, 0.03), (3, 0.3))]
    out += [feed("rss", 80, 4, 0, tail) for tail in ("<title>late</title>", "<image><url>u</url></image>", '<a b="never', "<!-- never", "</channel><item/>", "<item><title>cut")]
    out += [feed("rss", 60, 5, 0)[:-40], feed("atom", 60, 6, 0).replace("<title>Title 30", "<title x='<entry>'>Title 30"), feed("rss", 60, 7, 0).replace("</item>", "", 3), "<rss><channel></channel></rss>", "no feed", '{"version":"https://jsonfeed.org/version/1.1","items":[' + ",".join('{"id":"%d"}' % i for i in range(400)) + "]}"]
    out += [feed("rss", 3, 8).replace("<item>", "<!-- <item> -->" + "<description>" + "d" * 5000 + "</description><item>", 1), feed("rss", 50, 9, 0).encode("utf-16"), feed("rss", 50, 10, 0).replace("Title", "Ünïcode"), '<?xml version="1.0" encoding="iso-8859-1"?>'.encode() + feed("rss", 50, 11, 0).replace("Title", "Ünï").encode("latin-1"), None, b""]
    return [d.encode() if isinstance(d, str) else d for d in out]


@pytest.mark.parametrize("options", [Options(), Options(limits=replace(Limits(), entries=37, feed_size=14_000))])
def test_pieces_give_the_same_rows(spark, options):
    docs = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in enumerate([*documents(), documents()[0]])], "_no int, content binary").repartition(3)
    rows = lambda piece: sorted(map(str, parse_entries(docs, options=options, entry_fields=FIELDS, piece=piece).collect()))
    want = rows(None)
    assert rows(1500) == want and len(want) > 700
    assert rows(1 << 20) == want


def test_a_large_document_is_dealt_out(spark):
    docs = spark.createDataFrame([(1, bytearray(feed("rss", 4000, 12, 0.01).encode()))], "id int, content binary")
    cut = P.cut(docs.first().content, Options(), 20_000)
    assert len(cut[2]) > 10 and cut[1] + "".join(cut[2]) == docs.first().content.decode()
    got = parse_entries(docs, entry_fields=("title",), piece=20_000)
    assert [r.entry_idx for r in got.orderBy("entry_idx").collect()] == list(range(got.count()))


PARTS = ["<", "</", "<a ", "<b>", "</b>", '"', "'", "=", "<!--", "-->", "<![CDATA[", "]]>", "<?", "?>", "<!x", "[", "]", " ", "t", "<item>", "<item x='", "</item>", ">"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40))
def test_states_compose_and_are_those_of_the_tokens(parts):
    text = "".join(parts)
    cuts = [i for i in range(len(text)) if text.startswith("<item", i)]
    state, seen = P.TEXT, []
    for a, b in zip([0, *cuts], [*cuts, len(text)]):
        seen.append(state)
        found = P.transfer(text[a:b])
        assert found == [P.end_state(text[a:b], s) for s in range(9)]
        state = found[state]
    assert state == P.end_state(text, P.TEXT)
    if state not in P.OPEN_TAG:
        tokens, at, starts = Tokens(text), 0, set()
        while (token := tokens.take(at)) is not None:
            starts.add(token[1])
            at = token[2]
        assert [s == P.TEXT for s in seen[1:]] == [c in starts for c in cuts]


def test_documents_in_another_order_at_each_reading(spark):
    def shuffled(batches):
        for batch in batches:
            yield batch.take(pa.array(random.sample(range(batch.num_rows), batch.num_rows), pa.int64()))

    bodies = [feed("rss", 20 + 7 * i, i, 0) for i in range(12)] + [feed("rss", 40, 20, 0.5)] * 3 + [feed("rss", 40, 21, 0).replace("<summary>", "<!-- </item><item>x</item> --><summary>")] * 2 + ["<rss><channel><item/>" + "<a b='" + "x" * 3000] * 2
    docs = spark.createDataFrame([(i % 15, bytearray(b.encode())) for i, b in enumerate(bodies)], "_k int, content binary").coalesce(1)
    docs = docs.mapInArrow(shuffled, docs.schema)
    rows = lambda piece: sorted(map(str, parse_entries(docs, entry_fields=FIELDS, piece=piece).collect()))
    want = rows(None)
    assert len(want) > 700 and all(rows(900) == want for _ in range(3))


def test_a_document_is_cut_behind_entries(spark):
    body = feed("rss", 300, 13, 0).replace("<summary>", "<description><![CDATA[<item>no</item> &]]></description><!-- <item> --><summary>").encode()
    _, _, texts = P.cut(body, Options(), 3000)
    assert len(texts) > 10 and all(P.end_state(t, P.TEXT) == P.TEXT and t.startswith("<item><title>") for t in texts)
