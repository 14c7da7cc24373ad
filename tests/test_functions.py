"""Hashes, addresses, tokens and wire forms against known values."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions import hashing, html, tokens, urls, wire

URL_HASHES = {
    "http://transfer.example.invalid/doc-150.txt": "TULSZfg4-80c", "http://example.com/": "pr8XV7QpK89Y", "http://example.zip/": "t3W5Y7JLp4kY",
    "http://8.8.8.8/": "CBPqTsg_XLIY", "http://localhost/": "ydtWn7sIW_pc", "http://127.0.0.1/": "aZ_PRjJhfryc", "http://site.onion/": "cgKOV7BYHCjc",
    "http://printer.local/": "29i2X7wOGGwc", "http://doc.example/": "q2iRT7ZE1a9c", "http://exampleab.com/": "AMOmD7IlHtxZ",
    "http://longexampledomain.com/": "zMNQE7pM_BVb", "https://example.com/": "GCzO2s5gBFP4",
}
REGIONAL = {"http://example.de/": "-QU1M7NH-7-A", "http://example.br/": "3kp2X7J0kuTE", "http://example.jp/": "Re7-j7TLc0dI", "http://bücher.de/": "0Vuap7fMfOoC"}
NORMAL_FORMS = {
    "http://Example.COM:80/Path": "http://example.com/Path", "https://Example.com:443/": "https://example.com/", "http://example.com:8080/x": "http://example.com:8080/x",
    "http://example.com/a?sid=1&b=2": "http://example.com/a?b=2", "http://example.com/a?b=2&sid=1": "http://example.com/a?b=2", "http://example.com/a?sid=1": "http://example.com/a",
    "http://example.com/a?jsessionid=1&b=2": "http://example.com/a?b=2", "http://example.com/a/b/../c": "http://example.com/a/c", "http://example.com/a/b/..": "http://example.com/a",
    "http://example.com/a/./b": "http://example.com/a/b", "http://example.com/a//b": "http://example.com/a/b", "http://example.com/a/b/../../c": "http://example.com/c",
    "http://example.com/../a": "http://example.com/a", "http://example.com/..": "http://example.com/", "http://example.com": "http://example.com/",
    "http://example.com/a/b/../c?x=/../y": "http://example.com/a/c?x=/../y", "http://bücher.example/": "http://xn--bcher-kva.example/", "http://例え.テスト/": "http://xn--r8jz45g.xn--zckzah/",
    "http://www.bücher.com/": "http://www.xn--bcher-kva.com/",
}
CANONICAL = {
    "HTTP://Example.COM": "http://example.com/", "http://example.com:80/a": "http://example.com/a", "https://example.com:443/a": "https://example.com/a",
    "http://example.com/a/../b": "http://example.com/b", "http://example.com/a/#frag": "http://example.com/a/", "http://example.com:8080/x": "http://example.com:8080/x",
    "http://example.com/a/b/": "http://example.com/a/b/", "::bad": None, "ftp://example.com/x": None, "http:///path": None, None: None,
}


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_url_hashes(spark):
    rows = spark.createDataFrame([(u, h) for u, h in URL_HASHES.items()], "url string, want string")
    for r in rows.withColumn("got", urls.url_hash(F.col("url"))).collect():
        assert r.got == r.want, r.url


def test_url_hashes_with_regions(spark):
    rows = spark.createDataFrame(list(REGIONAL.items()), "url string, want string")
    for r in rows.withColumn("got", urls.url_hash(F.col("url"), {"de": 0, "br": 1, "jp": 2})).collect():
        assert r.got == r.want, r.url


@pytest.mark.parametrize(("url", "want"), NORMAL_FORMS.items())
def test_normal_form(url, want):
    assert urls.normal_form(url) == want


@pytest.mark.parametrize(("url", "want"), CANONICAL.items())
def test_canonical(url, want):
    assert urls.canonical(url) == want


def test_links():
    assert urls.joined("http://example.com/dir/page", "../x?y=1#z") == "http://example.com/x?y=1"
    assert urls.joined("http://example.com/", "mailto:a@b.c") is None


def test_symbols(spark):
    for data, want in ((b"", ""), (b"\x00", "AA"), (b"\xff", "_w"), (b"\x00\x00\x00", "AAAA")):
        r = one(spark, hashing.encode64(F.lit(data)), hashing.decode64(F.lit(want)))
        assert (r.c0, bytes(r.c1)) == (want, data)
    assert one(spark, hashing.decode64(F.lit("a!"))).c0 is None


def test_word_hash_shifts_reserved_prefix(spark):
    df = spark.createDataFrame([("_____abcdefg",), ("______bcdefg",), ("abc",)], "h string")
    lead = F.length("h") - F.length(F.ltrim("h", F.lit("_")))
    shifted = F.when(lead >= 5, F.rpad(F.substr("h", lead - 3), 12, F.lit("A"))).otherwise(F.col("h"))
    assert [r.s for r in df.select(shifted.alias("s")).collect()] == ["____abcdefgA", "____bcdefgAA", "abc"]
    assert one(spark, hashing.word_hash(F.lit("Peer"))).c0 == one(spark, hashing.word_hash(F.lit("pEER"))).c0


def test_ring(spark):
    r = one(spark, hashing.ring_position(F.lit("AAAAAAAAAAAA")), hashing.ring_position(F.lit("____________")), hashing.ring_distance(F.lit(10), F.lit(7)), hashing.ring_distance(F.lit(7), F.lit(10)), hashing.hash_at(hashing.ring_position(F.lit("Jz3VmXzl_3YP"))), hashing.ring_sector(hashing.ring_position(F.lit("____________"))))
    assert (r.c0, r.c1, r.c3, r.c4[:10], r.c5) == (7, 2**63 - 1, 3, "Jz3VmXzl_3", 63)
    assert r.c2 == 2**63 - 3


def test_split_hashes(spark):
    assert one(spark, hashing.split_hashes(F.lit("A" * 12 + "B" * 12 + "C"))).c0 == ["A" * 12, "B" * 12]
    assert one(spark, hashing.split_hashes(F.lit("short"))).c0 == []


def test_positions(spark):
    df = spark.createDataFrame([(1, "State-of-the-art costs 3.14, x. ... Really? No end"), (2, None), (3, ""), (4, "...")], "id int, text string")
    got = [tuple(r) for r in tokens.positions(df, ["id"], "text").orderBy("id", "text_position").collect()]
    assert got == [
        (1, "state-of-the-art", 0, 100, 1), (1, "costs", 1, 100, 2), (1, "3.14", 2, 100, 3), (1, "really", 3, 101, 1), (1, "no", 4, 102, 1), (1, "end", 5, 102, 2),
    ]
    stats = {r.id: tuple(r.s) for r in df.select("id", tokens.statistics(F.col("text")).alias("s")).collect()}
    assert stats == {1: (6, 3), 2: (0, 0), 3: (0, 0), 4: (0, 0)}


def test_posting_lines(spark):
    word, url = "abcdefghijkl", "mnopqrstuvwx"
    lines = [
        word + "{a=100,c=7,d=105,g=0,h=" + url + ",i=0,k=0,l=en,m=42,n=4,o=1,p=8,r=3,s=100,t=258,u=3,w=120,x=2,y=5,z=AAAAAA}",
        word + "{c=1,d=104,h=" + url + ",l=eng,t=258x,x=2,z=AAAAAAA}", word + "{c=300,h=" + url + ", c = 2 }", "no form", word + "{h=short}", word + "{h=" + url + ",x}", "",
    ]
    got = wire.read_postings(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r.hits, r.text_position, r.document_type, r.language) for r in got] == [(7, 258, "image", "en"), (1, 258, "html", "en"), (2, 0, None, None)]
    batch = spark.createDataFrame([(1, "\n".join(lines[:3] + lines[:1])), (2, lines[3])], "id int, raw string")
    assert [(r.id, r.hits) for r in wire.read_batch(batch, "id", "raw", 3).collect()] == [(1, 7), (1, 1), (1, 2)]


def test_properties_and_messages(spark):
    text = F.lit("a=1, b = x=y ,,c=")
    r = one(spark, wire.properties(text), wire.properties(F.lit("a=1,b")), wire.properties(F.lit("=1")), wire.properties(F.lit("")), wire.properties(F.lit("a=1,b=2,a=3")))
    assert (r.c0, r.c1, r.c2, r.c3, r.c4) == ({"a": "1", "b": "x=y", "c": ""}, None, None, {}, {"a": "3", "b": "2"})
    m = wire.read_message(F.lit("# no\n\nk=v\nx\\=y = 1=2\nbad\n=z\n"))
    assert one(spark, m).c0 == {"k": "v", "x=y": "1=2"}
    assert one(spark, wire.message_text(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))).c0 == "a=1\nb=2\n"


def test_values(spark):
    r = one(
        spark, wire.decimal_prefix(F.lit("  -12x")), wire.cardinal(F.lit("-1"), 0xFF), wire.cardinal(F.lit("258x"), 0xFFFF), wire.micro_date(F.lit("262145")), wire.read_short_day(F.lit("20250229")),
        wire.read_short_day(F.lit("20250228")), wire.short_day(F.lit(None).cast("date")), wire.utc_offset(F.lit("-0130")), wire.utc_offset_text(F.lit(-90)), wire.bitfield_mask(wire.bitfield_number(wire.bitfield(F.lit(2245)))),
        wire.unframed(F.lit("p|x")), wire.unframed(wire.framed(F.lit("ü|"))), wire.unframed(F.lit("plain")), wire.unframed(F.lit("q|x")), wire.read_short_second(F.lit("20250102030405")),
    )
    assert tuple(r)[:4] == (-12, 255, 258, 1)
    assert tuple(r)[4:] == (None, date(2025, 2, 28), "", -90, "-0130", 2245, "x", "ü|", "plain", None, datetime(2025, 1, 2, 3, 4, 5))


def test_gzip_frame(spark):
    import base64
    import gzip

    text = "z|" + base64.urlsafe_b64encode(gzip.compress(b"hello")).decode().rstrip("=")
    assert one(spark, wire.unframed(F.lit(text))).c0 == "hello"


def test_abstract(spark):
    hashes = F.array(*[F.lit(h) for h in ("bbbbbb-sites", "aaaaaa-sites", "_aaaaaAsites")])
    assert one(spark, wire.abstract(hashes)).c0 == "{Asites:_aaaaa,-sites:aaaaaabbbbbb}"


PAGE = """<html lang="en-GB"><head><title> A  page </title><base href="http://x.test/d/"><meta name="robots" content="NOINDEX, follow"><style>p{}</style></head>
<body><nav><a href="/">Home</a></nav><h1>Head</h1><p>Some <b>bold</b> text, long enough for an article to be found.</p><ul><li>one</li><li><a href="p?q#f">two</a></li></ul>
<script>no()</script><a href="http://y.test/">out</a><a href="http://y.test/">again</a></body></html>"""


def test_html(spark):
    r = spark.createDataFrame([("http://x.test/d/a", PAGE), (None, None)], "url string, body string").select(html.extract("url", "body").alias("x"), html.flatten("body").alias("t"), html.to_markdown("body").alias("m"), html.to_readable("body").alias("a")).collect()
    x = r[0].x
    assert (x.title, x.language, x.local_links, x.external_links, x.refuses_indexing, x.refuses_following) == ("A page", "en", 2, 1, True, False)
    assert x.links == ["http://x.test/", "http://x.test/d/p?q", "http://y.test/"]
    assert "Some bold text, long enough for an article to be found." in r[0].t.split("\n")
    assert "no()" not in r[0].t
    assert "# Head" in r[0].m and "**bold**" in r[0].m and "- one" in r[0].m
    assert r[0].a.startswith("<article>") and "Some <b>bold</b> text" in r[0].a and "Home" not in r[0].a and "no()" not in r[0].a
    assert r[1].t is None
