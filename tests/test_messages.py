"""Messages, signed links, visits and counters."""

import hashlib
import hmac

from pyspark.sql import functions as F

from lodestone.functions import messages, visits
from lodestone.operators import visits as visiting


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_versions_and_sizes(spark):
    r = one(spark, messages.version(F.lit("1.92109000")), messages.version(F.lit("1.9")), messages.version(F.lit("x")), messages.version_text(F.lit(1.5), F.lit(7)), messages.byte_size(F.lit("2 kb")), messages.byte_size(F.lit("1TB")), messages.byte_size(F.lit("1")))
    assert (tuple(r.c0), tuple(r.c1), r.c2, r.c3, r.c4, r.c5, r.c6) == ((1.921, 9000), (1.9, 0), None, "1.5007", 2048, 1 << 40, None)


def test_checks(spark):
    rows = [("a-b.example", True), ("-a.example", False), ("a..b", False), ("", False), (None, False), ("x" * 64, False)]
    df = spark.createDataFrame(rows, "h string, want boolean").withColumn("got", messages.is_host_name(F.col("h")))
    assert all(r.got == r.want for r in df.collect())


def test_signed_links(spark):
    df = spark.createDataFrame([("https://a.test/x y?z=1&w=ü", 100), ("ftp://a.test", 100), (None, 1)], "u string, e long")
    rows = df.select(visits.link("s", "https://o", F.col("e"), F.col("u")).alias("l"), visits.signature("s", F.col("e"), F.col("u")).alias("s")).collect()
    want = hmac.new(b"s", "100\nhttps://a.test/x y?z=1&w=ü".encode(), hashlib.sha256).hexdigest()
    assert rows[0].s == want
    assert rows[0].l == f"https://o/visit?url=https%3A%2F%2Fa.test%2Fx%20y%3Fz%3D1%26w%3D%C3%BC&expires=100&signature={want}"
    assert rows[1].l == "ftp://a.test" and rows[2].s is None
    r = one(spark, visits.genuine("s", F.lit(100).cast("long"), F.lit("https://a.test/x y?z=1&w=ü"), F.lit(want)), visits.expired(F.lit(5), F.lit(5)), visits.expired(F.lit(5), F.lit(6)))
    assert tuple(r) == (True, False, True)


def test_chunks_and_orders(spark):
    good = '{"Kind":"posting","CanonicalURL":"http://a.test/","Postings":[{"word_hash":"w","url_hash":"u","hits":1,"text_position":0}]}'
    r = one(spark, messages.read_chunk(F.lit(good)), messages.read_chunk(F.lit('{"Kind":"other","CanonicalURL":"x"}')), messages.read_order(F.to_json(visits.order_of(F.lit("http://a.test/"), F.lit("o1")))), messages.read_order(F.lit('{"OrderID":"o"}')))
    assert r.c0.Postings[0].hits == 1 and r.c1 is None and r.c2.SeedURLs == ["http://a.test/"] and r.c3 is None


def test_forms():
    assert messages.request_form("query=AB&count=5&query=C&x=") == {"query": "AB", "count": "5", "x": ""}
    assert messages.request_text({"a": "1 2", "b": ""}) == "a=1+2"


def test_visits(spark):
    base = {"due": True, "status": "fetched", "deferrals": 0, "attempts": 0, "body_bytes": 1, "media_supported": True, "extractable": True, "refuses_indexing": False, "ignores_refusal": False}
    cases = [({}, "completed", None), ({"due": False}, "completed", "not-due"), ({"status": "deferred"}, "deferred", None), ({"status": "deferred", "deferrals": 3}, "abandoned", "deferrals-exhausted"), ({"status": "failed", "attempts": 4}, "abandoned", "fetch-abandoned"), ({"status": "failed"}, "retryable", None), ({"body_bytes": 1 << 30}, "completed", "oversized"), ({"refuses_indexing": True}, "completed", "indexing-refused"), ({"refuses_indexing": True, "ignores_refusal": True}, "completed", None)]
    df = spark.createDataFrame([{**base, **c, "n": i} for i, (c, _, _) in enumerate(cases)])
    got = {r.n: (r.conclusion, r.disposal) for r in visiting.outcomes(df).collect()}
    assert got == {i: (a, b) for i, (_, a, b) in enumerate(cases)}
    assert {b for _, _, b in cases if b} <= set(visiting.REASONS)
    h = {r.bound: r.n for r in visiting.histogram(df, F.col("body_bytes"), [1, 10], []).collect()}
    assert h == {1.0: 8, float("inf"): 1}
