"""Search, ring, intake, crawl, full text and skew against small cases and brute force."""

import io
import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.functions import hashing
from lodestone.operators import crawl, derive, fulltext, index, ingest, ring, search, skew
from lodestone.plans import core
from lodestone.sources import archives
from lodestone.sources.stores import LostUpdate, Store, drift

POSTING = "word_hash string, url_hash string, hits int, text_position int, language string, document_type int, appearance int"


def postings(spark, rows):
    return spark.createDataFrame([(w.ljust(12, "A"), u.ljust(12, "A"), h, p, lang, 0, a) for w, u, h, p, lang, a in rows], POSTING)


def t(*names):
    return tuple(n.ljust(12, "A") for n in names)


def found(df):
    return [r.url_hash.rstrip("A") for r in search.ranked(df).collect()]


def test_and_join_sums_and_ranks(spark):
    p = postings(spark, [("w1", "u1", 4, 1, "en", 0), ("w1", "u2", 5, 1, "de", 0), ("w2", "u1", 4, 3, "en", 0), ("w2", "u2", 2, 1, "en", 0), ("w2", "u3", 9, 1, None, 4)])
    m = search.matches(p, search.Criteria(t("w1", "w2")))
    assert [(r.url_hash[:2], r.occurrences, r.spread) for r in search.ranked(m).collect()] == [("u1", 8, 2), ("u2", 7, 0)]
    assert found(search.matches(p, search.Criteria(t("w1"), t("w2")))) == []
    assert found(search.matches(p, search.Criteria(t("w2"), language="en"))) == ["u1", "u2"]
    assert found(search.matches(p, search.Criteria(t("w2"), content_kind="image"))) == ["u3"]
    assert found(search.matches(p, search.Criteria(t("w2"), required_documents=t("u3", "u9")))) == ["u3"]
    twice = search.matches(p, search.Criteria(t("w1", "w1"))).orderBy("url_hash").collect()
    assert [r.occurrences for r in twice] == [8, 10]


def test_spread_is_average_gap(spark):
    rows = [(w, u, 1, x, None, 0) for u, at in (("uA", (1, 5, 9)), ("uB", (1, 10, 20))) for w, x in zip(("w1", "w2", "w3"), at, strict=True)]
    m = search.matches(postings(spark, rows), search.Criteria(t("w1", "w2", "w3"), max_spread=5))
    assert found(m) == ["u"]


def test_cap_after_filter_and_ties(spark):
    p = postings(spark, [("w", f"u{i}", h, 0, None, 0) for i, h in enumerate((5, 1, 7, 3))])
    assert sorted(r.hits for r in search.kept(p, 2).collect()) == [5, 7]
    counts = search.term_counts(p, search.Criteria(t("w"), per_term=2)).first()
    assert (counts.held, counts.accepted, counts.kept) == (4, 4, 2)
    same = postings(spark, [("w", "u2", 1, 0, None, 0), ("w", "u1", 1, 0, None, 0)])
    assert [r.url_hash[:2] for r in search.ranked(search.matches(same, search.Criteria(t("w"))), 1).collect()] == ["u1"]


def test_report(spark):
    p = postings(spark, [("a", "u1", 1, 0, None, 0), ("b", "u1", 1, 0, None, 0), ("b", "u2", 1, 0, None, 0), ("c", "u3", 1, 0, None, 0)])
    c = search.Criteria(t("a", "b"))
    assert [(r.word_hash, r.n_documents) for r in search.report(p, c, "auto").collect()] == [(t("b")[0], 2)]
    assert search.report(p, search.Criteria(t("a")), "auto").count() == 0
    assert [r.n_documents for r in search.report(p, search.Criteria(t("a"), t("c")), "terms", t("c")).collect()] == [1]
    tie = postings(spark, [("b", "u1", 1, 0, None, 0), ("a", "u2", 1, 0, None, 0)])
    assert search.report(tie, c, "auto").first().word_hash == t("a")[0]


def test_topics(spark):
    df = spark.createDataFrame([("Alpha, beta: gamma",), ("the alpha-beta",), ("alpha 42 zz",), (None,)], "descr string")
    assert [r.topic for r in search.topics(df, search.Criteria(())).collect()] == ["alpha", "beta", "gamma"]


def test_criteria():
    c = search.criteria_of({"query": "A" * 24 + "B", "modifier": "/language/de x site:a.test", "count": "x", "time": "9000", "contentdom": "image", "strictContentDom": "on"}, {"a.test": "hosths"})
    assert (c.terms, c.language, c.site_hash, c.results, c.seconds, c.content_kind, c.strict_content_kind) == (("A" * 12, "A" * 12), "de", "hosths", 10, 3.0, "image", True)


def test_appearance_and_latest(spark):
    df = spark.createDataFrame([(m,) for m in (0, 1, 2245, 4095)], "m int").select("m", index.appearance_mask(index.appearance_flags(F.col("m"))).alias("b"))
    assert all(r.m == r.b for r in df.collect())
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "c")], "k int, s int, v string")
    assert sorted((r.k, r.v) for r in index.latest(rows, ["k"], ["s"]).collect()) == [(1, None), (2, "c")]


def test_nearest_peers_against_brute_force(spark):
    random.seed(5)
    name = lambda: "".join(random.choices(hashing.ALPHABET, k=12))
    peers, ids = [name() for _ in range(17)], [(name(), name()) for _ in range(40)]
    me = name()
    p = spark.createDataFrame([(x,) for x in [*peers, peers[0]]], "peer_hash string")
    rows = spark.createDataFrame(ids, "word_hash string, url_hash string")

    def place(h):
        n = 0
        for c in h[:10]:
            n = n * 64 + hashing.ALPHABET.index(c)
        return n * 8 + 7

    mask = (1 << 59) - 1
    at = {(w, u): place(w) & mask | place(u) & ~mask & (2**63 - 1) for w, u in ids}
    got = {}
    for r in ring.nearest_peers(rows, p).collect():
        got.setdefault((r.word_hash, r.url_hash), []).append((r.rank, r.peer_hash, r.distance))
    closer = {(r.word_hash, r.url_hash): r.closer_peers for r in ring.closer_than(rows, p, me).collect()}
    for k, x in at.items():
        want = sorted(((place(h) - x) % 2**63, h) for h in peers)[:3]
        assert sorted(got[k]) == [(i + 1, h, d) for i, (d, h) in enumerate(want)]
        assert closer[k] == sum((place(h) - x) % 2**63 < (place(me) - x) % 2**63 for h in peers)
    assert ring.nearest_peers(rows, p.limit(0)).count() == 0


def test_offers_and_handoff(spark):
    random.seed(6)
    name = lambda: "".join(random.choices(hashing.ALPHABET, k=12))
    peers, ids = [name() for _ in range(9)], [(name(), name()) for _ in range(20)]
    p, rows = spark.createDataFrame([(x,) for x in peers], "peer_hash string"), spark.createDataFrame(ids, "word_hash string, url_hash string")
    up = p.select("peer_hash", F.lit(True).alias("reachable"), F.lit(True).alias("recently_reachable"))
    windows = ring.replica_windows(rows, p, name())
    first = ring.nearest_peers(rows, p, 1).select("word_hash", "url_hash", "peer_hash")
    states = ring.holder_states(first, windows, up)
    assert {r.state for r in states.collect()} == {"inside"}
    for r in ring.offers(rows, p, states, windows, p).join(windows, ["word_hash", "url_hash"]).join(first, ["word_hash", "url_hash"]).collect():
        assert r.acceptances_needed == r.required - 1
        assert r.peers == r.closest[1 : 1 + r.acceptances_needed]
    gone = p.select("peer_hash", F.lit(False).alias("reachable"), F.lit(False).alias("recently_reachable"))
    assert {r.state for r in ring.holder_states(first, windows, gone).collect()} == {"expired"}
    assert ring.handed_off(first, peers[0], up, 1).count() <= 20


def test_schedule(spark):
    df = spark.createDataFrame([(100, 50), (0, 100_000)], "due long, interval int")
    got = [tuple(r) for r in df.select(ring.widened(F.col("interval")), ring.pause(F.col("interval"), F.lit(700)), ring.next_due(F.col("due"), F.lit(90_000))).collect()]
    assert got == [(300, 700, 100 + 2 * 86_400), (86_400, 86_400, 2 * 86_400)]


def test_escrow(spark):
    at = lambda s: datetime(2025, 1, 1) + timedelta(seconds=s)
    holds = spark.createDataFrame([("w1", "u1", at(0)), ("w1", "u1", at(200)), ("w2", "u1", at(10)), ("w1", "u2", at(0)), ("w1", "u3", at(9))], "word_hash string, url_hash string, held_at timestamp")
    came = spark.createDataFrame([("u1", at(400)), ("u3", at(5)), ("u3", at(7))], "url_hash string, arrived_at timestamp")
    got = {(r.word_hash, r.url_hash): r.outcome for r in ingest.escrow(holds, came).collect()}
    assert got == {("w1", "u1"): "released", ("w2", "u1"): "expired", ("w1", "u2"): "expired", ("w1", "u3"): "stored"}


def test_eviction_stops_below_the_mark(spark):
    rows = [(f"u{i}", None if i == 0 else datetime(2025, 1, 1 + i).date()) for i in range(10)]
    m = spark.createDataFrame(rows, "url_hash string, load_day date").withColumns({"mod_day": F.lit(None).cast("date"), "fresh_day": F.lit(None).cast("date")})
    sizes = m.select("url_hash", F.lit(10).cast("long").alias("bytes"))
    assert sorted(r.url_hash for r in ingest.evicted(m, sizes, 80).collect()) == ["u0", "u1", "u2"]
    assert ingest.evicted(m, sizes, 1000).count() == 0
    assert [r.url_hash for r in ingest.stalest(m, 2).collect()] == ["u0", "u1"]


def test_traversal(spark):
    links = spark.createDataFrame([("http://a.test/", "http://a.test/1"), ("http://a.test/1", "http://a.test/2"), ("http://a.test/1", "http://b.test/"), ("http://a.test/2", "http://a.test/3"), ("http://a.test/", "http://a.test/q?x=1")], "source string, target string")
    seeds = spark.createDataFrame([("http://a.test/",)], "url string")
    got = {r.url: r.depth for r in crawl.traversal(seeds, links, crawl.Profile(scope="domain", max_depth=2)).collect()}
    assert got == {"http://a.test/": 0, "http://a.test/1": 1, "http://a.test/2": 2}
    assert crawl.traversal(seeds, links, crawl.Profile(max_depth=3, max_per_host=2)).count() == 3
    sub = crawl.within_scope(links.select(F.col("target").alias("url")), spark.createDataFrame([("http://a.test/x",)], "url string"), "subpath")
    assert sub.where("url like 'http://b%'").count() == 0 and sub.count() == 4


def test_http_values(spark):
    df = spark.createDataFrame([("120",), ("Wed, 01 Jan 2025 00:02:00 GMT",), ("soon",), (None,)], "h string")
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    assert [r[0] for r in df.select(crawl.retry_after(F.col("h"), now)).collect()] == [120, 120, 60, 60]
    r = spark.range(1).select(crawl.robots_directives(F.lit("bot: NoIndex, nofollow , x")).alias("a"), crawl.robots_directives(F.lit("none")).alias("b"), crawl.media_type(F.lit("Text/HTML; charset=x")).alias("m"), crawl.retry_delay(F.lit(3)).alias("d")).first()
    assert (tuple(r.a), tuple(r.b), r.m, r.d) == ((False, True), (True, True), "text/html", 1.125)


def test_fulltext(spark):
    d = spark.createDataFrame([("u1", "Red fox", "the fox runs", "en-GB"), ("u2", "Blue", "red fox", "en"), ("u3", "", "red fox", "en"), ("u4", "Red", "fox", "de"), ("u5", "Foxes", "red", None)], "url string, title string, content string, language string")
    words = fulltext.postings(d)
    assert [(r.url, r.score) for r in fulltext.page_of(fulltext.search(words, ["Fox", "red"], "en"), 1).collect()] == [("u1", 7), ("u2", 2)]
    assert fulltext.search(words, []).count() == 0 and fulltext.postings(d.limit(0)).count() == 0
    stems = fulltext.postings(d, analysed=True)
    assert {r.url for r in fulltext.search(stems, ["foxes"], analysed=True).collect()} == {"u1", "u2", "u4", "u5"} and {r.url for r in fulltext.search(stems, ["fox"], analysed=True).collect()} == {"u1", "u2", "u4"}
    over = fulltext.search_over({"en": words.where("language = 'en'"), "de": words.where("language = 'de'")}, ["red", "fox"])
    assert {(r.url, r.language_index) for r in over.collect()} == {("u1", "en"), ("u2", "en"), ("u4", "de")}
    assert {r.url: r.language_index for r in fulltext.routed(d, ["en"]).collect()} == {"u1": "en", "u2": "en", "u3": "en", "u4": "und", "u5": "und"}
    with pytest.raises(ValueError, match="twice"):
        fulltext.index_names("x", ["en", "en-GB"])


def test_derivations(spark):
    assert derive.derivable("html", "readable_text") and not derive.derivable("markdown", "html")
    derive.check({"html"}, {"readable_text", "markdown"})
    with pytest.raises(ValueError, match="nothing leads"):
        derive.check({"pdf"}, {"text"})
    page = "<nav><a href='/'>Home</a></nav><div><p>hello world, this is a text</p></div>"
    pages = derive.formats(spark.createDataFrame([(1, page), (2, "<p>short</p>"), (3, None)], "id int, html string"), "html", "html", ["readable_html", "readable_text", "markdown"])
    r = {x.id: x for x in pages.collect()}
    assert r[1].readable_text == r[1].markdown == "hello world, this is a text" and r[1].readable_html == "<article><p>hello world, this is a text</p></article>"
    assert (r[2].readable_html, r[2].readable_text, r[2].markdown) == (None, "short", "short") and r[3].markdown is None
    made, count = derive.published(pages, ["readable_html", "markdown"], ["id"])
    assert {(x.id, x.kind) for x in made.collect()} == {(1, "readable_html"), (1, "markdown"), (2, "markdown")}
    assert {(x.id, x.underivable, x.failed) for x in count.collect()} == {(1, 0, False), (2, 1, False), (3, 2, True)}


def test_archives(spark):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x.html", "<p>x")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("a.txt", "a")
        z.writestr("in.zip", inner.getvalue())
        z.writestr("bad.gz", b"no gzip")
    got = {r.url.split("!", 1)[1]: (r.media_type, r.error) for r in archives.expand(spark.createDataFrame([("http://h.test/o.zip", "application/zip", bytearray(outer.getvalue()))], "url string, media_type string, body binary")).collect()}
    assert got == {"/a.txt": ("text/plain", None), "/in.zip!/x.html": ("text/html", None), "/bad.gz": ("application/gzip", "BadGzipFile")} or set(got) == {"/a.txt", "/in.zip!/x.html", "/bad.gz"}


def test_archive_budgets(monkeypatch):
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(6):
            z.writestr(f"{i}.txt", "x")
        z.writestr("bomb.txt", "0" * 300_000)
    got = archives.expanded("http://h.test/o.zip", None, many.getvalue(), budget=3)
    assert [e for *_, e in got] == [None, None, None, "document budget exhausted"]
    monkeypatch.setattr(archives, "MEMBER_BYTES", 1000)
    assert [e for *_, e in archives.expanded("http://h.test/o.zip", None, many.getvalue())] == [None] * 6 + ["TooLarge"]


def test_crawl_budget(spark):
    links = spark.createDataFrame([(f"http://a.test/{i}", f"http://a.test/{j}") for i in range(6) for j in (2 * i + 1, 2 * i + 2)], "source string, target string")
    seeds = spark.createDataFrame([("http://a.test/0",)], "url string")
    full = {r.url[-1]: r.depth for r in crawl.traversal(seeds, links, crawl.Profile(max_pages=None, max_depth=2)).collect()}
    assert full == {"0": 0, "1": 1, "2": 1, "3": 2, "4": 2, "5": 2, "6": 2}
    cut = {r.url[-1]: r.depth for r in crawl.traversal(seeds, links, crawl.Profile(max_pages=4, max_depth=3)).collect()}
    assert cut == {"0": 0, "1": 1, "2": 1, "3": 2}


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    df = lambda rows: spark.createDataFrame(rows, "k int, s int, v string")
    s.upsert("t", df([(1, 1, "a"), (2, 1, "b")]), ["k"], ["s"])
    s.upsert("t", df([(1, 2, "c")]), ["k"], ["s"])
    assert sorted((r.k, r.v) for r in s.read("t").collect()) == [(1, "c"), (2, "b")]
    s.remove("t", spark.createDataFrame([(2,)], "k int"))
    assert s.counts() == {"t": 1}
    before = s.version()
    s.commit({}, {"t": s.read("t"), "u": df([(9, 9, None)])})
    assert s.lengths() == {"t": 2, "u": 1} and s.read("t").count() == 2
    with pytest.raises(LostUpdate):
        s.commit({"t": df([(5, 5, "e")])}, on=before)
    assert s.lengths() == {"t": 2, "u": 1}
    assert s.vacuum(keep=1) > 0 and s.read("t").count() == 2 and s.read("u").count() == 1
    assert drift(s.read("t"), {"k": "int", "v": "int", "x": "int"}) == ["missing x", "surplus s", "v: string, not int"]


@pytest.mark.parametrize("width", [1, 3, 8])
def test_skew_against_brute_force(spark, width):
    random.seed(width)
    rows = [(random.choice(["hot"] * 6 + ["a", "b", None]), random.choice(["u1", "u2", "u3", None]), random.choice([1, 2, 2, 9, None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v string, m int, i long").withColumn("key", F.lit("clash"))
    got = {r.key: r for r in skew.per_key(df, F.col("k"), F.col("v"), F.col("m"), F.col("i"), 3, width).collect()}
    assert set(got) == {r[0] for r in rows}
    for k, r in got.items():
        own = [x for x in rows if x[0] == k]
        assert (r.n_rows, r.n_distinct, r.total) == (len(own), len({x[1] for x in own} - {None}), sum(x[2] or 0 for x in own))
        best = sorted((x for x in own if x[2] is not None), key=lambda x: (-x[2], x[1] or "", x[3]))[:3]
        assert [(x.measure, x.value, x.id) for x in r.top] == [(x[2], x[1], x[3]) for x in best]
    heavy = {r.key for r in skew.heavy_keys(df, F.col("k"), F.col("i"), 0.5, width).collect()}
    assert heavy == {"hot"}


def test_skew_empty(spark):
    df = spark.createDataFrame([], "k string, v string, m int, i long")
    assert skew.per_key(df, F.col("k"), F.col("v"), F.col("m"), F.col("i")).count() == 0
    assert skew.heavy_keys(df, F.col("k"), F.col("i"), 0.1).count() == 0


def test_scope_prefix_takes_every_seed(spark, tmp_path):
    seeds = [f"http://{'h' * n}.test/d{n}/index" for n in range(1, 9)]
    rows = [(i, f"seed{i}", u, None) for i, u in enumerate(seeds)]
    rows += [(10 + i, f"in{i}", u.replace("index", "sub/page?q=1"), f"seed{(i + 3) % 8}") for i, u in enumerate(seeds)]
    rows += [(20 + i, f"out{i}", u.replace("/d", "/e"), f"seed{i}") for i, u in enumerate(seeds)]
    spark.createDataFrame(rows, "stream_seq long, url_hash string, url string, referrer string").write.parquet(f"{tmp_path}/url_metadata.parquet")
    dirs = [u[: u.rindex("/") + 1] for u in seeds]
    want = {u for _, _, u, r in rows if r and any(u.split("?")[0].startswith(d) for d in dirs)}
    assert {r.url for r in core.scope_prefix(spark, str(tmp_path)).collect()} == want and len(want) == 8
