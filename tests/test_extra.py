"""Codecs, transfers, distribution, frontier, extension points and regions, against small cases."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from lodestone import extensions
from lodestone.functions import codecs, hashing, urls, wire
from lodestone.operators import crawl, distribution, frontier, index, ingest, skew, transfer
from lodestone.sources import compacted
from lodestone.sources.stores import Store

# Hashes of addresses.
HASHES = {
    "http://example.de/": "-QU1M7NH-7-A", "http://example.ru/": "CYe0z7P0yZBA", "http://example.br/": "3kp2X7J0kuTE", "http://example.jp/": "Re7-j7TLc0dI", "http://example.ir/": "LU5jE7lSmaAM",
    "http://example.us/": "pug_Z7L2Q4LQ", "http://example.za/": "gt1MV7E2yesU", "http://example.com/": "pr8XV7QpK89Y", "http://example.zip/": "t3W5Y7JLp4kY", "http://8.8.8.8/": "CBPqTsg_XLIY",
    "http://localhost/": "ydtWn7sIW_pc", "http://127.0.0.1/": "aZ_PRjJhfryc", "http://site.onion/": "cgKOV7BYHCjc", "http://printer.local/": "29i2X7wOGGwc", "http://doc.example/": "q2iRT7ZE1a9c",
    "http://exampleab.com/": "AMOmD7IlHtxZ", "http://longexampledomain.com/": "zMNQE7pM_BVb", "https://example.com/": "GCzO2s5gBFP4", "http://b\u00fccher.de/": "0Vuap7fMfOoC", "http://transfer.example.invalid/doc-150.txt": "TULSZfg4-80c",
}


def test_regions_in_hashes(spark):
    df = spark.createDataFrame(list(HASHES.items()), "url string, want string")
    assert {r.url: r.h for r in df.select("url", urls.url_hash(F.col("url")).alias("h")).collect()} == HASHES
    assert len(urls.default_regions()) > 200 and urls.default_regions()["org"] == urls.default_regions()["ca"] == 4 and "cw" not in urls.default_regions()


def test_local_hosts(spark):
    local = ["localhost", "LocalHost", "10.1.2.3", "127.0.0.1", "172.16.0.1", "172.31.9.9", "192.168.0.1", "169.254.1.1", "fe80::1", "::1", "fd00::5", "fc12:3", "0:0:0:0:0:0:0:1", "printer"]
    others = ["172.15.0.1", "172.32.0.1", "11.0.0.1", "192.169.0.1", "8.8.8.8", "a.test", "fdroid.org", "fcbarcelona.es"]
    df = spark.createDataFrame([(h,) for h in local + others], "h string")
    got = {r.h: r.x for r in df.select("h", urls.is_local(F.col("h")).alias("x")).collect()}
    assert [h for h in local if not got[h]] == [] and [h for h in others if got[h]] == []


def test_keys_sort_like_their_parts(spark):
    random.seed(3)
    rows = [(random.choice(["aa", "ab", "b_"]), random.choice([-(2**63), -5, -1, 0, 1, 7, 2**40, 2**63 - 1])) for _ in range(60)]
    df = spark.createDataFrame(rows, "t string, n long")
    key = codecs.key(codecs.text_part(F.col("t")), codecs.descending(codecs.number_part(F.col("n"))))
    got = [(r.t, r.n, r.back) for r in df.select("t", "n", key.alias("k")).select("t", "n", "k", codecs.number_of(codecs.descending(codecs.part(F.col("k"), 2, 8))).alias("back")).orderBy("k").collect()]
    assert [(t, n) for t, n, _ in got] == sorted(rows, key=lambda r: (r[0], -r[1])) and all(n == b for _, n, b in got)


def test_broken_values_read_as_nulls(spark):
    df = spark.createDataFrame([(None,), (bytearray(b""),), (bytearray(b"\x00\xff"),), (bytearray(b"\x05\x01"),)], "v binary")
    assert all(r[0] is None for x in df.select(codecs.read_posting("v").alias("p")).collect() for r in [x.p])
    assert [r.p for r in df.select(codecs.payload_of(F.col("v")).alias("p")).collect()][3] is None
    n = [0, 1, 127, 128, 300, 2**21, 2**31 - 1]
    got = spark.createDataFrame([(x,) for x in n], "n long").select(codecs.varint(F.col("n")).alias("v")).collect()
    assert [codecs._numbers(bytes(r.v), 0, 1)[0][0] for r in got] == n


def test_transfers_with_faults(spark):
    good, bad = {"iam": "A" * 12, "youare": "B" * 12, "wordc": "1", "entryc": "2", "key": "c81e728d9d4c2f636f067f89cc14862c", "indexes": "x"}, {"iam": "short", "youare": "B" * 12, "entryc": "2"}
    rows = [(1, good), (2, bad), (3, good | {"entryc": "two"}), (4, good | {"key": "?"}), (5, None)]
    got = {r.id: r.key_fits for r in transfer.read_posting_requests(spark.createDataFrame(rows, "id int, form map<string,string>"), "id").collect()}
    assert got == {1: True, 4: False}
    urls_ = [(1, {"iam": "A" * 12, "youare": "B" * 12, "urlc": "3", "url0": "{a}", "url2": "{c}", "url3": "{beyond}"}), (2, {"iam": "A" * 12, "youare": "B" * 12, "urlc": "0"})]
    assert sorted((r.id, r.row) for r in transfer.read_metadata_requests(spark.createDataFrame(urls_, "id int, form map<string,string>"), "id").collect()) == [(1, "{a}"), (1, "{c}")]
    report = spark.createDataFrame([("  a\n b ",), (None,), ("\n",), ("é" * 600,)], "b string").select(transfer.failure_report(F.col("b")).alias("r")).collect()
    assert [r.r for r in report[:3]] == ["a b", "no reported body", "no reported body"] and len(report[3].r) == 256


def test_small_columns(spark):
    networks = ["10.0.0.0/8", "192.168.1.5"]
    df = spark.createDataFrame([("10.1.1.1", "1.2.3.4, 5.6.7.8"), ("11.1.1.1", "1.2.3.4"), ("10.1.1.1", None), ("192.168.1.5", " 9.9.9.9"), ("::1", "1.2.3.4")], "p string, f string")
    assert [r[0] for r in df.select(wire.client_address(F.col("p"), F.col("f"), networks)).collect()] == ["1.2.3.4", "11.1.1.1", "10.1.1.1", "9.9.9.9", "::1"]
    masks = spark.createDataFrame([(0,), (1,), ((1 << 12) - 1,), (6,)], "m int").select("m", wire.bitfield(F.col("m")).alias("t"))
    got = {r.m: r.c for r in masks.select("m", wire.constraint_mask(F.col("t")).alias("c")).collect()}
    assert got == {0: None, 1: 1, (1 << 12) - 1: (1 << 12) - 1, 6: 6}
    assert tuple(spark.range(1).select(wire.constraint_mask(F.lit("")), wire.constraint_mask(hashing.encode64(F.unhex(F.lit("FFFFFFFF"))))).first()) == (None, None)
    h = spark.range(50).select(hashing.random_hash(3).alias("h")).where(hashing.is_hash(F.col("h"))).distinct().count()
    assert h == 50
    m = spark.createDataFrame([("Text/HTML; x",), (None,)], "t string")
    assert [tuple(r) for r in m.select(crawl.media_type_allowed(F.col("t"), []), crawl.media_type_allowed(F.col("t"), ["text/html"])).collect()] == [(True, True), (True, False)]
    assert crawl.always_due(m).where("due").count() == 2


def test_receipts_of_a_full_escrow(spark):
    rows = [(b, f"w{b}{i}", "u-known" if i % 2 else f"u{b}") for b in range(4) for i in range(6)] + [(9, f"w9{i}", "u-known") for i in range(20)]
    batches = spark.createDataFrame(rows, "batch int, word_hash string, url_hash string")
    known, waiting = spark.createDataFrame([("u-known",)], "url_hash string"), spark.createDataFrame([("w00", "u0")], "word_hash string, url_hash string")
    got = {r.batch: (r.n_stored, r.n_held, r.refusal) for r in ingest.receipts(batches, known, waiting, "batch", batch_cap=10, capacity=7).collect()}
    assert got == {0: (3, 3, None), 1: (3, 3, None), 2: (0, 0, "escrow-full"), 3: (0, 0, "escrow-full"), 9: (0, 0, "request-too-large")}
    assert {r.refusal: r.postings for r in ingest.refused_by_reason(ingest.receipts(batches, known, waiting, "batch", at_capacity=True, batch_cap=10)).collect()} == {"storage-full": 24, "request-too-large": 20}
    assert ingest.receipts(batches.limit(0), known, waiting, "batch").count() == 0


def test_eviction_over_parts_equals_a_plain_sum(spark):
    random.seed(6)
    rows = [(f"h{i:03}", random.choice([None, "2025-01-01", "2025-01-02"]), random.randint(1, 9)) for i in range(200)]
    m = spark.createDataFrame([(h, d) for h, d, _ in rows], "url_hash string, d string").select("url_hash", F.to_date("d").alias("load_day"), F.lit(None).cast("date").alias("mod_day"), F.lit(None).cast("date").alias("fresh_day"))
    sizes = spark.createDataFrame([(h, n) for h, _, n in rows], "url_hash string, bytes long")
    left, want = sum(n for _, _, n in rows), set()
    for h, _, n in sorted(rows, key=lambda r: (r[1] or "", r[0])):
        if left < 450:
            break
        want.add(h)
        left -= n
    assert {r.url_hash for r in ingest.evicted(m, sizes, 500).collect()} == want and want
    assert ingest.evicted(m.limit(0), sizes, 500).count() == 0


KEY = "word_hash string, url_hash string"


def test_distribution_cycle(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    k = lambda i: (f"word{i:08}", f"docu{i:08}")
    df = spark.createDataFrame
    s.commit({
        "postings": df([(*k(i), i) for i in range(6) if i != 2], f"{KEY}, hits int"), "ledger": df([(*k(0), ["peerA".ljust(12, "A"), "gone".ljust(12, "A")])], f"{KEY}, holders array<string>"),
        "schedule": df([(*k(i), 100 + i, 300) for i in range(6)], f"{KEY}, due_at long, interval int"), "metadata": df([(k(i)[1], "t") for i in range(6)], "url_hash string, descr string"),
    })
    peers = df([(x.ljust(12, "A"),) for x in ("peerA", "peerB", "peerC")], "peer_hash string")
    up = peers.withColumn("reachable", F.lit(True))
    none = F.array().cast("array<string>")
    offered = lambda due: due.select("word_hash", "url_hash", F.array(F.lit("peerB".ljust(12, "A"))).alias("peers"), F.lit(1).alias("acceptances_needed"), F.when(F.col("word_hash") == k(0)[0], F.array(F.lit("gone".ljust(12, "A")))).otherwise(none).alias("stale_holders"))
    ask = lambda batch: batch.select("word_hash", "url_hash", F.explode("peers").alias("peer_hash"), F.when(F.col("word_hash") == k(1)[0], "refused").otherwise("accepted").alias("outcome"), F.lit(0).alias("pause"), F.lit(False).alias("unknown_url"), F.lit(False).alias("metadata_delivered"))
    done = distribution.cycle(s, peers, up, "A" * 12, F.lit(103).cast("long"), offered, ask, per_batch=3)
    assert done == [(2, 1), (1, 0)]  # due until 103; the second of the first batch is gone
    ledger = {r.word_hash: r.holders for r in s.read("ledger").collect()}
    assert ledger == {k(0)[0]: ["peerA".ljust(12, "A"), "peerB".ljust(12, "A")], k(3)[0]: ["peerB".ljust(12, "A")]}
    schedule = {r.word_hash: (r.due_at, r.interval) for r in s.read("schedule").collect()}
    assert set(schedule) == {k(i)[0] for i in (0, 1, 3, 4, 5)} and schedule[k(1)[0]] == (103 + 600, 600) and schedule[k(0)[0]][0] > 80_000 and schedule[k(5)[0]] == (105, 300)
    assert distribution.cycle(s, peers.limit(2), up, "A" * 12, F.lit(10**6).cast("long"), offered, ask) == []
    distribution.purged(s, df([(k(5)[1],)], "url_hash string"))
    assert s.lengths() == {"ledger": 2, "metadata": 5, "postings": 4, "schedule": 4}


def test_frontier_rounds(spark):
    now = lambda x: F.lit(f"2025-01-01 00:{x:02}:00").cast("timestamp")
    f = frontier.opened(spark.createDataFrame([("a",), ("b",), ("a",), ("c",)], "url string"))
    assert f.count() == 3 and len(frontier.ready(f, now(0), 2).collect()) == 2
    seen = spark.createDataFrame([("a", "fetched", None), ("b", "deferred", 120), ("c", "failed", None)], "url string, status string, defer_seconds int")
    f = frontier.advanced(f, seen, spark.createDataFrame([("a", 1), ("d", 1), ("d", 2)], "url string, depth int"), now(0))
    rows = {r.url: r for r in f.collect()}
    assert set(rows) == {"b", "c", "d"} and rows["b"].deferrals == 1 and rows["c"].attempts == 1 and rows["d"].depth == 1
    assert {r.url for r in frontier.ready(f, now(1)).collect()} == {"c", "d"} and {r.url for r in frontier.ready(f, now(2)).collect()} == {"b", "c", "d"}
    for _ in range(3):
        f = frontier.advanced(f, seen.where("url = 'b'"), None, now(9))
    assert {r.url for r in f.collect()} == {"c", "d"} and {r.disposal for r in frontier.left_over(f).collect()} == {"budget-truncated"}


def test_compacted_tables_follow_their_files(spark, tmp_path):
    rows = [(i, f"w{i % 7:011}", f"u{i % 5:011}", i) for i in range(50)]
    write = lambda r: spark.createDataFrame(r, "stream_seq long, word_hash string, url_hash string, hits int").write.mode("overwrite").parquet(f"{tmp_path}/postings.parquet")
    write(rows)
    want = {(w, u): h for _, w, u, h in rows}
    assert {(r.word_hash, r.url_hash): r.hits for r in compacted.postings(spark, str(tmp_path)).collect()} == want
    assert {r.word_hash: r.n for r in compacted.words(spark, str(tmp_path)).collect()} == {w: len({u for x, u in want if x == w}) for w, _ in want}
    at = compacted.postings(spark, str(tmp_path)).inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    shutil.rmtree("/" + at.lstrip("/"))
    assert compacted.postings(spark, str(tmp_path)).count() == len(want)
    write([(i, w, u, h + 1) for i, w, u, h in rows[:10]])
    assert compacted.postings(spark, str(tmp_path)).count() == 10


@pytest.mark.parametrize("width", [1, 3, 8])
def test_ranks_over_parts(spark, width):
    random.seed(width)
    rows = [(random.choice(["hot"] * 7 + ["a", "z", None]), random.choice([1, 2, 3, 9, None]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o int, i long").withColumn("rank", F.lit("clash"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    try:
        got = {r.i: r.n for r in skew.ranked(df, ["k"], ["o", "i"], "n").collect()}
        assert skew.ranked(df.limit(0), ["k"], ["o"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[i] for _, _, i in own] == list(range(len(own)))


def test_page_chunks_of_nothing(spark):
    p = spark.createDataFrame([], "url_hash string, word_hash string, hits int")
    assert index.page_chunks(p.select("url_hash"), p, "url_hash", ["word_hash"]).count() == 0


def test_extension_points(spark):
    class Text:
        media_types = ("text/plain",)

        def extract(self, pages):
            return pages.select("url", F.decode("body", "utf-8").alias("text"))

    r = extensions.Registry()
    r.add(extensions.MediaExtractor, "text", Text())
    assert r.names(extensions.MediaExtractor) == ["text"] and r.for_media_type(extensions.MediaExtractor, "Text/Plain") is r.get(extensions.MediaExtractor, "text") and r.for_media_type(extensions.MediaExtractor, "x") is None
    with pytest.raises(ValueError, match="already"):
        r.add(extensions.MediaExtractor, "text", Text())
    with pytest.raises(TypeError, match="no PageFetcher"):
        r.add(extensions.PageFetcher, "x", Text())
    m = extensions.Memory()
    assert isinstance(m, extensions.StorageEngine)
    df = spark.createDataFrame([(1,), (2,)], "k int")
    n = extensions.observed(m, {"t": [lambda name, rows: {f"{name}-count": rows.groupBy().count()}]}, {"t": df})
    m.commit({}, {"t": df}, on=n)
    assert m.tables() == ["t", "t-count"] and m.lengths() == {"t": 4, "t-count": 1}
    with pytest.raises(RuntimeError):
        m.commit({}, on=0)
