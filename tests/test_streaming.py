"""Streams give what the batch plans give."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import fulltext, ingest
from lodestone.sources.stores import LostUpdate, Store
from lodestone.streaming import consumers, stateful


def at(s):
    return datetime(2025, 1, 1) + timedelta(seconds=s)


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_escrow_stream_equals_batch(spark, tmp_path):
    events = [("posting", "u1", "w1", at(0)), ("posting", "u1", "w2", at(250)), ("metadata", "u1", None, at(400)), ("posting", "u1", "w3", at(500)), ("posting", "u2", "w1", at(10)), ("metadata", "u3", None, at(2000))]
    schema = "kind string, url_hash string, word_hash string, at timestamp"
    for i, e in enumerate(events):
        spark.createDataFrame([e], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    got = sorted((r.word_hash, r.url_hash, r.outcome) for r in run(spark, stateful.escrow_stream(stream), "escrow"))
    df = spark.createDataFrame(events, schema)
    batch = ingest.escrow(df.where("kind = 'posting'").selectExpr("word_hash", "url_hash", "at held_at"), df.where("kind = 'metadata'").selectExpr("url_hash", "at arrived_at"))
    want = sorted((r.word_hash, r.url_hash, r.outcome) for r in batch.collect())
    assert got == want


@pytest.mark.parametrize("remember", [None, 40])
def test_escrow_works_on_all_documents_of_a_page_at_once(remember):
    """As if row by row, in a few calls to the state however many documents a batch has."""

    class State:
        kept, calls, timers = None, 0, ()

        def getValueState(self, *_):  # noqa: N802
            return self

        def get(self):
            self.calls += 1
            return self.kept

        def update(self, value):
            self.calls, self.kept = self.calls + 1, value

        def registerTimer(self, at):  # noqa: N802
            self.calls, self.timers = self.calls + 1, (*self.timers, at)

    rng, state, hold, got, want = random.Random(5), State(), 30, [], []
    arrived, waiting = {}, {}
    escrow = stateful._Escrow(hold, remember)
    escrow.init(state)
    for batch in range(6):
        rows = [(rng.choice(["posting"] * 5 + ["metadata"]), f"u{rng.randrange(60)}", f"w{rng.randrange(3)}", (batch * 20 + rng.randrange(20)) * 1_000_000) for _ in range(200)]
        events = pd.DataFrame(rows, columns=["kind", "url_hash", "word_hash", "us"])
        events.loc[events.kind == "metadata", "word_hash"] = None
        before = state.calls
        for out in escrow.handleInputRows((0,), iter([events[:90], events[90:]]), None):
            got += [(batch, *r) for r in out.itertuples(index=False)]
        assert state.calls - before <= 3
        for kind, u, w, t in sorted(rows, key=lambda r: (r[3], r[0])):
            if kind == "metadata":
                arrived.setdefault(u, t)
                want += [(batch, k, u, h, "expired" if t - h > hold * 1e6 else "released") for k, h in waiting.pop(u, {}).items()]
            elif u in arrived and (not remember or t <= arrived[u] + remember * 1e6):
                want.append((batch, w, u, t, "stored"))
            else:
                waiting.setdefault(u, {})[w] = t
        now = (batch * 20 + 19) * 1000
        fired, state.timers = [t for t in state.timers if t <= now], tuple(t for t in state.timers if t > now)
        for _ in fired:
            for out in escrow.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now), None):
                got += [(batch, *r) for r in out.itertuples(index=False)]
        for u, words in waiting.items():
            want += [(batch, w, u, h, "expired") for w, h in words.items() if h / 1000 + hold * 1000 <= now]
            waiting[u] = {w: h for w, h in words.items() if h / 1000 + hold * 1000 > now}
        arrived = {u: t for u, t in arrived.items() if not remember or t / 1000 + remember * 1000 > now}
    assert sorted(got) == sorted(want) and {o for *_, o in got} == {"stored", "released", "expired"}


def test_escrow_forgets_arrivals(spark, tmp_path):
    """A posting after the memory ended waits again, unless the metadata table tells."""
    schema = "kind string, url_hash string, word_hash string, at timestamp"
    batches = [[("metadata", "u1", None, at(0)), ("posting", "u1", "w1", at(1))], [("posting", "u9", "w9", at(900))], [("posting", "u1", "w2", at(950))], [("posting", "u9", "w8", at(5000))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = sorted((r.word_hash, r.outcome) for r in run(spark, stateful.escrow_stream(stream, 300, remember_seconds=600), "forgets"))
    assert ("w1", "stored") in got and ("w2", "stored") not in got and ("w2", "expired") in got
    events = spark.createDataFrame([r for b in batches for r in b], schema)
    stored, rest = stateful.known_first(events, spark.createDataFrame([("u1",)], "url_hash string"))
    assert sorted(r.word_hash for r in stored.collect()) == ["w1", "w2"] and rest.count() == 3


def test_first_visits(spark, tmp_path):
    schema = "url string, at timestamp"
    spark.createDataFrame([("a", at(0)), ("a", at(5)), ("b", at(1))], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert sorted(r.url for r in run(spark, stateful.first_visits(stream, "url", "at", "1 hour"), "visits")) == ["a", "b"]


def test_dead_letters(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("no json",), (None,)], "value string")
    good, bad = stateful.split_bad(df, "a int")
    assert [r.a for r in good.collect()] == [1]
    assert bad.count() == 2


def test_page_consumers(spark, tmp_path):
    schema = "canonical_url string, title string, text string, markdown string, language string, crawled_at timestamp"
    store = Store(spark, f"file://{tmp_path}/store")
    for i, rows in enumerate([[("u1", "t", "old", "# old", "en", at(0)), ("u2", None, "two", None, "de", at(0))], [("u1", "t", "new", "# new", "en", at(9)), ("u3", "t", " ", "x", "en", at(1))], [("u1", "t", "late", "# late", "en", at(5))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        consumers.text_pages(stream, store, f"{tmp_path}/c1").awaitTermination()
        consumers.page_objects(stream, store, f"{tmp_path}/c2").awaitTermination()
    assert {r.url: r.content for r in store.read("documents").collect()} == {"u1": "new", "u2": "two"}
    assert {r.url: r.body for r in store.read("objects").collect()} == {"u1": "# new", "u3": "x"}
    assert store.used_bytes() > 0 and store.at_capacity(1) and not store.at_capacity(1 << 40)
    names = fulltext.index_names("x", ["en", "de"])
    assert consumers.index_tables(store, names, "url string") == ["x_v1_de", "x_v1_en", "x_v1_und"] and consumers.index_tables(store, names, "url string") == []


def test_retries_settlements_and_recalls(spark, tmp_path):
    tries, slept = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise LostUpdate
        return "done"

    assert consumers.with_retries(flaky, sleep=slept.append) == "done" and slept == [0.5, 0.75]
    with pytest.raises(OSError, match="gone"):
        consumers.with_retries(lambda: (_ for _ in ()).throw(OSError("gone")), attempts=2, sleep=slept.append)
    orders = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "b")], "order_id int, url string")
    visits = spark.createDataFrame([(1, "a", "completed"), (1, "b", "abandoned"), (3, "a", "completed"), (3, "b", "lost")], "order_id int, url string, conclusion string")
    assert {r.order_id: r.settlement for r in consumers.settled(orders, visits).collect()} == {1: "done", 2: "open", 3: "redeliver"}
    bodies, log, clock = spark.createDataFrame([("u", "body")], "url string, body string"), spark.createDataFrame([("v", 7)], "url string, revision int"), iter(range(100))
    look = lambda url, mark: consumers.recalled(url, "text", lambda: {"text": bodies}, lambda: log, mark, 3, now=lambda: next(clock), sleep=slept.append)
    assert look("u", 0) == ("found", "body") and look("v", 6) == ("disposed", None) and look("v", 7) == ("deadline", None)
    store = Store(spark, f"file://{tmp_path}/s")
    assert consumers.settled_identity(store, None, lambda: "A" * 12) == consumers.settled_identity(store, "A" * 12, str) == "A" * 12
    with pytest.raises(ValueError, match="belongs"):
        consumers.settled_identity(store, "B" * 12, str)
    assert fulltext.kinds(F.lit(None).cast("array<string>")) is not None
