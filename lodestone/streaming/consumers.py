"""Consumers of page streams: full-text documents, page objects and crawl orders, kept in stores batch by batch.

A batch is merged by key, the last version wins, so a batch that comes again after a failure changes nothing; a batch
that can't be stored fails the query, stays pending at the stream's checkpoint, and comes again when it is started.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import fulltext
from lodestone.sources.stores import LostUpdate, Store

# Attempts of a commit or delivery, the first pause between them in seconds, and its growth.
ATTEMPTS, PAUSE, GROWTH = 4, 0.5, 1.5


def with_retries(action: Callable[[], object], transient: tuple[type[BaseException], ...] = (LostUpdate, OSError), attempts: int = ATTEMPTS, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> object:
    """What an action gives, tried again after transient failures, with growing pauses; the last failure is raised."""
    for n in range(attempts):
        try:
            return action()
        except transient:
            if n + 1 == attempts:
                raise
            sleep(pause * GROWTH**n)
    raise ValueError("no attempt")


def _merged(store: Store, name: str, make: Callable[[DataFrame], DataFrame], keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    return lambda batch, _: with_retries(lambda: store.upsert(name, make(batch), keys, order))


def text_pages(stream: DataFrame, store: Store, checkpoint: str):  # noqa: ANN201
    """Text pages as full-text documents, routed to an index of their language or the one for others; runs to the present end."""
    keep = _merged(store, "documents", lambda b: fulltext.search_document(b), ["url"], ["crawled_at"])
    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_objects(stream: DataFrame, store: Store, checkpoint: str, body: str = "markdown"):  # noqa: ANN201
    """Bodies of pages as objects named by their address, a later one over those before."""
    make = lambda b: fulltext.objects(b, body, ["crawled_at"]).join(b.groupBy(F.col("canonical_url").alias("url")).agg(F.max("crawled_at").alias("crawled_at")), "url")
    return stream.writeStream.foreachBatch(_merged(store, "objects", make, ["name"], ["crawled_at"])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_tables(store: Store, names: dict[str, str], schema: str) -> list[str]:
    """Creates the empty index of each language that isn't there yet, all in one commit; returns those created."""
    have = set(store.tables())
    new = sorted(t for t in names.values() if t not in have)
    if new:
        store.commit({t: store.spark.createDataFrame([], schema) for t in new})
    return new


def settled(orders: DataFrame, visits: DataFrame) -> DataFrame:
    """``order_id, settlement``: ``done`` when every page of an order has its outcome, ``redeliver`` if one was lost, else ``open``.

    ``orders`` has ``order_id, url``, ``visits`` ``order_id, url, conclusion``, null for a page whose worker was lost.
    """
    rows = orders.join(visits, ["order_id", "url"], "left").select("order_id", F.col("conclusion"), F.col("url").isNotNull().alias("asked"))
    final = F.coalesce(F.col("conclusion").isin("completed", "abandoned"), F.lit(False))
    lost = F.coalesce(F.col("conclusion") == "lost", F.lit(False))
    return rows.groupBy("order_id").agg(F.when(F.bool_or(lost), "redeliver").when(F.bool_and(final), "done").otherwise("open").alias("settlement"))


def recalled(url: str, kind: str, corpora: Callable[[], dict[str, DataFrame]], disposals: Callable[[], DataFrame], mark: int, deadline: float, pause: float = PAUSE, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str | None]:
    """``(state, body)`` of one page: looked up until it is found, too large, disposed of since ``mark``, or the time is over."""
    spark = SparkSession.getActiveSession()
    asked = spark.createDataFrame([(url,)], "url string")
    while True:
        row = fulltext.recall(asked, {kind: corpora()[kind]}).first()
        if row.state != "unavailable":
            return row.state, row.body
        if not disposals().where((F.col("url") == url) & (F.col("revision") > mark)).isEmpty():
            return "disposed", None
        if now() + pause >= deadline:
            return "deadline", None
        sleep(pause)


def settled_identity(store: Store, given: str | None, make: Callable[[], str]) -> str:
    """The node's hash: settled once, by the one given or one made; a later one that differs is refused."""
    if "identity" in store.tables():
        held = store.read("identity").first().peer_hash
        if given is not None and given != held:
            raise ValueError(f"this store belongs to {held}")
        return held
    own = given or make()
    store.commit({"identity": store.spark.createDataFrame([(own,)], "peer_hash string")})
    return own
