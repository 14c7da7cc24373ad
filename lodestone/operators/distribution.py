"""A cycle of handing postings to the peers that should hold them, batch by batch, each batch one commit.

The state is four tables of a ``Store``: ``postings``, ``schedule`` (``word_hash, url_hash, due_at, interval``),
``ledger`` (``word_hash, url_hash, holders``) and ``metadata``. What peers answer comes from outside, as a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import ring
from lodestone.session import materialise
from lodestone.sources.stores import Store

KEY = ["word_hash", "url_hash"]
# Postings of a batch, batches of a cycle at most, and peers below which a cycle is skipped.
PER_BATCH, BATCHES, MIN_PEERS = 256, 40, 3


def due_postings(schedule: DataFrame, postings: DataFrame, now: Column, limit: int = PER_BATCH) -> DataFrame:
    """The earliest due entries with ``gone``: whether the posting isn't in the index any more."""
    held = postings.select(*KEY).distinct().withColumn("__held", F.lit(True))
    return ring.due(schedule, now, limit).join(held, KEY, "left").withColumn("gone", F.col("__held").isNull()).drop("__held")


def enough_peers(peers: DataFrame, least: int = MIN_PEERS) -> bool:
    """Whether a cycle is worth its while; counts no further than needed."""
    return peers.limit(least).count() >= least


def committed(postings: DataFrame, ledger: DataFrame, schedule: DataFrame, batch: DataFrame, answers: DataFrame, reachability: DataFrame, self_hash: str, now: Column) -> dict[str, DataFrame]:
    """The tables after a batch: stale holders dropped, new ones recorded, postings handed off, offers rescheduled.

    ``batch`` has ``word_hash, url_hash, gone, acceptances_needed, stale_holders``; ``answers`` as ``ring.accepted``.
    Gone postings leave the schedule. A posting that enough closer peers hold leaves the index, the ledger and the schedule.
    """
    none = F.array().cast("array<string>")
    live = batch.where("not gone")
    took = ring.accepted(answers)
    kept = ring.without_holders(ledger, live)
    new = kept.join(took.select(*KEY, F.col("holders").alias("__new")), KEY, "full").select(*KEY, F.sort_array(F.array_union(F.coalesce("holders", none), F.coalesce("__new", none))).alias("holders")).where(F.size("holders") > 0)
    offered = live.select(*KEY).distinct()
    each = new.join(offered, KEY, "left_semi").select(*KEY, F.explode("holders").alias("peer_hash"))
    leaves = ring.handed_off(each, self_hash, reachability).select(*KEY)
    outcome = live.select(*KEY, "acceptances_needed").join(took, KEY, "left").select(*KEY, "acceptances_needed", F.coalesce("acceptances", F.lit(0)).alias("acceptances"), F.coalesce("longest_pause", F.lit(0)).alias("longest_pause"))
    again = ring.rescheduled(schedule, outcome, now).join(leaves, KEY, "left_anti")
    rest = schedule.join(batch.select(*KEY).distinct(), KEY, "left_anti")
    return {
        "postings": postings.join(leaves, KEY, "left_anti"), "ledger": new.join(leaves, KEY, "left_anti"),
        "schedule": rest.unionByName(again.select(*rest.columns)),
    }


def cycle(store: Store, peers: DataFrame, reachability: DataFrame, self_hash: str, now: Column, offered: Callable[[DataFrame], DataFrame], ask: Callable[[DataFrame], DataFrame], per_batch: int = PER_BATCH, batches: int = BATCHES) -> list[tuple[int, int]]:
    """Batches until one isn't full or ``batches`` are done; returns the ``(offered, gone)`` of each. Nothing below the least number of peers.

    ``offered`` adds ``peers, acceptances_needed, stale_holders`` to due postings, ``ask`` gets the peers' answers. Each
    batch is one commit on the manifest it was computed from, so a lost driver or a second one never leaves half a batch.
    """
    if not enough_peers(peers):
        return []
    done = []
    while len(done) < batches:
        number = store.version()
        postings, ledger, schedule = (store.read(t) for t in ("postings", "ledger", "schedule"))
        due = materialise(due_postings(schedule, postings, now, per_batch), "due")
        gone, n = due.where("gone").count(), due.count()
        if not n:
            break
        batch = materialise(offered(due.where("not gone")).withColumn("gone", F.lit(False)), "offers")
        answers = materialise(ask(batch), "answers")
        all_ = batch.select(*KEY, "gone", "acceptances_needed", "stale_holders").unionByName(due.where("gone").select(*KEY, "gone", F.lit(0).alias("acceptances_needed"), F.array().cast("array<string>").alias("stale_holders")))
        store.commit(committed(postings, ledger, schedule, all_, answers, reachability, self_hash, now), on=number)
        done.append((n - gone, gone))
        if n < per_batch:
            break
    return done


def purged(store: Store, urls: DataFrame) -> int:
    """Removes documents with all that hangs on them - metadata, postings, schedule, ledger - in one commit; returns its number."""
    number = store.version()
    gone = materialise(urls.select("url_hash").distinct(), "purged")
    tables = [t for t in ("metadata", "postings", "schedule", "ledger") if t in store.tables()]
    return store.commit({t: store.read(t).join(gone, "url_hash", "left_anti") for t in tables}, on=number)


def references(postings: DataFrame, stored: DataFrame, purged_: DataFrame, counts: DataFrame) -> DataFrame:
    """``url_hash, n``: postings that refer to each document, after some were stored and others purged; 0 is left out.

    ``counts`` are those before, so that a batch costs as much as its rows and the documents it names.
    """
    moved = stored.select("url_hash", F.lit(1).alias("d")).unionByName(purged_.select("url_hash", F.lit(-1).alias("d")))
    both = counts.select("url_hash", F.col("n").cast("long").alias("d")).unionByName(moved.select("url_hash", F.col("d").cast("long").alias("d")))
    return both.groupBy("url_hash").agg(F.sum("d").alias("n")).where("n > 0")


def nearness(terms: DataFrame, own_position: int, exponent: int = ring.EXPONENT) -> DataFrame:
    """``present, bound, n``: how near this node is to the words it was asked for, by whether it holds postings of them.

    ``terms`` has ``word_hash, held``. The distance is from the word's place on the ring to the node.
    """
    from lodestone.functions import hashing

    fraction = hashing.ring_fraction(hashing.ring_distance(hashing.ring_position(F.col("word_hash")), F.lit(own_position)))
    return terms.groupBy((F.col("held") > 0).alias("present"), ring.fraction_bucket(fraction).alias("bound")).agg(F.count(F.lit(1)).alias("n"))
