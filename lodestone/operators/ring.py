"""Replica placement on the hash ring: nearest peers, windows, offers, hand-off and their schedule.

A roster of peers is bounded (``MAX_PEERS``, checked): its sorted ring positions go to every task, and the peers
nearest to a posting are found by binary search, without pairing every posting with every peer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import hashing

MAX_PEERS = 65_536
# Copies kept, exponent of the ring's partitions, shortest and longest pause between offers (seconds).
REDUNDANCY, EXPONENT, SHORTEST, LONGEST = 3, 4, 300, 86_400


def accepting(peers: DataFrame) -> DataFrame:
    """Peers known to accept a remote index."""
    return peers.where(F.coalesce("accept_remote_index", F.lit(False)))


def eligible(peers: DataFrame, now: Column) -> DataFrame:
    """Peers that are not held back any more."""
    return peers.where(F.col("held_back_until").isNull() | (now >= F.col("held_back_until")))


def recently_reachable(now: Column, announce_seconds: int) -> Column:
    return F.coalesce(F.col("last_reachable") > now - F.make_dt_interval(secs=F.lit(2.0 * announce_seconds)), F.lit(False))


def _roster(peers: DataFrame) -> tuple[np.ndarray, list[str]]:
    """Distinct peers in the order of their positions, equals by hash. More than ``MAX_PEERS`` are refused."""
    rows = peers.select(F.col("peer_hash").alias("h"), hashing.ring_position(F.col("peer_hash")).alias("p")).where("p is not null").distinct().limit(MAX_PEERS + 1).collect()
    if len(rows) > MAX_PEERS:
        raise ValueError(f"a roster has at most {MAX_PEERS} peers")
    rows.sort(key=lambda r: (r.p, r.h))
    return np.array([r.p for r in rows], np.int64), [r.h for r in rows]


def nearest_peers(postings: DataFrame, peers: DataFrame, k: int = REDUNDANCY, exponent: int = EXPONENT) -> DataFrame:
    """``word_hash, url_hash, rank, peer_hash, distance`` of the ``k`` peers that come first forward from each posting."""
    places, names = _roster(peers)
    k = min(k, len(names))
    rows = postings.select("word_hash", "url_hash", hashing.posting_position(F.col("word_hash"), F.col("url_hash"), exponent).alias("position")).where("position is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = pa.array(names)
        for b in batches:
            at = b.column(2).to_numpy()
            first = np.searchsorted(places, at, side="left")
            index = (first[:, None] + np.arange(k)) % max(len(places), 1)
            found = places[index] if len(places) else np.zeros((len(at), 0), np.int64)
            distance = (found - at[:, None]) & np.int64(hashing.RING_MAX)
            n = np.repeat(np.arange(len(at)), k)
            rows = pa.array(n)
            columns = [b.column(0).take(rows), b.column(1).take(rows), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()), array.take(pa.array(index.ravel())), pa.array(distance.ravel(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["word_hash", "url_hash", "rank", "peer_hash", "distance"])

    return rows.mapInArrow(run, "word_hash string, url_hash string, rank int, peer_hash string, distance long")


def closer_than(postings: DataFrame, peers: DataFrame, self_hash: str, exponent: int = EXPONENT) -> DataFrame:
    """``word_hash, url_hash, closer_peers``: how many peers come before a given one, forward from each posting."""
    places, _ = _roster(peers)
    me = hashing.ring_position(F.lit(self_hash))
    rows = postings.select("word_hash", "url_hash", hashing.posting_position(F.col("word_hash"), F.col("url_hash"), exponent).alias("position"), me.alias("me")).where("position is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, me = b.column(2).to_numpy(), b.column(3).to_numpy()
            low, high = np.searchsorted(places, at, side="left"), np.searchsorted(places, me, side="left")
            n = np.where(me >= at, high - low, len(places) - low + high)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["word_hash", "url_hash", "closer_peers"])

    return rows.mapInArrow(run, "word_hash string, url_hash string, closer_peers long")


def with_nearest(rows: DataFrame, peers: DataFrame, want: Column, out: str = "near", self_hash: str | None = None, exponent: int = EXPONENT) -> DataFrame:
    """Rows with ``out``, the ``(peer_hash, distance)`` that come first forward from each posting, as many as it wants.

    With ``self_hash`` also ``closer_peers``, how many come before it. Nothing is shuffled; rows without a position are left out.
    """
    places, names = _roster(peers)
    here = hashing.posting_position(F.col("word_hash"), F.col("url_hash"), exponent)
    me = hashing.ring_position(F.lit(self_hash)) if self_hash is not None else F.lit(0).cast("long")
    given = rows.withColumns({"__at": here, "__me": me, "__want": F.least(F.coalesce(want, F.lit(0)).cast("int"), F.lit(len(names)))}).where("__at is not null")
    kept = given.drop("__at", "__me", "__want").schema
    near = "array<struct<peer_hash:string,distance:bigint>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` {near}", *(["closer_peers long"] if self_hash is not None else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = pa.array(names, pa.string())
        for b in batches:
            at, me, k = (b.column(i).to_numpy() for i in range(len(kept), len(kept) + 3))
            first = np.searchsorted(places, at, side="left")
            stops = np.concatenate([[0], np.cumsum(k)])
            row = np.repeat(np.arange(len(at)), k)
            index = (first[row] + np.arange(len(row)) - stops[row]) % max(len(places), 1)
            distance = (places[index] - at[row]) & np.int64(hashing.RING_MAX) if len(row) else np.zeros(0, np.int64)
            pairs = pa.StructArray.from_arrays([array.take(pa.array(index)), pa.array(distance, pa.int64())], ["peer_hash", "distance"])
            columns = [*b.columns[: len(kept)], pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pairs)]
            if self_hash is not None:
                high = np.searchsorted(places, me, side="left")
                columns.append(pa.array(np.where(me >= at, high - first, len(places) - first + high), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), out, *(["closer_peers"] if self_hash is not None else [])])

    return given.mapInArrow(run, schema)


def replica_windows(postings: DataFrame, peers: DataFrame, self_hash: str, redundancy: int = REDUNDANCY, exponent: int = EXPONENT) -> DataFrame:
    """``word_hash, url_hash, required, closest, farthest``: the peers that should hold a posting, and how far the last one is.

    A node that is itself among the closest keeps one copy, so one fewer is required of others.
    """
    both = with_nearest(postings.select("word_hash", "url_hash"), peers, F.lit(redundancy), "n", self_hash, exponent)
    required = F.when(F.col("closer_peers") < redundancy, redundancy - 1).otherwise(redundancy)
    closest = F.slice("n", 1, required)
    return both.select("word_hash", "url_hash", required.alias("required"), F.transform(closest, lambda x: x["peer_hash"]).alias("closest"), F.when(F.size(closest) > 0, F.element_at(closest, -1)["distance"]).alias("farthest"))


def holder_states(ledger: DataFrame, windows: DataFrame, reachability: DataFrame, exponent: int = EXPONENT) -> DataFrame:
    """``word_hash, url_hash, peer_hash, state`` of recorded holders: inside or outside of the window, or expired.

    ``reachability`` has ``peer_hash, reachable, recently_reachable``; an unknown peer is not reachable.
    """
    rows = ledger.join(windows, ["word_hash", "url_hash"]).join(reachability, "peer_hash", "left")
    here = hashing.posting_position(F.col("word_hash"), F.col("url_hash"), exponent)
    distance = hashing.ring_distance(here, hashing.ring_position(F.col("peer_hash")))
    inside = (F.size("closest") < F.greatest("required", F.lit(1))) | (distance <= F.col("farthest"))
    up = F.coalesce("reachable", F.lit(False))
    state = F.when(~up & F.coalesce("recently_reachable", F.lit(False)), "inside").when(~up, "expired").when(inside, "inside").otherwise("outside")
    return rows.select("word_hash", "url_hash", "peer_hash", state.alias("state"))


def offers(postings: DataFrame, peers: DataFrame, states: DataFrame, windows: DataFrame, eligible_peers: DataFrame, redundancy: int = REDUNDANCY, exponent: int = EXPONENT) -> DataFrame:
    """``word_hash, url_hash, peers, acceptances_needed, stale_holders`` of each posting.

    With enough holders inside its window a posting is offered to them again, and holders that are expired or outside
    are dropped; else the nearest eligible peers that hold no unexpired copy are asked for the missing ones.
    """
    key = ["word_hash", "url_hash"]
    none = F.array().cast("array<string>")
    accepting_too = states.join(peers.select("peer_hash").distinct().withColumn("__accepts", F.lit(True)), "peer_hash", "left")
    of = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("peer_hash"))))
    is_ = lambda *s: F.col("state").isin(*s)
    by = accepting_too.groupBy(*key).agg(of(is_("inside")).alias("inside"), of(is_("outside")).alias("outside"), of(is_("expired")).alias("expired"), of(is_("inside", "outside") & F.coalesce("__accepts", F.lit(False))).alias("holding"))
    rows = windows.join(by, key, "left").withColumns({c: F.coalesce(c, none) for c in ("inside", "outside", "expired", "holding")})
    # the peers asked are the first that hold no unexpired copy: at most as many come before them as the posting has such holders
    rows = with_nearest(rows, eligible_peers, F.lit(redundancy) + F.size("inside") + F.size("outside"), "near", None, exponent).withColumn("near", F.transform("near", lambda x: x["peer_hash"]))
    missing = F.col("required") - F.size("inside")
    asked = F.slice(F.array_except(F.coalesce("near", none), F.concat("inside", "outside")), 1, F.greatest(missing, F.lit(0)))
    fresh = missing <= 0
    return rows.select(
        *key, F.when(fresh, F.col("holding")).otherwise(asked).alias("peers"),
        F.when(fresh, 0).otherwise(missing).alias("acceptances_needed"), F.when(fresh, F.concat("expired", "outside")).otherwise(F.col("expired")).alias("stale_holders"),
    )


def handed_off(ledger: DataFrame, self_hash: str, reachability: DataFrame, redundancy: int = REDUNDANCY, exponent: int = EXPONENT) -> DataFrame:
    """Postings that enough reachable peers closer than this node hold, so that it may drop its copy."""
    rows = ledger.join(reachability.where("reachable").select("peer_hash").distinct(), "peer_hash", "left_semi")
    here = hashing.posting_position(F.col("word_hash"), F.col("url_hash"), exponent)
    distance = lambda h: hashing.ring_distance(here, hashing.ring_position(h))
    closer = rows.where(distance(F.col("peer_hash")) < distance(F.lit(self_hash)))
    return closer.groupBy("word_hash", "url_hash").agg(F.count_distinct("peer_hash").alias("closer_holders")).where(F.col("closer_holders") >= redundancy)


def sector_histogram(peers: DataFrame) -> DataFrame:
    """Peers in each of the 64 sectors, zeros included."""
    n = peers.groupBy(hashing.ring_sector(hashing.ring_position(F.col("peer_hash"))).alias("sector")).agg(F.count(F.lit(1)).alias("n"))
    return peers.sparkSession.range(64).select(F.col("id").cast("int").alias("sector")).join(n, "sector", "left").select("sector", F.coalesce("n", F.lit(0)).alias("peers"))


def fraction_bucket(fraction: Column, low: float = 1e-6, buckets: int = 13) -> Column:
    """Index of the exponential bucket, between ``low`` and 1, whose bound a fraction does not exceed; ``buckets`` beyond all."""
    bounds = [low * (1 / low) ** (i / (buckets - 1)) for i in range(buckets)]
    out = F.lit(buckets)
    for i in reversed(range(buckets)):
        out = F.when(fraction <= bounds[i], F.lit(i)).otherwise(out)
    return out


def widened(interval: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The doubled pause within its bounds, in seconds."""
    return F.least(F.greatest(interval * 2, F.lit(shortest)), F.lit(longest))


def pause(interval: Column, requested: Column) -> Column:
    return F.greatest(widened(interval), F.coalesce(requested, F.lit(0)))


def next_due(due: Column, now: Column, longest: int = LONGEST) -> Column:
    """The next due time (seconds), whole longest pauses after the last one, later than now."""
    missed = F.greatest(((now - due) / longest).cast("long"), F.lit(0).cast("long"))
    return due + (missed + 1) * longest


def due(schedule: DataFrame, now: Column, limit: int) -> DataFrame:
    """Due postings, earliest first."""
    return schedule.where(F.col("due_at") <= now).orderBy("due_at", "word_hash", "url_hash").limit(limit)


def longest_lateness(schedule: DataFrame, now: Column) -> DataFrame:
    """Seconds the earliest due posting is late, 0 if none is."""
    return schedule.agg(F.greatest(F.coalesce(now - F.min("due_at"), F.lit(0)), F.lit(0)).alias("lateness"))


def grouped_by_peer(offered: DataFrame) -> DataFrame:
    """Offers by peer: ``peer_hash, n_postings, n_words``."""
    each = offered.select("word_hash", "url_hash", F.explode("peers").alias("peer_hash"))
    return each.groupBy("peer_hash").agg(F.count(F.lit(1)).alias("n_postings"), F.count_distinct("word_hash").alias("n_words"))


def accepted(answers: DataFrame) -> DataFrame:
    """Per posting the acceptances, the longest pause asked for, and the peers that now hold it.

    ``answers`` has ``word_hash, url_hash, peer_hash, outcome, pause, unknown_url, metadata_delivered``; a copy whose
    document the peer did not know counts only if its metadata was delivered.
    """
    ok = (F.col("outcome") == "accepted") & (~F.coalesce("unknown_url", F.lit(False)) | F.coalesce("metadata_delivered", F.lit(False)))
    return answers.groupBy("word_hash", "url_hash").agg(F.count_if(ok).alias("acceptances"), F.max("pause").alias("longest_pause"), F.sort_array(F.collect_set(F.when(ok, F.col("peer_hash")))).alias("holders"))


def rescheduled(schedule: DataFrame, outcome: DataFrame, now: Column) -> DataFrame:
    """The schedule after a round: a met offer is due again on its grid, a missed one after a widened pause."""
    rows = schedule.join(outcome, ["word_hash", "url_hash"])
    met = F.col("acceptances") >= F.col("acceptances_needed")
    wait = pause(F.col("interval"), F.col("longest_pause"))
    return rows.select("word_hash", "url_hash", F.when(met, next_due(F.col("due_at"), now)).otherwise(now + wait).alias("due_at"), F.when(met, F.lit(LONGEST)).otherwise(wait).alias("interval"))


def without_holders(ledger: DataFrame, stale: DataFrame) -> DataFrame:
    """A ledger ``posting -> holders`` without stale holders; entries left without any go."""
    rows = ledger.join(stale.select("word_hash", "url_hash", "stale_holders"), ["word_hash", "url_hash"], "left")
    left = F.array_except("holders", F.coalesce("stale_holders", F.array().cast("array<string>")))
    return rows.select("word_hash", "url_hash", left.alias("holders")).where(F.size("holders") > 0)
