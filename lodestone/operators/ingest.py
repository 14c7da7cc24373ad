"""What happens to rows that come in: admission, waiting for metadata, expiry, upserts, eviction, and the peer roster.

These are the state machines as batch plans; :mod:`lodestone.streaming` runs the ones with memory as streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import hashing
from lodestone.operators import skew
from lodestone.operators.index import freshness, latest

# Postings of a batch, waiting postings, seconds they wait, and share of the quota at which eviction begins.
BATCH, WAITING, HOLD_SECONDS, HIGH_WATER, EVICTED_AT_ONCE = 1000, 8192, 300, 0.9, 256


# Why a batch is refused.
TOO_LARGE, STORAGE_FULL, ESCROW_FULL = "request-too-large", "storage-full", "escrow-full"


def admission(batches: DataFrame, metadata: DataFrame, batch: str, batch_cap: int = BATCH) -> DataFrame:
    """Each posting with ``route``: ``refused`` in a batch beyond the cap, ``held`` until its metadata comes, or ``stored``."""
    size = batches.groupBy(batch).agg(F.count(F.lit(1)).alias("__n"))
    known = metadata.select("url_hash").distinct().withColumn("__known", F.lit(True))
    rows = batches.join(size, batch).join(known, "url_hash", "left")
    route = F.when(F.col("__n") > batch_cap, "refused").when(F.col("__known"), "stored").otherwise("held")
    return rows.withColumn("route", route).drop("__n", "__known")


def receipts(batches: DataFrame, metadata: DataFrame, waiting: DataFrame, batch: str, at_capacity: bool = False, batch_cap: int = BATCH, capacity: int = WAITING) -> DataFrame:
    """``batch, n, n_stored, n_held, refusal`` of batches that arrive in their order.

    ``waiting`` has the ``word_hash, url_hash`` held already. A batch is refused as a whole if it is too large, if the
    store is full, or if the postings that it would newly hold don't fit beside those waiting and those of batches
    before. A posting held already is held again and takes no more room.

    Batches are summed up to one row each before their order matters, and running sums are made over ranges of them. Room is counted as if each batch before that is
    not too large were held, so once the escrow is full it stays so for those that need room.
    """
    key = ["word_hash", "url_hash"]
    routed = admission(batches, metadata, batch, batch_cap)
    held = routed.where("route = 'held'").select(batch, *key).distinct()
    new = held.join(waiting.select(*key).distinct(), key, "left_anti").groupBy(*key).agg(F.min(batch).alias(batch)).groupBy(batch).agg(F.count(F.lit(1)).alias("__new"))
    per = routed.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("route") == "stored").alias("n_stored"), F.count_if(F.col("route") == "held").alias("n_held"))
    rows = per.join(new, batch, "left").withColumn("__new", F.coalesce("__new", F.lit(0)))
    room = capacity - waiting.select(*key).distinct().count()
    rows = skew.running(rows.withColumn("__asks", F.when(F.col("n") <= batch_cap, F.col("__new")).otherwise(0).cast("long")), [batch], "__asks", "__sum")
    fits = F.col("__sum") + F.col("__asks") <= room
    refusal = F.when(F.col("n") > batch_cap, TOO_LARGE).when(F.lit(at_capacity), STORAGE_FULL).when((F.col("__new") > 0) & ~fits, ESCROW_FULL)
    none = lambda c: F.when(F.col("refusal").isNull(), F.col(c)).otherwise(0).alias(c)
    return rows.withColumn("refusal", refusal).select(batch, "n", none("n_stored"), none("n_held"), "refusal")


def refused_by_reason(receipts_: DataFrame) -> DataFrame:
    """Postings of refused batches by reason."""
    return receipts_.where("refusal is not null").groupBy("refusal").agg(F.sum("n").alias("postings"))


def intake(table: DataFrame, rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """Metadata after new rows, the rows rejected one by one, and how many were there before.

    A row is rejected alone: if its hash is none, or its address is empty; the others are stored.
    """
    good = F.coalesce(hashing.is_hash(F.col("url_hash")) & (F.coalesce("url", F.lit("")) != ""), F.lit(False))
    stored = rows.where(good)
    known = duplicates(table, stored, "url_hash").first().duplicates
    return upsert(table, stored, ["url_hash"], order), rows.where(~good), known


def escrow(postings: DataFrame, arrivals: DataFrame, hold_seconds: int = HOLD_SECONDS) -> DataFrame:
    """Each posting ``word_hash, url_hash, held_at`` with the time its metadata came, and what became of it.

    Holding a posting again refreshes its time, so the last hold before the arrival counts. ``stored`` if the metadata
    was there, ``released`` if it came within the time, else ``expired``.
    """
    first = arrivals.groupBy("url_hash").agg(F.min("arrived_at").alias("arrived_at"))
    rows = postings.join(first, "url_hash", "left")
    before = F.col("arrived_at").isNotNull() & (F.col("arrived_at") <= F.col("held_at"))
    kind = F.when(before, "stored").otherwise("waiting")
    held = rows.withColumn("kind", kind).groupBy("word_hash", "url_hash", "kind", "arrived_at").agg(F.max("held_at").alias("held_at"))
    in_time = F.col("arrived_at").isNotNull() & (F.unix_micros(F.col("arrived_at")) - F.unix_micros(F.col("held_at")) <= F.lit(hold_seconds * 1_000_000))
    return held.withColumn("outcome", F.when(F.col("kind") == "stored", "stored").when(in_time, "released").otherwise("expired")).drop("kind")


def expired_holds(holds: DataFrame, cutoff: Column, limit: int = 256) -> DataFrame:
    """The oldest holds from before a time, at most ``limit``."""
    return holds.where(F.col("held_at") < cutoff).orderBy("held_at", "word_hash", "url_hash").limit(limit)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A keyed table after new rows: the last of each key wins."""
    return latest(table.unionByName(rows), keys, order)


def duplicates(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """How many of the new rows have a key that the table holds."""
    return rows.join(table.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("duplicates"))


def stalest(metadata: DataFrame, limit: int) -> DataFrame:
    """Documents of the oldest known day first; an unknown day is the oldest."""
    return metadata.select("url_hash", freshness(metadata).alias("fresh_on")).orderBy(F.asc_nulls_first("fresh_on"), "url_hash").limit(limit)


def evicted(metadata: DataFrame, sizes: DataFrame, quota_bytes: int, high_water: float = HIGH_WATER) -> DataFrame:
    """The stalest documents that have to go until less than the high-water mark is used.

    ``sizes`` has ``url_hash, bytes``. Running sums are made over ranges of day and hash, so that a day of any size, such
    as the unknown one, is spread over tasks.
    """
    rows = metadata.select("url_hash", F.coalesce(freshness(metadata), F.to_date(F.lit("0001-01-01"))).alias("day")).join(sizes, "url_hash")
    rows = skew.running(rows.select("url_hash", "day", "bytes"), ["day", "url_hash"], "bytes", "before")
    used = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).scalar()
    excess = used - F.lit(int(quota_bytes * high_water)) + 1
    return rows.where(F.col("before") < excess).select("url_hash", F.nullif("day", F.to_date(F.lit("0001-01-01"))).alias("fresh_on"), "bytes")


def roster(sightings: DataFrame, capacity: int) -> DataFrame:
    """Peers after sightings, the last of each: those contacted longest ago go beyond the capacity."""
    last = latest(sightings, ["peer_hash"], ["last_seen"])
    return last.orderBy(F.desc_nulls_last("last_seen"), "peer_hash").limit(capacity)


def unreachable(peers: DataFrame, limit: int) -> DataFrame:
    """Unreachable peers to try: last reachable first, then those contacted longest ago."""
    return peers.where(~F.coalesce("reachable", F.lit(False))).orderBy(F.desc_nulls_last("last_reachable"), F.asc_nulls_first("last_contacted"), "peer_hash").limit(limit)


def known_sample(peers: DataFrame, n: int, seed: int) -> DataFrame:
    """A random sample of peers: a sampling operator, with its seed."""
    return peers.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "peer_hash")), "peer_hash").limit(n)


def transfer_outcome(answers: DataFrame) -> DataFrame:
    """What came of an offer to a peer: ``address`` (null if it has none), HTTP ``status`` (null if it can't be reached) and ``result``."""
    said = F.lower(F.trim("result"))
    kind = F.when(said == "ok", "accepted").when(said.isin("busy", "not_granted"), "deferred").when(said == "too high load", "overloaded").otherwise("refused")
    reached = F.coalesce(F.col("status") == 200, F.lit(False))
    return answers.withColumn("outcome", F.when(F.col("address").isNull(), "unaddressable").when(~reached, "unreachable").otherwise(kind))


def delivered(rows: DataFrame, key: str, order: str, failed: str, batch: int = 50) -> DataFrame:
    """Rows with the number of their batch, and whether it was delivered: after a failed batch of a peer none is."""
    numbered = skew.ranked(rows, [key], [order], "__n").withColumn("batch", F.floor(F.col("__n") / batch).cast("int")).drop("__n")
    bad = numbered.where(F.col(failed)).groupBy(F.col(key).alias("__k")).agg(F.min("batch").alias("__bad"))
    return numbered.join(bad, F.col(key).eqNullSafe(F.col("__k")), "left").withColumn("delivered", F.coalesce(F.col("batch") < F.col("__bad"), F.lit(True))).drop("__k", "__bad")
