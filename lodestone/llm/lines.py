"""Lines repeated across the documents of one source, kept incrementally.

A line's key is the 64-bit hash of its source and its letters (case, digits, marks and spaces don't count). The state
holds, for each key below the threshold ``k``, the distinct documents that have the line, as hashes, in a table of pairs
that only grows; and the keys that have crossed, about which nothing more need be known. So a key has less than ``k``
pairs, whatever the line's count. A new partition of rows is a delta: its distinct ``(line, document)`` pairs, cut to
``k`` per line in every task before the shuffle (exact, as a union of sets each cut at ``k`` reaches ``k`` just when the
whole union does). Only state of the delta's lines is read on, from the buckets these lines are in; new pairs are
appended. Lines that reach ``k`` have crossed, and the pairs the state had of them name exactly the earlier documents
that hold a newly crossed line: these and the delta's own are rebuilt, no others.

The state is kept in a ``Store``: a folder that a later session opens again. A commit names the manifest it was computed
from, so that two deltas merged at once can't be lost in each other.

Null contents and rows with no source have no lines of interest; empty text has no letters; lines without a letter
are never counted. Equal rows count once, as documents are compared by their address.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import materialise, partitions
from lodestone.sources.stores import Store

#: Crossed lines are broadcast while there are at most so many (8 bytes each); beyond, the join shuffles.
BROADCAST_KEYS = 1_000_000
_FLUSH = 1_000_000
#: Parts of the state, by key; a delta reads those its lines are in.
BUCKETS = 256


def site_of(url: Column) -> Column:
    """Host in lower case, without user, port and a leading ``www.``; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#\s]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def letters_of(line: Column) -> Column:
    """The letters of a line, without case (sharp s as its capitals)."""
    return F.replace(F.lower(F.regexp_replace(line, r"[^\p{L}]+", "")), F.lit("ß"), F.lit("ss"))


def rows_of(df: DataFrame, row_id: Column, source: Column, document: Column, text: Column) -> DataFrame:
    """``row_id, source, doc, text`` of each row."""
    return df.select(row_id.alias("row_id"), source.alias("source"), F.xxhash64(document).alias("doc"), text.alias("text"))


def exploded(rows: DataFrame) -> DataFrame:
    """``row_id, line_no, key, doc`` of each line with a letter."""
    rows = rows.where("source is not null and doc is not null and text is not null")
    lines = rows.select("row_id", "source", "doc", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.select("row_id", (F.col("at") + 1).cast("long").alias("line_no"), "source", "doc", letters_of(F.col("line")).alias("letters"))
    return lines.where("letters <> ''").select("row_id", "line_no", F.xxhash64("source", "letters").alias("key"), "doc")


def _capped(key: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    start = np.ones(len(key), bool)
    start[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(start)
    rank = np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))
    return key[rank < k], doc[rank < k]


def _capped_pairs(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    keys, docs, held = [], [], 0

    def flush() -> pa.RecordBatch:
        a, b = _capped(np.concatenate(keys), np.concatenate(docs), k)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["key", "doc"])

    for b in batches:
        keys.append(b.column(0).to_numpy())
        docs.append(b.column(1).to_numpy())
        held += b.num_rows
        if held > _FLUSH:
            a = flush()
            keys, docs, held = [a.column(0).to_numpy()], [a.column(1).to_numpy()], a.num_rows
            if held > _FLUSH // 2:
                yield a
                keys, docs, held = [], [], 0
    if held:
        yield flush()


class LineCounts:
    """Line counts in a folder, after any number of deltas."""

    def __init__(self, spark: SparkSession, folder: str, k: int):
        self.store, self.k = Store(spark, folder), k

    def crossed(self) -> DataFrame:
        """Keys of all lines that reached ``k``."""
        return self.store.read("crossed").select("key") if "crossed" in self.store.tables() else self._none("key long")

    def _none(self, schema: str) -> DataFrame:
        return self.store.spark.createDataFrame([], schema)

    def _pairs(self, buckets: list[int]) -> DataFrame:
        """The state's pairs in some buckets; others aren't read."""
        if "pairs" not in self.store.tables():
            return self._none("key long, doc long")
        return self.store.read("pairs").where(F.col("bucket").isin(buckets)).select("key", "doc")

    def merge(self, lines: DataFrame) -> DataFrame:
        """Merges a delta of keyed lines; returns ``doc`` of each earlier document that holds a line that has crossed now."""
        k, number = self.k, self.store.version()
        bucket = F.pmod(F.col("key"), F.lit(BUCKETS)).cast("int").alias("bucket")
        pairs = lines.select("key", "doc").mapInArrow(lambda it: _capped_pairs(it, k), "key long, doc long")
        if number:
            pairs = pairs.join(_sized(self.crossed()), "key", "left_anti")
        new = materialise(pairs.groupBy("key").agg(F.slice(F.collect_set("doc"), 1, k).alias("docs")).select("key", "docs", bucket), "line-delta")
        if number:
            buckets = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
            old = self._pairs(buckets).join(new.select("key"), "key", "left_semi").groupBy("key").agg(F.collect_set("doc").alias("old"))
            both = new.join(old, "key", "left").withColumn("old", F.coalesce("old", F.array().cast("array<long>")))
        else:
            both = new.withColumn("old", F.array().cast("array<long>"))
        both = materialise(both.select("key", "bucket", "old", F.array_except("docs", "old").alias("added")), "line-merge")
        crosses = F.size("old") + F.size("added") >= k
        added = both.where(~crosses).select("bucket", "key", F.explode("added").alias("doc"))
        # rows of one bucket stand together, so that a read of some buckets skips the others
        self.store.commit({}, {"crossed": both.where(crosses).select("key", F.lit(number + 1).alias("delta")), "pairs": added.repartitionByRange(partitions(self.store.spark), "bucket", "key").sortWithinPartitions("bucket", "key")}, on=number)
        return both.where(crosses).select(F.explode("old").alias("doc")).distinct()

    def fresh(self) -> DataFrame:
        """Keys that crossed in the last delta."""
        return self.store.read("crossed").where(F.col("delta") == self.store.version()).select("key")


class RepeatedLines:
    """Flagged lines, and texts without them, of rows ``row_id, source, doc, text`` that arrive in deltas."""

    def __init__(self, spark: SparkSession, folder: str, k: int):
        self.counts, self.spark = LineCounts(spark, folder, k), spark
        self.flagged: DataFrame | None = None
        self.cleaned: DataFrame | None = None
        #: rows that the last delta caused to be rebuilt, its own among them
        self.rebuilt: DataFrame | None = None

    def advance(self, delta: DataFrame, earlier: DataFrame | None, clean: bool = True) -> RepeatedLines:
        """Merges a delta. ``earlier``: the rows of all deltas before; of these, only rows with a newly crossed line are looked at again."""
        touched = self.counts.merge(exploded(delta))
        rows = delta
        if earlier is not None:
            rows = delta.unionByName(earlier.join(_sized(touched), "doc", "left_semi").select(delta.columns))
        self.rebuilt = rows
        flagged = materialise(crossed_lines(exploded(rows), self.counts.crossed()), "flagged-lines")
        again = None if earlier is None else materialise(earlier.join(_sized(touched), "doc", "left_semi").select("row_id").distinct(), "rebuilt-rows")
        keep = lambda df: df if again is None else df.join(_sized(again), "row_id", "left_anti")
        self.flagged = flagged if self.flagged is None else keep(self.flagged).unionByName(flagged)
        if clean:
            texts = without_lines(rows.select("row_id", "text"), "row_id", "text", flagged, "cleaned").select("row_id", "cleaned")
            self.cleaned = texts if self.cleaned is None else keep(self.cleaned).unionByName(texts)
            self.cleaned = self.cleaned if again is not None else materialise(self.cleaned, "cleaned-texts")
        return self


def keyed_lines(df: DataFrame, row_id: Column, source: Column, document: Column, text: Column) -> DataFrame:
    """The same right from a table."""
    return exploded(rows_of(df, row_id, source, document, text))


def _sized(keys: DataFrame) -> DataFrame:
    """Keys marked for a broadcast if they are few; else left to a shuffled join."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def crossed_lines(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """``row_id, line_no`` of each occurrence of the given keys."""
    return lines.join(_sized(keys), "key", "left_semi").select("row_id", "line_no")


def without_lines(df: DataFrame, row_id: str, text: str, flagged: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``, the text without its flagged lines; rows without flagged lines keep their text."""
    drop = flagged.groupBy("row_id").agg(F.collect_set("line_no").alias("__drop"))
    joined = df.join(drop.withColumnRenamed("row_id", "__row"), F.col(row_id) == F.col("__row"), "left")
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("__drop", (i + 1).cast("long")))
    return joined.withColumn(out, F.when(F.col("__drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("__drop", "__row")
