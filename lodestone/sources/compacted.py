"""Keyed tables as an index keeps them: the last row of each key, sorted by key, written once and read by every query.

Parts don't overlap in their keys and are sorted, so a predicate on the first key part reaches the scan and skips the
parts and row groups that can't hold it; a key with most rows is spread over parts by the rest of its key. A table is
written anew if the files it comes from change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.index import latest
from lodestone.session import partitions, place
from lodestone.sources.tables import table

_WRITTEN: dict[tuple, tuple[str, object]] = {}


def state_of(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files at a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listStatus(at) if fs.exists(at) else []
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def kept(spark: SparkSession, folder: str, name: str, what: str, make: Callable[[], DataFrame], sort: list[str]) -> DataFrame:
    """A table made of table ``name`` of a folder, written once in the order of ``sort`` for a state of its files.

    If what was written is gone, as the shared folder was cleared, it is written again.
    """
    key = (spark.sparkContext.applicationId, folder, what, state_of(spark, f"{folder}/{name}.parquet"))
    if key not in _WRITTEN or not state_of(spark, f"{_WRITTEN[key][0]}/_SUCCESS"):
        df, at = make(), place(spark, what)
        df.repartitionByRange(partitions(spark), *sort).sortWithinPartitions(*sort).write.parquet(at)
        _WRITTEN[key] = at, df.schema
    at, schema = _WRITTEN[key]
    return spark.read.schema(schema).parquet(at)


def postings(spark: SparkSession, folder: str) -> DataFrame:
    """The last delivery of each word and document, by word."""
    return kept(spark, folder, "postings", "compacted-postings", lambda: latest(table(spark, folder, "postings"), ["word_hash", "url_hash"], ["stream_seq"]), ["word_hash", "url_hash"])


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """The last metadata row of each document."""
    return kept(spark, folder, "url_metadata", "compacted-metadata", lambda: latest(table(spark, folder, "url_metadata"), ["url_hash"], ["stream_seq"]), ["url_hash"])


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The last version of each full-text document."""
    return kept(spark, folder, "search_documents", "compacted-documents", lambda: latest(table(spark, folder, "search_documents"), ["url"], ["crawled_at", "stream_seq"]), ["url"])


def words(spark: SparkSession, folder: str) -> DataFrame:
    """Each word with its number of documents."""
    return kept(spark, folder, "postings", "word-counts", lambda: postings(spark, folder).groupBy("word_hash").agg(F.count(F.lit(1)).alias("n")), ["word_hash"])
