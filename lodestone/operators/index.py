"""The inverted index: postings and document metadata made from pages, and the tables they are kept in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import hashing, tokens, urls
from lodestone.operators import skew

CHUNK = 1000
# Flags of a posting's appearance, from the lowest bit on.
APPEARANCE = (
    "index_of", "has_location", "has_image", "has_audio", "has_video", "has_app", "in_description", "in_title", "in_creator", "in_subject", "in_identifier", "emphasized",
)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as a keyed table holds after all puts.

    A window limited to one row a key: each task cuts its rows to that before the shuffle, so that a key with a third
    of all rows moves one row a task. For reads over and over, keep the result (``sources.compacted``).
    """
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order]))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def appearance_flags(mask: Column) -> Column:
    """The twelve flags of a mask as a struct."""
    return F.struct(*[F.getbit(mask, F.lit(i)).cast("boolean").alias(name) for i, name in enumerate(APPEARANCE)])


def appearance_mask(flags: Column) -> Column:
    """The mask of a struct of flags; a null flag is unset."""
    bits = [F.coalesce(flags[name], F.lit(False)).cast("int") * (1 << i) for i, name in enumerate(APPEARANCE)]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return total


def component_count(path: Column) -> Column:
    """Parts of a path between slashes."""
    inner = F.trim(path, F.lit("/"))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, "/")))


def two_letter(language: Column) -> Column:
    return F.when(F.octet_length(language) == 2, language)


def page_postings(pages: DataFrame) -> DataFrame:
    """Postings of ``canonical_url, title, text, language, crawled_at, local_links, external_links`` rows.

    A page with no word gives no postings. Hashes of addresses come from :func:`lodestone.functions.urls.url_hash`.
    """
    p = pages.select(
        urls.url_hash(F.col("canonical_url")).alias("url_hash"), F.col("text"), F.unix_date(F.col("crawled_at").cast("date")).alias("last_modified"),
        tokens.statistics(F.col("title"))["words"].alias("title_words"), two_letter(F.col("language")).alias("language"), F.col("local_links"), F.col("external_links"),
        F.octet_length("canonical_url").alias("url_length"), component_count(urls.path_of(F.col("canonical_url"))).alias("url_components"),
    )
    words = tokens.occurrences(p, [c for c in p.columns if c != "text"], "text")
    return words.select(hashing.word_hash(F.col("word")).alias("word_hash"), *[c for c in words.columns if c != "word"], F.lit(0).alias("appearance"))


def page_metadata(pages: DataFrame, byte_size: Column) -> DataFrame:
    """Metadata rows of pages; ``byte_size`` is the size of the body as it was rendered."""
    return pages.select(
        urls.url_hash(F.col("canonical_url")).alias("url_hash"), F.col("canonical_url").alias("url"), F.col("title").alias("descr"),
        F.col("crawled_at").cast("date").alias("load_day"), byte_size.alias("byte_size"), tokens.statistics(F.col("text"))["words"].alias("wc"),
        F.lit("t").alias("dt"), two_letter(F.col("language")).alias("lang"), F.col("local_links").alias("llocal"), F.col("external_links").alias("lother"),
    )


def chunks(postings: DataFrame, key: str, order: list[str], size: int = CHUNK) -> DataFrame:
    """``key, chunk, postings``: a document's postings in groups of at most ``size``, a document of any size over many tasks."""
    numbered = skew.ranked(postings, [key], order, "__n").withColumn("chunk", F.floor(F.col("__n") / size).cast("int")).drop("__n")
    return numbered.groupBy(key, "chunk").agg(F.collect_list(F.struct(*[c for c in postings.columns if c != key])).alias("postings"))


def reassembled(parts: DataFrame, key: str) -> DataFrame:
    """The postings of documents from their chunks; a chunk that came twice counts once."""
    once = parts.dropDuplicates([key, "chunk"])
    return once.select(key, F.explode("postings").alias("p")).select(key, "p.*")


def counts(postings: DataFrame, metadata: DataFrame) -> DataFrame:
    """Postings, distinct referenced documents and metadata rows, one row."""
    p = postings.agg(F.count(F.lit(1)).alias("postings"), F.count_distinct("url_hash").alias("referenced_urls"))
    m = metadata.agg(F.count_distinct("url_hash").alias("metadata_rows"))
    return p.select("*", m.scalar().alias("metadata_rows"))


def missing_urls(postings: DataFrame, metadata: DataFrame) -> DataFrame:
    """Distinct referenced documents without metadata."""
    return postings.select("url_hash").distinct().join(metadata.select("url_hash"), "url_hash", "left_anti")


def words_of_urls(postings: DataFrame, requested: DataFrame) -> DataFrame:
    """Words of the requested documents."""
    return postings.select("url_hash", "word_hash").join(requested.select("url_hash").distinct(), "url_hash", "left_semi").distinct()


def freshness(metadata: DataFrame) -> Column:
    """The first known of loaded, modified and fresh-until day."""
    return F.coalesce("load_day", "mod_day", "fresh_day")


def freshness_rank(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyyMMdd"), F.lit("00000000"))


def media_flags(metadata: DataFrame) -> DataFrame:
    """Whether documents hold images, audio, video, applications, a location, or list a directory; and these as wire bits."""
    mime = lambda p: F.coalesce(F.startswith("mime", F.lit(p)), F.lit(False))
    some = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    flags = {
        "is_directory_listing": F.coalesce(F.exists(F.split("tags", ","), lambda t: F.contains(t, F.lit("indexof"))), F.lit(False)),
        "has_location": F.col("lat").isNotNull() & F.col("lon").isNotNull() & ((F.col("lat") != 0) | (F.col("lon") != 0)),
        "has_image": some("limage") | mime("image/"), "has_audio": some("laudio") | mime("audio/"), "has_video": some("lvideo") | mime("video/"), "has_application": some("lapp") | mime("application/"),
    }
    out = metadata.withColumns(flags)
    bits = dict(zip(flags, (0, 19, 20, 21, 22, 23), strict=True))
    total = F.lit(0)
    for name, bit in bits.items():
        total = total + F.col(name).cast("int") * (1 << bit)
    return out.withColumn("flags", total)


def page_chunks(metadata: DataFrame, postings: DataFrame, key: str, order: list[str], size: int = CHUNK) -> DataFrame:
    """``key, chunk, kind, postings``: of each page first its one metadata chunk, numbered 0, then its postings from 1 on."""
    first = metadata.select(key).distinct().select(key, F.lit(0).alias("chunk"), F.lit("metadata").alias("kind"))
    rest = chunks(postings, key, order, size)
    return rest.select(key, (F.col("chunk") + 1).alias("chunk"), F.lit("postings").alias("kind"), "postings").unionByName(first, allowMissingColumns=True)


def reassembled_pages(parts: DataFrame, transfer: str, key: str) -> DataFrame:
    """``transfer, key, n_postings, fault``: pages from the chunks of each transfer.

    A chunk that came twice counts once. The fault is null for a whole page; else why the transfer is no page: without a
    metadata chunk, with more than one, or with a chunk of another page.
    """
    once = parts.dropDuplicates([transfer, key, "kind", "chunk"])
    meta = F.col("kind") == "metadata"
    page = F.min(F.when(meta, F.col(key)))
    each = once.groupBy(transfer).agg(page.alias(key), F.count_if(meta).alias("__m"), F.count_distinct(F.when(~meta, F.col(key))).alias("__k"), F.max(F.when(~meta, F.col(key))).alias("__p"), F.sum(F.when(~meta, F.size("postings")).otherwise(0)).alias("n_postings"))
    fault = F.when(F.col("__m") == 0, "no metadata chunk").when(F.col("__m") > 1, "more than one metadata chunk").when((F.col("__k") > 1) | (F.col("__k") == 1) & (F.col("__p") != F.col(key)), "a chunk of another page")
    return each.select(transfer, key, "n_postings", fault.alias("fault"))


def distinct_words(postings: DataFrame, batch: str) -> DataFrame:
    """Distinct words of each batch."""
    return postings.groupBy(batch).agg(F.count_distinct("word_hash").alias("words"))


def self_seed(base: dict[str, Column], postings: DataFrame, metadata: DataFrame, now: Column, started: Column) -> DataFrame:
    """This node's own seed, one row: its settings with live counts and the time it has been up."""
    n = postings.agg(F.count(F.lit(1)).alias("indexed_words"))
    up = ((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(started.cast("timestamp"))) / 60).cast("int")
    rows = n.select("indexed_words", metadata.agg(F.count_distinct("url_hash").alias("n")).scalar().alias("stored_urls"))
    return rows.select(*[c.alias(k) for k, c in base.items()], up.alias("uptime_minutes"), now.alias("last_seen"), "indexed_words", "stored_urls")
