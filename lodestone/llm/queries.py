"""Queries of this package over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import body, bodyfit, language, leak, lines, mojibake, packing, truncation
from lodestone.llm.sql import SQL  # noqa: F401
from lodestone.session import materialise, place
from lodestone.sources.tables import table

REPEATED = 5
CAPACITY = 2048
#: Partitions of search_documents arrive in this order: crawled before (or at no known time), and since.
DELTA = datetime(2025, 7, 1)


def _repeated(spark: SparkSession, folder: str, clean: bool) -> lines.RepeatedLines:
    """Two deltas: rows crawled before a day (or at no known time), and since."""
    docs = table(spark, folder, "search_documents")
    rows = lambda df: lines.rows_of(df, F.col("stream_seq"), lines.site_of(F.col("url")), F.col("url"), F.col("content"))
    early = F.coalesce(F.col("crawled_at") < F.lit(DELTA).cast("timestamp_ntz"), F.lit(True))
    first, second = rows(docs.where(early)), rows(docs.where(~early))
    return lines.RepeatedLines(spark, place(spark, "line-state"), REPEATED).advance(first, None, clean).advance(second, first, clean)


def _together(*made: Callable[[], object]) -> list:
    """What some functions make that don't need each other: their jobs share the cluster."""
    with ThreadPoolExecutor(len(made)) as pool:
        return [f.result() for f in [pool.submit(m) for m in made]]


def _language_setup(spark: SparkSession, folder: str) -> tuple:
    """The model; a maker of the spans of the lines of a page's body, for the tasks to call; and the counts to repair a field's garbled texts by."""
    others = [table(spark, folder, t).select(F.col(c).alias("field")) for t, c in (("documents", "text"), ("pages_text", "text"), ("url_metadata", "snippet"))]

    def model() -> language.Model:
        clean = language.samples_of(table(spark, folder, "lang_samples"))
        return language.Model(clean + language.confirmed(table(spark, folder, "documents"), F.col("lang"), F.col("text"), clean))

    fitted, weights, other, decoded = _together(
        model, lambda: _weights(spark, folder), lambda: _counts(spark, folder, others[0].unionByName(others[1]).unionByName(others[2])), lambda: _decoded_counts(spark, folder)
    )
    shared = spark.sparkContext.broadcast(weights)

    return fitted, lambda: body.Bodies(shared.value), lambda field: decoded if field in ("content", "descr") else other


def _record_languages(spark: SparkSession, folder: str) -> DataFrame:
    """``tab, rec_id, label, langs`` of each record with a text."""
    model, bodies, counts = _language_setup(spark, folder)
    tab, rec_id, label = (lambda t: F.lit(t).alias("tab")), (lambda c: F.col(c).cast("long").alias("rec_id")), (lambda c: F.col(c).alias("label"))
    docs = language.languages(table(spark, folder, "documents"), [tab("documents"), rec_id("doc_id"), label("lang")], F.col("text"), model, counts=counts("text"))
    pages = language.languages(table(spark, folder, "pages_text"), [tab("pages_text"), rec_id("stream_seq"), label("language")], F.col("text"), model, bodies, counts("text"))
    found = language.languages(table(spark, folder, "search_documents"), [tab("search_documents"), rec_id("stream_seq"), label("language")], F.col("content"), model, bodies, counts("content"))
    urls = table(spark, folder, "url_metadata")
    titles = language.languages(urls, [tab("url_metadata"), rec_id("stream_seq"), label("lang"), F.col("snippet")], F.col("descr"), model, counts=counts("descr"))
    both = language.languages(titles, [F.col("tab"), F.col("rec_id"), F.col("label"), F.col("langs").alias("of_title")], F.col("snippet"), model, counts=counts("snippet"), read=False)
    both = both.select("tab", "rec_id", "label", F.array_union("of_title", "langs").alias("langs"))
    return docs.unionByName(pages).unionByName(found).unionByName(both)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    records = _record_languages(spark, folder)
    named = F.coalesce(F.array_contains("langs", language.label_language(F.col("label"))), F.lit(False))
    return records.where((F.size("langs") > 0) & (~named | (F.size("langs") > 1))).select("tab", "rec_id", F.explode("langs").alias("lang_code"))


def p1_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Each text's spans with language and confidence: whole texts, bodies of pages, titles and snippets; garbled ones as repaired."""
    model, bodies, counts = _language_setup(spark, folder)
    parts = []
    for tab, key, text, look in (("documents", "doc_id", "text", None), ("pages_text", "stream_seq", "text", bodies), ("search_documents", "stream_seq", "content", bodies), ("url_metadata", "stream_seq", "descr", None), ("url_metadata", "stream_seq", "snippet", None)):
        keys = [F.lit(tab).alias("tab"), F.lit(text).alias("field"), F.col(key).cast("long").alias("rec_id")]
        parts.append(language.segments(table(spark, folder, tab), keys, F.col(text), model, look, counts(text)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _repeated(spark, folder, clean=False).flagged.withColumnRenamed("row_id", "stream_seq")


def p2_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Each content without its repeated lines: of the first delta as cleaned then, unless a line of it has crossed since."""
    cleaned = _repeated(spark, folder, clean=True).cleaned.withColumnRenamed("row_id", "stream_seq")
    return table(spark, folder, "search_documents").select("stream_seq", "url").join(cleaned, "stream_seq").select("stream_seq", "url", "cleaned")


def _decoded_fields(spark: SparkSession, folder: str) -> DataFrame:
    urls = table(spark, folder, "url_metadata").select(F.lit("url_metadata").alias("tab"), "stream_seq", F.col("descr").alias("field"))
    docs = table(spark, folder, "search_documents").select(F.lit("search_documents").alias("tab"), "stream_seq", F.col("content").alias("field"))
    return urls.unionByName(docs)


def _counts(spark: SparkSession, folder: str, fields: DataFrame) -> mojibake.Counts:
    """Of all rows of one column, and of the clean sentences."""
    return mojibake.frequencies(fields.unionByName(table(spark, folder, "lang_samples").select(F.col("text").alias("field"))))


def _decoded_counts(spark: SparkSession, folder: str) -> mojibake.Counts:
    """What every repair of these fields goes by, so that all queries see the same text."""
    return _counts(spark, folder, _decoded_fields(spark, folder).select("field"))


def p3_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Affected records with their restored text, the damaged tokens, and whether lost characters remain."""
    fields = _decoded_fields(spark, folder)
    found = mojibake.restored(fields, [F.col("tab"), F.col("stream_seq")], F.col("field"), _decoded_counts(spark, folder))
    return found.withColumn("complete", ~F.contains("restored", F.lit("\ufffd")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_restored(spark, folder).select("tab", "stream_seq")


def _pages(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame]]:
    return [
        ("pages_text", table(spark, folder, "pages_text").select("stream_seq", F.col("text").alias("content"))),
        ("search_documents", table(spark, folder, "search_documents").select("stream_seq", "content")),
    ]


def _weights(spark: SparkSession, folder: str) -> body.Weights:
    """Of body and furniture, from all pages of both tables."""
    pages = [
        table(spark, folder, t).select(F.col(url).alias("u"), F.col("title").alias("t"), F.col(text).alias("x"))
        for t, url, text in (("pages_text", "canonical_url", "text"), ("search_documents", "url", "content"))
    ]
    return bodyfit.fitted(pages, body.clean_lines(table(spark, folder, "lang_samples")))


def _page_lines(spark: SparkSession, folder: str) -> tuple[body.Weights, list[tuple[str, DataFrame]]]:
    """Weights of the lines; and the pages, garbled ones as repaired."""
    weights, counts = _together(lambda: _weights(spark, folder), lambda: _decoded_counts(spark, folder))
    return weights, [(tab, mojibake.repaired(df, "content", counts) if tab == "search_documents" else df) for tab, df in _pages(spark, folder)]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    weights, pages = _page_lines(spark, folder)
    parts = [body.furniture(df, F.col("stream_seq"), F.col("content"), weights).select(F.lit(tab).alias("tab"), F.col("row_id").alias("stream_seq"), "line_no") for tab, df in pages]
    return parts[0].unionByName(parts[1])


def p4_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The body of each page, garbled ones as repaired."""
    weights, pages = _page_lines(spark, folder)
    parts = [body.main_body(df, F.col("stream_seq"), F.col("content"), weights).select(F.lit(tab).alias("tab"), F.col("row_id").alias("stream_seq"), "body") for tab, df in pages]
    return parts[0].unionByName(parts[1])


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Written once: every text is taken apart into tokens once."""
    return materialise(packing.token_sizes(table(spark, folder, "documents")), "token-sizes")


def p6_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """What holds of every packing: no container beyond the capacity, each document in it once and whole, and nine tenths of the space in use."""
    sizes = _sizes(spark, folder)
    out = None
    for c in (512, 2048, 8192):
        placed = materialise(packing.pack(sizes, c), "packed")
        over = placed.groupBy("container").agg(F.sum("size").alias("n")).where(F.col("n") > c)
        per = placed.groupBy("doc_id").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("pieces"), F.max("piece").alias("last"))
        broken = per.join(sizes.groupBy("doc_id").agg(F.sum("size").alias("size")), "doc_id", "full").where(~F.coalesce((F.col("n") == F.col("size")) & (F.col("pieces") == F.col("last")), F.lit(False)))
        one = placed.agg(F.lit(c).alias("capacity"), F.count_distinct("doc_id").alias("documents"), (F.sum("size") >= 0.9 * c * (F.max("container") + 1)).alias("filled"))
        one = one.withColumns({"over": over.agg(F.count(F.lit(1)).alias("n")).scalar(), "broken": broken.agg(F.count(F.lit(1)).alias("n")).scalar()})
        out = one if out is None else out.unionByName(one)
    return out


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Which document, or piece of one, goes into which container of ``CAPACITY`` tokens."""
    return packing.pack(_sizes(spark, folder), CAPACITY).withColumn("capacity", F.lit(CAPACITY))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and the share of their space in use, for three capacities."""
    sizes = _sizes(spark, folder)
    used = [packing.pack(sizes, c).agg(F.lit(c).alias("capacity"), F.count(F.lit(1)).alias("pieces"), (F.max("container") + 1).alias("containers"), F.sum("size").alias("tokens")) for c in (512, 2048, 8192)]
    return used[0].unionByName(used[1]).unionByName(used[2]).withColumn("fill", F.round(F.col("tokens") / (F.col("capacity") * F.col("containers")), 6))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_contained(spark, folder).select("doc_id", "item_id")


def p7_contained(spark: SparkSession, folder: str) -> DataFrame:
    """Each leak with the share of the item's distinct five-word shingles that the document holds."""
    found = leak.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.select("doc_id", "item_id", F.round("contained", 9).alias("contained"))


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each evaluation item with the number of documents it leaked into."""
    items = table(spark, folder, "eval_items").select("item_id", "suite", "lang")
    n = p7_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return items.join(n, "item_id", "left").select("item_id", "suite", "lang", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(table(spark, folder, "documents"))[0].where("cut").select("doc_id")


def p8_sources(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source cuts, at a limit and in transfer, and the lengths at which it has a limit, in characters (``limits``) and in bytes."""
    rows, hazards = truncation.truncated(table(spark, folder, "documents"))
    kind = lambda x: F.count_if(F.coalesce(F.col("evidence") == x, F.lit(False)))
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("cut").alias("n_cut"), kind(truncation.LIMIT).alias("n_cut_at_limit"), kind(truncation.TRANSFER).alias("n_cut_in_transfer"))
    of = lambda unit: F.sort_array(F.collect_list(F.when(F.col("unit") == unit, F.col("length"))))
    limits = hazards.where("limit").groupBy(F.col("source").alias("s")).agg(of("chars").alias("limits"), of("bytes").alias("limits_bytes"))
    joined = per.join(limits, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return joined.withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_texts"), 6))


def p8_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """The hazard of each length of each source, and whether it is a limit."""
    hazards = truncation.length_hazards(truncation.endings(table(spark, folder, "documents")))
    return hazards.withColumn("p", F.round("p", 9))


QUERIES = {f.__name__: f for f in (p1_found, p1_segments, p2_found, p2_cleaned, p3_found, p3_restored, p4_found, p4_bodies, p6_packed, p6_fill, p6_bounds, p7_found, p7_contained, p7_items, p8_found, p8_sources, p8_lengths)}
