"""What a crawl does with each page it meets, and the counts kept of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reasons for which a page is disposed of.
REASONS = (
    "not-due", "not-modified", "refused", "deferrals-exhausted", "not-a-page", "fetch-abandoned", "budget-truncated", "oversized",
    "unsupported-media-type", "nesting-too-deep", "document-budget-exhausted", "unextractable", "uncanonicalizable-url", "indexing-refused",
)
DEFERRALS, ATTEMPTS, MAX_BODY = 3, 4, 2 << 20


def outcomes(visits: DataFrame, max_body: int = MAX_BODY) -> DataFrame:
    """Each visit with ``conclusion`` (completed, deferred, retryable or abandoned) and ``disposal``, null where a page is kept.

    ``visits`` has ``due, status, deferrals, attempts, body_bytes, media_supported, extractable, refuses_indexing,
    ignores_refusal``. The first rule that holds decides.
    """
    c = F.col
    conclusion = (
        F.when(~c("due"), "completed").when((c("status") == "deferred") & (c("deferrals") < DEFERRALS), "deferred").when((c("status") == "failed") & (c("attempts") < ATTEMPTS), "retryable")
        .when(c("status").isin("deferred", "failed"), "abandoned").otherwise("completed")
    )
    refused = c("refuses_indexing") & ~c("ignores_refusal")
    disposal = (
        F.when(~c("due"), "not-due").when(c("status") == "unmodified", "not-modified").when(c("status") == "ceased", "refused").when(c("status") == "not-a-page", "not-a-page")
        .when((c("status") == "deferred") & (c("deferrals") >= DEFERRALS), "deferrals-exhausted").when((c("status") == "failed") & (c("attempts") >= ATTEMPTS), "fetch-abandoned").when(c("status").isin("deferred", "failed"), None)
        .when(c("body_bytes") > max_body, "oversized").when(~c("media_supported"), "unsupported-media-type").when(~c("extractable"), "unextractable").when(refused, "indexing-refused")
    )
    return visits.withColumns({"conclusion": conclusion, "disposal": disposal})


def disposed_since(log: DataFrame, marks: DataFrame) -> DataFrame:
    """Whether a page was disposed of after a mark: ``url, disposed`` for ``url, mark`` and a log of ``url, revision``."""
    last = log.groupBy("url").agg(F.max("revision").alias("__last"))
    return marks.join(last, "url", "left").select("url", F.coalesce(F.col("__last") > F.col("mark"), F.lit(False)).alias("disposed"))


def counters(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Rows by labels, as counters of operation are kept."""
    return rows.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def histogram(rows: DataFrame, value: Column, bounds: list[float], labels: list[str]) -> DataFrame:
    """Values by the least bound they don't exceed, infinity beyond; with their sum."""
    bucket = F.lit(float("inf"))
    for b in sorted(bounds, reverse=True):
        bucket = F.when(value <= b, F.lit(float(b))).otherwise(bucket)
    return rows.groupBy(*labels, bucket.alias("bound")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
