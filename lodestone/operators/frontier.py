"""Pages a crawl still has to visit: those ready, and those put off until a time. A step is a plan over the whole table.

A frontier has ``url, depth, deferrals, attempts, not_before, place``; ``not_before`` is null for a page that is ready,
``place`` its place in the line. Pages put off go to the end of the line when they are due, earliest first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.crawl import retry_delay
from lodestone.operators.visits import ATTEMPTS, DEFERRALS

SCHEMA = "url string, depth int, deferrals int, attempts int, not_before timestamp, place long"


def opened(seeds: DataFrame, url: str = "url") -> DataFrame:
    """A frontier of seeds, in the order of their addresses."""
    place = F.xxhash64(url)  # any order, the same at each run
    return seeds.select(F.col(url).alias("url")).distinct().select("url", F.lit(0).alias("depth"), F.lit(0).alias("deferrals"), F.lit(0).alias("attempts"), F.lit(None).cast("timestamp").alias("not_before"), place.alias("place"))


def ready(frontier: DataFrame, now: Column, budget: int | None = None) -> DataFrame:
    """Pages to visit now, first in line first: at most ``budget``."""
    due = frontier.where(F.col("not_before").isNull() | (F.col("not_before") <= now))
    order = [F.asc_nulls_first("not_before"), F.asc("place"), F.asc("url")]
    return due.orderBy(*order).limit(budget) if budget is not None else due


def advanced(frontier: DataFrame, visited: DataFrame, admitted: DataFrame | None, now: Column, max_deferrals: int = DEFERRALS, max_attempts: int = ATTEMPTS) -> DataFrame:
    """The frontier after visits ``url, status, defer_seconds``; ``admitted`` (``url, depth``) are new pages.

    A deferred page waits as long as it was told, a failed one with growing delay, each so many times; then, like all
    others, it leaves. A page that is in the frontier, or was visited now, isn't admitted again.
    """
    rows = frontier.join(visited.select("url", "status", "defer_seconds"), "url", "left")
    deferred = (F.col("status") == "deferred") & (F.col("deferrals") < max_deferrals)
    again = (F.col("status") == "failed") & (F.col("attempts") < max_attempts)
    later = lambda seconds: F.timestamp_micros(F.unix_micros(now.cast("timestamp")) + (seconds * 1_000_000).cast("long"))
    kept = rows.where(F.col("status").isNull() | deferred | again).select(
        "url", "depth", (F.col("deferrals") + F.when(deferred, 1).otherwise(0)).alias("deferrals"), (F.col("attempts") + F.when(again, 1).otherwise(0)).alias("attempts"),
        F.when(deferred, later(F.coalesce("defer_seconds", F.lit(0)))).when(again, later(retry_delay(F.col("attempts") + 1))).otherwise(F.col("not_before")).alias("not_before"), "place",
    )
    if admitted is None:
        return kept
    new = admitted.groupBy("url").agg(F.min("depth").alias("depth")).join(frontier.select("url"), "url", "left_anti").join(visited.select("url").distinct(), "url", "left_anti")
    new = new.select("url", "depth", F.lit(0).alias("deferrals"), F.lit(0).alias("attempts"), F.lit(None).cast("timestamp").alias("not_before"), F.xxhash64("url").alias("place"))
    return kept.unionByName(new)


def left_over(frontier: DataFrame) -> DataFrame:
    """Pages never visited when a run ends for its budget, with the reason."""
    return frontier.select("url", F.lit("budget-truncated").alias("disposal"))
