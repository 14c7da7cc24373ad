"""Bounded samples of rows: always the same ones, however the table is split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Rows that pass the first cut, as a multiple of those wanted.
_MARGIN = 2


def least(df: DataFrame, n: int) -> list[Row]:
    """At most ``n`` distinct rows of a table, the least by a hash of all their columns.

    Rows above the quantile of the hash that leaves about twice as many are dropped where they are read, so that what
    reaches the driver doesn't grow with the table or its splits. Where most rows are copies there may be fewer than ``n``.
    """
    total, rows = df.count(), df.withColumn("__h", F.xxhash64(*df.columns))
    if total > _MARGIN * n:
        rows = rows.where(F.col("__h") < -(2**63) + int(_MARGIN * n / total * 2**64))
    return rows.dropDuplicates(df.columns).orderBy("__h", *df.columns).limit(n).drop("__h").collect()
