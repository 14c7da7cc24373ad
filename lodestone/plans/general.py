"""Queries of the general training-data operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import skew
from lodestone.sources.tables import table

HEAVY_SHARE = 0.01
TOP_POSTINGS = 3


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    heavy = skew.heavy_keys(table(spark, folder, "postings"), F.col("word_hash"), F.col("stream_seq"), HEAVY_SHARE)
    return heavy.where("key is not null").select(F.col("key").alias("word_hash"))


def p5_word_totals(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "postings")
    per = skew.per_key(p, F.col("word_hash"), F.col("url_hash"), F.col("hits"), F.col("stream_seq"), TOP_POSTINGS)
    return per.select(
        F.col("key").alias("word_hash"), "n_rows", F.col("n_distinct").alias("n_urls"), F.col("total").alias("sum_hits"),
        F.concat_ws(" ", F.transform("top", lambda t: F.concat_ws(":", t["measure"].cast("string"), F.coalesce(t["value"], F.lit("")), t["id"].cast("string")))).alias("top_postings"),
    )


QUERIES = {"p5_found": p5_found, "p5_word_totals": p5_word_totals}

SQL = {
    "p5_found": f"select word_hash from postings where word_hash is not null group by 1 having count(*) >= {HEAVY_SHARE} * (select count(*) from postings)",
    "p5_word_totals": f"""
        with r as (select *, row_number() over (partition by word_hash order by hits desc, url_hash nulls first, stream_seq) rn from postings where hits is not null),
        t as (select word_hash, string_agg(concat_ws(':', hits, coalesce(url_hash, ''), stream_seq), ' ' order by rn) top_postings from r where rn <= {TOP_POSTINGS} group by 1)
        select c.word_hash, n_rows, n_urls, sum_hits, coalesce(top_postings, '') top_postings
        from (select word_hash, count(*) n_rows, count(distinct url_hash) n_urls, cast(coalesce(sum(hits), 0) as bigint) sum_hits from postings group by 1) c
        left join t on c.word_hash is not distinct from t.word_hash""",
}
