"""Queries of point reads, messages, visits, counters and streams over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import hashing, messages, visits, wire
from lodestone.operators import visits as visiting
from lodestone.plans.core import CUR, META, TOP, current, metadata, terms
from lodestone.session import materialise
from lodestone.sources.tables import table
from lodestone.streaming import stateful

QUERIES, SQL = {}, {}
SECRET = "a shared secret"
ADJECTIVES, NOUNS = ["amber", "brisk", "calm", "deep", "early", "fair", "green", "high"], ["anchor", "brook", "cedar", "delta", "ember", "field", "grove"]


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- reads by key --------------------------------------------------------------------------------------------------


@query(f"with {CUR}, {TOP} select c.word_hash, c.url_hash, c.hits from cur c where c.word_hash = (select word_hash from top where k = 1) and c.url_hash = (select min(url_hash) from cur where word_hash = (select word_hash from top where k = 1))")
def posting_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One posting by word and document."""
    word = terms(spark, folder, 1)[0]
    rows = current(spark, folder).where(F.col("word_hash") == word)
    first = rows.agg(F.min("url_hash").alias("u")).first().u
    return rows.where(F.col("url_hash") == first).select("word_hash", "url_hash", "hits")


@query("select stream_seq, word_hash from postings where word_hash >= 'M' and word_hash < 'c' and received_at >= timestamp '2025-03-01'")
def key_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges of the first key part; both reach the scan."""
    p = table(spark, folder, "postings")
    return p.where((F.col("word_hash") >= "M") & (F.col("word_hash") < "c") & (F.col("received_at") >= F.lit("2025-03-01").cast("timestamp_ntz"))).select("stream_seq", "word_hash")


@query(f"with {META}, ask as (select url_hash, row_number() over (order by last_seen desc, url_hash) rank from (select url_hash, max(received_at) last_seen from postings group by 1)) select rank, url_hash, url from ask join meta using (url_hash) where rank <= 200")
def metadata_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of requested documents in the order asked; missing ones leave gaps."""
    p = table(spark, folder, "postings").groupBy("url_hash").agg(F.max("received_at").alias("s")).orderBy(F.desc("s"), "url_hash").limit(200)
    # at most the 200 of the request
    order = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("s").cast("timestamp"))).alias("o"), "url_hash")))
    asked = p.agg(order.alias("a")).select(F.posexplode("a").alias("at", "x"))
    asked = asked.select((F.col("at") + 1).cast("long").alias("rank"), F.col("x.url_hash").alias("url_hash"))
    return metadata(spark, folder).join(F.broadcast(asked), "url_hash").select("rank", "url_hash", "url")


# --- messages ------------------------------------------------------------------------------------------------------


@query("select peer_hash, " + f"list_element({ADJECTIVES!r}, cast(('0x' || substr(md5(peer_hash), 1, 2)) as int) % {len(ADJECTIVES)} + 1) || '-' || list_element({NOUNS!r}, cast(('0x' || substr(md5(peer_hash), 3, 2)) as int) % {len(NOUNS)} + 1) || '-' || lpad(cast(cast(('0x' || substr(md5(peer_hash), 5, 4)) as int) % 10000 as varchar), 4, '0') as name from seeds")
def derived_peer_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "seeds").select("peer_hash", messages.peer_name(F.col("peer_hash"), ADJECTIVES, NOUNS).alias("name"))


@query("select peer_hash, coalesce(regexp_full_match(peer_name, '[A-Za-z0-9_-]{3,80}'), false) good_name, coalesce(port between 1 and 65535, false) good_port, coalesce(len(string_split(tags, '|')) <= 2, false) few_tags, regexp_full_match(peer_hash, '[A-Za-z0-9_-]{12}') good_hash from seeds")
def seed_checks(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "seeds")
    return s.select("peer_hash", messages.is_peer_name(F.col("peer_name")).alias("good_name"), messages.is_port(F.col("port")).alias("good_port"), messages.are_tags(F.split("tags", r"\|"), 2).alias("few_tags"), hashing.is_hash(F.col("peer_hash")).alias("good_hash"))


@query(f"with {META} select url_hash, coalesce(lat between -90 and 90 and lon between -180 and 180, false) located from meta")
def coordinate_checks(spark: SparkSession, folder: str) -> DataFrame:
    return metadata(spark, folder).select("url_hash", messages.are_coordinates(F.col("lat"), F.col("lon")).alias("located"))


@query("select peer_hash originator, 'crwlstrt' category, date_trunc('second', first_seen) created, date_trunc('second', last_seen) received, cast(stored_urls % 7 as int) distributed, coalesce(peer_type, '') kind from seeds where first_seen is not null and peer_type is not null")
def news_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "seeds").where("first_seen is not null and peer_type is not null")
    text = messages.news_text(F.col("peer_hash"), F.lit("crwlstrt"), F.col("first_seen"), F.col("last_seen"), F.coalesce(F.col("stored_urls") % 7, F.lit(0)).cast("int"), F.create_map(F.lit("kind"), F.col("peer_type")))
    plain = s.select(text.alias("text"), F.col("stored_urls").isNull().alias("unknown")).select(wire.once(wire.unframed(F.col("text"))).alias("plain"), "unknown")
    n = plain.select(wire.once(messages.read_news(F.col("plain"), ["crwlstrt"])).alias("n"), "unknown")
    d = F.when(~F.col("unknown"), F.col("n.distributed"))
    return n.select("n.originator", "n.category", F.col("n.created").cast("timestamp_ntz").alias("created"), F.col("n.received").cast("timestamp_ntz").alias("received"), d.alias("distributed"), F.element_at("n.attributes", F.lit("kind")).alias("kind"))


@query(f"with {CUR} select url_hash, count(*) n_postings, cast(sum(hits) as bigint) hits from cur group by 1")
def chunk_json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    per = current(spark, folder).groupBy("url_hash").agg(F.collect_list(F.struct("word_hash", "url_hash", "hits", "text_position")).alias("p"))
    back = per.select(messages.read_chunk(messages.chunk_json(F.lit("posting"), F.col("url_hash"), F.col("p"))).alias("c"))
    return back.select(F.col("c.CanonicalURL").alias("url_hash"), F.explode("c.Postings").alias("p")).groupBy("url_hash").agg(F.count(F.lit(1)).alias("n_postings"), F.sum("p.hits").cast("long").alias("hits"))


# --- visits --------------------------------------------------------------------------------------------------------


_INNER, _OUTER = (bytes(b ^ pad for b in SECRET.encode().ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
_SEAL = f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(cast(expires as varchar) || chr(10) || url))))"


@query(f"with u as (select distinct url, cast(floor(epoch(crawled_at)) as bigint) expires from search_documents where url is not null) select url, case when regexp_matches(url, '^https?://') then 'https://search.example/visit?url=' || url_encode(url) || '&expires=' || expires || '&signature=' || {_SEAL} else url end link, expires is not null genuine, 1751328000 > expires as over from u")
def signed_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links through the recorder, whether they prove genuine, and whether they are over."""
    u = table(spark, folder, "search_documents").where("url is not null").select("url", F.unix_seconds(F.col("crawled_at").cast("timestamp")).alias("expires")).distinct()
    signed = u.withColumns({"link": visits.link(SECRET, "https://search.example", F.col("expires"), F.col("url")), "signature": visits.signature(SECRET, F.col("expires"), F.col("url"))})
    return signed.select("url", "link", visits.genuine(SECRET, F.col("expires"), F.col("url"), F.col("signature")).alias("genuine"), visits.expired(F.col("expires"), F.lit(1751328000)).alias("over"))


_VISITS = """v as (select stream_seq, stream_seq % 5 <> 0 due, list_element(['fetched', 'unmodified', 'deferred', 'failed', 'ceased', 'not-a-page', 'fetched'], cast(stream_seq % 7 as int) + 1) status, cast(stream_seq % 4 as int) deferrals, cast(stream_seq % 6 as int) attempts,
    length(coalesce(content, '')) body_bytes, stream_seq % 11 <> 0 media_supported, coalesce(content, '') <> '' extractable, stream_seq % 13 = 0 refuses_indexing, stream_seq % 2 = 0 ignores_refusal from search_documents),
    o as (select stream_seq, case when not due then 'completed' when status = 'deferred' and deferrals < 3 then 'deferred' when status = 'failed' and attempts < 4 then 'retryable' when status in ('deferred', 'failed') then 'abandoned' else 'completed' end conclusion,
    case when not due then 'not-due' when status = 'unmodified' then 'not-modified' when status = 'ceased' then 'refused' when status = 'not-a-page' then 'not-a-page' when status = 'deferred' and deferrals >= 3 then 'deferrals-exhausted'
    when status = 'failed' and attempts >= 4 then 'fetch-abandoned' when status in ('deferred', 'failed') then null when body_bytes > 4000 then 'oversized' when not media_supported then 'unsupported-media-type' when not extractable then 'unextractable' when refuses_indexing and not ignores_refusal then 'indexing-refused' end disposal from v)"""


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("stream_seq")
    statuses = F.array(*[F.lit(x) for x in ("fetched", "unmodified", "deferred", "failed", "ceased", "not-a-page", "fetched")])
    text = F.coalesce("content", F.lit(""))
    v = table(spark, folder, "search_documents").select(
        n, (n % 5 != 0).alias("due"), F.element_at(statuses, (n % 7 + 1).cast("int")).alias("status"), (n % 4).cast("int").alias("deferrals"), (n % 6).cast("int").alias("attempts"), F.length(text).alias("body_bytes"),
        (n % 11 != 0).alias("media_supported"), (text != "").alias("extractable"), (n % 13 == 0).alias("refuses_indexing"), (n % 2 == 0).alias("ignores_refusal"),
    )
    return visiting.outcomes(v, 4000).select("stream_seq", "conclusion", "disposal")


@query(f"with {_VISITS} select * from o")
def visit_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _outcomes(spark, folder)


@query(f"with {_VISITS} select conclusion, disposal, count(*) n from o group by 1, 2")
def visit_counters(spark: SparkSession, folder: str) -> DataFrame:
    return visiting.counters(_outcomes(spark, folder), ["conclusion", "disposal"])


@query(f"with {_VISITS}, log as (select s.url, max(s.stream_seq) last from o join search_documents s using (stream_seq) where disposal is not null group by 1), m as (select url, min(stream_seq) mark from search_documents group by 1) select url, coalesce(last > mark, false) disposed from m left join log using (url)")
def disposal_since(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "search_documents").select("stream_seq", "url")
    log = _outcomes(spark, folder).where("disposal is not null").join(s, "stream_seq").select("url", F.col("stream_seq").alias("revision"))
    return visiting.disposed_since(log, s.groupBy("url").agg(F.min("stream_seq").alias("mark")))


@query("select language, case when text_words <= 50 then 50.0 when text_words <= 200 then 200.0 when text_words <= 1000 then 1000.0 else cast('inf' as double) end \"bound\", count(*) n, cast(sum(text_words) as bigint) total from postings group by 1, 2")
def text_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return visiting.histogram(table(spark, folder, "postings"), F.col("text_words"), [50, 200, 1000], ["language"])


# --- streams -------------------------------------------------------------------------------------------------------


@query("""with p as (select url_hash, word_hash, received_at t from postings), pages as (select canonical_url url, min(received_at) t from pages_text group by 1),
    m as (select url_hash, min(t) came from (select distinct url, url_hash from url_metadata) join pages using (url) group by 1), w as (select max(t) wm from (select t from p union all select t from pages join url_metadata using (url))),
    e as (select p.*, came, came is not null and p.t >= came stored from p left join m using (url_hash)),
    h as (select word_hash, url_hash, came, max(t) held from e where not stored group by 1, 2, 3),
    o as (select word_hash, url_hash, 'stored' outcome from e where stored
        union all select word_hash, url_hash, case when came is not null and came - held <= interval 10 day then 'released' else 'expired' end from h, w where came is not null or held + interval 10 day <= wm)
    select outcome, count(*) n, count(distinct word_hash || url_hash) postings from o group by 1""")
def stream_escrow(spark: SparkSession, folder: str) -> DataFrame:
    """Postings that wait for the first text of their page, as a stream with timers, run to its present end."""
    posting = table(spark, folder, "postings").select(F.lit("posting").alias("kind"), "url_hash", "word_hash", F.col("received_at").cast("timestamp").alias("at"))
    pages = table(spark, folder, "pages_text").groupBy(F.col("canonical_url").alias("url")).agg(F.min("received_at").cast("timestamp").alias("at"))
    came = table(spark, folder, "url_metadata").select("url", "url_hash").distinct().join(pages, "url").select(F.lit("metadata").alias("kind"), "url_hash", F.lit(None).cast("string").alias("word_hash"), "at")
    events = materialise(posting.unionByName(came), "escrow-events")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = events.inputFiles()[0].rsplit("/", 1)[0]
    out = at.replace("escrow-events", "escrow-out")
    stream = stateful.escrow_stream(spark.readStream.schema(events.schema).parquet(at), 10 * 86_400)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stateful.ESCROW_OUT).parquet(out).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("word_hash", "url_hash").alias("postings"))


@query(f"with {META} select url_hash, descr from meta")
def stream_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata rows merged batch by batch into a keyed table: a batch that comes again changes nothing."""
    from lodestone.sources.stores import Store

    rows = materialise(table(spark, folder, "url_metadata").select("stream_seq", "url_hash", "descr").repartition(4), "upsert-in")
    at = rows.inputFiles()[0].rsplit("/", 1)[0]
    store = Store(spark, at.replace("upsert-in", "upsert-store"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(at)
    stateful.upsert_sink(stream, lambda df, _: store.upsert("meta", df, ["url_hash"], ["stream_seq"]), at.replace("upsert-in", "upsert-state")).awaitTermination()
    return store.read("meta").select("url_hash", "descr")

