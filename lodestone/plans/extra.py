"""Queries of codecs, transfers, admission, distribution, frontier, full text by language and small functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import codecs, hashing, messages, wire
from lodestone.operators import crawl, distribution, frontier, fulltext, index, ingest, ring, search, transfer
from lodestone.plans.core import _CORPUS, _CLOSER, _IDS, _PEERS, CUR, META, NOW, TOP, _corpus, _matches_sql, _pos, current, metadata, peers, terms
from lodestone.sources import compacted
from lodestone.sources.tables import table

QUERIES, SQL = {}, {}
_NOW = f"timestamp '{NOW:%Y-%m-%d %H:%M:%S}'"
SELF = "AAAAAAAAAAAA"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- stored forms --------------------------------------------------------------------------------------------------


@query("""select stream_seq, upper(hex(word_hash)) || upper(hex(url_hash)) || lpad(hex(9223372036854775807 - epoch_us(received_at)), 16, '0') triple_key, word_hash, url_hash, epoch_us(received_at) received_us from postings""")
def key_layouts(spark: SparkSession, folder: str) -> DataFrame:
    """Triple keys, the last part descending, and what they decode to."""
    us = F.unix_micros(F.col("received_at").cast("timestamp"))
    k = codecs.key(codecs.text_part(F.col("word_hash")), codecs.text_part(F.col("url_hash")), codecs.descending(codecs.number_part(us)))
    rows = table(spark, folder, "postings").select("stream_seq", k.alias("k"))
    at = codecs.number_of(codecs.descending(codecs.part(F.col("k"), 24, 8)))
    return rows.select("stream_seq", F.hex("k").alias("triple_key"), codecs.text_of(codecs.part(F.col("k"), 0, 12)).alias("word_hash"), codecs.text_of(codecs.part(F.col("k"), 12, 12)).alias("url_hash"), at.alias("received_us"))


@query("select stream_seq, nullif(language, '') as language, " + ", ".join(f"coalesce({c}, 0) {c}" for c in codecs.POSTING) + " from postings")
def posting_value_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "postings").select("stream_seq", codecs.posting_value().alias("v"))
    return stored.select("stream_seq", codecs.read_posting("v").alias("p")).select("stream_seq", "p.*")


@query("select stream_seq, " + ", ".join(codecs.DAYS) + ", " + ", ".join(f"coalesce({c}, 0) {c}" for c in codecs.NUMBERS) + " from url_metadata")
def metadata_value_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "url_metadata").select("stream_seq", codecs.metadata_value().alias("v"))
    return stored.select("stream_seq", codecs.read_metadata("v").alias("m")).select("stream_seq", "m.*")


@query("select peer_hash, 'seed of ' || peer_hash seed, epoch_us(first_seen) first_us, epoch_us(last_seen) last_us from seeds")
def roster_value_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    none = F.lit(None).cast("long")
    stored = table(spark, folder, "seeds").select("peer_hash", codecs.roster_value([us("first_seen"), none, us("last_seen"), none], F.concat(F.lit("seed of "), "peer_hash")).alias("v"))
    r = stored.select("peer_hash", codecs.read_roster(F.col("v")).alias("r"))
    return r.select("peer_hash", "r.seed", F.element_at("r.times", 1).alias("first_us"), F.element_at("r.times", 3).alias("last_us"))


# --- transfers -----------------------------------------------------------------------------------------------------


@query(f"with {CUR}, t as (select *, stream_seq // 500 transfer from cur) select transfer, count(*) n_postings, count(distinct word_hash) n_words, cast(sum(hits & 255) as bigint) hits, true key_fits from t group by 1")
def transfer_postings_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of at most 500 postings, written and read again."""
    rows = current(spark, folder).select(F.expr("stream_seq div 500").alias("transfer"), wire.posting_line().alias("line"))
    sent = transfer.posting_requests(rows, "transfer", F.lit(SELF), F.lit("BBBBBBBBBBBB"))
    got = transfer.read_posting_requests(sent, "transfer")
    lines = got.select("transfer", "key_fits", "entry_count", "word_count", F.explode(F.split("lines", "\n")).alias("line"))
    back = wire.read_postings(lines, "line", ("transfer", "key_fits", "entry_count", "word_count"))
    n = back.groupBy("transfer", "key_fits", "entry_count", "word_count").agg(F.count(F.lit(1)).alias("n"), F.sum("hits").cast("long").alias("hits"))
    return n.where("n = entry_count").select("transfer", F.col("n").alias("n_postings"), F.col("word_count").cast("long").alias("n_words"), "hits", "key_fits")


@query("select stream_seq // 50 transfer, count(*) n_rows, count(distinct url) n_urls from url_metadata where url <> '' group by 1")
def transfer_metadata_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of at most 50 metadata rows, written and read again."""
    m = index.media_flags(table(spark, folder, "url_metadata").where("url <> ''"))
    rows = m.select(F.expr("stream_seq div 50").alias("transfer"), "stream_seq", wire.metadata_row(F.col("flags")).alias("row"))
    got = transfer.read_metadata_requests(transfer.metadata_requests(rows, "transfer", "stream_seq", F.lit(SELF), F.lit("BBBBBBBBBBBB")), "transfer")
    back = wire.read_metadata(got, "row", ("transfer",))
    return back.groupBy("transfer").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("url").alias("n_urls"))


_RESULT = "list_element(['ok', 'busy', 'not_granted', 'too high load', 'wrong_target', 'what'], cast(coalesce(port, 0) % 6 as int) + 1)"


@query(f"select peer_hash, case when {_RESULT} <> 'what' then {_RESULT} end result, cast(coalesce(stored_urls, 0) % 5000 as int) pause_ms, case when coalesce(port, 0) % 2 = 0 then peer_hash || ' ' || reverse(peer_hash) else '' end unknown from seeds")
def transfer_responses(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "seeds")
    p = F.coalesce("port", F.lit(0))
    result = F.element_at(F.array(*[F.lit(x) for x in (*transfer.RESULTS, "what")]), (p % 6 + 1).cast("int"))
    unknown = F.when(p % 2 == 0, F.array("peer_hash", F.reverse("peer_hash"))).otherwise(F.array().cast("array<string>"))
    text = transfer.posting_response(result, (F.coalesce("stored_urls", F.lit(0)) % 5000).cast("int"), unknown, F.array().cast("array<string>"))
    r = s.select("peer_hash", wire.once(text).alias("t")).select("peer_hash", transfer.read_posting_response(F.col("t")).alias("r"))
    return r.select("peer_hash", "r.result", "r.pause_ms", F.array_join("r.unknown", " ").alias("unknown"))


@query(f"select peer_hash, case when port is null then 'unaddressable' when port % 7 = 0 then 'unreachable' when {_RESULT} = 'ok' then 'accepted' when {_RESULT} in ('busy', 'not_granted') then 'deferred' when {_RESULT} = 'too high load' then 'overloaded' else 'refused' end outcome from seeds")
def transfer_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    p = F.coalesce("port", F.lit(0))
    result = F.element_at(F.array(*[F.lit(x) for x in (*transfer.RESULTS, "what")]), (p % 6 + 1).cast("int"))
    answers = table(spark, folder, "seeds").select("peer_hash", F.when(F.col("port").isNotNull(), F.concat(F.lit("h:"), F.col("port").cast("string"))).alias("address"), F.when(p % 7 != 0, 200).alias("status"), result.alias("result"))
    return ingest.transfer_outcome(answers).select("peer_hash", "outcome")


@query("select peer_hash, (coalesce(peer_type, '') in ('', 'senior')) and peer_hash = (select min(peer_hash) from seeds where peer_type = 'senior') for_us from seeds")
def request_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that name a network after the peer's type; the default one counts if none is named."""
    s = table(spark, folder, "seeds")
    own = s.where("peer_type = 'senior'").agg(F.min("peer_hash")).first()[0]
    network = F.when(F.col("peer_type") == "senior", F.lit(transfer.NETWORK)).otherwise(F.col("peer_type"))
    return s.select("peer_hash", transfer.addresses(network, F.col("peer_hash"), own).alias("for_us"))


@query("select stream_seq, coalesce(nullif(trim(regexp_replace(descr, '\\s+', ' ', 'g')), ''), 'no reported body') report from url_metadata where descr is null or (octet_length(encode(descr)) <= 512 and not regexp_matches(descr, '[^\\x00-\\x7f]'))")
def failure_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Short ASCII titles as what a peer says when it fails."""
    m = table(spark, folder, "url_metadata").where("descr is null or octet_length(descr) <= 512 and not descr rlike '[^\\\\x00-\\\\x7f]'")
    return m.select("stream_seq", transfer.failure_report(F.col("descr")).alias("report"))


# --- intake --------------------------------------------------------------------------------------------------------

_ADMIT = """b as (select stream_seq // 400 batch, word_hash, url_hash from postings where stream_seq % 3 <> 0 or (stream_seq // 400) % 2 = 0),
    k as (select distinct url_hash from url_metadata where stream_seq % 2 = 0), wait as (select distinct word_hash, url_hash from postings where stream_seq < 400 and url_hash not in (select url_hash from k)),
    r as (select b.*, k.url_hash is not null known from b left join k using (url_hash)),
    per as (select batch, count(*) n, count(*) filter (known) n_stored, count(*) filter (not known) n_held from r group by 1),
    big as (select batch from per where n > 300),
    hn as (select word_hash, url_hash, min(batch) batch from r where not known and batch not in (select batch from big) and (word_hash, url_hash) not in (select (word_hash, url_hash) from wait) group by 1, 2),
    nw as (select batch, count(*) c from hn group by 1),
    s as (select per.*, coalesce(c, 0) c, sum(coalesce(c, 0)) over (order by batch) run from per left join nw using (batch)),
    x as (select *, case when n > 300 then 'request-too-large' when c > 0 and run > 2000 - (select count(*) from wait) then 'escrow-full' end refusal from s)"""


def _receipts(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "postings")
    batch = F.expr("stream_seq div 400")
    known = table(spark, folder, "url_metadata").where("stream_seq % 2 = 0").select("url_hash")
    rows = p.where((F.col("stream_seq") % 3 != 0) | (batch % 2 == 0)).select(batch.alias("batch"), "word_hash", "url_hash")
    waiting = p.where("stream_seq < 400").join(known, "url_hash", "left_anti").select("word_hash", "url_hash")
    return ingest.receipts(rows, known, waiting, "batch", batch_cap=300, capacity=2000)


@query(f"with {_ADMIT} select batch, n, case when refusal is null then n_stored else 0 end n_stored, case when refusal is null then n_held else 0 end n_held, refusal from x")
def admission_receipts(spark: SparkSession, folder: str) -> DataFrame:
    return _receipts(spark, folder)


@query(f"with {_ADMIT} select refusal, cast(sum(n) as bigint) postings from x where refusal is not null group by 1")
def refused_postings(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.refused_by_reason(_receipts(spark, folder))


_INTAKE = "m as (select *, case when stream_seq % 11 = 0 then 'bad' else url_hash end h from url_metadata), good as (select * from m where regexp_full_match(h, '[A-Za-z0-9_-]{12}') and coalesce(url, '') <> '')"


@query(f"with {_INTAKE}, old as (select * from good where stream_seq % 2 = 0), new as (select * from good where stream_seq % 2 = 1) select (select count(distinct h) from good) stored, (select count(*) from new where h in (select h from old)) known, (select count(*) from m where stream_seq % 2 = 1) - (select count(*) from new) rejected")
def metadata_intake(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata that came in two halves, rows with a bad hash or no address rejected each for itself."""
    m = table(spark, folder, "url_metadata").withColumn("url_hash", F.when(F.col("stream_seq") % 11 == 0, "bad").otherwise(F.col("url_hash"))).select("stream_seq", "url_hash", "url")
    empty = m.limit(0)
    first, _, _ = ingest.intake(empty, m.where("stream_seq % 2 = 0"), ["stream_seq"])
    stored, rejected, known = ingest.intake(first, m.where("stream_seq % 2 = 1"), ["stream_seq"])
    counts = stored.agg(F.count(F.lit(1)).alias("stored"))
    return counts.select("stored", F.lit(known).cast("long").alias("known"), rejected.agg(F.count(F.lit(1)).alias("n")).scalar().alias("rejected"))


@query("with l as (select url_hash, 1 d from postings where stream_seq % 3 <> 0 union all select url_hash, -1 from postings where stream_seq % 15 = 1) select url_hash, cast(sum(d) as bigint) n from l group by 1 having sum(d) > 0")
def reference_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Postings that refer to a document: counted at first, then moved by what was stored and purged."""
    p = table(spark, folder, "postings").select("stream_seq", "url_hash")
    before = p.where("stream_seq % 3 = 1").groupBy("url_hash").agg(F.count(F.lit(1)).alias("n"))
    return distribution.references(p, p.where("stream_seq % 3 = 2"), p.where("stream_seq % 15 = 1"), before)


@query("select stream_seq // 1000 batch, count(distinct word_hash) words from postings group by 1")
def batch_words(spark: SparkSession, folder: str) -> DataFrame:
    return index.distinct_words(table(spark, folder, "postings").withColumn("batch", F.expr("stream_seq div 1000")), "batch")


# --- chunks --------------------------------------------------------------------------------------------------------

_PARTS = f"""{CUR}, {META}, c as (select url_hash, word_hash, (row_number() over (partition by url_hash order by word_hash) - 1) // 20 chunk from cur), pages as (select distinct url_hash from meta)"""


@query(f"with {_PARTS} select url_hash, cast(0 as int) chunk, 'metadata' kind, cast(-1 as int) n from pages union all select url_hash, cast(chunk + 1 as int), 'postings', cast(count(*) as int) from c group by 1, 2")
def page_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of at most 20 postings behind the metadata chunk of each page."""
    parts = index.page_chunks(metadata(spark, folder), current(spark, folder), "url_hash", ["word_hash"], 20)
    return parts.select("url_hash", "chunk", "kind", F.coalesce(F.when(F.col("postings").isNotNull(), F.size("postings")), F.lit(-1)).alias("n"))


@query(f"""with {_PARTS}, p as (select url_hash, 0 chunk, 'metadata' kind, 0 n from pages where url_hash >= 'C' union all select url_hash, chunk + 1, 'postings', count(*) from c group by 1, 2 union all select url_hash, 9999, 'metadata', 0 from pages where url_hash > 'y'),
    t as (select *, case when url_hash < 'E' or url_hash >= 'G' then url_hash else substr(url_hash, 1, 3) end transfer from p),
    g as (select transfer, min(url_hash) filter (kind = 'metadata') url_hash, count(*) filter (kind = 'metadata') m, count(distinct url_hash) filter (kind = 'postings') k, max(url_hash) filter (kind = 'postings') x, cast(sum(n) as bigint) n_postings from t group by 1)
    select transfer, url_hash, n_postings, case when m = 0 then 'no metadata chunk' when m > 1 then 'more than one metadata chunk' when k > 1 or (k = 1 and x <> url_hash) then 'a chunk of another page' end fault from g""")
def page_reassembly(spark: SparkSession, folder: str) -> DataFrame:
    """Pages from chunks, of which some transfers lack the metadata, have it twice, or hold several pages."""
    parts = index.page_chunks(metadata(spark, folder), current(spark, folder), "url_hash", ["word_hash"], 20).where("kind = 'postings' or url_hash >= 'C'")
    twice = parts.where("kind = 'metadata' and url_hash > 'y'").withColumn("chunk", F.lit(9999))
    sent = parts.unionByName(twice).unionByName(parts.where("chunk = 1"))  # and some of them again
    u = F.col("url_hash")
    return index.reassembled_pages(sent.withColumn("transfer", F.when((u < "E") | (u >= "G"), u).otherwise(F.substring(u, 1, 3))), "transfer", "url_hash")


# --- distribution and frontier -------------------------------------------------------------------------------------


@query("with s as (select distinct word_hash, url_hash, epoch_ms(received_at) // 1000 due_at from postings where stream_seq % 4 = 0), d as (select word_hash, url_hash, max(due_at) due_at from s group by 1, 2), t as (select * from d where due_at <= 1750000000 order by due_at, word_hash, url_hash limit 500) select t.*, not exists (select 1 from postings p where p.word_hash = t.word_hash and p.url_hash = t.url_hash and p.stream_seq % 8 <> 0) gone from t")
def due_and_gone(spark: SparkSession, folder: str) -> DataFrame:
    """Postings due to be offered, and whether they left the index since."""
    p = table(spark, folder, "postings")
    schedule = p.where("stream_seq % 4 = 0").groupBy("word_hash", "url_hash").agg(F.max(F.unix_seconds(F.col("received_at").cast("timestamp"))).alias("due_at"))
    return distribution.due_postings(schedule, p.where("stream_seq % 8 <> 0"), F.lit(1_750_000_000), 500)


@query(f"with {CUR}, h as (select word_hash, count(*) filter (language = 'en') held from cur group by 1), x as (select held > 0 present, cast((cast(7 as hugeint) - {_pos('word_hash')} + 9223372036854775808) % 9223372036854775808 as double) / 9223372036854775808 f from h), b as (select present, cast(13 - count(k.i) as int) bound from (select row_number() over () id, * from x) z left join (select unnest(range(13)) i) k on z.f <= 1e-6 * pow(1e6, k.i / 12.0) group by id, present) select present, bound, count(*) n from b group by 1, 2")
def nearness_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """How near a node at the beginning of the ring is to the words of the index, by whether it has English postings of them."""
    held = current(spark, folder).groupBy("word_hash").agg(F.count_if(F.coalesce(F.col("language") == "en", F.lit(False))).alias("held"))
    return distribution.nearness(held, 7)


_FRONTIER = """f as (select url, min(stream_seq) s from search_documents where url is not null group by 1),
    r as (select url, cast(s % 3 as int) deferrals, cast(s % 5 as int) attempts, case when s % 4 = 0 then timestamp '2025-06-30 00:00:00' when s % 4 = 1 then timestamp '2025-07-02 00:00:00' end not_before, list_element(['fetched', 'deferred', 'failed', null], cast(s % 4 as int) + 1) status, s from f),
    k as (select url, deferrals + (coalesce(status, '') = 'deferred')::int deferrals, attempts + (coalesce(status, '') = 'failed')::int attempts, case when status = 'deferred' then timestamp '2025-07-01 00:01:30' when status = 'failed' then null else not_before end not_before, s, status
        from r where status is null or (status = 'deferred' and deferrals < 2) or (status = 'failed' and attempts < 4))"""


@query(f"with {_FRONTIER} select url, deferrals, attempts, coalesce(status, '') = 'failed' retried, not_before from k union all select distinct canonical_url, 0, 0, false, null::timestamp from pages_text where canonical_url not in (select url from f)")
def frontier_step(spark: SparkSession, folder: str) -> DataFrame:
    """A frontier of the pages of full-text documents after a round of visits, with the pages of texts admitted."""
    s = F.col("s")
    f = table(spark, folder, "search_documents").where("url is not null").groupBy("url").agg(F.min("stream_seq").alias("s"))
    day = lambda x: F.lit(x).cast("timestamp")
    open_ = f.select("url", F.lit(0).alias("depth"), (s % 3).cast("int").alias("deferrals"), (s % 5).cast("int").alias("attempts"), F.when(s % 4 == 0, day("2025-06-30")).when(s % 4 == 1, day("2025-07-02")).alias("not_before"), s.alias("place"))
    status = F.element_at(F.array(F.lit("fetched"), F.lit("deferred"), F.lit("failed")), (s % 4 + 1).cast("int"))
    visited = f.where("s % 4 < 3").select("url", status.alias("status"), F.lit(90).alias("defer_seconds"))
    new = table(spark, folder, "pages_text").select(F.col("canonical_url").alias("url"), F.lit(1).alias("depth"))
    after = frontier.advanced(open_, visited, new, day("2025-07-01"), max_deferrals=2, max_attempts=4)
    failed = visited.where("status = 'failed'").select("url", F.lit(True).alias("retried"))
    rows = after.join(failed, "url", "left").withColumn("retried", F.coalesce("retried", F.lit(False)))
    return rows.select("url", "deferrals", "attempts", "retried", F.when(~F.col("retried"), F.col("not_before")).cast("timestamp_ntz").alias("not_before"))


# --- full text by language -----------------------------------------------------------------------------------------

_TOKENS_OF = r"list_transform(list_filter(regexp_extract_all(coalesce({0}, ''), '(?:-?\p{{L}}|-?\p{{Nd}}(?:[.,]\p{{Nd}})*)+|[.!?]'), lambda x: x not in ('.', '!', '?')), lambda x: lower(x))"
_LANG = "coalesce(nullif(regexp_split_to_array(lower(trim(language)), '[-_]')[1], ''), 'und')"
_FOLD = "translate({0}, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿąćęłńóśźż', 'aaaaaaceeeeiiiinooooouuuuyyacelnoszz')"
_STEM = "case " + " ".join(f"when lang = '{lang}' then regexp_replace({{0}}, '^(.{{{{{fulltext.SHORTEST_STEM},}}}}?)(?:{'|'.join(e)})$', '\\1')" for lang, e in fulltext.ENDINGS.items()) + f" else {_FOLD} end"
_WORDS = f"""{_CORPUS}, w as (select url, {_LANG} lang, 3 weight, unnest({_TOKENS_OF.format('title')}) word from d where coalesce(title, '') <> '' and coalesce(url, '') <> ''
    union all select url, {_LANG}, 1, unnest({_TOKENS_OF.format('content')}) from d where coalesce(title, '') <> '' and coalesce(url, '') <> '')"""


def _stems(spark: SparkSession, folder: str) -> DataFrame:
    """Stems of titles and contents, kept by stem."""
    return compacted.kept(spark, folder, "search_documents", "document-stems", lambda: fulltext.postings(_corpus(spark, folder), analysed=True), ["word", "url"])


def _asked(word: str) -> str:
    return f"select url, cast(sum(weight) as bigint) score from w where {_STEM.format('word')} = {_STEM.format(chr(39) + word + chr(39))} group by 1"


@query(f"with {_WORDS}, a as ({_asked('replicas')}), b as ({_asked('server')}) select url, a.score + b.score score from a join b using (url)")
def fulltext_stemmed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that have some form of two words, each in the manner of its own language."""
    return fulltext.search(_stems(spark, folder), ["replicas", "server"], analysed=True)


@query(f"with {_WORDS}, i as (select *, case when lang in ('de', 'en', 'fr', 'ru') then lang else 'und' end idx from w), s as (select url, idx language_index, cast(sum(weight) as bigint) score from i where word = 'server' group by 1, 2) select * from s")
def fulltext_over_languages(spark: SparkSession, folder: str) -> DataFrame:
    """A search over the indexes of all languages at once."""
    docs = fulltext.routed(_corpus(spark, folder), ["de", "en", "fr", "ru"])
    indexes = {lang: fulltext.postings(docs.where(F.col("language_index") == lang)) for lang in ("de", "en", "fr", "ru", "und")}
    return fulltext.search_over(indexes, ["server"])


@query(f"select coalesce(title, '') title, canonical_url url, length(text) n_chars, crawled_at, {_LANG} as language from pages_text where coalesce(trim(text, ' '), '') <> ''")
def text_pages_as_documents(spark: SparkSession, folder: str) -> DataFrame:
    d = fulltext.search_document(table(spark, folder, "pages_text"))
    return d.select("title", "url", F.length("content").cast("long").alias("n_chars"), "crawled_at", "language")


@query("with p as (select *, row_number() over (partition by canonical_url order by crawled_at desc, stream_seq desc) rn from pages_text where text is not null) select sha256(canonical_url) as name, canonical_url url, cast(length(text) as bigint) n_chars from p where rn = 1")
def page_objects(spark: SparkSession, folder: str) -> DataFrame:
    """An object for each page, named by its address, the last version over those before."""
    o = fulltext.objects(table(spark, folder, "pages_text"), "text", ["crawled_at", "stream_seq"])
    return o.select("name", "url", F.length("body").cast("long").alias("n_chars"))


@query("select stream_seq, case when language = 'en' then ['text', 'markdown'] when language = 'de' then ['text'] else ['markdown'] end kinds from pages_text")
def recall_kinds(spark: SparkSession, folder: str) -> DataFrame:
    asked = F.when(F.col("language") == "en", F.array(F.lit("text"), F.lit("pdf"), F.lit("markdown"))).when(F.col("language") == "de", F.array(F.lit("text"))).when(F.col("language") == "fr", F.array(F.lit("pdf")))
    return table(spark, folder, "pages_text").select("stream_seq", fulltext.kinds(asked).alias("kinds"))


# --- search --------------------------------------------------------------------------------------------------------


@query(f"with {_matches_sql(2, 'document_type = 9')} select * from m")
def search_strict_kind(spark: SparkSession, folder: str) -> DataFrame:
    """A strict search for images, where the test tables write 9 for them."""
    rows = current(spark, folder).withColumn("document_type", F.when(F.col("document_type") == 9, ord("i")).otherwise(F.col("document_type")))
    return search.matches(rows, search.Criteria(terms(spark, folder, 2), content_kind="image", strict_content_kind=True))


# --- small functions -----------------------------------------------------------------------------------------------


@query("select cast(i as int) status, case when i between 200 and 299 then 'fetched' when i = 304 then 'unmodified' when i in (429, 503) then 'deferred' when i in (401, 403, 451) then 'ceased' when i between 400 and 499 then 'not-a-page' else 'failed' end outcome from (select unnest(range(100, 600)) i)")
def fetch_statuses(spark: SparkSession, folder: str) -> DataFrame:
    s = spark.range(100, 600).select(F.col("id").cast("int").alias("status"))
    return s.select("status", crawl.fetch_status(F.col("status")).alias("outcome"))


_HEADERS = ("noindex", "NoFollow , x", "none", "otherbot: noindex", "index, follow", "", "noindex,nofollow", "x-none")
_BOTH = {"noindex": (True, False), "NoFollow , x": (False, True), "none": (True, True), "noindex,nofollow": (True, True)}


@query(" union all ".join(f"select {i} id, {_BOTH.get(h, (False, False))[0]} noindex, {_BOTH.get(h, (False, False))[1]} nofollow" for i, h in enumerate(_HEADERS)))
def robots_headers(spark: SparkSession, folder: str) -> DataFrame:
    h = spark.range(len(_HEADERS)).select(F.col("id").cast("int").alias("id"), F.element_at(F.array(*[F.lit(x) for x in _HEADERS]), (F.col("id") + 1).cast("int")).alias("h"))
    return h.select("id", crawl.robots_directives(F.col("h")).alias("r")).select("id", "r.*")


@query(f"with {META} select url_hash, lower(trim(regexp_split_to_array(mime || '; q=1', ';')[1])) media_type, coalesce(lower(trim(regexp_split_to_array(mime, ';')[1])) in ('text/html', 'application/pdf'), false) allowed, case when mime is null then null when mime = 'text/html' then 'nesting-too-deep' when mime = 'application/pdf' then 'unsupported-media-type' else 'unextractable' end disposal from meta")
def media_types(spark: SparkSession, folder: str) -> DataFrame:
    """Media types, whether they are allowed, and disposals by errors that stand for them."""
    m = metadata(spark, folder)
    error = F.when(F.col("mime") == "text/html", "nested too deep").when(F.col("mime") == "application/pdf", "Unsupported media type ").when(F.col("mime").isNotNull(), "what")
    typed = F.concat("mime", F.lit("; q=1"))
    return m.select("url_hash", crawl.media_type(typed).alias("media_type"), crawl.media_type_allowed(typed, ["text/html", "Application/PDF"]).alias("allowed"), crawl.extraction_disposal(error).alias("disposal"))


@query(f"select peer_hash, last_seen is null or {_NOW} >= last_seen + interval 1 day eligible, coalesce(last_seen > {_NOW} - interval 20 day, false) recent from seeds")
def peer_times(spark: SparkSession, folder: str) -> DataFrame:
    """Peers that are not held back until a day after they were seen; and those seen within two intervals of ten days."""
    s = table(spark, folder, "seeds").select("peer_hash", (F.col("last_seen") + F.expr("interval 1 day")).alias("held_back_until"), F.col("last_seen").alias("last_reachable"))
    now = F.lit(NOW).cast("timestamp_ntz")
    ok = ring.eligible(s, now).select("peer_hash", F.lit(True).alias("eligible"))
    return s.join(ok, "peer_hash", "left").select("peer_hash", F.coalesce("eligible", F.lit(False)).alias("eligible"), ring.recently_reachable(now, 10 * 86_400).alias("recent"))


@query(f"select peer_hash, substr(peer_hash, 1, 10) || '__' at_position, cast(({_pos('peer_hash')} - {_pos(repr('MMMMMMMMMMMM'))}) & {(1 << 59) - 1} as bigint) past from seeds")
def hashes_at_positions(spark: SparkSession, folder: str) -> DataFrame:
    p = hashing.ring_position(F.col("peer_hash"))
    return table(spark, folder, "seeds").select("peer_hash", hashing.hash_at(p).alias("at_position"), hashing.distance_from_word(p, F.lit("MMMMMMMMMMMM"), 4).alias("past"))


@query(f"select peer_hash, row_number() over (order by translate(peer_hash, '{hashing.ALPHABET}', '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_`abcdefghijklmnopqrstuvwxyz') collate \"C\") place, md5(peer_hash || coalesce(peer_name, '') || 'x') network_key from (select distinct peer_hash, peer_name from seeds)".replace(' collate \\"C\\"', "").replace(' collate "C"', ""))
def hash_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Peers in the order of the alphabet; a roster is bounded, so one task may number it."""
    s = table(spark, folder, "seeds").select("peer_hash", "peer_name").distinct()
    n = F.row_number().over(W.orderBy(hashing.alphabet_order(F.col("peer_hash")))).cast("long")
    return s.select("peer_hash", n.alias("place"), hashing.network_key(F.col("peer_hash"), F.col("peer_name"), F.lit("x")).alias("network_key"))


@query("select peer_hash, case when port % 1440 - 720 < 0 then '-' else '+' end || lpad(cast(abs(port % 1440 - 720) // 60 as varchar), 2, '0') || lpad(cast(abs(port % 1440 - 720) % 60 as varchar), 2, '0') shown, cast(port % 1440 - 720 as int) as minutes from seeds where port is not null")
def utc_offsets(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "seeds").where("port is not null").select("peer_hash", wire.utc_offset_text(F.col("port") % 1440 - 720).alias("shown"))
    return s.select("peer_hash", "shown", wire.utc_offset(F.col("shown")).cast("int").alias("minutes"))


@query("select peer_hash, cast(1.5 + (port % 9) / 1000.0 as double) as release, cast(1000 + port % 5000 as int) revision from seeds where port is not null")
def software_versions(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "seeds").where("port is not null")
    t = messages.version_text((F.lit(1.5) + (F.col("port") % 9) / 1000).cast("double"), (F.lit(1000) + F.col("port") % 5000).cast("int"))
    v = s.select("peer_hash", wire.once(messages.version(t)).alias("v"))
    return v.select("peer_hash", F.col("v.release").alias("release"), F.col("v.revision").alias("revision"))


@query("select s.url_hash || s.word_hash joined, s.url_hash first_hash, s.word_hash second_hash, 2 as n from (select distinct url_hash, word_hash from postings) s")
def hash_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes written one after another, with a rest that is none."""
    p = table(spark, folder, "postings").select("url_hash", "word_hash").distinct()
    h = hashing.split_hashes(F.concat("url_hash", "word_hash", F.lit("rest")))
    return p.select(F.concat("url_hash", "word_hash").alias("joined"), F.element_at(h, 1).alias("first_hash"), F.element_at(h, 2).alias("second_hash"), F.size(h).alias("n"))


@query(f"select peer_hash, cast(case when port is null then 60 when port % 2 = 0 then port % 1000 else greatest(date_diff('second', {_NOW}, date_trunc('second', last_seen)), 0) end as int) as seconds from seeds where last_seen is not null")
def retry_after_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers and dates of peers as what a server asks to wait."""
    s = table(spark, folder, "seeds").where("last_seen is not null")
    date = F.concat(F.date_format("last_seen", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    header = F.when(F.col("port") % 2 == 0, (F.col("port") % 1000).cast("string")).when(F.col("port").isNotNull(), date)
    return s.select("peer_hash", crawl.retry_after(header, F.lit(NOW).cast("timestamp")).alias("seconds"))


@query(f"with {CUR}, {META} select 'AAAAAAAAAAAA' peer_hash, 'own' as name, (select count(*) from cur) indexed_words, (select count(*) from meta) stored_urls, 90 uptime_minutes")
def own_seed(spark: SparkSession, folder: str) -> DataFrame:
    now, began = F.lit(NOW).cast("timestamp"), F.lit("2025-06-30 22:30:00").cast("timestamp")
    s = index.self_seed({"peer_hash": F.lit(SELF), "name": F.lit("own")}, current(spark, folder), metadata(spark, folder), now, began)
    return s.select("peer_hash", "name", "indexed_words", "stored_urls", "uptime_minutes")


@query(f"with {_PEERS}, {_IDS}, {_CLOSER} select word_hash, count(*) n, cast(max(closer_peers) as bigint) most_closer from closer group by 1")
def closer_by_word(spark: SparkSession, folder: str) -> DataFrame:
    """For each word the postings and the most peers that are closer to one of them than this node."""
    ids = table(spark, folder, "postings").select("word_hash", "url_hash").distinct()
    c = ring.closer_than(ids, peers(spark, folder), SELF)
    return c.groupBy("word_hash").agg(F.count(F.lit(1)).alias("n"), F.max("closer_peers").cast("long").alias("most_closer"))
