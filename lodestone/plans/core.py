"""Queries of the search-index operators over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import hashing, html, tokens, urls, wire
from lodestone.operators import crawl, derive, fulltext, index, ingest, ring, search
from lodestone.session import materialise
from lodestone.sources import compacted
from lodestone.sources.tables import table

NOW = datetime(2025, 7, 1)
SELF = "AAAAAAAAAAAA"
_NOW = f"timestamp '{NOW:%Y-%m-%d %H:%M:%S}'"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a query under the name of its function, with the SQL for it."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def current(spark: SparkSession, folder: str) -> DataFrame:
    """Postings as the index holds them: the last delivery of each word and document."""
    return compacted.postings(spark, folder)


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    return compacted.metadata(spark, folder)


def terms(spark: SparkSession, folder: str, n: int) -> tuple[str, ...]:
    """The words with most documents: the terms of the example requests."""
    return tuple(r.word_hash for r in compacted.words(spark, folder).orderBy(F.desc("n"), "word_hash").limit(n).collect())


def peers(spark: SparkSession, folder: str) -> DataFrame:
    return ring.accepting(table(spark, folder, "seeds"))


CUR = "cur as (select * exclude rn from (select *, row_number() over (partition by word_hash, url_hash order by stream_seq desc) rn from postings) where rn = 1)"
META = "meta as (select * exclude rn from (select *, row_number() over (partition by url_hash order by stream_seq desc) rn from url_metadata) where rn = 1)"
TOP = "top as (select word_hash, row_number() over (order by count(*) desc, word_hash) k from cur group by 1)"
_B64 = "list_aggregate(list_transform(range(1, {n} + 1), lambda i: cast(instr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_', substr({h}, i, 1)) - 1 as hugeint) * cast(power(64, {n} - i) as hugeint)), 'sum')"


def _pos(h: str) -> str:
    return "cast(" + _B64.format(n=10, h=h) + " * 8 + 7 as bigint)"


_MASK = (1 << 59) - 1
_HIGH = (2**63 - 1) & ~_MASK


def _ppos(w: str = "word_hash", u: str = "url_hash") -> str:
    return f"(({_pos(w)} & {_MASK}) | ({_pos(u)} & {_HIGH}))"


def _dist(a: str, b: str) -> str:
    return f"cast((cast({b} as hugeint) - {a} + 9223372036854775808) % 9223372036854775808 as bigint)"


# --- texts to postings ---------------------------------------------------------------------------------------------

_TOKENS = r"""
    t as (select doc_id, regexp_extract_all(text, '(?:-?\p{L}|-?\p{Nd}(?:[.,]\p{Nd})*)+|[.!?]') a from documents where text is not null),
    e as (select doc_id, unnest(a) tok, generate_subscripts(a, 1) i from t),
    s as (select doc_id, i, tok, sum(case when tok in ('.', '!', '?') then 1 else 0 end) over (partition by doc_id order by i) seg from e),
    w as (select doc_id, i, seg, lower(tok) word from s where tok not in ('.', '!', '?') and length(tok) >= 2),
    p as (select doc_id, word, cast(row_number() over (partition by doc_id order by i) - 1 as int) text_position, cast(dense_rank() over (partition by doc_id order by seg) + 99 as int) phrase_position,
          cast(row_number() over (partition by doc_id, seg order by i) as int) phrase_relative_position from w)"""
_HASH = "replace(replace(substr(to_base64(unhex(md5(lower({w})))), 1, 12), '+', '-'), '/', '_')"


@query(f"with {_TOKENS} select * from p")
def tokenize_positions(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.positions(table(spark, folder, "documents"), ["doc_id"], "text")


@query(f"with {_TOKENS}, n as (select doc_id, cast(count(*) as int) words, cast(count(distinct phrase_position) as int) phrases from p group by 1) select d.doc_id, coalesce(words, 0) words, coalesce(phrases, 0) phrases from documents d left join n using (doc_id)")
def text_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", tokens.statistics(F.col("text")).alias("s")).select("doc_id", "s.*")


@query(f"with {_TOKENS} select doc_id, {_HASH.format(w='word')} word_hash, cast(count(*) as int) hits, arg_min(text_position, text_position) text_position, arg_min(phrase_position, text_position) phrase_position, arg_min(phrase_relative_position, text_position) phrase_relative_position from p group by doc_id, word")
def build_postings(spark: SparkSession, folder: str) -> DataFrame:
    words = tokens.occurrences(table(spark, folder, "documents"), ["doc_id"], "text")
    return words.select("doc_id", hashing.word_hash(F.col("word")).alias("word_hash"), "hits", "text_position", "phrase_position", "phrase_relative_position")


def _latest_pages(spark: SparkSession, folder: str) -> DataFrame:
    p = index.latest(table(spark, folder, "pages_text"), ["canonical_url"], ["crawled_at", "stream_seq"])
    return p.select("canonical_url", "title", "text", fulltext.primary_language(F.col("language")).alias("language"), "crawled_at", F.lit(0).alias("local_links"), F.lit(0).alias("external_links"))


def page_postings(spark: SparkSession, folder: str) -> DataFrame:
    return index.page_postings(_latest_pages(spark, folder))


def page_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return index.page_metadata(_latest_pages(spark, folder), F.octet_length("text"))


@query(f"with {CUR}, n as (select url_hash, cast((row_number() over (partition by url_hash order by word_hash) - 1) // 1000 as int) chunk from cur) select url_hash, chunk, count(*) n_postings from n group by 1, 2")
def posting_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return index.chunks(current(spark, folder), "url_hash", ["word_hash"]).select("url_hash", "chunk", F.size("postings").alias("n_postings"))


@query(f"with {CUR} select word_hash, count(*) n_postings, cast(sum(hits) as bigint) hits from cur group by 1")
def chunk_reassembly(spark: SparkSession, folder: str) -> DataFrame:
    parts = index.chunks(current(spark, folder), "url_hash", ["word_hash"])
    return index.reassembled(parts, "url_hash").groupBy("word_hash").agg(F.count(F.lit(1)).alias("n_postings"), F.sum("hits").alias("hits"))


# --- search --------------------------------------------------------------------------------------------------------


_ENGLISH = "language = 'en'"


def _matches_sql(n: int = 2, where: str = "true", excluded: int | None = None, spread: int = 0, more: str = "") -> str:
    out = f" and c.url_hash not in (select url_hash from cur where word_hash = (select word_hash from top where k = {excluded}))" if excluded else ""
    return f"""{CUR}, {TOP}{more},
        f as (select c.* from cur c join top using (word_hash) where k <= {n} and ({where}){out}),
        kept as (select * from (select *, row_number() over (partition by word_hash order by hits desc, url_hash) rk from f) where rk <= 1000),
        m0 as (select url_hash, cast(sum(hits) as bigint) occurrences, min(text_position) first_position, max(text_position) last_position, cast((max(text_position) - min(text_position)) // {max(n - 1, 1)} as int) spread from kept group by 1 having count(*) = {n}),
        m as (select * from m0 where {spread} = 0 or spread <= {spread})"""


@query(f"with {CUR}, {TOP} select word_hash, url_hash, hits, text_position, phrase_position from cur join top using (word_hash) where k = 2")
def term_scan(spark: SparkSession, folder: str) -> DataFrame:
    word = terms(spark, folder, 2)[1]
    return current(spark, folder).where(F.col("word_hash") == word).select("word_hash", "url_hash", "hits", "text_position", "phrase_position")


@query(f"with {_matches_sql(2, _ENGLISH, 3)}, n as (select word_hash, count(*) held from cur join top using (word_hash) where k <= 2 group by 1), a as (select word_hash, count(*) accepted from f group by 1) select word_hash, held, coalesce(accepted, 0) accepted, least(coalesce(accepted, 0), 1000) kept from n left join a using (word_hash)")
def term_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = terms(spark, folder, 3)
    return search.term_counts(current(spark, folder), search.Criteria(t[:2], t[2:], language="en"))


@query(f"with {CUR}, r as (select *, row_number() over (partition by word_hash order by hits desc, url_hash) rk from cur) select word_hash, url_hash, hits from r where rk <= 3")
def top_postings_per_term(spark: SparkSession, folder: str) -> DataFrame:
    return search.kept(current(spark, folder), 3).select("word_hash", "url_hash", "hits")


def _search(where: str = "true", n: int = 2, excluded: int | None = None, spread: int = 0, more: str = "", **criteria):  # noqa: ANN003, ANN202
    """A search by the most frequent words; criteria may be functions of the session and folder."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        t = terms(spark, folder, max(n, excluded or 0))
        given = {k: v(spark, folder) if callable(v) else v for k, v in criteria.items()}
        c = search.Criteria(t[:n], (t[excluded - 1],) if excluded else (), max_spread=spread, **given)
        return search.matches(current(spark, folder), c)

    return run, f"with {_matches_sql(n, where, excluded, spread, more)} select * from m"


def _site(spark: SparkSession, folder: str) -> str:
    h = hashing.host_hash(F.col("url_hash"))
    return current(spark, folder).groupBy(h.alias("h")).count().orderBy(F.desc("count"), "h").first().h


def _required(spark: SparkSession, folder: str) -> tuple[str, ...]:
    return tuple(r.url_hash for r in metadata(spark, folder).select("url_hash").orderBy("url_hash").limit(500).collect())


for _name, (_run, _sql) in {
    "search_and": _search(),
    "search_three_terms": _search(n=3),
    "search_exclude": _search(excluded=3),
    "search_language": _search("language = 'en'", language="en"),
    "search_spread": _search(spread=50),
    "search_appearance": _search("appearance & 384 <> 0", required_appearance=384),
    "search_images": _search("appearance & 4 <> 0", content_kind="image"),
    "search_images_strict": _search(f"document_type = {ord('i')}", content_kind="image", strict_content_kind=True),
    "search_site": _search("substr(c.url_hash, 7, 6) = (select h from site)", 1, more=", site as (select substr(url_hash, 7, 6) h from cur group by 1 order by count(*) desc, h limit 1)", site_hash=_site),
    "search_required_documents": _search("c.url_hash in (select url_hash from req)", more=f", {META}, req as (select url_hash from meta order by url_hash limit 500)", required_documents=_required),
}.items():
    QUERIES[_name], SQL[_name] = _run, _sql


@query(f"with {_matches_sql()} select url_hash, occurrences, spread from m order by occurrences desc, spread, url_hash limit 10")
def search_ranked_top10(spark: SparkSession, folder: str) -> DataFrame:
    return search.ranked(search.matches(current(spark, folder), search.Criteria(terms(spark, folder, 2)))).select("url_hash", "occurrences", "spread")


@query(f"with {_matches_sql()}, {META}, r as (select *, cast(row_number() over (order by occurrences desc, spread, url_hash) as int) rank from m) select rank, url_hash, occurrences, url, descr from r join meta using (url_hash) where rank <= 10")
def search_results(spark: SparkSession, folder: str) -> DataFrame:
    c = search.Criteria(terms(spark, folder, 2))
    return search.documents(current(spark, folder), metadata(spark, folder), c).select("rank", "url_hash", "occurrences", "url", "descr")


_RANKED = "translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_', '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_`abcdefghijklmnopqrstuvwxyz')"
_ABSTRACT = f"""
    g as (select word_hash, substr(url_hash, 7, 6) site, string_agg(substr(url_hash, 1, 6), '' order by {_RANKED.replace('(h,', '(substr(url_hash, 1, 6),')}) paths, count(*) n from rep group by 1, 2)
    select word_hash, cast(sum(n) as int) n_documents, '{{' || string_agg(site || ':' || paths, ',' order by {_RANKED.replace('(h,', '(site,')}) || '}}' abstract from g group by 1"""


@query(f"with {_matches_sql()}, best as (select word_hash from kept group by 1 order by count(*) desc, word_hash limit 1), rep as (select k.* from kept k join best using (word_hash)), {_ABSTRACT.strip()}")
def report_auto(spark: SparkSession, folder: str) -> DataFrame:
    return search.report(current(spark, folder), search.Criteria(terms(spark, folder, 2)), "auto")


@query(f"with {CUR}, {TOP}, f as (select c.* from cur c join top using (word_hash) where k in (3, 4)), rep as (select * from (select *, row_number() over (partition by word_hash order by hits desc, url_hash) rk from f) where rk <= 1000), {_ABSTRACT.strip()}")
def report_requested_terms(spark: SparkSession, folder: str) -> DataFrame:
    t = terms(spark, folder, 4)
    return search.report(current(spark, folder), search.Criteria(t[:2]), "terms", t[2:])


@query(rf"""with {_matches_sql()}, {META}, r as (select descr from (select url_hash from m order by occurrences desc, spread, url_hash limit 10) join meta using (url_hash)),
    w as (select unnest(regexp_split_to_array(lower(descr), '[ /()\-:_.,?!''"]+')) topic from r)
    select topic, count(*) frequency from w where regexp_full_match(topic, '[a-z]{{3,}}') and topic not in {tokens.COMMON_TITLE_WORDS!r} group by 1 order by 2 desc, 1 limit 5""")
def title_topics(spark: SparkSession, folder: str) -> DataFrame:
    c = search.Criteria(terms(spark, folder, 2))
    return search.topics(search.documents(current(spark, folder), metadata(spark, folder), c), c)


# --- the index as tables -------------------------------------------------------------------------------------------


@query(f"with {CUR}, {META} select (select count(*) from cur) postings, (select count(distinct url_hash) from cur) referenced_urls, (select count(*) from meta) metadata_rows")
def index_counts(spark: SparkSession, folder: str) -> DataFrame:
    return index.counts(current(spark, folder), metadata(spark, folder))


@query("select distinct url_hash from postings where url_hash not in (select url_hash from url_metadata)")
def missing_urls(spark: SparkSession, folder: str) -> DataFrame:
    return index.missing_urls(table(spark, folder, "postings"), table(spark, folder, "url_metadata"))


@query(f"with {CUR} select url_hash, word_hash from cur where url_hash in (select url_hash from url_metadata where lang = 'de')")
def reverse_index(spark: SparkSession, folder: str) -> DataFrame:
    return index.words_of_urls(current(spark, folder), table(spark, folder, "url_metadata").where("lang = 'de'"))


@query("select substr(url_hash, 7, 6) host_hash, count(distinct url_hash) n_urls from url_metadata group by 1")
def host_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "url_metadata").groupBy(hashing.host_hash(F.col("url_hash")).alias("host_hash")).agg(F.count_distinct("url_hash").alias("n_urls"))


@query("select 'postings' collection, count(*) entries from postings union all select 'url_metadata', count(*) from url_metadata union all select 'seeds', count(*) from seeds union all select 'search_documents', count(*) from search_documents")
def collection_counts(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for name in ("postings", "url_metadata", "seeds", "search_documents"):
        n = table(spark, folder, name).agg(F.lit(name).alias("collection"), F.count(F.lit(1)).alias("entries"))
        out = n if out is None else out.unionByName(n)
    return out


@query(f"with {META} select url_hash, coalesce(load_day, mod_day, fresh_day) fresh_on, coalesce(strftime(coalesce(load_day, mod_day, fresh_day), '%Y%m%d'), '00000000') rank from meta")
def freshness_ranks(spark: SparkSession, folder: str) -> DataFrame:
    m = metadata(spark, folder)
    return m.select("url_hash", index.freshness(m).alias("fresh_on"), index.freshness_rank(index.freshness(m)).alias("rank"))


@query(f"with {META} select url_hash, coalesce(load_day, mod_day, fresh_day) fresh_on from meta order by fresh_on asc nulls first, url_hash limit 256")
def stalest_urls(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.stalest(metadata(spark, folder), ingest.EVICTED_AT_ONCE)


_EVICT = f"""with {META}, s as (select url_hash, coalesce(load_day, mod_day, fresh_day) fresh_on, cast(coalesce(byte_size, 0) + 100 as bigint) bytes from meta),
    r as (select *, coalesce(sum(bytes) over (order by coalesce(fresh_on, date '0001-01-01'), url_hash rows between unbounded preceding and 1 preceding), 0) b, sum(bytes) over () used from s)
    select url_hash, fresh_on, bytes from r where b < used - cast(floor(2000000 * 0.9) as bigint) + 1"""


@query(_EVICT)
def quota_eviction(spark: SparkSession, folder: str) -> DataFrame:
    m = metadata(spark, folder)
    sizes = m.select("url_hash", (F.coalesce("byte_size", F.lit(0)) + 100).cast("long").alias("bytes"))
    return ingest.evicted(m, sizes, 2_000_000)


@query(f"""with {META}, f as (select url_hash, coalesce(list_has_any(list_transform(string_split(tags, ','), lambda t: contains(t, 'indexof')), [true]), false) is_directory_listing, lat is not null and lon is not null and (lat <> 0 or lon <> 0) has_location,
    coalesce(limage > 0, false) or coalesce(starts_with(mime, 'image/'), false) has_image, coalesce(laudio > 0, false) or coalesce(starts_with(mime, 'audio/'), false) has_audio,
    coalesce(lvideo > 0, false) or coalesce(starts_with(mime, 'video/'), false) has_video, coalesce(lapp > 0, false) or coalesce(starts_with(mime, 'application/'), false) has_application from meta)
    select url_hash, is_directory_listing, has_location, has_image, has_audio, has_video, has_application,
    cast(is_directory_listing::int + has_location::int * 524288 + has_image::int * 1048576 + has_audio::int * 2097152 + has_video::int * 4194304 + has_application::int * 8388608 as int) flags from f""")
def media_flags(spark: SparkSession, folder: str) -> DataFrame:
    m = index.media_flags(metadata(spark, folder))
    return m.select("url_hash", "is_directory_listing", "has_location", "has_image", "has_audio", "has_video", "has_application", "flags")


@query("select " + ", ".join(f"cast(sum((appearance >> {i}) & 1) as bigint) {n}" for i, n in enumerate(index.APPEARANCE)) + ", count(*) n from postings")
def appearance_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "postings").select(index.appearance_flags(F.col("appearance")).alias("f")).withColumn("f", index.appearance_flags(index.appearance_mask(F.col("f"))))
    return rows.agg(*[F.sum(F.col("f")[n].cast("long")).alias(n) for n in index.APPEARANCE], F.count(F.lit(1)).alias("n"))


# --- wire forms ----------------------------------------------------------------------------------------------------

_BYTE = ("title_words", "local_links", "external_links", "url_length", "url_components", "hits", "phrase_relative_position", "phrase_position")
_WORD = ("text_words", "phrases", "text_position")


@query(f"""with {CUR} select word_hash, url_hash, cast(((last_modified % 262144) + 262144) % 262144 as int) last_modified, substr(language, 1, 2) as language, appearance, {', '.join(f'{c} & 255 as {c}' for c in _BYTE)}, {', '.join(f'{c} & 65535 as {c}' for c in _WORD)} from cur
    where regexp_full_match(word_hash, '[A-Za-z0-9_-]{{12}}') and regexp_full_match(url_hash, '[A-Za-z0-9_-]{{12}}')""")
def posting_wire_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    lines = current(spark, folder).select(wire.posting_line().alias("line"))
    return wire.read_postings(lines).drop("document_type")


@query(f"""with {META} select url, descr, coalesce(author, '') author, coalesce(tags, '') tags, coalesce(publisher, '') publisher, mod_day, load_day, fresh_day, nullif(referrer, '') referrer, coalesce(byte_size, 0) byte_size, coalesce(wc, 0) wc, case when length(lang) = 2 then lang end lang, coalesce(llocal, 0) llocal, nullif(snippet, '') snippet
    from meta where url <> ''""".replace("select url, descr,", "select url, coalesce(descr, '') descr,"))
def metadata_wire_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    m = index.media_flags(metadata(spark, folder))
    rows = m.where("url is not null").select(wire.metadata_row(F.col("flags")).alias("row"))
    return wire.read_metadata(rows).select("url", "descr", "author", "tags", "publisher", "mod_day", "load_day", "fresh_day", "referrer", "byte_size", "wc", "lang", "llocal", "snippet")


@query("""select peer_hash, nullif(peer_name, '') peer_name, peer_type, port, case when coalesce(tags, '') in ('', '*') then '' else tags end tags, accept_remote_index, date_trunc('second', first_seen) first_seen, date_trunc('second', last_seen) last_seen, coalesce(stored_urls, 0) stored_urls, coalesce(indexed_words, 0) indexed_words from seeds""")
def seed_wire_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "seeds")
    flags = F.when(F.col("accept_remote_index").isNotNull(), wire.capabilities_text(F.struct(F.lit(False).alias("direct_connect"), F.lit(False).alias("accept_remote_crawl"), F.col("accept_remote_index").alias("accept_remote_index"), F.lit(False).alias("root_node"), F.lit(False).alias("ssl_available"))))
    columns = {"Hash": F.col("peer_hash"), "Name": F.col("peer_name"), "PeerType": F.col("peer_type"), "Port": F.col("port"), "Tags": F.col("tags"), "Flags": F.replace(flags, F.lit(" "), F.lit(" ")), "BDate": wire.short_second(F.col("first_seen")), "LastSeen": wire.short_second(F.col("last_seen")), "LCount": F.col("stored_urls"), "ICount": F.col("indexed_words")}
    back = wire.read_seeds(s.select(wire.seed_line(columns).alias("line")))
    return back.select("peer_hash", "peer_name", "peer_type", "port", F.array_join("tags", "|").alias("tags"), F.col("capabilities.accept_remote_index").alias("accept_remote_index"), F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "stored_urls", "indexed_words")


# --- addresses -----------------------------------------------------------------------------------------------------


@query(r"""with u as (select distinct url from url_metadata where url is not null), h as (select url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*:(\d+)', 1) p, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?', 1) path from u)
    select url, host, coalesce(try_cast(nullif(p, '') as int), case when starts_with(lower(url), 'https:') then 443 else 80 end) port, path, contains(url, '?') has_query, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(.*/)', 1) directory, regexp_extract(host, '^(?:.*\.)?([^.:]+)\.[^.:]*$', 1) "domain", regexp_extract(host, '^(.+)\.[^.:]+\.[^.:]*$', 1) subdomain from h""")
def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    u = table(spark, folder, "url_metadata").where("url is not null").select("url").distinct()
    url, host = F.col("url"), urls.host_of(F.col("url"))
    return u.select("url", host.alias("host"), urls.port_of(url).alias("port"), urls.path_of(url).alias("path"), urls.has_query(url).alias("has_query"), urls.directory_of(url).alias("directory"), urls.domain_of(host).alias("domain"), urls.subdomain_of(host).alias("subdomain"))


_N = r"""q as (select url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) sch, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) host, regexp_extract(url, '^[A-Za-z]+://[^/?#:]*:(\d+)', 1) port, regexp_extract(url, '^[A-Za-z]+://[^/?#]*(/[^?#]*)?', 1) path, regexp_extract(url, '(\?[^#]*)', 1) qs from u where url is not null),
    n as (select *, sch || '://' || host || case when port = '' or (sch = 'http' and port = '80') or (sch = 'https' and port = '443') then '' else ':' || port end || case when path = '' then '/' else path end || qs form from q)"""
_U = "u as (select distinct url from url_metadata), " + _N
_SYM = "replace(replace(to_base64(unhex(md5({0}))), '+', '-'), '/', '_')"


_HASHED = f"""d as (select *, case when port = '' then case sch when 'https' then '443' else '80' end else port end pt, regexp_extract(host, '^(?:.*\\.)?([^.:]+)\\.[^.:]*$', 1) dom, regexp_extract(host, '^(.+)\\.[^.:]+\\.[^.:]*$', 1) sub, regexp_extract(case when path = '' then '/' else path end, '^/?([^/]+)/[^/]', 1) rt from n),
    hashed as (select url, path, form normal_form, substr({_SYM.format('form')}, 1, 5) || substr({_SYM.format("sub || ':' || pt || ':' || rt")}, 1, 1) || substr({_SYM.format("sch || ':' || host || ':' || pt")}, 1, 5)
    || substr('{hashing.ALPHABET}', ((case when regexp_matches(host, '\\.(alt|example|internal|invalid|local|localhost|onion|test)$') or not contains(host, '.') then 28 else 24 end) | (case when length(dom) <= 8 then 0 when length(dom) <= 12 then 1 when length(dom) <= 16 then 2 else 3 end) | (case when sch <> 'http' then 32 else 0 end)) + 1, 1) computed_hash from d)"""


@query(f"with {_U}, {_HASHED} select url, normal_form, computed_hash from hashed")
def url_hashes(spark: SparkSession, folder: str) -> DataFrame:
    u = table(spark, folder, "url_metadata").where("url is not null").select("url").distinct()
    return u.select("url", urls.normal_form_udf("url").alias("normal_form")).withColumn("computed_hash", urls.hash_of_normal_form(F.col("normal_form")))


_PAGES = r"""pg as (select * exclude rn from (select *, row_number() over (partition by canonical_url order by crawled_at desc, stream_seq desc) rn from pages_text) where rn = 1),
    pl as (select *, case when strlen(regexp_split_to_array(lower(trim(language)), '[-_]')[1]) = 2 then regexp_split_to_array(lower(trim(language)), '[-_]')[1] end lang from pg), u as (select distinct canonical_url url from pg)"""
_PAGE_TOKENS = _TOKENS.replace("doc_id", "canonical_url").replace("from documents", "from pg")
_TITLE_WORDS = r"len(list_filter(regexp_extract_all(coalesce(title, ''), '(?:-?\p{L}|-?\p{Nd}(?:[.,]\p{Nd})*)+|[.!?]'), lambda x: length(x) >= 2))"

QUERIES["page_postings"], QUERIES["page_metadata"] = page_postings, page_metadata
SQL["page_postings"] = f"""with {_PAGES}, {_N}, {_HASHED}, {_PAGE_TOKENS}, tx as (select canonical_url, count(*) text_words, count(distinct phrase_position) phrases from p group by 1),
    o as (select canonical_url, {_HASH.format(w='word')} word_hash, cast(count(*) as int) hits, arg_min(text_position, text_position) text_position, arg_min(phrase_position, text_position) phrase_position, arg_min(phrase_relative_position, text_position) phrase_relative_position from p group by 1, 2, word)
    select o.word_hash, h.computed_hash url_hash, cast(date_diff('day', date '1970-01-01', cast(crawled_at as date)) as int) last_modified, cast({_TITLE_WORDS} as int) title_words, lang as language, 0 local_links, 0 external_links, cast(strlen(canonical_url) as int) url_length,
    cast(case when trim(h.path, '/') = '' then 0 else len(string_split(trim(h.path, '/'), '/')) end as int) url_components, hits, text_position, phrase_position, phrase_relative_position, cast(text_words as int) text_words, cast(phrases as int) phrases, 0 appearance
    from o join pl using (canonical_url) join tx using (canonical_url) join hashed h on h.url = canonical_url"""
SQL["page_metadata"] = f"""with {_PAGES}, {_N}, {_HASHED}, {_PAGE_TOKENS}, tx as (select canonical_url, count(*) wc from p group by 1)
    select h.computed_hash url_hash, canonical_url url, title descr, cast(crawled_at as date) load_day, cast(strlen(text) as int) byte_size, cast(coalesce(wc, 0) as int) wc, 't' dt, lang, 0 llocal, 0 lother from pl left join tx using (canonical_url) join hashed h on h.url = canonical_url"""


@query(f"with {_U} select url, form canonical_url from n")
def canonical_urls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "url_metadata").select("url").distinct().withColumn("canonical_url", urls.canonical_udf("url"))


# --- the ring ------------------------------------------------------------------------------------------------------

_PEERS = "p as (select distinct peer_hash, " + _pos("peer_hash") + " pos from seeds where accept_remote_index)"
_IDS = f"ids as (select word_hash, url_hash, {_ppos()} pos from (select distinct word_hash, url_hash from postings))"
_NEAR = f"near as (select word_hash, url_hash, peer_hash, d distance, cast(rk as int) rank from (select i.word_hash, i.url_hash, p.peer_hash, {_dist('i.pos', 'p.pos')} d, row_number() over (partition by i.word_hash, i.url_hash order by {_dist('i.pos', 'p.pos')}, p.peer_hash) rk from ids i, p) where rk <= 4)"
_SELF_POS = 7
_CLOSER = f"closer as (select i.word_hash, i.url_hash, count(*) filter ({_dist('i.pos', 'p.pos')} < {_dist('i.pos', str(_SELF_POS))}) closer_peers from ids i, p group by 1, 2)"


def _identities(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "postings").select("word_hash", "url_hash").distinct()


@query(f"select peer_hash, {_pos('peer_hash')} as position, cast({_pos('peer_hash')} >> 57 as int) sector from seeds")
def ring_positions(spark: SparkSession, folder: str) -> DataFrame:
    p = hashing.ring_position(F.col("peer_hash"))
    return table(spark, folder, "seeds").select("peer_hash", p.alias("position"), hashing.ring_sector(p).alias("sector"))


@query(f"select s.sector, count(peer_hash) peers from (select cast(unnest(range(64)) as int) sector) s left join (select peer_hash, cast({_pos('peer_hash')} >> 57 as int) sector from seeds where accept_remote_index) x using (sector) group by 1")
def ring_sector_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return ring.sector_histogram(peers(spark, folder))


@query(f"with {_IDS} select word_hash, url_hash, pos as position, cast((pos & {_MASK}) - ({_pos('word_hash')} & {_MASK}) as bigint) distance_from_word from ids")
def posting_positions(spark: SparkSession, folder: str) -> DataFrame:
    at = hashing.posting_position(F.col("word_hash"), F.col("url_hash"), ring.EXPONENT)
    return _identities(spark, folder).select("word_hash", "url_hash", at.alias("position"), hashing.distance_from_word(at, F.col("word_hash"), ring.EXPONENT).alias("distance_from_word"))


@query(f"with {_PEERS}, {_IDS}, {_NEAR} select word_hash, url_hash, rank, peer_hash, distance from near where rank <= 3")
def nearest_peers(spark: SparkSession, folder: str) -> DataFrame:
    return ring.nearest_peers(_identities(spark, folder), peers(spark, folder))


@query(f"with {_PEERS}, {_IDS}, {_CLOSER} select * from closer")
def closer_than_self(spark: SparkSession, folder: str) -> DataFrame:
    return ring.closer_than(_identities(spark, folder), peers(spark, folder), SELF)


_WINDOW = f"{_PEERS}, {_IDS}, {_NEAR}, {_CLOSER}, win as (select c.word_hash, c.url_hash, cast(case when closer_peers < 3 then 2 else 3 end as int) required from closer c), wins as (select w.word_hash, w.url_hash, required, string_agg(peer_hash, ' ' order by rank) closest, max(distance) farthest from win w join near n on w.word_hash = n.word_hash and w.url_hash = n.url_hash and n.rank <= required group by 1, 2, 3)"


@query(f"with {_WINDOW} select * from wins")
def replica_windows(spark: SparkSession, folder: str) -> DataFrame:
    w = ring.replica_windows(_identities(spark, folder), peers(spark, folder), SELF)
    return w.withColumn("closest", F.concat_ws(" ", "closest"))


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Holders on record: the second and fourth nearest peers."""
    return ring.nearest_peers(_identities(spark, folder), peers(spark, folder), 4).where("rank in (2, 4)").select("word_hash", "url_hash", "peer_hash")


def _reachability(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "seeds")
    return s.select("peer_hash", (F.coalesce("stored_urls", F.lit(0)) % 3 != 0).alias("reachable"), (F.coalesce("stored_urls", F.lit(0)) % 2 == 0).alias("recently_reachable"))


_STATES = f"{_WINDOW}, r as (select peer_hash, coalesce(stored_urls, 0) % 3 <> 0 reachable, coalesce(stored_urls, 0) % 2 = 0 recent from seeds), states as (select n.word_hash, n.url_hash, n.peer_hash, case when not reachable and recent then 'inside' when not reachable then 'expired' when n.distance <= w.farthest then 'inside' else 'outside' end state from near n join wins w using (word_hash, url_hash) join r using (peer_hash) where n.rank in (2, 4))"


@query(f"with {_STATES} select * from states")
def holder_states(spark: SparkSession, folder: str) -> DataFrame:
    ids, p = _identities(spark, folder), peers(spark, folder)
    return ring.holder_states(_ledger(spark, folder), ring.replica_windows(ids, p, SELF), _reachability(spark, folder))


def _offers(spark: SparkSession, folder: str) -> DataFrame:
    ids, p = _identities(spark, folder), peers(spark, folder)
    windows = materialise(ring.replica_windows(ids, p, SELF), "windows")  # both are read more than once
    states = materialise(ring.holder_states(_ledger(spark, folder), windows, _reachability(spark, folder)), "holder-states")
    return ring.offers(ids, p, states, windows, p)


_OFFERS = f"""{_STATES},
    h as (select word_hash, url_hash, count(*) filter (state = 'inside') ni, string_agg(peer_hash, ' ' order by peer_hash) filter (state in ('inside', 'outside')) holding, string_agg(peer_hash, ' ' order by peer_hash) filter (state = 'expired') ex, string_agg(peer_hash, ' ' order by peer_hash) filter (state = 'outside') ou from states group by 1, 2),
    cand as (select i.word_hash, i.url_hash, p.peer_hash, row_number() over (partition by i.word_hash, i.url_hash order by {_dist('i.pos', 'p.pos')}, p.peer_hash) r from ids i cross join p anti join (select * from states where state <> 'expired') s on s.word_hash = i.word_hash and s.url_hash = i.url_hash and s.peer_hash = p.peer_hash),
    asked as (select c.word_hash, c.url_hash, string_agg(peer_hash, ' ' order by r) asked from cand c join wins w using (word_hash, url_hash) left join h using (word_hash, url_hash) where r <= required - coalesce(ni, 0) group by 1, 2),
    offers as (select w.word_hash, w.url_hash, case when required <= coalesce(ni, 0) then coalesce(holding, '') else coalesce(asked, '') end peers, cast(greatest(required - coalesce(ni, 0), 0) as int) acceptances_needed, case when required <= coalesce(ni, 0) then concat_ws(' ', ex, ou) else coalesce(ex, '') end stale_holders
        from wins w left join h using (word_hash, url_hash) left join asked using (word_hash, url_hash))"""


@query(f"with {_OFFERS} select * from offers")
def offer_plan(spark: SparkSession, folder: str) -> DataFrame:
    o = _offers(spark, folder)
    return o.select("word_hash", "url_hash", F.concat_ws(" ", "peers").alias("peers"), "acceptances_needed", F.concat_ws(" ", "stale_holders").alias("stale_holders"))


@query(f"with {_OFFERS}, e as (select word_hash, url_hash, unnest(string_split(peers, ' ')) peer_hash from offers where peers <> '') select peer_hash, count(*) n_postings, count(distinct word_hash) n_words from e group by 1")
def offers_by_peer(spark: SparkSession, folder: str) -> DataFrame:
    return ring.grouped_by_peer(_offers(spark, folder))


@query(f"with {_STATES} select word_hash, url_hash, string_agg(peer_hash, ' ' order by peer_hash) filter (state not in ('expired', 'outside')) holders from states group by 1, 2 having count(*) filter (state not in ('expired', 'outside')) > 0")
def ledger_without_stale(spark: SparkSession, folder: str) -> DataFrame:
    states = holder_states(spark, folder)
    stale = states.groupBy("word_hash", "url_hash").agg(F.collect_set(F.when(F.col("state").isin("expired", "outside"), F.col("peer_hash"))).alias("stale_holders"))
    ledger = states.groupBy("word_hash", "url_hash").agg(F.sort_array(F.collect_set("peer_hash")).alias("holders"))
    return ring.without_holders(ledger, stale).select("word_hash", "url_hash", F.concat_ws(" ", "holders").alias("holders"))


@query(f"with {_STATES} select n.word_hash, n.url_hash, count(distinct n.peer_hash) closer_holders from near n join ids i using (word_hash, url_hash) join r using (peer_hash) where n.rank in (2, 4) and reachable and n.distance < {_dist('i.pos', str(_SELF_POS))} group by 1, 2 having count(distinct n.peer_hash) >= 2")
def handoff(spark: SparkSession, folder: str) -> DataFrame:
    return ring.handed_off(_ledger(spark, folder), SELF, _reachability(spark, folder), 2)


@query(f"with {_PEERS}, {_IDS}, {_NEAR}, f as (select cast(distance as double) / 9223372036854775808 x from near where rank = 1), b as (select cast(13 - count(*) as int) bucket from (select row_number() over () id, x from f) z, (select unnest(range(13)) i) k where x <= 1e-6 * pow(1e6, i / 12.0) group by id) select bucket, count(*) n from b group by 1")
def ring_fraction_histogram(spark: SparkSession, folder: str) -> DataFrame:
    near = ring.nearest_peers(_identities(spark, folder), peers(spark, folder), 1)
    bucket = ring.fraction_bucket(hashing.ring_fraction(F.col("distance")))
    return near.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# --- schedules -----------------------------------------------------------------------------------------------------


def _schedule(spark: SparkSession, folder: str) -> DataFrame:
    c = current(spark, folder)
    return c.select("word_hash", "url_hash", F.unix_seconds(F.col("received_at").cast("timestamp")).alias("due_at"), (F.col("hits") * 100).alias("interval"))


_T = 1751328000  # NOW in seconds
_SCHED = f"{CUR}, s as (select word_hash, url_hash, cast(floor(epoch(received_at)) as bigint) due_at, hits * 100 as \"interval\" from cur)"


@query(f"with {_SCHED} select word_hash, url_hash, due_at from s where due_at <= {_T} order by due_at, word_hash, url_hash limit 1000")
def due_offers(spark: SparkSession, folder: str) -> DataFrame:
    return ring.due(_schedule(spark, folder), F.lit(_T), 1000).select("word_hash", "url_hash", "due_at")


@query(f"with {_SCHED} select word_hash, url_hash, least(greatest(\"interval\" * 2, 300), 86400) widened, due_at + (greatest(case when {_T} >= due_at then ({_T} - due_at) // 86400 else 0 end, 0) + 1) * 86400 next_due from s")
def next_offer(spark: SparkSession, folder: str) -> DataFrame:
    s = _schedule(spark, folder)
    return s.select("word_hash", "url_hash", ring.widened(F.col("interval")).alias("widened"), ring.next_due(F.col("due_at"), F.lit(_T)).alias("next_due"))


@query(f"with {_SCHED} select greatest({_T} - min(due_at), 0) lateness from s")
def longest_lateness(spark: SparkSession, folder: str) -> DataFrame:
    return ring.longest_lateness(_schedule(spark, folder), F.lit(_T))


_ANSWERS = f"answers as (select word_hash, url_hash, peer_hash, case when (rank + length(peer_name)) % 3 <> 0 then 'accepted' else 'busy' end outcome, cast(rank * 1000 as int) pause from near join seeds using (peer_hash) where rank <= 3 and peer_name is not null)"


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    near = ring.nearest_peers(_identities(spark, folder), peers(spark, folder))
    names = table(spark, folder, "seeds").where("peer_name is not null").select("peer_hash", F.length("peer_name").alias("n"))
    rows = near.join(names, "peer_hash")
    return rows.select("word_hash", "url_hash", "peer_hash", F.when((F.col("rank") + F.col("n")) % 3 != 0, "accepted").otherwise("busy").alias("outcome"), (F.col("rank") * 1000).alias("pause"), F.lit(False).alias("unknown_url"), F.lit(True).alias("metadata_delivered"))


@query(f"with {_PEERS}, {_IDS}, {_NEAR}, {_ANSWERS} select word_hash, url_hash, count(*) filter (outcome = 'accepted') acceptances, max(pause) longest_pause, coalesce(string_agg(peer_hash, ' ' order by peer_hash) filter (outcome = 'accepted'), '') holders from answers group by 1, 2")
def acceptances(spark: SparkSession, folder: str) -> DataFrame:
    return ring.accepted(_answers(spark, folder)).withColumn("holders", F.concat_ws(" ", "holders"))


@query(f"with {_PEERS}, {_IDS}, {_NEAR}, {_ANSWERS}, {_SCHED}, o as (select word_hash, url_hash, count(*) filter (outcome = 'accepted') acceptances, max(pause) longest_pause from answers group by 1, 2) select word_hash, url_hash, case when acceptances >= 2 then due_at + (greatest(case when {_T} >= due_at then ({_T} - due_at) // 86400 else 0 end, 0) + 1) * 86400 else {_T} + greatest(least(greatest(\"interval\" * 2, 300), 86400), longest_pause) end due_at, cast(case when acceptances >= 2 then 86400 else greatest(least(greatest(\"interval\" * 2, 300), 86400), longest_pause) end as int) \"interval\" from s join o using (word_hash, url_hash)")
def rescheduled(spark: SparkSession, folder: str) -> DataFrame:
    outcome = ring.accepted(_answers(spark, folder)).withColumn("acceptances_needed", F.lit(2))
    return ring.rescheduled(_schedule(spark, folder), outcome, F.lit(_T))


# --- intake --------------------------------------------------------------------------------------------------------


@query("with n as (select stream_seq // 1000 b, count(*) c from postings group by 1) select stream_seq, case when c > 999 then 'refused' when url_hash in (select url_hash from url_metadata) then 'stored' else 'held' end route from postings join n on stream_seq // 1000 = b")
def admission_route(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "postings").select("stream_seq", "url_hash", F.expr("stream_seq div 1000").alias("batch"))
    return ingest.admission(rows, table(spark, folder, "url_metadata"), "batch", 999).select("stream_seq", "route")


def _arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """When a document's metadata came: with the first text of its page."""
    p = table(spark, folder, "pages_text").select(F.col("canonical_url").alias("url"), F.col("received_at").alias("arrived_at"))
    return table(spark, folder, "url_metadata").select("url", "url_hash").distinct().join(p, "url").select("url_hash", "arrived_at")


@query("""with a as (select url_hash, min(p.received_at) arrived_at from (select distinct url, url_hash from url_metadata) u join pages_text p on u.url = p.canonical_url group by 1),
    r as (select word_hash, url_hash, received_at held_at, arrived_at, arrived_at is not null and arrived_at <= received_at before from postings left join a using (url_hash)),
    g as (select word_hash, url_hash, before, arrived_at, max(held_at) held_at from r group by 1, 2, 3, 4)
    select word_hash, url_hash, held_at, arrived_at, case when before then 'stored' when arrived_at is not null and arrived_at - held_at <= interval 10 day then 'released' else 'expired' end outcome from g""")
def escrow_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "postings").select("word_hash", "url_hash", F.col("received_at").cast("timestamp").alias("held_at"))
    a = _arrivals(spark, folder).withColumn("arrived_at", F.col("arrived_at").cast("timestamp"))
    out = ingest.escrow(p, a, 10 * 86_400)
    return out.select("word_hash", "url_hash", F.col("held_at").cast("timestamp_ntz").alias("held_at"), F.col("arrived_at").cast("timestamp_ntz").alias("arrived_at"), "outcome")


@query(f"with {CUR} select word_hash, url_hash, received_at held_at from cur where received_at < {_NOW} order by 3, 1, 2 limit 256")
def escrow_expired(spark: SparkSession, folder: str) -> DataFrame:
    holds = current(spark, folder).select("word_hash", "url_hash", F.col("received_at").alias("held_at"))
    return ingest.expired_holds(holds, F.lit(NOW).cast("timestamp_ntz"))


@query("select count(*) duplicates from url_metadata where load_day >= date '2025-07-01' and url_hash in (select url_hash from url_metadata where load_day < date '2025-07-01')")
def metadata_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "url_metadata")
    return ingest.duplicates(m.where("load_day < '2025-07-01'"), m.where("load_day >= '2025-07-01'"), "url_hash")


@query(f"with {META} select url_hash, descr, load_day from meta")
def metadata_upsert(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "url_metadata")
    half = F.coalesce(F.col("load_day") < "2025-07-01", F.lit(True))
    return ingest.upsert(m.where(half), m.where(~half), ["url_hash"], ["stream_seq"]).select("url_hash", "descr", "load_day")


@query("select peer_hash, last_seen from seeds order by last_seen desc nulls last, peer_hash limit 256")
def roster_capacity(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.roster(table(spark, folder, "seeds"), 256).select("peer_hash", "last_seen")


@query("select peer_hash from (select peer_hash, last_seen, first_seen from seeds where not coalesce(accept_remote_index, false)) order by last_seen desc nulls last, first_seen asc nulls first, peer_hash limit 50")
def unreachable_peers(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "seeds").select("peer_hash", F.col("accept_remote_index").alias("reachable"), F.col("last_seen").alias("last_reachable"), F.col("first_seen").alias("last_contacted"))
    return ingest.unreachable(s, 50).select("peer_hash")


@query("select peer_hash, peer_name from seeds order by md5('7:' || peer_hash), peer_hash limit 100")
def known_peers_sample(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.known_sample(table(spark, folder, "seeds"), 100, 7).select("peer_hash", "peer_name")


@query("with n as (select peer_hash, url_hash, row_number() over (partition by peer_hash order by url_hash) rn from (select distinct substr(url_hash, 7, 6) peer_hash, url_hash from url_metadata)), b as (select *, cast((rn - 1) // 50 as int) batch, starts_with(url_hash, 'A') failed from n) select peer_hash, url_hash, batch, coalesce(batch < min(case when failed then batch end) over (partition by peer_hash), true) delivered from b")
def metadata_delivery(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "url_metadata").select(hashing.host_hash(F.col("url_hash")).alias("peer_hash"), "url_hash", F.startswith("url_hash", F.lit("A")).alias("failed")).distinct()
    return ingest.delivered(rows, "peer_hash", "url_hash", "failed").select("peer_hash", "url_hash", "batch", "delivered")


# --- crawl ---------------------------------------------------------------------------------------------------------

_LINKS = f"{META}, links as (select distinct r.url source, m.url target from meta m join meta r on m.referrer = r.url_hash), sd as (select url from meta where referrer is null or referrer = '')"
_HOST = r"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    m = metadata(spark, folder).select("url_hash", "url", "referrer")
    links = m.join(m.select(F.col("url_hash").alias("referrer"), F.col("url").alias("source")), "referrer").select("source", F.col("url").alias("target")).distinct()
    return m.where("referrer is null or referrer = ''").select("url"), links


@query(f"with recursive {_LINKS}, walk as (select distinct url, 0 as depth from sd where not contains(url, '?') union select l.target, w.depth + 1 from walk w join links l on l.source = w.url where w.depth < 3 and not contains(l.target, '?')) select url, cast(min(depth) as int) depth from walk group by 1")
def crawl_rounds(spark: SparkSession, folder: str) -> DataFrame:
    seeds, links = _graph(spark, folder)
    return crawl.traversal(seeds, links, crawl.Profile(max_pages=None))


@query(f"with {_LINKS} select distinct l.target url from links l where {_HOST.format(u='l.target')} in (select {_HOST.format(u='url')} from sd) and not contains(l.target, '?')")
def crawl_admission(spark: SparkSession, folder: str) -> DataFrame:
    seeds, links = _graph(spark, folder)
    return crawl.admissible(links.select(F.col("target").alias("url")).distinct(), seeds, crawl.Profile(scope="domain"))


@query(f"""with {_LINKS}, d as (select distinct regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(.*/)', 1) dir from sd),
    t as (select distinct target url, regexp_replace(target, '[?#].*$', '') bare from links), p as (select url, substr(bare, 1, unnest(list_filter(range(1, length(bare) + 1), lambda i: substr(bare, i, 1) = '/'))) dir from t)
    select distinct url from p join d using (dir) where dir <> ''""")
def scope_prefix(spark: SparkSession, folder: str) -> DataFrame:
    seeds, links = _graph(spark, folder)
    return crawl.within_scope(links.select(F.col("target").alias("url")).distinct(), seeds, "subpath")


@query(f"with {META} select url from (select url, row_number() over (partition by {_HOST.format(u='url')} order by load_day nulls first, url) rn from meta) where rn <= 5")
def per_host_cap(spark: SparkSession, folder: str) -> DataFrame:
    return crawl.capped_per_host(metadata(spark, folder).select("url", "load_day"), 5, ["load_day", "url"]).select("url")


@query(f"select canonical_url, max(crawled_at) visited_at, coalesce(epoch_us({_NOW}) - epoch_us(max(crawled_at)) >= 7776000000000, true) due from pages_text group by 1")
def recrawl_due(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "pages_text").groupBy("canonical_url").agg(F.max("crawled_at").alias("visited_at"))
    return crawl.recrawl_due(v, F.lit(NOW).cast("timestamp"), 90 * 86_400)


@query("select attempt, least(0.5 * pow(1.5, attempt - 1), 30.0) delay from (select distinct cast(hits as int) attempt from postings where hits > 0)")
def retry_delays(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "postings").where("hits > 0").select(F.col("hits").alias("attempt")).distinct().select("attempt", crawl.retry_delay(F.col("attempt")).alias("delay"))


@query("with c as (select distinct url, lower(url) low, regexp_replace(lower(url), '^http:', 'https:') last from search_documents) select distinct h url, last resolved_url from (select unnest([url, low]) h, last from c) where h <> last")
def redirect_hops(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("url")
    chains = table(spark, folder, "search_documents").select(F.array(u, F.lower(u), F.regexp_replace(F.lower(u), "^http:", "https:")).alias("chain")).distinct()
    return crawl.redirects(chains)


@query("select url, case when starts_with(url, 'http:') then 'https:' || substr(url, 6) else url end resolved_url from (select distinct url from search_documents)")
def redirect_resolution(spark: SparkSession, folder: str) -> DataFrame:
    u = table(spark, folder, "search_documents").select("url").distinct()
    moved = u.where(F.startswith("url", F.lit("http:"))).select("url", F.concat(F.lit("https:"), F.expr("substr(url, 6)")).alias("resolved_url"))
    return crawl.resolved(u, moved)


@query("select page, case when bool_and(disposal is not null) then arg_min(disposal, member) end disposal from (select regexp_replace(url, '[^/]*$', '') page, url member, case when language is null or language = '' then 'no-language' when length(content) < 500 then 'short' end disposal from search_documents) group by 1")
def container_disposal(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "search_documents")
    why = F.when(F.col("language").isNull() | (F.col("language") == ""), "no-language").when(F.length("content") < 500, "short")
    return crawl.disposal_of_members(s.select(F.regexp_replace("url", "[^/]*$", "").alias("page"), F.col("url").alias("member"), why.alias("disposal")), "page")


# --- full text -----------------------------------------------------------------------------------------------------

_CORPUS = "d as (select * exclude rn from (select *, row_number() over (partition by url order by crawled_at desc, stream_seq desc) rn from search_documents) where rn = 1)"
_LANGS = ("de", "en", "es", "fr", "it", "nl", "pl", "pt", "ru")


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    return compacted.documents(spark, folder)


def _words_index(spark: SparkSession, folder: str) -> DataFrame:
    """Words of titles and contents, kept by word."""
    return compacted.kept(spark, folder, "search_documents", "document-words", lambda: fulltext.postings(_corpus(spark, folder)), ["word", "url"])


@query(f"with {_CORPUS} select url, stream_seq, title, sha256(url) object_key, cast(('0x' || substr(sha256(url), 1, 15))::bigint as hugeint) * 8 + ('0x' || substr(sha256(url), 16, 1))::int // 2 numeric_key from d".replace("cast(('0x' || substr(sha256(url), 1, 15))::bigint as hugeint) * 8 + ('0x' || substr(sha256(url), 16, 1))::int // 2", "cast(cast(('0x' || substr(sha256(url), 1, 15))::bigint as hugeint) * 8 + ('0x' || substr(sha256(url), 16, 1))::int // 2 as bigint)"))
def latest_per_url(spark: SparkSession, folder: str) -> DataFrame:
    return fulltext.corpus(table(spark, folder, "search_documents")).select("url", "stream_seq", "title", "object_key", "numeric_key")


@query(f"with l as (select nullif(regexp_split_to_array(lower(trim(language)), '[-_]')[1], '') p from search_documents) select case when p in {_LANGS} then p else 'und' end language_index, count(*) n from l group by 1")
def language_routing(spark: SparkSession, folder: str) -> DataFrame:
    return fulltext.routed(table(spark, folder, "search_documents"), list(_LANGS)).groupBy("language_index").agg(F.count(F.lit(1)).alias("n"))


_FT = rf"""{_CORPUS}, k as (select url, title, list_transform(regexp_extract_all(coalesce(title, ''), '{tokens.TOKEN}'), lambda x: lower(x)) t, list_transform(regexp_extract_all(coalesce(content, ''), '{tokens.TOKEN}'), lambda x: lower(x)) c, language from d where coalesce(title, '') <> ''),
    s as (select url, language, len(list_filter(t, lambda x: x = 'replica')) * 3 + len(list_filter(c, lambda x: x = 'replica')) a, len(list_filter(t, lambda x: x = 'peers')) * 3 + len(list_filter(c, lambda x: x = 'peers')) b from k),
    found as (select url, cast(a + b as bigint) score from s where a > 0 and b > 0 and regexp_split_to_array(lower(trim(language)), '[-_]')[1] = 'en')"""


@query(f"with {_FT} select * from found")
def fulltext_and(spark: SparkSession, folder: str) -> DataFrame:
    return fulltext.search(_words_index(spark, folder), ["replica", "peers"], "en")


@query(f"with {_FT} select * from found order by score desc, url limit 10 offset 10")
def fulltext_paged(spark: SparkSession, folder: str) -> DataFrame:
    return fulltext.page_of(fulltext.search(_words_index(spark, folder), ["replica", "peers"], "en"), 2)


@query(rf"""with {_FT.replace("a > 0 and b > 0 and regexp_split_to_array(lower(trim(language)), '[-_]')[1] = 'en'", "a > 0")}, x as (select url, content, list_slice(regexp_extract_all(content, '(?is)\b.{{0,60}}(?:\breplica\b).{{0,60}}'), 1, 3) parts from found join d using (url))
    select url, case when len(parts) > 0 then array_to_string(parts, ' … ') else left(content, 300) end excerpt from x""")
def fulltext_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    found = _corpus(spark, folder).join(fulltext.search(_words_index(spark, folder), ["replica"]), "url")
    return found.select("url", fulltext.excerpt(F.col("content"), ["replica"]).alias("excerpt"))


@query(f"with {_CORPUS}, r as (select distinct canonical_url url from pages_text) select url, 'text' kind, case when content is null then 'unavailable' when octet_length(encode(content)) > 2000 then 'too large' else 'found' end state from r left join d using (url)")
def recall_states(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "pages_text").select(F.col("canonical_url").alias("url"))
    bodies = _corpus(spark, folder).select("url", F.col("content").alias("body"))
    return fulltext.recall(asked, {"text": bodies}, max_bytes=2000).select("url", "kind", "state")


# --- pages as HTML -------------------------------------------------------------------------------------------------


def _html_pages(spark: SparkSession, folder: str) -> DataFrame:
    p = _latest_pages(spark, folder)
    return p.select(F.col("canonical_url").alias("url"), html.page_of_text(F.col("title"), F.col("text"), F.col("language")).alias("html"))


_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(rf"with {_PAGES} select canonical_url url, regexp_replace(regexp_replace(coalesce(title, ''), '^{_SPACE}|{_SPACE}$', '', 'g'), '{_SPACE}', ' ', 'g') title, case when regexp_full_match(l, '[a-z]{{2}}') then l end as language, cast(0 as int) local_links, cast(0 as int) external_links, false refuses_indexing from (select *, regexp_split_to_array(lower(trim(language)), '[-_]')[1] l from pg)")
def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return _html_pages(spark, folder).select("url", html.extract("url", "html").alias("x")).select("url", "x.title", "x.language", "x.local_links", "x.external_links", "x.refuses_indexing")


@query(rf"""with {_PAGES}, t as (select canonical_url url, list_transform(string_split(coalesce(title, '') || coalesce(text, ''), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^{_SPACE}|{_SPACE}$', '', 'g'), '{_SPACE}', ' ', 'g')) lines from pg)
    select url, array_to_string(list_filter(lines, lambda x: x <> ''), chr(10)) full_text from t""")
def page_full_text(spark: SparkSession, folder: str) -> DataFrame:
    """Pages made of texts, flattened again: a line for each block, the title before the first."""
    return _html_pages(spark, folder).select("url", html.flatten("html").alias("full_text"))


@query()
def page_formats(spark: SparkSession, folder: str) -> DataFrame:
    return derive.formats(_html_pages(spark, folder), "html", "html", ["full_text", "readable_html", "readable_text", "markdown"]).drop("html")


# --- extension -----------------------------------------------------------------------------------------------------


@query("select time_bucket(interval 1 hour, ts) window_start, event_type, count(*) n, count(distinct user_id) users from events group by 1, 2")
def event_window_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tumbling windows of an hour over events: an extension."""
    e = table(spark, folder, "events").withColumn("t", F.col("ts").cast("timestamp"))
    out = e.groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "users")
