"""Larger messages of peers and services: news, requests, responses, chunks and orders, and checks of their values."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import hashing, wire

# Names of the five standard columns of a news record, and its greatest length.
NEWS = ("ori", "cat", "cre", "rec", "dis")
NEWS_BYTES = 1024
CHUNK_JSON = "Kind string, CanonicalURL string, Metadata array<map<string,string>>, Postings array<struct<word_hash:string,url_hash:string,hits:int,text_position:int>>"
ORDER_JSON = "OrderID string, Profile struct<Name:string,Scope:string,URLMustMatch:string,URLMustNotMatch:string,MaxDepth:int,AllowQueryURLs:boolean,MaxPagesPerHost:int,IgnoresIndexingRefusal:boolean>, SeedURLs array<string>"


def version(text: Column) -> Column:
    """``release`` and ``revision`` of a packed version number; null if it isn't one."""
    ok = text.rlike(r"^\d+\.\d{1,3}\d{0,5}$")
    revision = F.regexp_extract(text, r"^\d+\.\d{1,3}(\d{0,5})$", 1)
    return F.when(ok, F.struct(F.regexp_extract(text, r"^(\d+\.\d{1,3})", 1).cast("double").alias("release"), F.coalesce(revision.try_cast("int"), F.lit(0)).alias("revision")))


def version_text(release: Column, revision: Column) -> Column:
    return F.concat(F.format_string("%.3f", release), revision.cast("string"))


def peer_name(hash_: Column, adjectives: list[str], nouns: list[str]) -> Column:
    """A name made of a hash: two words picked by bytes of its md5, and a number of four digits. The words are a parameter."""
    hex_ = F.md5(hash_.cast("binary"))
    number = lambda at, n: F.conv(F.substring(hex_, at, n), 16, 10).cast("int")
    pick = lambda words, at: F.element_at(F.array(*[F.lit(w) for w in words]), number(at, 2) % len(words) + 1)
    return F.concat_ws("-", pick(adjectives, 1), pick(nouns, 3), F.lpad((number(5, 4) % 10_000).cast("string"), 4, F.lit("0")))


def news_text(originator: Column, category: Column, created: Column, received: Column, distributed: Column, attributes: Column) -> Column:
    """A framed news record; attributes in the order of their names."""
    kv = lambda k, v: F.concat(F.lit(k + "="), v)
    more = F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    parts = F.concat(F.array_compact(F.array(kv(NEWS[0], originator), kv(NEWS[1], category), kv(NEWS[2], wire.short_second(created)), F.when(received.isNotNull(), kv(NEWS[3], wire.short_second(received))), kv(NEWS[4], distributed.cast("string")))), more)
    return wire.framed(F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}")))


def read_news(plain: Column, categories: list[str]) -> Column:
    """A news record of its unframed text, null if it is too long, its originator no hash, its category unknown or its time missing."""
    p = wire.properties(F.regexp_replace(F.regexp_replace(plain, r"^[^{]*\{", ""), r"\}[^}]*$", ""))
    get = lambda k: F.element_at(p, F.lit(k))
    created = wire.read_short_second(get(NEWS[2]))
    ok = (F.octet_length(plain) <= NEWS_BYTES) & hashing.is_hash(get(NEWS[0])) & get(NEWS[1]).isin(*categories) & created.isNotNull()
    attributes = F.map_filter(p, lambda k, _: ~k.isin(*NEWS))
    return F.when(ok, F.struct(get(NEWS[0]).alias("originator"), get(NEWS[1]).alias("category"), created.alias("created"), wire.read_short_second(get(NEWS[3])).alias("received"), F.coalesce(get(NEWS[4]).try_cast("int"), F.lit(0)).alias("distributed"), attributes.alias("attributes")))


def request_form(text: str) -> dict[str, str]:
    """A request's form: the first value of each field."""
    out: dict[str, str] = {}
    for k, v in parse_qsl(text, keep_blank_values=True):
        out.setdefault(k, v)
    return out


def request_text(form: dict[str, str]) -> str:
    return urlencode({k: v for k, v in form.items() if v})


def search_response(results: DataFrame, rows: DataFrame, counts: DataFrame | None, abstracts: DataFrame | None, seconds_ms: int, topics: list[str], join_count: int) -> str:
    """The message that answers a search. All parts are bounded: results by their limit, counts and abstracts by the terms."""
    lines = {"searchtime": str(seconds_ms), "references": ",".join(topics), "joincount": str(join_count), "count": str(results.count())}
    for i, r in enumerate(rows.collect()):
        lines[f"resource{i}"] = r[0]
    for r in counts.collect() if counts is not None else ():
        lines[f"indexcount.{r[0]}"] = str(r[1])
    for r in abstracts.collect() if abstracts is not None else ():
        lines[f"indexabstract.{r[0]}"] = r[1]
    return "".join(f"{k}={lines[k]}\n" for k in sorted(lines))


def chunk_json(kind: Column, url: Column, postings: Column) -> Column:
    return F.to_json(F.struct(kind.alias("Kind"), url.alias("CanonicalURL"), postings.alias("Postings")))


def read_chunk(text: Column) -> Column:
    """A chunk, null unless its kind is known and it has an address."""
    c = F.from_json(text, CHUNK_JSON)
    return F.when(c["Kind"].isin("metadata", "posting") & (c["CanonicalURL"] != ""), c)


def read_order(text: Column) -> Column:
    """A crawl order, null unless it has an id and seeds."""
    o = F.from_json(text, ORDER_JSON)
    return F.when((F.coalesce(o["OrderID"], F.lit("")) != "") & (F.size(o["SeedURLs"]) > 0), o)


def byte_size(text: Column) -> Column:
    """Bytes of a size with a unit from B to TB, in powers of 1,024; null if it isn't one."""
    unit = F.regexp_extract(F.upper(text), r"^\s*\d+\s*([KMGT]?B)\s*$", 1)
    number = F.regexp_extract(text, r"^\s*(\d+)", 1).try_cast("long")
    factor = F.when(unit == "B", 1).when(unit == "KB", 1 << 10).when(unit == "MB", 1 << 20).when(unit == "GB", 1 << 30).when(unit == "TB", 1 << 40)
    return number * factor


def is_host_name(text: Column) -> Column:
    """Labels of letters, digits and inner hyphens, 63 at most each, 255 in all."""
    label = r"(?!-)[A-Za-z0-9-]{1,63}(?<!-)"
    return F.coalesce((F.octet_length(text) <= 255) & text.rlike(rf"^{label}(?:\.{label})*$"), F.lit(False))


def is_peer_name(text: Column, shortest: int = 3, longest: int = 80) -> Column:
    return F.coalesce(text.rlike(rf"^[A-Za-z0-9_-]{{{shortest},{longest}}}$"), F.lit(False))


def is_port(number: Column) -> Column:
    return F.coalesce(number.between(1, 65_535), F.lit(False))


def are_coordinates(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def are_tags(tags: Column, most: int = 64, longest: int = 100) -> Column:
    return F.coalesce((F.size(tags) <= most) & F.forall(tags, lambda t: F.octet_length(t) <= longest), F.lit(False))
