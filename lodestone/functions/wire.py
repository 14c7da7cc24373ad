"""Texts that peers exchange, as columns: postings, metadata rows, seeds, messages, and the values in them."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import hashing

BATCH = 1000
# Days a date column counts before it wraps; bits of the flags in a bit field; types by character.
MICRO_DATE_MODULUS = 262144
APPEARANCE_BITS = (0, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29)
DOCUMENT_TYPES = {"t": "text", "h": "html", "d": "document", "i": "image", "m": "movie", "f": "flash", "s": "share", "a": "audio", "p": "pdf", "b": "binary", "u": "unknown"}
CAPABILITY_BITS = {"direct_connect": 0, "accept_remote_crawl": 1, "accept_remote_index": 2, "root_node": 3, "ssl_available": 4}
MAX_INFLATED = 1 << 20


def properties(body: Column) -> Column:
    """``k=v`` pairs parted by commas as a map, blanks trimmed, the last of equal keys; null if a part has no key."""
    even = F.regexp_replace(F.regexp_replace(F.trim(body), r"\s*,[\s,]*", ","), r"^,|,$", "")
    even = F.regexp_replace(even, r"(^|,)\s*([^=,]*?)\s*=\s*", "$1$2=")
    bad = even.rlike(r"(?:^|,)(?:=|[^=,]+(?:,|$))")
    twice = even.rlike(r"(?:^|,)([^=,]+)=.*,\1=")
    pairs = F.transform(F.split(even, ","), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substr(p, F.instr(p, "=") + 1).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    last = F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda x: x["k"] == k), -1)["v"].alias("v")))
    none = F.create_map().cast("map<string,string>")
    return F.when(even == "", none).when(bad, None).when(twice, F.map_from_entries(last)).otherwise(F.str_to_map(even, F.lit(","), F.lit("=")))


def once(column: Column) -> Column:
    """A column that is computed once a row, however often it is referred to: the optimizer doesn't look through a generator."""
    return F.explode(F.array(column))


def decimal_prefix(text: Column) -> Column:
    """The number a text begins with after blanks, 0 if none; what exceeds 64 bits is 0."""
    return F.coalesce(F.regexp_extract(text, r"^ *([+-]?\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def cardinal(text: Column, mask: int) -> Column:
    """A decimal prefix cut to the width of its column, as two's complement."""
    return decimal_prefix(text).bitwiseAND(F.lit(mask).cast("long")).cast("int")


def micro_date(text: Column) -> Column:
    """Days since 1970 as they are written: modulo the width of the column."""
    return F.pmod(decimal_prefix(text), F.lit(MICRO_DATE_MODULUS)).cast("int")


def bitfield_number(text: Column) -> Column:
    """The four bytes of a bit field in symbols as a number; null if it isn't one."""
    return F.conv(F.rpad(F.hex(hashing.decode64(text)), 8, F.lit("0")), 16, 10).cast("long")


def bitfield_mask(number: Column) -> Column:
    """The appearance mask of that number."""
    bits = [F.shiftright(number, 8 * (3 - (b >> 3)) + (b & 7)).bitwiseAND(1) * (1 << i) for i, b in enumerate(APPEARANCE_BITS)]
    return reduce(lambda a, b: a + b, bits).cast("int")


def bitfield(mask: Column) -> Column:
    """An appearance mask as a bit field of four bytes in symbols."""
    bytes_ = []
    for slot in range(4):
        bits = [F.shiftleft(F.shiftright(mask, i).bitwiseAND(1), b & 7) for i, b in enumerate(APPEARANCE_BITS) if b >> 3 == slot]
        bytes_.append(F.lpad(F.hex(reduce(lambda a, b: a + b, bits) if bits else F.lit(0)), 2, F.lit("0")))
    return hashing.encode64(F.unhex(F.concat(*bytes_)))


#: Cardinal columns of a posting line: name, key, mask.
_CARDINALS = (
    ("title_words", "u", 0xFF), ("text_words", "w", 0xFFFF), ("phrases", "p", 0xFFFF), ("local_links", "x", 0xFF), ("external_links", "y", 0xFF),
    ("url_length", "m", 0xFF), ("url_components", "n", 0xFF), ("hits", "c", 0xFF), ("text_position", "t", 0xFFFF),
    ("phrase_relative_position", "r", 0xFF), ("phrase_position", "o", 0xFF),
)


#: Keys of a posting line that are read.
_KEYS = ("h", "l", "z", "a", "d", *(k for _, k, _ in _CARDINALS))
_BLANKS = " \t\n\x0b\f\r"


def _pairs(body: str) -> dict[str, str] | None:
    """What ``properties`` gives, for one text."""
    out = {}
    for part in body.strip(" ").split(","):
        if part := part.strip(_BLANKS):
            k, eq, v = part.partition("=")
            k = k.rstrip(_BLANKS)
            if not eq or not k:
                return None
            out[k] = v.lstrip(_BLANKS)
    return out


def _fields(lines: DataFrame, line: str, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns, ``word_hash``, and the fields of each line that is one, as texts: taken apart once, batch by batch."""
    rows = lines.select(*keep, F.rtrim(F.col(line), F.lit("\r")).alias("__line")).where("__line like '%{%}'")
    kept = rows.schema[:-1]
    names = [*(f.name for f in kept), "word_hash", *(f"__{k}" for k in _KEYS)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "word_hash string", *(f"__{k} string" for k in _KEYS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, words, found = [], [], []
            for i, text in enumerate(b.column(len(kept)).to_pylist()):
                word, _, rest = text.partition("{")
                fields = _pairs(rest[:-1])
                if fields is not None:
                    at.append(i)
                    words.append(word)
                    found.append(fields)
            taken = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns[:-1], pa.array(words, pa.string()), *(pa.array([f.get(k) for f in found], pa.string()) for k in _KEYS)], names=names)

    return rows.mapInArrow(run, schema)


def read_postings(lines: DataFrame, line: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Postings of lines ``wordhash{k=v,...}``. Lines that are none, or have a bad hash, language or flags, are dropped."""
    get = lambda k: F.col(f"__{k}")
    kinds = F.create_map(*[x for c, t in DOCUMENT_TYPES.items() for x in (F.lit(ord(c)), F.lit(t))])
    rows = _fields(lines, line, keep).where(hashing.is_hash(F.col("word_hash")))
    columns = [get("h").alias("url_hash"), F.substring(get("l"), 1, 2).alias("language"), F.when(get("z").isNull(), F.lit(0).cast("long")).otherwise(bitfield_number(get("z"))).alias("flags")]
    numbers = [micro_date(get("a")).alias("last_modified"), F.element_at(kinds, cardinal(get("d"), 0xFF)).alias("document_type"), *[F.coalesce(cardinal(get(k), m), F.lit(0)).alias(n) for n, k, m in _CARDINALS]]
    rows = rows.select(*keep, "word_hash", *columns, *numbers)
    rows = rows.where(hashing.is_hash(F.col("url_hash")) & F.col("flags").isNotNull() & (F.col("language").isNull() | (F.octet_length("language") == 2)))
    names = ["last_modified", "document_type", *[n for n, _, _ in _CARDINALS]]
    return rows.select(*keep, "word_hash", "url_hash", "language", bitfield_mask(F.col("flags")).alias("appearance"), *names)


def read_batch(batch: DataFrame, batch_id: str, raw: str, limit: int = BATCH) -> DataFrame:
    """Postings of whole transfers, the first ``limit`` good lines of each; ``batch_id`` names a transfer."""
    lines = batch.select(batch_id, F.posexplode(F.split(raw, "\n")).alias("line_no", "line")).where("trim(line) <> ''")
    n = F.row_number().over(W.partitionBy(batch_id).orderBy("line_no"))
    return read_postings(lines, "line", (batch_id, "line_no")).withColumn("__n", n).where(F.col("__n") <= limit).drop("__n", "line_no")


def posting_line(doc_type: Column | None = None) -> Column:
    """A posting as a line, keys in order."""
    c = lambda n: F.col(n).cast("string")
    kind = F.ascii(doc_type) if doc_type is not None else F.col("document_type")
    values = {
        "a": F.pmod(F.col("last_modified"), F.lit(MICRO_DATE_MODULUS)).cast("string"), "c": c("hits"), "d": kind.cast("string"), "h": F.col("url_hash"), "l": F.col("language"), "m": c("url_length"), "n": c("url_components"),
        "o": c("phrase_position"), "p": c("phrases"), "r": c("phrase_relative_position"), "t": c("text_position"), "u": c("title_words"), "w": c("text_words"), "x": c("local_links"), "y": c("external_links"), "z": bitfield(F.col("appearance")),
    }
    return F.concat(F.col("word_hash"), F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(k + "="), v) for k, v in values.items()]), F.lit("}"))


@F.pandas_udf(T.StringType())
def _inflated(data: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        try:
            out = gzip.GzipFile(fileobj=io.BytesIO(b)).read(MAX_INFLATED + 1)
            return out.decode() if len(out) <= MAX_INFLATED else None
        except (OSError, EOFError, UnicodeDecodeError):
            return None

    return data.map(one)


def unframed(text: Column) -> Column:
    """Payload of ``p|`` plain, ``b|`` symbols and ``z|`` gzip in symbols; text without a frame as it is; null if bad."""
    body, tag = F.substr(text, F.lit(3)), F.substring(text, 1, 1)
    framed = F.substring(text, 2, 1) == "|"
    return F.when(~F.coalesce(framed, F.lit(False)), text).when(tag == "p", body).when(tag == "b", hashing.decode64(body).cast("string")).when(tag == "z", _inflated(hashing.decode64(body)))


def framed(text: Column) -> Column:
    return F.concat(F.lit("b|"), hashing.encode64(F.coalesce(text, F.lit("")).cast("binary")))


def short_day(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyyMMdd"), F.lit(""))


def read_short_day(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def short_second(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyyMMddHHmmss"), F.lit(""))


def read_short_second(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{14}$"), F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")))


_METADATA_TEXTS = ("url", "descr", "author", "tags", "publisher", "mime", "snippet", "favicon")
_METADATA_NUMBERS = (("size", "byte_size"), ("wc", "wc"), ("llocal", "llocal"), ("lother", "lother"), ("limage", "limage"), ("laudio", "laudio"), ("lvideo", "lvideo"), ("lapp", "lapp"))


def _degrees(c: str) -> Column:
    v = F.coalesce(F.col(c), F.lit(0.0))
    return F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))


def metadata_row(flags: Column) -> Column:
    """A metadata row as ``{k=v,...}``: texts framed, days short, empty optional columns left out."""
    kv = lambda k, v: F.concat(F.lit(k + "="), v)
    optional = lambda k, c, v: F.when(F.coalesce(F.col(c), F.lit("")) != "", kv(k, v))
    number = lambda k, c: kv(k, F.coalesce(F.col(c), F.lit(0)).cast("string"))
    hex_ = F.hex(F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(flags, 8 * i).bitwiseAND(255)), 2, F.lit("0"))) for i in range(4)]))
    parts = [
        kv("hash", F.col("url_hash")), *[kv(k, framed(F.col(k))) for k in _METADATA_TEXTS[:5]], kv("lat", _degrees("lat")), kv("lon", _degrees("lon")),
        *[kv(k, short_day(F.col(c))) for k, c in (("mod", "mod_day"), ("load", "load_day"), ("fresh", "fresh_day"))], kv("referrer", F.coalesce("referrer", F.lit(""))),
        number("size", "byte_size"), number("wc", "wc"), kv("dt", F.coalesce("dt", F.lit("u"))), optional("mime", "mime", framed(F.col("mime"))), kv("flags", hashing.encode64(F.unhex(hex_))),
        F.when(F.octet_length("lang") == 2, kv("lang", F.col("lang"))), *[number(k, c) for k, c in _METADATA_NUMBERS[2:]],
        optional("snippet", "snippet", framed(F.col("snippet"))), optional("favicon", "favicon", framed(F.col("favicon"))),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def read_metadata(rows: DataFrame, row: str = "row", keep: tuple[str, ...] = ()) -> DataFrame:
    """Metadata of rows ``{k=v,...}``; rows that are none, or have no address, are dropped."""
    text = F.col(row)
    body = F.when(F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}")) & (F.length(text) >= 2), F.substr(text, F.lit(2), F.length(text) - 2))
    p = rows.select("*", once(properties(body)).alias("__p")).where("__p is not null")
    get = lambda k: F.element_at("__p", F.lit(k))
    degrees = {k: get(k).try_cast("double") for k in ("lat", "lon")}
    nowhere = (degrees["lat"] == 0) & (degrees["lon"] == 0)
    return p.select(
        *keep, *[unframed(get(k)).alias(k) for k in _METADATA_TEXTS], *[F.when(~nowhere, v).alias(k) for k, v in degrees.items()],
        *[read_short_day(get(k)).alias(c) for k, c in (("mod", "mod_day"), ("load", "load_day"), ("fresh", "fresh_day"))], F.nullif(get("referrer"), F.lit("")).alias("referrer"),
        *[F.coalesce(get(k).try_cast("int"), F.lit(0)).alias(c) for k, c in _METADATA_NUMBERS], F.substring(get("dt"), 1, 1).alias("dt"), F.when(F.octet_length(get("lang")) == 2, get("lang")).alias("lang"),
    ).where("url <> ''")


def capabilities(text: Column) -> Column:
    """Five flags in four characters of five bits above the blank."""
    value = F.coalesce(F.ascii(F.substring(text, 1, 1)) - 32, F.lit(0))
    return F.struct(*[(F.shiftright(value, bit).bitwiseAND(1) == 1).alias(name) for name, bit in CAPABILITY_BITS.items()])


def capabilities_text(flags: Column) -> Column:
    total = reduce(lambda a, b: a + b, [F.coalesce(flags[name], F.lit(False)).cast("int") * (1 << bit) for name, bit in CAPABILITY_BITS.items()])
    return F.concat(F.char(total + 32), F.lit("   "))


def tag_list(text: Column) -> Column:
    """Tags between bars; ``*`` stands for all (an empty array)."""
    return F.when(F.coalesce(text, F.lit("")).isin("*", ""), F.array().cast("array<string>")).otherwise(F.filter(F.split(text, r"\|"), lambda t: t != ""))


def tag_text(tags: Column) -> Column:
    return F.when(F.size(tags) == 0, F.lit("*")).otherwise(F.array_join(tags, "|"))


def utc_offset(text: Column) -> Column:
    """Minutes east of ``±HHMM``; null if it isn't that."""
    part = lambda i: F.regexp_extract(text, r"^([+-])(\d\d)(\d\d)$", i)
    minutes = part(2).try_cast("int") * 60 + part(3).try_cast("int")
    return F.when(part(1) == "-", -minutes).otherwise(minutes)


def utc_offset_text(minutes: Column) -> Column:
    a = F.abs(minutes)
    return F.concat(F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.floor(a / 60).cast("string"), 2, F.lit("0")), F.lpad((a % 60).cast("string"), 2, F.lit("0")))


def read_message(data: Column) -> Column:
    """``key=value`` lines as a map: blank lines and ``#`` comments left out, the first ``=`` without a backslash parts."""
    lines = F.filter(F.transform(F.split(data, "\n"), lambda x: F.trim(x)), lambda x: ~F.startswith(x, F.lit("#")) & x.rlike(r"^.(?:\\=|[^=])*=") & ~F.startswith(x, F.lit("=")))
    unescape = lambda t: F.replace(F.replace(F.replace(F.replace(t, F.lit("\\\\"), F.lit("\x00")), F.lit("\\n"), F.lit("\n")), F.lit("\\="), F.lit("=")), F.lit("\x00"), F.lit("\\"))
    pattern = r"(?s)^(.(?:\\=|[^=\\]|\\(?!=))*)=(.*)$"
    pairs = F.transform(lines, lambda x: F.struct(unescape(F.trim(F.regexp_extract(x, pattern, 1))).alias("k"), unescape(F.trim(F.regexp_extract(x, pattern, 2))).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda x: x["k"] == k), -1)["v"].alias("v"))))


def message_text(message: Column) -> Column:
    """A map as ``key=value`` lines in the order of the keys."""
    entries = F.array_sort(F.map_entries(message))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit("\n"))), "")


def seed_line(columns: dict[str, Column]) -> Column:
    """A seed as a framed property form; columns with null are left out."""
    return framed(F.concat(F.lit("{"), F.concat_ws(",", *[F.when(v.isNotNull(), F.concat(F.lit(k + "="), v.cast("string"))) for k, v in columns.items()]), F.lit("}")))


def read_seeds(lines: DataFrame, line: str = "line", max_bytes: int = 4096) -> DataFrame:
    """Seeds of framed lines; those that are too long, or have no hash, are dropped."""
    plain = lines.select(unframed(F.col(line)).alias("t")).where(F.octet_length("t") <= max_bytes)
    body = F.regexp_replace(F.regexp_replace(F.col("t"), r"^[^{]*\{", ""), r"\}[^}]*$", "")
    p = plain.select(once(properties(body)).alias("p")).where("p is not null")
    get = lambda k: F.element_at("p", F.lit(k))
    return p.where(hashing.is_hash(get("Hash"))).select(
        get("Hash").alias("peer_hash"), F.nullif(get("Name"), F.lit("")).alias("peer_name"), get("PeerType").alias("peer_type"), get("Port").try_cast("int").alias("port"),
        tag_list(get("Tags")).alias("tags"), F.when(get("Flags").isNotNull(), capabilities(get("Flags"))).alias("capabilities"), read_short_second(get("BDate")).alias("first_seen"),
        read_short_second(get("LastSeen")).alias("last_seen"), F.coalesce(get("LCount").try_cast("long"), F.lit(0)).alias("stored_urls"), F.coalesce(get("ICount").try_cast("long"), F.lit(0)).alias("indexed_words"),
        utc_offset(get("UTC")).alias("utc_offset"),
    )


def abstract(hashes: Column) -> Column:
    """Distinct-site form of document hashes: ``{site:paths,...}``, sites and paths in the order of the alphabet."""
    by = lambda h: hashing.alphabet_order(h)
    sites = F.transform(F.array_sort(F.transform(F.array_distinct(F.transform(hashes, lambda h: F.substring(h, 7, 6))), lambda s: F.struct(by(s).alias("o"), s.alias("s")))), lambda x: x["s"])
    paths = lambda s: F.array_join(F.transform(F.array_sort(F.transform(F.filter(hashes, lambda h: F.substring(h, 7, 6) == s), lambda h: F.struct(by(F.substring(h, 1, 6)).alias("o"), F.substring(h, 1, 6).alias("p")))), lambda x: x["p"]), "")
    return F.concat(F.lit("{"), F.array_join(F.transform(sites, lambda s: F.concat(s, F.lit(":"), paths(s))), ","), F.lit("}"))



def constraint_mask(text: Column) -> Column:
    """The appearance a search asks for, as a mask; null for none: an empty field, or one without a flag or with all its 32 bits set."""
    number = bitfield_number(F.nullif(F.trim(text), F.lit("")))
    mask = bitfield_mask(number)
    return F.when(number.isNotNull() & (mask != 0) & (number != 0xFFFFFFFF), mask)


def client_address(peer: Column, forwarded: Column, trusted: list[str]) -> Column:
    """Address a request comes from: the first that was forwarded, if the peer is in a trusted network (IPv4, ``a.b.c.d/n``)."""
    number = lambda ip: F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.try_cast("long"))
    v4 = peer.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
    within = F.lit(False)
    for network in trusted:
        base, _, bits = network.partition("/")
        shift = 32 - int(bits or 32)
        at = sum(int(x) << 8 * (3 - i) for i, x in enumerate(base.split(".")))
        within = within | (F.shiftright(number(peer), shift) == at >> shift)
    first = F.nullif(F.trim(F.element_at(F.split(forwarded, ","), 1)), F.lit(""))
    return F.when(v4 & within, F.coalesce(first, peer)).otherwise(peer)
