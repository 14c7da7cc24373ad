"""Stored forms: keys whose bytes sort like their parts, and values of postings, metadata and peers.

Parquet needs none of these; they are for files that other programs read or wrote. Writers are columns in the JVM;
readers of several numbers in a row walk over the bytes and are Arrow batches.
"""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HEX, _COMPLEMENT = "0123456789ABCDEF", "FEDCBA9876543210"
#: Numbers of a stored posting in their order.
POSTING = (
    "last_modified", "title_words", "text_words", "phrases", "document_type", "local_links", "external_links", "url_length", "url_components",
    "appearance", "hits", "text_position", "phrase_relative_position", "phrase_position",
)
DAYS, NUMBERS = ("mod_day", "load_day", "fresh_day"), ("byte_size", "wc", "llocal", "lother", "limage", "laudio", "lvideo", "lapp")


# --- keys ----------------------------------------------------------------------------------------------------------


def text_part(text: Column) -> Column:
    """A key part of fixed width: the bytes of a text."""
    return F.encode(text, "utf-8")


def number_part(number: Column) -> Column:
    """Eight bytes that sort like the number."""
    return F.unhex(F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(-(2**63)).cast("long"))), 16, F.lit("0")))


def descending(part: Column) -> Column:
    """A part in the other order: each byte's complement. Twice gives the part again."""
    return F.unhex(F.translate(F.hex(part), _HEX, _COMPLEMENT))


def key(*parts: Column) -> Column:
    """A single, pair or triple key."""
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def part(key_: Column, start: int, width: int) -> Column:
    return F.substring(key_, start + 1, width)


def text_of(part_: Column) -> Column:
    return F.decode(part_, "utf-8")


def number_of(part_: Column) -> Column:
    """The number of eight bytes."""
    return (F.conv(F.hex(part_), 16, 10).cast("decimal(20,0)") - F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")


# --- values --------------------------------------------------------------------------------------------------------


def varint(number: Column) -> Column:
    """Seven bits a byte, the lowest first, the eighth bit set but for the last; of a number from 0 up to 2^35."""
    n = number.cast("long")
    out = None
    for i in range(5):
        more = F.shiftrightunsigned(n, 7 * (i + 1)) > 0
        byte = F.shiftrightunsigned(n, 7 * i).bitwiseAND(127).bitwiseOR(F.when(more, 128).otherwise(0))
        here = F.lpad(F.hex(byte), 2, F.lit("0"))
        out = here if out is None else F.concat(out, F.when(F.shiftrightunsigned(n, 7 * i) > 0, here).otherwise(F.lit("")))
    return F.unhex(out)


def zigzag(number: Column) -> Column:
    """Signed numbers as even and odd ones."""
    n = number.cast("long")
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def record(payload: Column) -> Column:
    """A payload behind the length of its metadata, of which there is none."""
    return F.concat(varint(F.lit(0)), payload)


def payload_of(record_: Column) -> Column:
    """What follows the metadata of a record, of less than 128 bytes; null for a broken one."""
    size = F.conv(F.hex(F.substring(record_, 1, 1)), 16, 10).cast("int")
    return F.when(F.octet_length(record_) > size, F.substr(record_, size + 2))


def posting_value() -> Column:
    """A posting's numbers and language as bytes; no language is an empty one."""
    lang = F.coalesce("language", F.lit(""))
    return record(F.concat(*[varint(zigzag(F.coalesce(c, F.lit(0)))) for c in POSTING], varint(F.octet_length(lang)), F.encode(lang, "utf-8")))


def day_value(day: Column) -> Column:
    """Year, month and day; a null day has the year zero."""
    return F.concat(*[varint(F.coalesce(x, F.lit(0))) for x in (F.year(day), F.month(day), F.dayofmonth(day))])


def metadata_value() -> Column:
    """A metadata row's days and numbers as bytes."""
    return record(F.concat(*[day_value(F.col(c)) for c in DAYS], *[varint(F.coalesce(c, F.lit(0))) for c in NUMBERS]))


def roster_value(times: list[Column], seed: Column) -> Column:
    """Four times (microseconds, null is 0) and a seed line with its length in front."""
    return record(F.concat(*[number_part(F.coalesce(t, F.lit(0)).cast("long")) for t in times], varint(F.octet_length(seed)), F.encode(seed, "utf-8")))


def _numbers(data: bytes, at: int, n: int) -> tuple[list[int], int]:
    out = []
    for _ in range(n):
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        out.append(value)
    return out, at


def _body(data: bytes) -> int:
    """Where the payload begins."""
    (size,), at = _numbers(data, 0, 1)
    return at + size


_POSTING = T.StructType([T.StructField(c, T.IntegerType()) for c in POSTING] + [T.StructField("language", T.StringType())])


@F.pandas_udf(_POSTING)
def read_posting(value: pd.Series) -> pd.DataFrame:
    """A stored posting; null throughout for a null or broken value."""
    rows = []
    for data in value:
        try:
            numbers, at = _numbers(data, _body(data), len(POSTING) + 1)
            lang = data[at : at + numbers[-1]].decode()
            rows.append([*[(n >> 1) ^ -(n & 1) for n in numbers[:-1]], lang or None])
        except (IndexError, TypeError, UnicodeDecodeError):
            rows.append([None] * (len(POSTING) + 1))
    return pd.DataFrame({c: pd.array([r[i] for r in rows], dtype="Int32") for i, c in enumerate(POSTING)} | {"language": [r[-1] for r in rows]})


_METADATA = T.StructType([T.StructField(c, T.DateType()) for c in DAYS] + [T.StructField(c, T.IntegerType()) for c in NUMBERS])


@F.pandas_udf(_METADATA)
def read_metadata(value: pd.Series) -> pd.DataFrame:
    """Stored days and numbers of a document."""
    rows = []
    for data in value:
        try:
            n, _ = _numbers(data, _body(data), 9 + len(NUMBERS))
            rows.append([*[datetime.date(*n[i : i + 3]) if n[i] else None for i in (0, 3, 6)], *n[9:]])
        except (IndexError, TypeError, ValueError):
            rows.append([None] * (3 + len(NUMBERS)))
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(DAYS)} | {c: pd.array([r[3 + i] for r in rows], dtype="Int32") for i, c in enumerate(NUMBERS)})


def read_roster(value: Column) -> Column:
    """``times`` (null for 0) and ``seed`` of a stored peer, whose seed has less than 16,384 bytes."""
    p = payload_of(value)
    times = F.array(*[F.nullif(number_of(F.substring(p, 1 + 8 * i, 8)), F.lit(0).cast("long")) for i in range(4)])
    long = F.conv(F.hex(F.substring(p, 33, 1)), 16, 10).cast("int") >= 128
    return F.struct(times.alias("times"), F.decode(F.substr(p, F.when(long, 35).otherwise(34)), "utf-8").alias("seed"))
