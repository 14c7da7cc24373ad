"""What peers send each other to hand over postings and metadata: request forms and responses as maps of text.

A batch of transfers is a table with a row per transfer; lines inside of a field are taken apart by the readers of
``functions.wire``. A response is a message (``wire.message_text``, ``wire.read_message``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import hashing, wire

# Names of the results, the longest failure report in bytes, and what stands for an empty one.
RESULTS = ("ok", "busy", "not_granted", "too high load", "wrong_target")
REPORT_BYTES, NO_REPORT = 512, "no reported body"
NETWORK = "freeworld"
_UNIT = "network.unit.name"


def _form(**fields: Column) -> Column:
    """Fields that aren't null as a map of text."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _field(form: Column, name: str) -> Column:
    return F.element_at(form, F.lit(name))


def _count(text: Column) -> Column:
    """A number that may be left out; what is no number is null, an empty one 0."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", 0).otherwise(F.trim(text).try_cast("int"))


def transfer_key(entry_count: Column) -> Column:
    """Key of a transfer of so many entries."""
    return F.md5(entry_count.cast("string"))


def posting_requests(lines: DataFrame, transfer: str, sender: Column, receiver: Column, line: str = "line") -> DataFrame:
    """``transfer, form``: requests with the postings of each transfer, a line each in their own order.

    Transfers are bounded groups, such as those of ``index.chunks``: a request is one value.
    """
    rows = lines.groupBy(transfer).agg(F.sort_array(F.collect_list(line)).alias("__l"), F.count_distinct(F.substring(line, 1, 12)).alias("__w"))
    n = F.size("__l")
    return rows.select(transfer, _form(**{_UNIT: F.lit(NETWORK)}, iam=sender, youare=receiver, wordc=F.col("__w"), entryc=n, indexes=F.array_join("__l", "\n"), key=transfer_key(n)).alias("form"))


def read_posting_requests(requests: DataFrame, transfer: str, form: str = "form") -> DataFrame:
    """``transfer, iam, youare, word_count, entry_count, key_fits, lines``; a request with a bad hash or count is left out."""
    f = F.col(form)
    n = _count(_field(f, "entryc"))
    rows = requests.select(transfer, _field(f, "iam").alias("iam"), _field(f, "youare").alias("youare"), _count(_field(f, "wordc")).alias("word_count"), n.alias("entry_count"), F.coalesce(_field(f, "key") == transfer_key(n), F.lit(False)).alias("key_fits"), _field(f, "indexes").alias("lines"))
    return rows.where(hashing.is_hash(F.col("iam")) & hashing.is_hash(F.col("youare")) & F.col("word_count").isNotNull() & F.col("entry_count").isNotNull())


def posting_response(result: Column, pause_ms: Column, unknown: Column, errors: Column) -> Column:
    """Response to postings; ``unknown`` and ``errors`` are arrays of document hashes."""
    return wire.message_text(_form(result=result, pause=pause_ms, unknownURL=F.array_join(unknown, ""), errorURL=F.array_join(errors, "")))


def read_posting_response(text: Column) -> Column:
    """``result, pause_ms, unknown, errors``; null in ``result`` for one that doesn't exist."""
    m = wire.read_message(text)
    result = _field(m, "result")
    return F.struct(F.when(result.isin(*RESULTS), result).alias("result"), _count(_field(m, "pause")).alias("pause_ms"), hashing.split_hashes(F.coalesce(_field(m, "unknownURL"), F.lit(""))).alias("unknown"), hashing.split_hashes(F.coalesce(_field(m, "errorURL"), F.lit(""))).alias("errors"))


def metadata_requests(rows: DataFrame, transfer: str, order: str, sender: Column, receiver: Column, row: str = "row") -> DataFrame:
    """``transfer, form``: requests with numbered metadata rows ``url0, url1, ...``."""
    each = rows.groupBy(transfer).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, row))), lambda x: x[row]).alias("__r"))
    numbered = F.map_from_entries(F.transform("__r", lambda r, i: F.struct(F.concat(F.lit("url"), i.cast("string")).alias("key"), r.alias("value"))))
    return each.select(transfer, F.map_concat(_form(**{_UNIT: F.lit(NETWORK)}, iam=sender, youare=receiver, urlc=F.size("__r")), numbered).alias("form"))


def read_metadata_requests(requests: DataFrame, transfer: str, form: str = "form") -> DataFrame:
    """``transfer, row`` of each metadata row that a request counts and holds; gaps are left out."""
    f = F.col(form)
    n = _count(_field(f, "urlc"))
    rows = requests.where(hashing.is_hash(_field(f, "iam")) & hashing.is_hash(_field(f, "youare")) & (n > 0))
    found = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(f, F.concat(F.lit("url"), i.cast("string"))))
    return rows.select(transfer, F.explode(found).alias("row")).where("coalesce(row, '') <> ''")


def metadata_response(result: Column, known: Column, errors: Column) -> Column:
    return wire.message_text(_form(result=result, double=known, errorURL=F.array_join(errors, "")))


def addresses(network: Column, target: Column, own_hash: str, own_network: str = NETWORK) -> Column:
    """Whether a request is for this node: of its network (none named is the default one) and with its hash."""
    unit = F.coalesce(F.nullif(F.trim(network), F.lit("")), F.lit(NETWORK))
    return F.coalesce((unit == (own_network or NETWORK)) & (target == own_hash), F.lit(False))


def failure_report(body: Column) -> Column:
    """What a peer said when it failed, in one line, of its first bytes."""
    cut = F.make_valid_utf8(F.substring(F.encode(F.coalesce(body, F.lit("")), "utf-8"), 1, REPORT_BYTES).cast("string"))
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(cut, r"\s+", " ")), F.lit("")), F.lit(NO_REPORT))
