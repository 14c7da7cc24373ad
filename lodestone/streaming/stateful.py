"""Streams with memory: postings that wait for the metadata of their document, and pages that are due again.

State lives in the session's state store, by key, with timers; output equals that of the batch plans for the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators.ingest import HOLD_SECONDS

ESCROW_OUT = "word_hash string, url_hash string, held_at timestamp, outcome string"


_STATE = "arrived binary, waiting binary, timer long"
_OUT = ["word_hash", "url_hash", "held_us", "outcome"]
_ARRIVED = pa.schema([("url_hash", pa.string()), ("us", pa.int64())])
_WAITING = pa.schema([("word_hash", pa.string()), ("url_hash", pa.string()), ("us", pa.int64())])
#: Documents share so many pages of state by a hash; fixed for a checkpoint.
PAGES = 1024


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_table(pa.Table.from_pandas(rows, schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes | None, schema: pa.Schema) -> pd.DataFrame:
    return (pa.ipc.open_stream(blob).read_all() if blob else schema.empty_table()).to_pandas()


class _Escrow(StatefulProcessor):
    """Per page of documents: whose metadata came, and the words that wait for it. A timer ends the waits and the memory.

    A state call costs more than handling hundreds of rows, so all documents of a page are read, worked on as columns and
    written at once. Times are in microseconds, and count in whole milliseconds for timers.
    """

    def __init__(self, hold_seconds: int, remember_seconds: int | None):
        self.hold_ms, self.remember_ms = hold_seconds * 1000, remember_seconds and remember_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", _STATE)

    def _load(self) -> tuple[pd.DataFrame, pd.DataFrame, int | None]:
        arrived, waiting, timer = self.page.get() or (None, None, None)
        return _unpacked(arrived, _ARRIVED), _unpacked(waiting, _WAITING), timer

    def _save(self, arrived: pd.DataFrame, waiting: pd.DataFrame, timer: int | None) -> None:
        """With a timer at the first end of a wait or a memory, unless an earlier one is set."""
        ends = [waiting["us"].min() // 1000 + self.hold_ms] if len(waiting) else []
        if self.remember_ms and len(arrived):
            ends.append(arrived["us"].min() // 1000 + self.remember_ms)
        if ends and (timer is None or min(ends) < timer):
            timer = int(min(ends))
            self.handle.registerTimer(timer)
        if len(arrived) or len(waiting) or timer is not None:
            self.page.update((_packed(arrived, _ARRIVED), _packed(waiting, _WAITING), timer))
        else:
            self.page.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        arrived, waiting, timer = self._load()
        events = pd.concat(list(rows), ignore_index=True)
        if events["us"].isna().any():
            raise ValueError("an event of the escrow has no time")
        doc, docs = pd.factorize(pd.concat([arrived["url_hash"], waiting["url_hash"], events["url_hash"]]), use_na_sentinel=False)
        doc_arrived, doc_waiting, doc = np.split(doc, [len(arrived), len(arrived) + len(waiting)])
        us, metadata = events["us"].to_numpy(np.int64), (events["kind"] == "metadata").to_numpy()
        order = np.lexsort((~metadata, us, doc))  # by document, then in time, metadata first
        doc, us, metadata, word = doc[order], us[order], metadata[order], events["word_hash"].to_numpy(object)[order]

        # how many metadata rows came of the document before a row in this batch; those of all documents stand in ``came``
        came, n_came = us[metadata], np.bincount(doc[metadata], minlength=len(docs))
        first = np.cumsum(n_came) - n_came
        before = np.cumsum(metadata) - first[doc]
        known, since = np.zeros(len(docs), bool), np.zeros(len(docs), np.int64)
        known[doc_arrived], since[doc_arrived] = True, arrived["us"].to_numpy(np.int64)
        new = np.flatnonzero(~known & (n_came > 0))
        since[new] = came[first[new]]
        stored = ~metadata & (known[doc] | (before > 0))
        if self.remember_ms:
            stored &= us // 1000 <= since[doc] // 1000 + self.remember_ms

        # a word that is held again waits from then on, until the next metadata of its document
        held = ~metadata & ~stored
        holds = pd.DataFrame(
            {
                "word_hash": np.concatenate([waiting["word_hash"].to_numpy(object), word[held]]), "doc": np.concatenate([doc_waiting, doc[held]]),
                "us": np.concatenate([waiting["us"].to_numpy(np.int64), us[held]]), "before": np.concatenate([np.zeros(len(waiting), np.int64), before[held]]),
            }
        ).drop_duplicates(["doc", "word_hash", "before"], keep="last")
        of, at, n = holds["doc"].to_numpy(), holds["us"].to_numpy(), holds["before"].to_numpy()
        ended = n < n_came[of]
        late = came[first[of[ended]] + n[ended]] - at[ended] > self.hold_ms * 1000
        names = np.asarray(docs, object)
        words = holds["word_hash"].to_numpy(object)
        if ended.any() or stored.any():
            yield pd.DataFrame(
                {
                    "word_hash": np.concatenate([word[stored], words[ended]]), "url_hash": names[np.concatenate([doc[stored], of[ended]])],
                    "held_us": np.concatenate([us[stored], at[ended]]), "outcome": np.concatenate([np.full(stored.sum(), "stored", object), np.where(late, "expired", "released").astype(object)]),
                }
            )
        if len(new):
            arrived = pd.concat([arrived, pd.DataFrame({"url_hash": names[new], "us": since[new]})])
        self._save(arrived, pd.DataFrame({"word_hash": words[~ended], "url_hash": names[of[~ended]], "us": at[~ended]}), timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs()  # all that ended until now: a timer set here fires with the next watermark
        arrived, waiting, timer = self._load()
        if self.remember_ms:
            arrived = arrived[arrived["us"] // 1000 + self.remember_ms > now]
        gone = waiting["us"] // 1000 + self.hold_ms <= now
        self._save(arrived, waiting[~gone], None if timer is not None and timer <= now else timer)
        if gone.any():
            yield waiting[gone].rename(columns={"us": "held_us"}).assign(outcome="expired")[_OUT]

    def close(self) -> None:
        pass


def escrow_stream(events: DataFrame, hold_seconds: int = HOLD_SECONDS, watermark: str = "0 seconds", remember_seconds: int | None = None, pages: int = PAGES) -> DataFrame:
    """Outcomes of a stream ``kind (posting or metadata), url_hash, word_hash, at``, by event time.

    With ``remember_seconds`` a document's arrival is forgotten after that time, so that the state is bounded by what
    came in it; postings of documents that came before have to be told by the metadata table (``known_first``).
    A batch reads and writes the pages of state that its documents fall in: the more documents a stream remembers, the more ``pages``.
    """
    paged = events.withColumns({"us": F.unix_micros(F.col("at").cast("timestamp")), "page": F.pmod(F.xxhash64("url_hash"), F.lit(pages))})
    keyed = paged.select("page", "kind", "url_hash", "word_hash", "us", "at").withWatermark("at", watermark).groupBy("page")
    out = keyed.transformWithStateInPandas(_Escrow(hold_seconds, remember_seconds), "word_hash string, url_hash string, held_us long, outcome string", "Append", "EventTime")
    return out.select("word_hash", "url_hash", F.timestamp_micros("held_us").alias("held_at"), "outcome")


def known_first(events: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of a stream whose document the metadata table holds, as stored; and the other events, for the escrow."""
    known = metadata.select("url_hash").distinct().withColumn("__known", F.lit(True))
    rows = events.join(known, "url_hash", "left")
    here = (F.col("kind") == "posting") & F.coalesce("__known", F.lit(False))
    return rows.where(here).select("word_hash", "url_hash", F.col("at").alias("held_at"), F.lit("stored").alias("outcome")), rows.where(~here).drop("__known")


def first_visits(visits: DataFrame, key: str, at: str, grace: str) -> DataFrame:
    """Visits of pages that were not visited within the grace: repeats are dropped as long as their key is remembered."""
    return visits.withWatermark(at, grace).dropDuplicatesWithinWatermark([key])


def upsert_sink(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):  # noqa: ANN201
    """Runs a stream to its present end, merging each batch; a batch that comes again after a failure merges to the same."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_bad(messages: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Decoded messages, and those that can't be decoded, for a table of dead letters."""
    parsed = messages.withColumn("__m", F.from_json(column, f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    bad = F.col("__m").isNull() | F.col("__m.__bad").isNotNull()
    return parsed.where(~bad).select("__m.*").drop("__bad"), parsed.where(bad).select(F.col(column).alias("dead_letter"))
