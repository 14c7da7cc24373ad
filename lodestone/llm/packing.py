"""Documents, sized in tokens, packed into containers of a fixed capacity with little space unused.

Bulk-synchronous best fit. Documents are range-sorted by size, and a document's rank within its size is its place in that
order. Sizes and gaps (the free space of open containers) are whole numbers up to the capacity, so both sorted lists are
held as runs of equal values. A round range-partitions the runs of documents and of gaps by their values; each task
sweeps over its part in ascending order, and every gap is given the largest documents of its part that fit, the lowest
ranks first. What no task could match meets in a last sweep over the parts, where a gap gets the next documents below.
Containers take one document a round, small ones (an eighth of the capacity at most) as many as fit. The gaps are then
updated, and the next round begins; where nothing fits, as many containers are opened as the rest needs at least. No
sweep reads a document: it decides on rank intervals, and tasks then place the documents where they are.

The number of runs depends on the capacity, not on the documents. README has the rounds and intervals measured.

A document larger than the capacity is cut into pieces of exactly the capacity and a remainder. Null and blank texts
are left out; a text of no tokens takes no space and still gets a container. Equal rows are separate items.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import materialise, partitions, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public vocabulary splits text before merging bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rank intervals that tasks may hold in memory (32 bytes each); beyond, a shuffled join matches them.
MAX_INTERVALS = 1_000_000
#: Runs that a task sweeps at least, if there are more.
RUNS_OF_A_PART = 256
#: Runs of spaces, which tokens may share out among them: such a text is encoded as a whole.
_SPACES = re.compile(r" \s|\s ")


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Sizer:
    """Counts tokens. Tokens never reach over a single space before a word, so words are counted each and remembered."""

    def __init__(self, path: str):
        self.encode = _encoding(path).encode_ordinary
        self.known: dict[str, int] = {}

    def size(self, text: str) -> int:
        if "  " in text or "\n " in text or " \n" in text or "\t" in text or "\r" in text or "\xa0" in text or "　" in text or any(c in text for c in "\x0b\x0c\x1c\x1d\x1e\x1f\x85     ") or any(chr(c) in text for c in range(0x2000, 0x200B)):
            return len(self.encode(text))
        head, *rest = text.split(" ")
        get, total = self.known.get, len(self.encode(head))
        for w in rest:
            n = get(w)
            if n is None:
                n = self._count_word(w)
            total += n
        return total

    def _count_word(self, word: str) -> int:
        n = len(self.encode(" " + word))
        if len(word) <= 48:
            if len(self.known) > 400_000:
                self.known.clear()
            self.known[word] = n
        return n


def token_sizes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, size``: tokens of each non-blank text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(tokenizer)
        for b in batches:
            ids, sizes = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t and not t.isspace():
                    ids.append(i)
                    sizes.append(sizer.size(t))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "size"])

    return spread(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(run, "doc_id long, size long")


def swept(rows: list[tuple[int, int, int, int]], small: int) -> tuple[list[tuple], list[tuple], list[tuple], list[tuple]]:
    """One sweep over runs ``(value, kind, n, first)`` in ascending order; of kind 0 are documents, of kind 1 gaps.

    Returns rank intervals ``(size, from, to, container, per)``, the gaps made, the documents left and the gaps left.
    """
    placed, made, documents, left = [], [], [], []
    for value, kind, n, first in rows:
        if kind == 0:
            documents.append((value, n, first))
            continue
        while n and documents:
            size, many, rank = documents[-1]
            per = 1 if size > small else value // size
            used = min(n, -(-many // per))
            took = min(many, used * per)
            placed.append((size, rank, rank + took, first, per))
            full, rest = divmod(took, per)
            made += [(value - per * size, full, first)] if full else []
            made += [(value - rest * size, 1, first + full)] if rest else []
            first, n = first + used, n - used
            documents.pop()
            if took < many:
                documents.append((size, many - took, rank + took))
        if n:
            left.append((value, n, first))
    return placed, made, documents, left


_RUNS = "value long, kind int, n long, first long"
_SWEPT = "what string, a long, b long, c long, d long, e long"


def _swept_part(batches: Iterator[pa.RecordBatch], small: int) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    out = [(what, *r, *[None] * (5 - len(r))) for what, part in zip(("placed", "made", "documents", "left"), swept(rows, small), strict=True) for r in part]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i == 0 else pa.int64()) for i in range(6)], names=["what", "a", "b", "c", "d", "e"])


def sweep(spark: SparkSession, histogram: dict[int, int], capacity: int, parts: int | None = None) -> tuple[list[tuple[int, int, int, int, int]], int, int]:
    """Rank intervals ``(size, from, to, container, per)``, the number of containers, and that of rounds.

    A document of that size with rank ``r`` in ``[from, to)`` goes into ``container + (r - from) // per``.
    """
    small = capacity // 8
    documents = [(s, n, 0) for s, n in histogram.items() if s and n]
    gaps: list[tuple[int, int, int]] = []
    out, opened, rounds = [], 0, 0
    while documents:
        least = min(s for s, _, _ in documents)
        gaps = [g for g in gaps if g[0] >= least]
        if not gaps:
            n = -(-sum(s * n for s, n, _ in documents) // capacity)
            gaps.append((capacity, n, opened))
            opened += n
        rounds += 1
        runs = spark.createDataFrame([(s, 0, n, r) for s, n, r in documents] + [(g, 1, n, c) for g, n, c in gaps], _RUNS)
        order = ["value", "kind", "first"]
        n_parts = parts or max(2, min(partitions(spark), (len(documents) + len(gaps)) // RUNS_OF_A_PART))
        found = runs.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).mapInArrow(lambda it: _swept_part(it, small), _SWEPT).collect()
        of = lambda what: [tuple(x for x in r[1:] if x is not None) for r in found if r.what == what]  # noqa: B023, E731
        # what is left of the parts, in the order of the values: at most the runs there are
        across = sorted([(s, 0, n, r) for s, n, r in of("documents")] + [(g, 1, n, c) for g, n, c in of("left")])
        placed, made, documents, left = swept(across, small)
        out += of("placed") + placed
        gaps = of("made") + made + left
    if histogram.get(0):
        opened = max(opened, 1)
        out.append((0, 0, histogram[0], 0, histogram[0]))
    return out, opened, rounds


def _local_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by size, with the part they are in and their place among equal sizes there."""
    from pyspark import TaskContext

    part, last, seen = TaskContext.get().partitionId(), None, 0
    for b in batches:
        size = b.column(2).to_numpy()
        if not len(size):
            continue
        new = np.ones(len(size), bool)
        new[1:] = size[1:] != size[:-1]
        starts = np.flatnonzero(new)
        place = np.arange(len(size)) - np.repeat(starts, np.diff(np.append(starts, len(size))))
        if size[0] == last:
            place[: starts[1] if len(starts) > 1 else len(size)] += seen
        last, seen = size[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(size), part), pa.int32()), pa.array(place, pa.int64())], names=[*b.schema.names, "part", "place"])


def pack(sizes: DataFrame, capacity: int, max_intervals: int = MAX_INTERVALS) -> DataFrame:
    """``doc_id, piece, size, container`` for a table of ``doc_id, size``; pieces of a document are numbered from 1."""
    spark = sizes.sparkSession
    full, rest = F.expr(f"size div {capacity}"), F.col("size") % capacity
    whole = F.transform(F.sequence(F.lit(1).cast("long"), full), lambda i: F.struct(i.alias("piece"), F.lit(capacity).cast("long").alias("size")))
    last = F.array(F.struct((full + 1).cast("long").alias("piece"), rest.cast("long").alias("size")))
    pieces = F.when(full == 0, last).when(rest == 0, whole).otherwise(F.concat(whole, last))
    items = sizes.where("size is not null").select("doc_id", F.explode(pieces).alias("p")).select("doc_id", "p.piece", "p.size")
    order = ["size", "doc_id", "piece"]
    ranked = items.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranked = materialise(ranked.mapInArrow(_local_ranks, "doc_id long, piece long, size long, part int, place long"), "packing-ranks")
    # at most one row for each size, and one more for each border between parts
    counts = sorted(tuple(r) for r in ranked.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n")).collect())
    histogram: dict[int, int] = {}
    offsets: dict[tuple[int, int], int] = {}
    for size, part, n in counts:
        offsets[size, part] = histogram.get(size, 0)
        histogram[size] = offsets[size, part] + n
    intervals, _, _ = sweep(spark, histogram, capacity)
    moved = {k: v for k, v in offsets.items() if v}
    if len(intervals) > max_intervals:
        return _joined(ranked, intervals, moved)
    table = np.array(sorted(intervals), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((table, moved))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, moved = shared.value
        key = (table[:, 0] << 40) + table[:, 1]
        for b in batches:
            size, part, rank = b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).to_numpy().copy()
            for p in np.unique(part):
                here = part == p
                for s in np.unique(size[here]):
                    if by := moved.get((int(s), int(p))):
                        rank[here & (size == s)] += by
            at = np.searchsorted(key, (size << 40) + rank, side="right") - 1
            got = table[at, 3] + (rank - table[at, 1]) // table[at, 4] if len(size) else rank
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(got, pa.int64())], names=["doc_id", "piece", "size", "container"])

    return ranked.mapInArrow(place, "doc_id long, piece long, size long, container long")


def _joined(ranked: DataFrame, intervals: list[tuple[int, int, int, int, int]], moved: dict[tuple[int, int], int]) -> DataFrame:
    """The same by a shuffled join."""
    spark = ranked.sparkSession
    by = spark.createDataFrame([(s, p, v) for (s, p), v in moved.items()] or [(-1, -1, 0)], "size long, part int, offset long")
    wide = spark.createDataFrame(intervals, "size long, low long, high long, first long, per long")
    rows = ranked.join(by, ["size", "part"], "left").withColumn("rank", F.col("place") + F.coalesce("offset", F.lit(0)))
    joined = rows.join(wide, (rows["size"] == wide["size"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return joined.select("doc_id", "piece", rows["size"], (F.col("first") + F.expr("(rank - low) div per")).alias("container"))
