"""Per-key results over a table in which a few keys hold most rows.

Rows are range-partitioned on the composite ``(key, order)`` with quantiles that Spark samples, so a heavy key spans as
many partitions as its share asks for. Each partition makes one partial state per key it holds (in its own order, in
one pass over Arrow batches, with bounded memory), and the partial states, about ``keys + partitions`` rows, are
stitched: sums add up, top lists merge, and a value that ends one partition and begins the next counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import materialise, partitions

_STATE = (
    "key string, part int, n_rows long, n_distinct long, total long, first_value string, last_value string, "
    "top array<struct<m:long,v:string,id:long>>"
)


def _partials(batches: Iterator[pa.RecordBatch], top_k: int) -> Iterator[pa.RecordBatch]:
    """One state for each run of equal keys in rows sorted by key and value; a run may go on over batches."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    out: list[list] = [[] for _ in range(8)]
    state: list | None = None  # key, rows, distinct, total, first, last, top

    def close() -> None:
        if state is not None:
            for at, value in zip(out, (state[0], part, *state[1:6], sorted(state[6], key=lambda t: (-t["m"], t["v"] or "", t["id"]))[:top_k]), strict=True):
                at.append(value)

    def batch() -> pa.RecordBatch:
        top = pa.list_(pa.struct([("m", pa.int64()), ("v", pa.string()), ("id", pa.int64())]))
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), top)
        names = ("key", "part", "n_rows", "n_distinct", "total", "first_value", "last_value", "top")
        made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)
        for x in out:
            x.clear()
        return made

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        key, value, measure, row_id = (b.column(i) for i in range(4))
        new_key = np.ones(n, bool)
        new_value = np.ones(n, bool)
        if n > 1:
            # equality with nulls kept apart: a null key or value equals only a null
            for col, flag in ((key, new_key), (value, new_value)):
                a, c = col.slice(1), col.slice(0, n - 1)
                same = pc.fill_null(pc.equal(a, c), False).to_numpy(zero_copy_only=False)
                both = pc.and_(pc.is_null(a), pc.is_null(c)).to_numpy(zero_copy_only=False)
                flag[1:] = ~(same | both)
        new_value |= new_key
        counted = new_value & pc.is_valid(value).to_numpy(zero_copy_only=False)
        m = pc.fill_null(measure, 0).to_numpy(zero_copy_only=False)
        has_m = pc.is_valid(measure).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(row_id, 0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new_key)
        ends = np.append(starts[1:], n)
        distinct = np.add.reduceat(counted, starts, dtype=np.int64)
        totals = np.add.reduceat(m, starts, dtype=np.int64)
        for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
            k, first, last = key[s].as_py(), value[s].as_py(), value[e - 1].as_py()
            usable = np.flatnonzero(has_m[s:e]) + s
            if len(usable) > top_k:  # all ties with the k-th are kept till the order by value decides
                least = np.partition(m[usable], len(usable) - top_k)[len(usable) - top_k]
                best = usable[m[usable] > least]
                # rows are in the order of value and id, so among ties the first are the ones to keep
                best = np.concatenate([best, usable[m[usable] == least][: top_k - len(best)]])
            else:
                best = usable
            top = [{"m": int(m[j]), "v": value[int(j)].as_py(), "id": int(ids[j])} for j in best]
            d = int(distinct[i])
            if state is not None and i == 0 and state[0] == k:
                if first is not None and state[5] == first:
                    d -= 1
                top = sorted(state[6] + top, key=lambda t: (-t["m"], t["v"] or "", t["id"]))[:top_k]
                state = [k, state[1] + int(e - s), state[2] + d, state[3] + int(totals[i]), state[4], last, top]
            else:
                close()
                state = [k, int(e - s), d, int(totals[i]), first, last, top]
        if len(out[0]) > 4096:
            yield batch()
    close()
    yield batch()


def partial_states(df: DataFrame, key: Column, value: Column, measure: Column, row_id: Column, top_k: int = 3, width: int | None = None) -> DataFrame:
    """The partial states of each key in each range partition."""
    rows = df.select(key.cast("string").alias("key"), value.cast("string").alias("value"), measure.cast("long").alias("measure"), row_id.cast("long").alias("id"))
    n = width or 2 * partitions(df.sparkSession)
    order = ["key", "value", "id"]
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(lambda it: _partials(it, top_k), _STATE)


def per_key(df: DataFrame, key: Column, value: Column, measure: Column, row_id: Column, top_k: int = 3, width: int | None = None) -> DataFrame:
    """``key, n_rows, n_distinct, total, top`` for every key, whatever its share of the rows.

    ``n_distinct`` counts distinct non-null values, ``total`` sums the measure with null as 0, ``top`` has the ``top_k``
    rows with the greatest non-null measure, ties in order of value (null first) and row id. A null key is a key.
    An empty table gives no rows. Columns beyond the four are not read. Repeated rows count as stored.
    """
    states = partial_states(df, key, value, measure, row_id, top_k, width)
    item = F.struct("part", "n_rows", "n_distinct", "total", "first_value", "last_value", "top")
    one = states.groupBy("key").agg(F.array_sort(F.collect_list(item)).alias("s"))  # at most one state a partition
    # boundaries at which the last value of a part opens the next: counted twice
    doubled = F.aggregate(
        F.sequence(F.lit(1), F.size("s") - 1), F.lit(0).cast("long"),
        lambda n, i: n + F.coalesce(F.element_at("s", i)["last_value"] == F.element_at("s", i + 1)["first_value"], F.lit(False)).cast("long"),
    )
    add = lambda name: F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + x[name])
    ranked = F.transform(F.flatten(F.transform("s", lambda x: x["top"])), lambda t: F.struct((-t["m"]).alias("o"), t["v"].alias("v"), t["id"].alias("id")))
    top = F.transform(F.slice(F.array_sort(ranked), 1, top_k), lambda t: F.struct((-t["o"]).alias("measure"), t["v"].alias("value"), t["id"].alias("id")))
    return one.select(
        "key", add("n_rows").alias("n_rows"),
        (add("n_distinct") - F.when(F.size("s") > 1, doubled).otherwise(F.lit(0))).alias("n_distinct"),
        add("total").alias("total"), top.alias("top"),
    )


def heavy_keys(df: DataFrame, key: Column, row_id: Column, share: float, width: int | None = None) -> DataFrame:
    """``key, n_rows, share`` of the keys that hold at least ``share`` of all rows, rows counted as stored.

    ``row_id`` is the secondary order by which a heavy key is split. An empty table gives no rows; a null key is a key.
    """
    none = F.lit(None)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()  # from the files' footers
    counts = per_key(df, key, none, none, row_id, 0, width).select("key", "n_rows")
    return counts.where(F.col("n_rows") >= F.lit(share) * total).select("key", "n_rows", (F.col("n_rows") / total).alias("share"))


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """Rows with ``out``, their place from 0 on among the rows of their key, in the given order, nulls first.

    Rows are range-partitioned by key and order, so a key of any size is spread over parts. Each part numbers the rows
    of its keys; only the first key of a part can have begun in parts before, and how many rows it has there is known
    from one row a part. Equal rows are numbered in any order.
    """
    spark = df.sparkSession
    plain = df.schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain), "__place long", "__part int"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        at = [plain.names.index(k) for k in keys]
        for b in batches:
            places = []
            for key in zip(*(b.column(i).to_pylist() for i in at), strict=True):
                seen = seen + 1 if key == last else 0
                last = key
                places.append(seen)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.int64()), pa.array([part] * len(places), pa.int32())], names=[*plain.names, "__place", "__part"])

    by = [*keys, *order]
    rows = materialise(df.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).mapInArrow(number, schema), "ranked")
    key = F.struct(*keys)
    ends = rows.groupBy("__part").agg(F.min(key).alias("first"), F.max(F.struct(key.alias("k"), "__place")).alias("last")).collect()  # one row a part
    offsets, held = [], (None, 0)
    for r in sorted(ends, key=lambda r: r["__part"]):
        before = held[1] if held[0] == r.first else 0
        offsets.append((r["__part"], r.first, before))
        held = r.last.k, r.last["__place"] + 1 + (before if r.last.k == r.first else 0)
    wanted = [o for o in offsets if o[2]]
    if not wanted:
        return rows.withColumnRenamed("__place", out).drop("__part")
    fields = T.StructType([T.StructField("__part", T.IntegerType()), T.StructField("__first", T.StructType([plain[k] for k in keys])), T.StructField("__before", T.LongType())])
    moved = rows.join(F.broadcast(spark.createDataFrame(wanted, fields)), "__part", "left")
    rank = F.col("__place") + F.when(key == F.col("__first"), F.col("__before")).otherwise(0)
    return moved.withColumn(out, F.coalesce(rank, F.col("__place"))).drop("__place", "__part", "__first", "__before")


def running(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Rows with ``out``, the sum of a whole number over all rows before, in the given order; a null counts as 0.

    Rows are range-partitioned by the order and each part adds up its own; the sums of the parts before it, one row a
    part, are added then. No task sees more than its part.
    """
    plain = df.schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain), "__local long", "__part int"])
    at = plain.names.index(value)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            n = np.asarray(pc.fill_null(b.column(at).cast(pa.int64()), 0))
            after = np.cumsum(n) + total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(after - n, pa.int64()), pa.array(np.full(len(n), part), pa.int32())], names=[*plain.names, "__local", "__part"])
            total = int(after[-1]) if len(n) else total

    spark = df.sparkSession
    # written once, so that both reads see the same parts
    rows = materialise(df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(add, schema), "running")
    sums = sorted((r["__part"], r.n or 0) for r in rows.groupBy("__part").agg(F.sum(value).alias("n")).collect())  # one row a part
    earlier, total = [], 0
    for part, n in sums:
        earlier.append((part, total))
        total += n
    offsets = spark.createDataFrame(earlier, "__part int, __earlier long")
    return rows.join(F.broadcast(offsets), "__part").withColumn(out, F.col("__earlier") + F.col("__local")).drop("__part", "__earlier", "__local")
