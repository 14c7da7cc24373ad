"""The weights of ``body`` from all pages: what ``body.fitted`` does for pages at hand, over tables of any size.

Words of few sites, lines that repeat, what stands around them and shapes that stand outside are counted over all pages.
Each page's lines are taken apart once and kept by their hashes. The labelled lines are then shared out, with their
counts over all pages, to as many shards as keep each at about ``PAGES`` pages; a task makes the regression of a shard,
and a token's weight is the mean of those shards that know it. With one shard that is the regression over all lines.

What reaches the driver, and every task, are words of ``NAME_SITES`` sites, hashes of repeated lines and of shapes, and weights.
"""

from __future__ import annotations

import ast
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import body
from lodestone.session import materialise, spread

#: Pages of a shard of the regression.
PAGES = 4_000
_OWN, _PARAGRAPH, _TEXT = 1, 2, 4
#: sums held by a task
_HELD = 300_000
_ONE = 1e9


def _known(pages: DataFrame) -> frozenset[str]:
    """Words of ``NAME_SITES`` sites or more. No more sites of a word than that are passed on from pages at hand, which is exact for the threshold."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full: set[str] = set()
        vocabulary = body.Vocabulary()
        for b in batches:
            texts = b.column(1).to_pylist()
            hosts = np.array([body.hashed(body._host(u)) for u in b.column(0).to_pylist()], np.int64)
            for some in body.slices(texts):
                vocabulary = vocabulary.bounded()
                at, word = vocabulary.taken(texts[some], alike=False)
                here, site = np.unique(hosts[some], return_inverse=True)
                word = np.where(vocabulary.are_digits()[word], vocabulary.zero, word)
                word, site = body.distinct(word, site[at], len(here))
                first, names = np.flatnonzero(np.diff(word, prepend=-1)), list(vocabulary.numbers)
                n = np.diff(first, append=len(word))
                rank = np.arange(len(word)) - np.repeat(first, n)
                done = np.array([names[i] in full for i in word[first].tolist()], bool)
                few = (rank < body.NAME_SITES) & ~np.repeat(done, n)
                full.update([names[i] for i in word[rank == body.NAME_SITES - 1].tolist()])
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in word[few].tolist()], pa.string()), pa.array(here[site[few]])], names=["w", "h"])

    pairs = spread(pages.select("u", "x")).mapInArrow(found, "w string, h long").dropDuplicates(["w", "h"])
    return frozenset(r[0] for r in pairs.groupBy("w").count().where(F.col("count") >= body.NAME_SITES).select("w").collect())


def _lined(pages: DataFrame, known: frozenset[str]) -> DataFrame:
    """Of each page its lines that aren't blank, as hashes ``k`` (0: names and numbers alone) and ``shape``, and what they are, as ``flags``."""
    shared = pages.sparkSession.sparkContext.broadcast(known)

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = body.Told(shared.value), {}

        def learn(lines: list[str]) -> None:
            at, word = words.taken(lines)
            counts = np.bincount(at, minlength=len(lines)).tolist()
            for x, k, n in zip(lines, words.skeletons(at, word, len(lines)).tolist(), counts, strict=True):
                text = body.ends_sentence(x) and body._BULLET.match(x) is None
                seen[x] = k, body.hashed(body._shape(x)), (_TEXT if text else 0) | (_PARAGRAPH if text and n >= body._WORDS_OF_PARAGRAPH else 0)

        for b in batches:
            titles, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
            for some in body.slices(texts):
                if len(seen) > body._HELD:
                    seen.clear()
                pages = [[y for y in x.split("\n") if y.strip()] for x in texts[some]]
                learn([y for y in dict.fromkeys(chain.from_iterable(pages)) if y not in seen])
                got = [seen[y] for lines in pages for y in lines]
                own = [t and body._letters(t) for t in titles[some]]
                title = [bool(t) and body.is_title(y, t) for lines, t in zip(pages, own, strict=True) for y in lines]
                ends = pa.array(np.cumsum([0, *map(len, pages)]), pa.int32())
                ks, shapes = (pa.ListArray.from_arrays(ends, pa.array([g[i] for g in got], pa.int64())) for i in (0, 1))
                flags = pa.ListArray.from_arrays(ends, pa.array([g[2] | (_OWN if t else 0) for g, t in zip(got, title, strict=True)], pa.int32()))
                page = b.slice(some.start, some.stop - some.start)
                yield pa.RecordBatch.from_arrays([page.column(0), page.column(2), ks, shapes, flags], names=["u", "x", "k", "shape", "flags"])

    return materialise(spread(pages).mapInArrow(taken, "u string, x string, k array<long>, shape array<long>, flags array<int>"), "page-lines")


def _values(column: pa.Array) -> list:
    """Of each row its value, or its list of numbers."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    ends = np.cumsum(column.value_lengths().to_numpy()).tolist()
    flat = column.flatten().to_numpy().tolist()
    return [flat[a:z] for a, z in zip([0, *ends], ends, strict=False)]


def _summed(df: DataFrame, columns: list[str], n: int, add: Callable[[dict, tuple], None]) -> DataFrame:
    """``key, s0, s1, ...``: sums over all pages of what ``add`` puts into a dict of lists of ``n`` counts."""
    names = ["key", *(f"s{i}" for i in range(n))]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = defaultdict(lambda: [0] * n)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), *(pa.array([s[i] for s in sums.values()], pa.int64()) for i in range(n))], names=names)

        for b in batches:
            for page in zip(*(_values(b.column(c)) for c in columns), strict=True):
                add(sums, page)
            if len(sums) > _HELD:
                yield out()
                sums.clear()
        yield out()

    parts = df.select(*columns).mapInArrow(counted, ", ".join(f"{c} long" for c in names))
    return parts.groupBy("key").agg(*(F.sum(c).alias(c) for c in names[1:]))


def _kinds(lines: DataFrame) -> dict[int, tuple[str, int]]:
    """Of each repeated line, by its hash: body ``B``, furniture ``F`` or furniture that opens a list ``L``; and how often it stands."""
    pairs = lines.select(F.xxhash64("u").alias("u"), F.explode(F.array_distinct("k")).alias("k")).where("k <> 0").dropDuplicates(["k", "u"])
    repeated = frozenset(r[0] for r in pairs.groupBy("k").count().where(F.col("count") >= body.REPEATED).select("k").collect())
    shared = lines.sparkSession.sparkContext.broadcast(repeated)

    def add(sums: dict, page: tuple) -> None:
        ks, flags = page
        among = shared.value
        for i, k in enumerate(ks):
            if k in among:
                s = sums[k]
                s[0] += 1
                s[1] += i > 0 and flags[i - 1] & _OWN  # the flag is 1
                if i + 1 < len(ks):
                    s[2] += 1
                    s[3] += not (flags[i + 1] & (_OWN | _TEXT) or ks[i + 1] in among)

    out = {}
    for k, n, follows, before, single in _summed(lines, ["k", "flags"], 4, add).collect():
        out[k] = "B" if follows >= body._BYLINE * n else "L" if single >= body._OPENER * max(1, before) else "F", n
    return out


def _own(ks: list[int], flags: list[int], kinds: dict[int, tuple[str, int]]) -> list[bool]:
    """What is the page's title, or stands before a byline."""
    own = [bool(f & _OWN) for f in flags]
    for i in range(len(ks) - 1):
        own[i] = own[i] or ks[i] not in kinds and ks[i + 1] in kinds and kinds[ks[i + 1]][0] == "B"
    return own


def _paragraphs(ks: list[int], flags: list[int], kinds: dict) -> list[int]:
    return [i for i, f in enumerate(flags) if f & _PARAGRAPH and ks[i] not in kinds]


def _outside(lines: DataFrame, shared) -> frozenset[int]:  # noqa: ANN001
    """Shapes of lines that hardly ever stand between paragraphs, nor as a page's own title."""

    def add(sums: dict, page: tuple) -> None:
        ks, shapes, flags = page
        kinds = shared.value
        if at := _paragraphs(ks, flags, kinds):
            own = _own(ks, flags, kinds)
            for i, shape in enumerate(shapes):
                if own[i]:
                    sums[shape][0] += 1
                elif ks[i] not in kinds:
                    sums[shape][0 if at[0] <= i <= at[-1] else 1] += 1

    sums = _summed(lines, ["k", "shape", "flags"], 2, add)
    return frozenset(r[0] for r in sums.where((F.col("s1") >= body.REPEATED) & (F.col("s0") <= body._OUTSIDE * F.col("s1"))).select("key").collect())


def _labelled(pages: list[tuple], kinds: dict, outside: frozenset[int]) -> tuple[dict[str, tuple[bool, int]], dict[int, str]]:
    """Distinct lines of a shard, whether they are of the body, and how often their like stands in all; and a line of each kind that opens a list."""
    out: dict[str, tuple[bool, int]] = {}
    openers: dict[int, str] = {}
    for text, ks, shapes, flags in pages:
        at, own, links = _paragraphs(ks, flags, kinds), _own(ks, flags, kinds), False
        for i, x in enumerate(y for y in text.split("\n") if y.strip()):
            kind, n = kinds.get(ks[i], (None, 1))
            if kind == "L":
                openers.setdefault(ks[i], x)
            if own[i] and not links:
                is_body: bool | None = True
            elif kind:
                is_body, links = kind == "B", kind == "L"
            elif shapes[i] in outside:
                is_body = False
            elif flags[i] & _PARAGRAPH:
                is_body, links = True, False
            else:
                is_body = True if at and at[0] < i < at[-1] and not links else None
            if is_body is not None:
                out.setdefault(x, (is_body, n))
    return out, openers


def fitted(tables: list[DataFrame], clean: list[str], pages_of_shard: int = PAGES) -> body.Weights:
    """Weights from all pages ``u, t, x`` (address, title, text) of some tables, and clean sentences."""
    pages = tables[0]
    for t in tables[1:]:
        pages = pages.unionByName(t)
    pages = pages.where("x is not null")
    share = pages.sparkSession.sparkContext.broadcast
    known = _known(pages)
    lines = _lined(pages, known)
    kinds = share(_kinds(lines))
    outside, known_words, sentences = share(_outside(lines, kinds)), share(known), share(clean)

    def regression(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = sorted(p for b in batches for p in zip(*map(_values, b.columns), strict=True))  # always the same order
        labelled, openers = _labelled(pages, kinds.value, outside.value)
        del pages
        skeleton = body.Weights({}, 0.0, known_words.value, frozenset()).skeleton
        rows = [("opener", repr(skeleton(body._words(x))), 0) for x in openers.values()]
        labelled = {x: (True, 1) for x in sentences.value} | labelled
        is_body = np.array([b for b, _ in labelled.values()], bool)
        if is_body.any() and not is_body.all():
            weights, bias = body._regression(list(labelled), is_body, np.array([n for _, n in labelled.values()]))
            rows += [("weight", repr(f), round(w * _ONE)) for f, w in weights.items()] + [("bias", "", round(bias * _ONE))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["what", "key", "n"])

    shards = max(1, round(lines.count() / pages_of_shard))
    shared_out = lines.select("x", "k", "shape", "flags").repartition(shards, F.xxhash64("x"))
    # whole numbers, so that the sums don't depend on the order of shards
    rows = shared_out.mapInArrow(regression, "what string, key string, n long").groupBy("what", "key").agg(F.sum("n"), F.count(F.lit(1))).collect()
    mean: dict[str, dict] = defaultdict(dict)
    for what, key, n, count in sorted(map(tuple, rows)):
        mean[what][ast.literal_eval(key) if key else ""] = n / count / _ONE
    return body.Weights(mean["weight"], mean["bias"].get("", 1.0), known, frozenset(mean["opener"]))
