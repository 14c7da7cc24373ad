"""Evaluation items that stand, wholly or in part, in the documents of a large corpus, and how much of each does.

A passage of ``LENGTH`` consecutive words of an item is a short test item of its own: a set of ``LENGTH - WIDTH + 1``
shingles of ``WIDTH`` words. Contained in a document means that the document has each of these shingles, in particular
the ones that are least under the hash functions of a MinHash. The index therefore keeps, per size class of items, only
the MinHash values of all passages; a document is a candidate for an item if its shingles hold the values of one of
its passages under every hash function. That misses no passage, and what it finds is verified by comparing the words.
The share of an item's distinct shingles that the document holds is then counted exactly. As a passage alone is enough,
the least share that counts falls with the item's size: a class of items of up to ``n`` words has the threshold
``(LENGTH - WIDTH + 1) / (n - WIDTH + 1)``, which every passage reaches; ``share`` asks for more of an item.

Items are few (``max_items`` and ``max_bytes`` bound a block); more items are searched block by block, each block
against all documents. A block is broadcast once and indexed once in each Python worker. Documents are read once per
block and never shuffled; only found pairs are.

Null, empty and blank texts have no words and give no rows; equal documents each give their rows; an item with fewer
words than ``LENGTH`` is never found; equal items are each found.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import spread

LENGTH = 9
WIDTH = 5
MAX_ITEMS = 20_000
MAX_BYTES = 32 << 20
#: words handled at once
_CHUNK = 100_000
_WORD = re.compile(r"[^\W_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str) -> list[str]:
    """The longest runs of letters and digits, without case."""
    return _WORD.findall(text.casefold())


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive values."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, width):
        out *= _MULTIPLIER
        out += h[j : j + n]
    return out ^ (out >> np.uint64(29))


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def _windowed_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    return np.lib.stride_tricks.sliding_window_view(x, width).min(axis=1) if n > 0 else x[:0]


class Index:
    """MinHash values of every passage of the items, by size class, and the passages themselves."""

    def __init__(self, items: list[tuple[int, str]], length: int, width: int):
        self.length, self.width = length, width
        self.passages: dict[int, list[tuple[int, tuple[str, ...]]]] = {}
        self.shingles: dict[int, set[tuple[str, ...]]] = {}
        classes: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            w = words_of(text)
            if len(w) < length:
                continue
            h = _hashes(w)
            self.shingles[item] = self.shingles.get(item, set()) | _shingles(w, width)
            shingles = _rolled(h, width)
            per = length - width + 1
            sig = np.stack([_windowed_min(shingles, per), _windowed_min(shingles * _SECOND, per)])
            classes.setdefault(int(np.log2(len(w))), []).append(sig)
            for at, p in enumerate(_rolled(h, length).tolist()):
                self.passages.setdefault(p, []).append((item, tuple(w[at : at + length])))
        # for each size class: the sorted values under the first function, and a filter in front of them
        self.classes = []
        for _, sigs in sorted(classes.items()):
            sig = np.concatenate(sigs, axis=1)
            bits = max(16, int(np.ceil(np.log2(64 * sig.shape[1] + 1))))
            tables = []
            for values in sig:
                values = np.unique(values)
                front = np.zeros(1 << bits, bool)
                front[(values >> np.uint64(64 - bits)).astype(np.int64)] = True
                tables.append((values, front))
            self.classes.append((np.uint64(64 - bits), tables))

    def candidates(self, shingles: np.ndarray) -> np.ndarray:
        """Positions whose shingle is the MinHash value of some passage under the first function, where the second has one near."""
        found = [np.zeros(0, np.int64)]
        reach = np.arange(self.width - self.length, self.length - self.width + 1)
        for shift, ((first, front), (second, _)) in self.classes:
            at = np.flatnonzero(front[(shingles >> shift).view(np.int64)])
            at = at[_among(shingles[at], first)]
            if len(at):
                near = np.clip(at[:, None] + reach, 0, len(shingles) - 1)
                both = _among((shingles[near] * _SECOND).ravel(), second).reshape(near.shape).any(axis=1)
                found.append(at[both])
        return np.unique(np.concatenate(found))


def _shingles(words: list[str], width: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(width)), strict=False))


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _search(ids: list[int], words: list[str], ends: list[int], index: Index) -> tuple[list[int], list[int], list[float]]:
    """Documents, the items in them and the share they hold; ``words`` holds the documents one after another, each up to its place in ``ends``."""
    length, width = index.length, index.width
    if len(words) < length:
        return [], [], []
    h = _hashes(words)
    at = index.candidates(_rolled(h, width))
    if not len(at):
        return [], [], []
    stops = np.array(ends)
    # a passage holding the shingle begins at most length - width words earlier, and ends in the same document
    starts = np.unique((at[:, None] - np.arange(length - width + 1)).ravel())
    starts = starts[starts >= 0]
    doc = np.searchsorted(stops, starts, side="right")
    inside = starts + length <= stops[np.minimum(doc, len(stops) - 1)]
    starts, doc = starts[inside], doc[inside]
    near = np.lib.stride_tricks.sliding_window_view(h, length)[starts]
    keys = _rolled(near.T, length)[0] if len(starts) else []
    seen = set()
    for s, d, key in zip(starts.tolist(), doc.tolist(), np.asarray(keys).tolist(), strict=True):
        for item, w in index.passages.get(key, ()):
            if (d, item) not in seen and tuple(words[s : s + length]) == w:
                seen.add((d, item))
    own = {d: _shingles(words[ends[d - 1] if d else 0 : ends[d]], width) for d in {d for d, _ in seen}}
    shares = [len(index.shingles[item] & own[d]) / len(index.shingles[item]) for d, item in seen]
    return [ids[d] for d, _ in seen], [item for _, item in seen], shares


_INDEXES: dict[str, Index] = {}


def _index(name: str, items: list[tuple[int, str]], length: int, width: int) -> Index:
    """The index of a block, made once in a worker; the one before is forgotten."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = Index(items, length, width)
    return _INDEXES[name]


def _found(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    def made(docs: list[int], hits: list[int], shares: list[float]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hits, pa.int64()), pa.array(shares, pa.float64())], names=["doc_id", "item_id", "contained"])

    ids, ends, words = [], [], []
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text:
                words += _WORD.findall(text.casefold())
                ids.append(doc)
                ends.append(len(words))
                if len(words) > _CHUNK:
                    yield made(*_search(ids, words, ends, index))
                    ids, ends, words = [], [], []
    yield made(*_search(ids, words, ends, index))


def blocks(items: DataFrame, item_id: str, text: str, max_items: int, max_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded count and size, in the order of their ids."""
    block, held = [], 0
    for r in items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").orderBy("i", "t").toLocalIterator():
        if block and (len(block) >= max_items or held + len(r.t) > max_bytes):
            yield block
            block, held = [], 0
        block.append((r.i, r.t))
        held += len(r.t)
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", length: int = LENGTH, width: int = WIDTH, max_items: int = MAX_ITEMS, max_bytes: int = MAX_BYTES, share: float = 0.0) -> DataFrame:
    """``doc_id, item_id, contained`` of each document and item that share ``length`` consecutive words.

    ``contained`` is the share of the item's distinct shingles that the document holds; pairs below ``share`` are left out.
    """
    docs = spread(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text")))
    schema = "doc_id long, item_id long, contained double"
    found = None
    for block in blocks(items, item_id, item_text, max_items, max_bytes):
        shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
        part = docs.mapInArrow(lambda it, shared=shared, name=name: _found(it, _index(name, shared.value, length, width)), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    # a document that stands in several rows under one id counts once
    return found.groupBy("doc_id", "item_id").agg(F.max("contained").alias("contained")).where(F.col("contained") >= share)
