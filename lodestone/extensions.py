"""What can be put in: the shape of each part that a user may bring, and a registry by name.

Parts are plans: they get and give DataFrames and Columns, so that what is put in runs where the rest does.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame


@runtime_checkable
class MediaExtractor(Protocol):
    """Makes documents of bodies of some media types."""

    media_types: tuple[str, ...]

    def extract(self, pages: DataFrame) -> DataFrame:
        """``url, title, text, language, links, error`` for ``url, media_type, body``."""


@runtime_checkable
class ContainerExpander(Protocol):
    """Takes apart containers of some media types."""

    media_types: tuple[str, ...]

    def expand(self, files: DataFrame) -> DataFrame:
        """``page, url, media_type, body, error`` for ``url, media_type, body``."""


@runtime_checkable
class FormatDerivation(Protocol):
    """Makes one format of another; ``operators.derive.Derivation`` is one."""

    source: str
    target: str
    derive: Callable[[Column], Column]


@runtime_checkable
class PageRepresentation(Protocol):
    """What a page is published as, under a kind."""

    kind: str

    def of(self, pages: DataFrame) -> DataFrame:
        """Rows to publish; pages that can't be represented are left out."""


@runtime_checkable
class RecrawlRule(Protocol):
    def due(self, visits: DataFrame, now: Column) -> DataFrame:
        """Visits with ``due``."""


@runtime_checkable
class PageFetcher(Protocol):
    def fetch(self, urls: DataFrame) -> DataFrame:
        """``url, status, headers, body`` for ``url, etag, modified``."""


@runtime_checkable
class SearchIndex(Protocol):
    def put(self, documents: DataFrame) -> None:
        """Keeps the last version of each document."""

    def search(self, words: list[str], language: str | None = None) -> DataFrame:
        """``url, score``."""


@runtime_checkable
class Corpus(Protocol):
    """Bodies of one kind by address."""

    kind: str

    def bodies(self) -> DataFrame:
        """``url, body``."""


@runtime_checkable
class StorageEngine(Protocol):
    """Named tables with commits of several at once; ``sources.stores.Store`` and ``Memory`` are two."""

    def tables(self) -> list[str]: ...
    def read(self, name: str) -> DataFrame: ...
    def commit(self, changed: dict[str, DataFrame], added: dict[str, DataFrame] | None = None, on: int | None = None) -> int: ...
    def lengths(self) -> dict[str, int]: ...


@runtime_checkable
class Codec(Protocol):
    """Keys or values as bytes."""

    def encode(self, *parts: Column) -> Column: ...
    def decode(self, data: Column) -> Column: ...


#: Called with the rows that a commit stored or purged, within it: what they return is committed too.
Observer = Callable[[str, DataFrame], dict[str, DataFrame]]


class Registry:
    """Parts of each kind by name. A name is taken once, and a part must have its kind's shape."""

    def __init__(self) -> None:
        self._parts: dict[tuple[type, str], object] = {}

    def add(self, kind: type, name: str, part: object) -> None:
        if not isinstance(part, kind):
            raise TypeError(f"{name} is no {kind.__name__}")
        if (kind, name) in self._parts:
            raise ValueError(f"{kind.__name__} {name} is there already")
        self._parts[kind, name] = part

    def get(self, kind: type, name: str) -> object:
        return self._parts[kind, name]

    def names(self, kind: type) -> list[str]:
        return sorted(n for k, n in self._parts if k is kind)

    def for_media_type(self, kind: type, media_type: str) -> object | None:
        """The part that takes a media type, the first by name; None if there is none."""
        return next((self._parts[kind, n] for n in self.names(kind) if media_type.lower() in getattr(self._parts[kind, n], "media_types", ())), None)


class Memory:
    """An engine that keeps the plans of its tables, for tests and for state of one session."""

    def __init__(self) -> None:
        self._tables: dict[str, DataFrame] = {}
        self._commits = 0

    def tables(self) -> list[str]:
        return sorted(self._tables)

    def read(self, name: str) -> DataFrame:
        return self._tables[name]

    def commit(self, changed: dict[str, DataFrame], added: dict[str, DataFrame] | None = None, on: int | None = None) -> int:
        if on is not None and on != self._commits:
            raise RuntimeError("another commit came first")
        self._tables |= changed | {n: self._tables[n].unionByName(df) if n in self._tables else df for n, df in (added or {}).items()}
        self._commits += 1
        return self._commits

    def lengths(self) -> dict[str, int]:
        return {n: df.count() for n, df in sorted(self._tables.items())}


def observed(engine: StorageEngine, observers: dict[str, list[Observer]], changed: dict[str, DataFrame], added: dict[str, DataFrame] | None = None) -> int:
    """A commit with what the observers of its tables make of it, all at once."""
    extra: dict[str, DataFrame] = {}
    for name, df in [*changed.items(), *(added or {}).items()]:
        for o in observers.get(name, ()):
            extra |= o(name, df)
    return engine.commit(changed | extra, added)
