"""Members of archives: zip, tar and gzip, nested, with bounds on depth and number."""

from __future__ import annotations

import gzip
import io
import mimetypes
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Nesting, and members of one page.
DEPTH, MEMBERS = 4, 1024
_CONTAINERS = {"application/zip": "zip", "application/x-tar": "tar", "application/gzip": "gzip", "application/x-gzip": "gzip"}


#: Bytes of a member, and of all members of one page, that are read at most.
MEMBER_BYTES, PAGE_BYTES = 64 << 20, 512 << 20


class TooManyMembers(ValueError):
    pass


class TooLarge(ValueError):
    """A member beyond the bound, whatever its header says: no more than the bound is ever unpacked."""


def _bounded(stream, limit: int) -> bytes:  # noqa: ANN001
    out = stream.read(limit + 1)
    if len(out) > limit:
        raise TooLarge
    return out


def _kind(name: str, media_type: str | None) -> str | None:
    if media_type in _CONTAINERS:
        return _CONTAINERS[media_type]
    low = name.lower()
    return "zip" if low.endswith(".zip") else "tar" if low.endswith((".tar", ".tar.gz", ".tgz")) else "gzip" if low.endswith(".gz") else None


def members(url: str, media_type: str | None, body: bytes) -> Iterator[tuple[str, str, bytes]]:
    """``(url, media type, body)`` of the members of one container; a name that comes twice counts once."""
    kind = _kind(url, media_type)
    seen: set[str] = set()
    if kind == "gzip" and not url.lower().endswith((".tar.gz", ".tgz")):
        name = url.rsplit("/", 1)[-1].removesuffix(".gz") or "member"
        entries = [(name, lambda: _bounded(gzip.GzipFile(fileobj=io.BytesIO(body)), MEMBER_BYTES))]
    elif kind == "zip":
        z = zipfile.ZipFile(io.BytesIO(body))
        entries = [(i.filename, lambda i=i: _bounded(z.open(i), MEMBER_BYTES)) for i in z.infolist() if not i.is_dir()]
    else:
        t = tarfile.open(fileobj=io.BytesIO(body))  # noqa: SIM115
        entries = [(i.name, lambda i=i: _bounded(t.extractfile(i), MEMBER_BYTES)) for i in t.getmembers() if i.isfile()]
    for name, read in entries:
        if name not in seen:
            seen.add(name)
            if len(seen) > MEMBERS:
                raise TooManyMembers(url)
            yield f"{url}!/{name}", mimetypes.guess_type(name)[0] or "application/octet-stream", read()


def expanded(url: str, media_type: str | None, body: bytes, depth: int = DEPTH, budget: int = MEMBERS) -> list[tuple[str, str, bytes | None, str | None]]:
    """``(url, media type, body, error)`` of all documents in a page; a member that fails is reported, the others go on.

    Where the budget of documents or of bytes ends, that is reported once, for the first that has no place.
    """
    out: list = []
    held = 0

    def full(url: str, media_type: str | None) -> bool:
        if len(out) < budget and held <= PAGE_BYTES:
            return False
        if not out or out[-1][3] != "document budget exhausted":
            out.append((url, media_type, None, "document budget exhausted"))
        return True

    def walk(url: str, media_type: str | None, body: bytes, level: int) -> bool:
        """Whether there is room for more."""
        nonlocal held
        if full(url, media_type):
            return False
        if _kind(url, media_type) is None:
            held += len(body)
            out.append((url, media_type or "application/octet-stream", body, None))
        elif level >= depth:
            out.append((url, media_type, None, "nested too deep"))
        else:
            try:
                for m in members(url, media_type, body):
                    if not walk(*m, level + 1):
                        return False
            except (OSError, EOFError, ValueError, RuntimeError, zipfile.BadZipFile, tarfile.TarError) as e:
                out.append((url, media_type, None, type(e).__name__))
        return True

    walk(url, media_type, body, 0)
    return out


def expand(files: DataFrame) -> DataFrame:
    """Documents in the pages of a table ``url, media_type, body``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.url, *d) for r in b.itertuples() if r.body is not None for d in expanded(r.url, r.media_type, bytes(r.body))]
            yield pd.DataFrame(rows, columns=["page", "url", "media_type", "body", "error"])

    return files.select("url", "media_type", "body").mapInPandas(run, "page string, url string, media_type string, body binary, error string")
