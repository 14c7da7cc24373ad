"""Keyed tables in a folder: versions are written beside each other, and numbered manifests name those that hold."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from lodestone.operators.index import latest


class LostUpdate(RuntimeError):
    """Another writer committed since this one read."""


class Store:
    """Named tables in ``folder``, each the union of some written parts.

    A commit of several tables becomes visible at once, as a manifest of the next number is renamed into its place; a
    crash before that changes nothing, and a reader sees the manifest before or after. Manifests are never changed. If
    two writers commit on top of the same manifest, the later one gets ``LostUpdate`` and has to begin again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path, self._rename = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Options.Rename
        self._fs = self._path(self.folder).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), conf)

    def version(self) -> int:
        """Number of the last manifest, 0 for an empty store."""
        at = self._path(f"{self.folder}/manifests")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(x.removesuffix(".json")) for x in names if x.endswith(".json") and x[0] != "."), default=0)

    def _manifest(self, number: int | None = None) -> dict[str, list[dict]]:
        number = self.version() if number is None else number
        if not number:
            return {}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder}/manifests/{number:012}.json").collect()))

    def tables(self) -> list[str]:
        return sorted(self._manifest())

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[p["at"] for p in self._manifest()[name]])

    def commit(self, changed: dict[str, DataFrame], added: dict[str, DataFrame] | None = None, on: int | None = None) -> int:
        """Writes new versions of tables, and parts to ``add`` to others; then the next manifest, whose number is returned.

        ``on``: the number of the manifest that the rows were computed from, if not the present one.
        """
        number = self.version() if on is None else on
        manifest = dict(self._manifest(number))
        for name, df in [*changed.items(), *(added or {}).items()]:
            at = f"{self.folder}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(at)
            part = {"at": at, "rows": self.spark.read.parquet(at).count()}
            manifest[name] = [part] if name in changed else [*manifest.get(name, []), part]
        self._fs.mkdirs(self._path(f"{self.folder}/manifests"))
        new, final = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/manifests/{number + 1:012}.json")
        out = self._fs.create(new)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self._rename, 0)
        try:
            self._context.rename(new, final, none)
        except Py4JJavaError as e:
            self._fs.delete(new, False)
            raise LostUpdate(f"{self.folder}: manifest {number + 1} is there already") from e
        return number + 1

    def upsert(self, name: str, rows: DataFrame, keys: list[str], order: list[str]) -> None:
        """Merges rows into a table: the last of each key wins."""
        number = self.version()
        both = self.read(name).unionByName(rows) if name in self._manifest(number) else rows
        self.commit({name: latest(both, keys, order)}, on=number)

    def remove(self, name: str, keys: DataFrame) -> None:
        number = self.version()
        self.commit({name: self.read(name).join(keys, keys.columns, "left_anti")}, on=number)

    def lengths(self) -> dict[str, int]:
        """Rows of each table, as the manifest keeps them: each commit counts the parts it wrote, by their footers, and no others."""
        return {n: sum(p["rows"] for p in parts) for n, parts in sorted(self._manifest().items())}

    counts = lengths

    def used_bytes(self) -> int:
        """Bytes of the parts that the last manifest names."""
        return sum(self._fs.getContentSummary(self._path(p["at"])).getLength() for parts in self._manifest().values() for p in parts)

    def at_capacity(self, quota_bytes: int) -> bool:
        return self.used_bytes() >= quota_bytes

    def vacuum(self, keep: int = 2) -> int:
        """Removes what only manifests older than the last ``keep`` name, and these; returns how many parts went."""
        last = self.version()
        held = {p["at"] for n in range(max(1, last - keep + 1), last + 1) for parts in self._manifest(n).values() for p in parts}
        gone = 0
        for n in range(last - keep, 0, -1):
            at = self._path(f"{self.folder}/manifests/{n:012}.json")
            if not self._fs.exists(at):
                break
            for part in {p["at"] for parts in self._manifest(n).values() for p in parts} - held:
                gone += self._fs.delete(self._path(part), True)
            self._fs.delete(at, False)
        return gone


def drift(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """Columns missing, surplus, or of another type than expected."""
    have = dict(df.dtypes)
    return [f"missing {c}" for c in expected if c not in have] + [f"surplus {c}" for c in have if c not in expected] + [f"{c}: {have[c]}, not {t}" for c, t in expected.items() if c in have and have[c] != t]
