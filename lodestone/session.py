"""Session helpers: where intermediate tables go, and how wide to shuffle."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PLACES: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the master is local (tests, a laptop) and it is unset, a temporary folder is chosen and set: on a cluster
    executors couldn't read it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        existing = spark.sparkContext._jsc.sc().getCheckpointDir()
        if existing.isDefined():
            return existing.get()
        if not (spark.sparkContext.master or "").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lodestone-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def place(spark: SparkSession, name: str) -> str:
    """A new folder of the session within the shared one. What stands in it goes when the session ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _PLACES:
        atexit.register(_remove_places)
    _PLACES.append((spark, at))
    return at


def _remove_places() -> None:
    for spark, at in _PLACES:
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001, S110 - the session may be gone; then the folder's owner clears it
            pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage in a form that outlives executors and stays splittable and column-prunable.
    """
    at = place(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, for work that costs far more than moving its rows, if the table has too few splits for that.

    Never at scale: a table with a split for every second core is left as it is, so what is moved has fewer splits than
    the cluster has cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
