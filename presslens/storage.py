"""Shared storage of intermediate tables.

Lineage is cut by writing a table to the folder that the cluster names in
``spark.checkpoint.dir``; all executors share it, so the loss of an executor
costs nothing. A folder of our own is set only where that setting is unset
(tests, notebooks).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_shared: dict[tuple, DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables. Where it is unset a temporary one is made in local mode; on a cluster that is an error, as executors do not share it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        set_by = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = set_by.get() if set_by.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="presslens-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/presslens/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` returned and that nothing reads any more."""
    path = getattr(df, "_written_at", None)
    found = [x for x in _written if x[1] == path]
    for x in found:
        _written.remove(x)
        _delete(*x)


def once(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of a session read, written by the first of them. ``key`` names it and its input."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _shared:
        _shared[key] = materialize(build(), str(key[1]))
    return _shared[key]


def table_bytes(df: DataFrame) -> int:
    """Bytes on disk of a table that ``materialize`` returned."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for name in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        pass


def release() -> None:
    """Delete every intermediate table written by this process."""
    _shared.clear()
    while _written:
        _delete(*_written.pop())


atexit.register(release)
