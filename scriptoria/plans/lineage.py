"""Cutting a lineage: a table in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and the master is local."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known and (d := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        known = d.get()
    if not known:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="scriptoria-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed with the tables of its scope."""
    path = f"{shared_folder(spark).rstrip('/')}/scriptoria/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_remove)
    _WRITTEN[path] = spark
    return path


def cut(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: a job runs now.

    What follows no longer depends on shuffle files of lost executors and isn't computed twice. `replaces`, a table that `cut` wrote
    and that nothing but `df` needs, is removed then: rounds of an iteration hold one table. Others go at the end of their `scope`, or
    when the driver ends.
    """
    spark = df.sparkSession
    path, schema = new_path(spark, name), df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scriptoria_path = path
    discard(replaces)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove tables that `cut` wrote; anything else is left alone."""
    for t in tables:
        path = getattr(t, "_scriptoria_path", None)
        if path in _WRITTEN:
            drop(path, _WRITTEN.pop(path))


@contextmanager
def scope() -> Iterator[None]:
    """Tables written inside are removed at the end: for queries whose result is consumed inside."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in [p for p in _WRITTEN if p not in before]:
            drop(path, _WRITTEN.pop(path))


def drop(path: str, spark: SparkSession) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove() -> None:
    for path, spark in _WRITTEN.items():
        try:
            drop(path, spark)
        except Exception:  # noqa: S112  a session that has ended can't remove its own; others still can
            continue
