"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_named: ContextVar[list[str] | None] = ContextVar("named", default=None)


def root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a session of one machine; a cluster,
    whose executors wouldn't see it, gets an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        made = tempfile.mkdtemp(prefix="primeweft-")
        atexit.register(shutil.rmtree, made, True)
        sc.setCheckpointDir("file://" + made)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def path_of(spark: SparkSession, tag: str) -> str:
    """A new folder name in the shared scratch space, deleted when Spark ends."""
    path = f"{root(spark)}/primeweft/{tag}-{uuid.uuid4().hex}"
    if (names := _named.get()) is not None:
        names.append(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


@contextmanager
def named() -> Iterator[list[str]]:
    """The folders that are named inside."""
    names: list[str] = []
    before = _named.set(names)
    try:
        yield names
    finally:
        _named.reset(before)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch folders that nothing reads any more."""
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared scratch space and read back, and its folder.

    It cuts lineage: later stages reread files that all executors share, and
    unique row ids made before it stay as they are.
    """
    path = path_of(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
