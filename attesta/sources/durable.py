"""Cutting lineage with tables that every executor can read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_made: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application for intermediate tables, under spark.checkpoint.dir.

    Where the session names no folder, one is made on this machine, which only a local session may do: on a cluster the
    executors would not see it, so there it is an error. What is written is removed by `clear`, at the latest when the
    driver ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _made:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="attesta-")
        if not _made:
            atexit.register(clear)
        _made[app] = f"{base.rstrip('/')}/attesta-{app}"
    return _made[app]


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """`df` written as a parquet table to the shared folder and read from there; losing an executor loses nothing of it.

    The columns that a reader doesn't select are not read, and the table's size is known where a join is planned.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of whatever file system; none where there is no folder."""
    at, fs = _at(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file of its own in whatever file system."""
    at, fs = _at(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(content))
    out.close()


def clear(spark: SparkSession | None = None) -> None:
    """Remove the intermediate tables of this application. DataFrames that read them can't be used any more."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    path = _made.pop(spark.sparkContext.applicationId, None)
    if path:
        at, fs = _at(spark, path)
        fs.delete(at, True)


def sized(written: DataFrame, most: int) -> DataFrame:
    """A table just written by `durable`, marked for broadcast where it has at most `most` rows; beyond, joins shuffle it."""
    return F.broadcast(written) if written.count() <= most else written
