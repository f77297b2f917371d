"""The folder that driver and executors share, and tables kept in it."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

_kept: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Only where that is unset on a local master (tests) a temporary folder is made and set; on a
    cluster, whose executors could not see it, that raises an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        own = spark.sparkContext.getCheckpointDir()
        if own is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            own = "file://" + tempfile.mkdtemp(prefix="shared-")
            spark.sparkContext.setCheckpointDir(own)
        where = own
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store through the store's own driver."""
    system, where = _store(spark, path)
    system.delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it in the shared folder, so that later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets executors delete the shuffles of stages whose results are kept in the shared folder now.

    Spark deletes them once the driver has found that no plan refers to them any more, which by
    itself may take until its memory fills; so the driver is asked to look.
    """
    spark._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like cut, in compressed columns: a fraction of a checkpoint's disk, and a size that plans know."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    del df
    release(spark)
    return spark.read.parquet(path)


def kept(spark: SparkSession, name: str, sources: Iterable[str], make: Callable[[], DataFrame]) -> DataFrame:
    """A table made from files, written once a session and read from then on.

    name and the files below `sources`, with their sizes and times, tell tables apart; a file that
    has changed makes a new one.
    """
    state = hashlib.sha256(name.encode())
    for path in sorted(sources):
        system, where = _store(spark, path)
        for found in sorted((str(s.getPath()), s.getLen(), s.getModificationTime()) for s in (system.listStatus(where) if system.getFileStatus(where).isDirectory() else [system.getFileStatus(where)])):
            state.update(repr(found).encode())
    key = (spark.sparkContext.applicationId, state.hexdigest())
    if key not in _kept:
        path = scratch_path(spark, name)
        make().write.parquet(path)
        _kept[key] = path
        release(spark)
    return spark.read.parquet(_kept[key])
