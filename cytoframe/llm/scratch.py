"""Lineage cuts: tables written to the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_DIR = "spark.checkpoint.dir"
_local: list[str] = []
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset and all runs on this machine (tests), a local temporary folder."""
    found = spark.conf.get(_DIR, None) or spark.sparkContext.getConf().get(_DIR)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{_DIR} must name a folder that driver and executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="cytoframe-"))
    return _local[0]


@contextlib.contextmanager
def _freeing_shuffles(spark: SparkSession):
    """Shuffle files of the write go as soon as its table stands; nothing reads them afterwards."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back.

    Unlike localCheckpoint the result survives the loss of executors, and unlike
    persist its columns can be pruned. The folder is the cluster's to expire, or
    :func:`release` removes this session's tables.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cytoframe-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with _freeing_shuffles(spark):
        df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Tables cut within go at the end, but for those appended to the list that it gives: what is returned must read no others."""
    kept: list[DataFrame] = []
    _open.append([])
    try:
        yield kept
    finally:
        # By their own names, as the same folder may be written with and without its file system.
        stay = {f.rsplit("/", 2)[-2] for table in kept for f in table.inputFiles()}
        for path in _open.pop():
            if path.rsplit("/", 1)[-1] not in stay:
                _delete(spark, path)


def forget(table: DataFrame) -> None:
    """Delete a table made by :func:`cut` once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        _delete(table.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Delete the tables that this session has cut; DataFrames that read them are unusable afterwards."""
    _delete(spark, f"{shared_dir(spark)}/cytoframe-{spark.sparkContext.applicationId}")
