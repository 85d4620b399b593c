"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the context's checkpoint folder. A temporary folder only in local mode (tests), where
    driver and executors are one process; elsewhere a missing setting is an error, as executors would not see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="flowloom-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Writes a table and reads it back: lineage ends here, and a lost executor costs nothing that was done before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flowloom-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.settled_at = path
    _tables().append(path)
    return back


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Deletes the files of a settled table that nothing reads any more."""
    delete(df.sparkSession, df.settled_at)


_local = threading.local()


def _tables() -> list[str]:
    """Tables that this thread has settled and not swept."""
    if not hasattr(_local, "tables"):
        _local.tables = []
    return _local.tables


def mark() -> int:
    """A place in the sequence of settled tables, for sweep()."""
    return len(_tables())


def sweep(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Deletes the tables that this thread has settled since a mark, except those that the tables to keep read."""
    tables = _tables()
    read = {part for df in keep for file in df.inputFiles() for part in file.split("/") if part.startswith("flowloom-")}
    for path in tables[since:]:
        if path.rpartition("/")[2] not in read:
            delete(spark, path)
    tables[since:] = [path for path in tables[since:] if path.rpartition("/")[2] in read]
