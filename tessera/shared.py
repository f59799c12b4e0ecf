"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; only where it is unset (tests), a new local folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-tessera-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_scopes = threading.local()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables written within are removed at the end, but those that are to be kept (till the end of the scope around, if there is one)."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and a lost executor loses nothing.

    Once the table is there its shuffles are of no more use; Spark is told to remove their files, so a job of many steps holds those of
    one step only. Tables written under temporary() go at its end unless kept; the others are scratch, and the folder may be emptied when no
    job runs.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    stack = getattr(_scopes, "stack", [])
    if len(stack) > keep:  # a table kept here belongs to the scope around
        stack[-1 - keep].append(path)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)
