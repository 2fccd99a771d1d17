"""Intermediate tables that later steps use more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder of the enclosing `scratch`, if there is one.
_WITHIN: ContextVar[str | None] = ContextVar("within", default=None)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local master gets a folder of our own; on a cluster, where executors
    couldn't see it, that fails."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fieldmerge-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside go into a folder of their own, which is removed at the end: by then, results must be written."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    outer = _WITHIN.set(folder)
    try:
        yield
    finally:
        _WITHIN.reset(outer)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: it is computed once, however often it is used, and lost executors don't
    lose it. Inside of `scratch` the table goes with it; else whoever owns the folder clears it."""
    spark = df.sparkSession
    path = f"{_WITHIN.get() or shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
