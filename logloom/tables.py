"""Tables between the steps of a query: Parquet in the folder that all executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

FOLDER: ContextVar[str | None] = ContextVar("TABLES", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a session in one process may leave that unset, as a cluster's machines share no local folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (path or "file:///tmp/checkpoints").rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table. It cuts lineage, survives lost executors, and what Spark has numbered in it stays as it is."""
    path = f"{FOLDER.get() or shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def kept_in(spark: SparkSession, folder: str) -> Iterator[None]:
    """What written() writes meanwhile goes to folder, which is deleted at the end: what reads it must have been run by then."""
    token = FOLDER.set(folder)
    try:
        yield
    finally:
        FOLDER.reset(token)
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
