"""What several of the text operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a session in one process may leave that unset and
    gets a local folder; on a cluster each executor would write to a disk of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (path or "file:///tmp/checkpoints").rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


FOLDER: ContextVar[str | None] = ContextVar("FOLDER", default=None)


@contextmanager
def tables_in(spark: SparkSession, folder: str) -> Iterator[None]:
    """What table() writes meanwhile goes to folder, which is deleted at the end: what reads it must have been run by then."""
    token = FOLDER.set(folder)
    try:
        yield
    finally:
        FOLDER.reset(token)
        delete(spark, folder)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(df: DataFrame, name: str, scratch: list[DataFrame] | None = None, dictionary: bool = True) -> DataFrame:
    """df written as Parquet in the shared folder and read back. It cuts lineage as checkpoint() does, survives lost
    executors, and lets later steps read single columns. scratch gathers tables that drop_tables() is to delete.

    While it is written, Spark drops shuffle files as soon as a job has ended, since the table stands for what they held;
    the setting changes no result."""
    spark = df.sparkSession
    path = f"{FOLDER.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    if scratch is not None:
        scratch.append(out)
    return out


def drop_tables(scratch: list[DataFrame]) -> None:
    while scratch:
        drop_table(scratch.pop())


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table() that nothing reads any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, parent)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else. lower() does the same on pure ASCII and is several times faster there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


#: A side with more rows is never broadcast.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """Broadcast a side whose rows have been counted and are few; else Spark joins it by shuffle. A row with an array counts as
    `weight` rows more, about one for fifty bytes."""
    rows = df.count() if weight is None else df.agg(F.sum(weight + 1)).first()[0] or 0
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def with_row_key(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k1 and k2: 128 bits that name a document by its key and text; null keys and texts have theirs too, and rows that
    repeat both share one."""
    return docs.withColumns({"k1": F.xxhash64(key, text), "k2": F.xxhash64(F.lit("#"), text, key)})


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has such a column."""
    out = []
    for name in names:
        while name in df.columns or name in out:
            name += "_"
        out.append(name)
    return out


def components(edges: DataFrame, name: str, max_rounds: int = 50) -> DataFrame:
    """Connected components of edges (a, b): (node, root), root the least node that is reachable.

    Alternates the large-star and small-star steps until nothing changes; each is a minimum over neighbours and a join
    back, so no neighbourhood is ever gathered in one place. Loops and repeated edges do no harm; no edges, no rows.
    """
    def minimal(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.min("b").alias("m"))

    now = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = minimal(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = table(large.distinct(), name)
        small = minimal(large)
        star = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        star = star.unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        new = table(star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), name)
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_table(large)
        drop_table(now)
        now = new
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
