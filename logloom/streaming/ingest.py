"""Incremental ingestion: new message files through the operators once, and a ledger of what is done.

`ingest` runs a file stream until nothing is left (availableNow). Its checkpoint keeps track of files; each batch rewrites
whole partitions (bag, mcap_id), so that a batch that is repeated after a failure changes nothing. The ledger is an
append-only table whose latest row for a key counts; a segment without messages is done as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import align, numbering

KEY = ["processor", "model", "bag", "mcap", "topic"]


def ledger_rows(items: DataFrame, processor: str, status: str = "completed", at: int | None = None) -> DataFrame:
    """Rows for items at any level: (bag, mcap_id) of a segment, with a model, a topic or both, or a model or bag alone."""
    level = lambda c: F.col(c).cast("string") if c in items.columns else F.lit(None).cast("string")
    when = F.unix_micros(F.current_timestamp()) if at is None else F.lit(at).cast("long")
    return items.select(F.lit(processor).alias("processor"), level("model").alias("model"), level("bag").alias("bag"), level("mcap_id").alias("mcap"), level("topic").alias("topic"), F.lit(status).alias("status"), when.alias("completed_at"))


def latest(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(*KEY).agg(F.max_by("status", "completed_at").alias("status"), F.max("completed_at").alias("completed_at"))


def unprocessed(items: DataFrame, ledger: DataFrame, processor: str) -> DataFrame:
    """Items that the processor has not completed: an item's columns among model, bag, mcap_id and topic name it, and the
    ledger's rows of just that level count."""
    named = {c: "mcap" if c == "mcap_id" else c for c in ("model", "bag", "mcap_id", "topic") if c in items.columns}
    others = [c for c in KEY[1:] if c not in named.values()]
    done = latest(ledger.where(F.col("processor") == processor)).where("status = 'completed'")
    for c in others:
        done = done.where(F.col(c).isNull())
    return items.join(done.select(*(F.col(k).alias(c) for c, k in named.items())).distinct(), list(named), "left_anti")


def merged_outputs(old: Column, new: Column) -> Column:
    return F.array_union(old, new)


def summaries_of(batch: DataFrame) -> DataFrame:
    """Counts and times by segment, the part of a summary that needs no other segment."""
    return batch.groupBy("bag", "mcap_id").agg(F.count("*").alias("count"), F.min("log_time_ns").alias("first_ts"), F.max("log_time_ns").alias("last_ts"))


def with_start_index(segments: DataFrame) -> DataFrame:
    """The summary over all segments that have been ingested so far, from each one's count."""
    return numbering.running_sum(segments, ["bag"], align.by_number(), "count", "start_index")


def ingest(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, outputs: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> StreamingQuery:
    """Every output over each batch's segments, into target/<name> by (bag, mcap_id); the ledger into target/ledger.

    A segment may come in several files and batches: a batch that touches one that is there already computes it from all
    of its files, which target/files names by segment; no other file is read again."""
    made = outputs or {"summary": summaries_of, "aligned": lambda b: align.nearest_messages(align.uniform_timeline(b), b)}
    key = ["bag", "mcap_id"]

    def by_batch(df: DataFrame, name: str, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{target}/{name}")

    def whole_segments(batch: DataFrame, number: int) -> DataFrame:
        if not number:
            return batch
        segments = batch.select("bag", F.col("mcap_id").cast("string").alias("mcap_id")).distinct()
        held = spark.read.parquet(f"{target}/files").where(F.col("batch") < number).join(segments, key, "left_semi")
        paths = [r["file"] for r in held.select("file").distinct().collect()]  # the late segments' own files
        if not paths:
            return batch
        earlier = spark.read.schema(schema).parquet(*paths).withColumn("file", F.lit(None).cast("string"))
        return batch.unionByName(earlier.join(segments, key, "left_semi").select(*batch.columns))

    def write(batch: DataFrame, number: int) -> None:
        held = whole_segments(batch.persist(), number)
        try:
            for name, f in made.items():
                f(held.drop("file")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key).parquet(f"{target}/{name}")
            named = batch.select("bag", F.col("mcap_id").cast("string").alias("mcap_id"), "file").distinct()
            by_batch(named, "files", number)
            by_batch(ledger_rows(named.select(*key).distinct(), "ingest"), "ledger", number)
        finally:
            batch.unpersist()

    stream = spark.readStream.schema(schema).parquet(source).select("*", F.col("_metadata.file_path").alias("file"))
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timed(messages: DataFrame, late: str) -> DataFrame:
    return messages.withColumn("at", F.timestamp_micros(F.call_function("div", "log_time_ns", F.lit(1000)))).withWatermark("at", late)


def live_counts(messages: DataFrame, late: str = "1 minute", width: str = "1 minute") -> DataFrame:
    """Counts by topic and window of event time over a live stream of (topic, log_time_ns); later rows than `late` are dropped."""
    return timed(messages, late).groupBy(F.window("at", width), "topic").agg(F.count("*").alias("n"))


def live_segments(messages: DataFrame, gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Segments of a live stream of (bag, topic, log_time_ns): a bag's messages without a pause of `gap`. State is kept for open segments
    alone; a segment is closed, and given out in append mode, when the watermark has passed its last message by `gap`. A late
    message that is not too late joins its own segment, or two that it lies between."""
    per = timed(messages, late).groupBy(F.session_window("at", gap).alias("s"), "bag")
    out = per.agg(F.count("*").alias("count"), F.min("log_time_ns").alias("first_ts"), F.max("log_time_ns").alias("last_ts"), F.approx_count_distinct("topic").alias("topics"))
    return out.select("bag", "count", "first_ts", "last_ts", "topics")
