"""Embedding manifests and summaries as clients keep them: vectors by shard, column order, metadata, names of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names

# The order of a manifest's columns, and how many results a page shows at first.
COLUMN_ORDER = ["id", "topic", "timestamp_ns", "minute_of_day", "mcap_identifier", "reference_timestamp", "reference_timestamp_index", "shard_id", "row_in_shard"]
PAGE = 12


def with_vectors(manifest: DataFrame, vectors: DataFrame, by: tuple[str, ...] = ("model", "bag")) -> DataFrame:
    """manifest rows with the embedding of their place (shard_id, row_in_shard); places without a vector are left out."""
    return manifest.join(vectors.select(*by, "shard_id", "row_in_shard", "embedding"), [*by, "shard_id", "row_in_shard"])


def ordered_columns(manifest: DataFrame) -> DataFrame:
    """The columns of COLUMN_ORDER that there are, then the others as they come."""
    return manifest.select(*(c for c in COLUMN_ORDER if c in manifest.columns), *(c for c in manifest.columns if c not in COLUMN_ORDER))


def metadata(vectors: DataFrame, by: tuple[str, ...] = ("model", "bag")) -> DataFrame:
    """(by, D, dtype, total_count): the largest width of a group's vectors and how many there are."""
    return vectors.groupBy(*by).agg(F.max(F.size("embedding")).alias("D"), F.lit("float32").alias("dtype"), F.count("*").alias("total_count"))


def client_summary(totals: DataFrame) -> DataFrame:
    """(bag, count, firstTimestampNs, lastTimestampNs, mcapRanges, _needsBackfill) of align.bag_totals(): times as text, for
    clients without 64-bit numbers; a range without a last time asks to be filled in."""
    text = lambda c: c.cast("string")
    one = lambda r: F.struct(r["start_index"].alias("startIndex"), r["mcap_id"].alias("mcapIdentifier"), F.coalesce(r["count"], F.lit(0)).alias("count"), text(r["first_ts"]).alias("firstTimestampNs"), text(r["last_ts"]).alias("lastTimestampNs"))
    ranges = F.transform("mcap_ranges", one)
    return totals.select(
        "bag", F.coalesce("total_count", F.lit(0)).alias("count"), text(F.col("first_ts")).alias("firstTimestampNs"), text(F.col("last_ts")).alias("lastTimestampNs"),
        ranges.alias("mcapRanges"), F.exists("mcap_ranges", lambda r: r["last_ts"].isNull()).alias("_needsBackfill"),
    )


def page(ranked: DataFrame, shown: int = PAGE, by: tuple[str, ...] = ()) -> DataFrame:
    """The first rows of `rank` that a client shows, of each query if there are several; `shown` grows page by page."""
    return ranked.where(F.col("rank") <= shown).orderBy(*by, "rank")


def ordered_distinct(values: Column) -> Column:
    """An array's different values in the order of their first places, without nulls and empty texts."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def pending_segments(pending: DataFrame, selected: DataFrame) -> DataFrame:
    """(path, mcap_id) of pending (key, mcap_id): a key is a selected path or the name of one; of several paths with a name
    the least counts, and keys that name none are left out."""
    by_name = selected.groupBy(names.bag_key(F.col("path")).alias("key")).agg(F.min("path").alias("path"))
    keys = by_name.unionByName(selected.select(F.col("path").alias("key"), "path")).groupBy("key").agg(F.min("path").alias("path"))
    return pending.join(keys, "key").select("path", "mcap_id").distinct()


def export_batch(items: DataFrame, batch: Column) -> DataFrame:
    """items (place, name, source_rosbag, ...) of one batch: those without a source get the first one's, and more than one item
    share a parent folder `batch`."""
    first = items.where("source_rosbag <> ''").agg(F.min_by("source_rosbag", "place")).scalar()
    count = items.agg(F.count("*")).scalar()
    source = F.when(F.coalesce("source_rosbag", F.lit("")) == "", first).otherwise(F.col("source_rosbag"))
    return items.withColumns({"source_rosbag": source, "output_parent": F.when(count > 1, batch)})
