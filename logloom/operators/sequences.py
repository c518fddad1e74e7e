"""Ordinals, fencepost samples, id ranges, time ticks and export parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import numbering


def ordinals(messages: DataFrame) -> DataFrame:
    """nth: a message's place among its topic's in its segment, from 0."""
    return messages.withColumn("nth", F.row_number().over(W.partitionBy("bag", "mcap_id", "topic").orderBy("log_time_ns", "sequence")) - 1)


def fenceposts(messages: DataFrame, parts: int = 8) -> DataFrame:
    """(bag, topic, p, mcap_id, nth, log_time_ns): the messages at the inner points of `parts` equal parts of a bag's
    segments; a point is a segment by its position, and within it the message at the same fraction."""
    segments = messages.select("bag", "mcap_id").distinct()
    place = segments.withColumn("pos", F.row_number().over(W.partitionBy("bag").orderBy(F.col("mcap_id").try_cast("int").asc_nulls_last(), "mcap_id")) - 1)
    points = segments.groupBy("bag").agg(F.count("*").alias("n")).withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(parts - 1))))
    exact = F.col("n") * F.col("p") / F.lit(float(parts))
    points = points.select("bag", "p", F.floor(exact).alias("pos"), (exact - F.floor(exact)).alias("frac")).join(place, ["bag", "pos"])
    counts = messages.groupBy("bag", "mcap_id", "topic").agg(F.count("*").alias("c"))
    wanted = points.join(counts, ["bag", "mcap_id"]).select("bag", "topic", "p", "mcap_id", F.floor(F.col("c") * F.col("frac")).cast("int").alias("nth"))
    return wanted.join(ordinals(messages).select("bag", "mcap_id", "topic", "nth", "log_time_ns"), ["bag", "mcap_id", "topic", "nth"]).select("bag", "topic", "p", "mcap_id", "nth", "log_time_ns")


def shards(df: DataFrame, by: list[str], order: list[str], size: int = 100_000, held: DataFrame | None = None) -> DataFrame:
    """Running ids in each group with shard and row within it. held: (by, id) of rows that are there already; each group goes
    on behind its own largest id and so fills its last shard first."""
    df, n = numbering.numbered(df, by, order, "_nth"), F.col("_nth")
    if held is not None:
        df = df.join(held.groupBy(*by).agg((F.max("id") + 1).alias("_from")), by, "left")
        n = n + F.coalesce("_from", F.lit(0))
    df = df.withColumn("id", n.cast("long")).drop("_from", "_nth")
    return df.withColumns({"shard_id": F.format_string("shard-%05d", (F.col("id") / size).cast("int")), "row_in_shard": (F.col("id") % size).cast("int")})


def range_ids(ranges: Column) -> Column:
    """The distinct ids of inclusive ranges (structs lo, hi), in order; reversed ranges are empty."""
    one = F.transform(ranges, lambda r: F.when(r["lo"] <= r["hi"], F.sequence(r["lo"], r["hi"])).otherwise(F.array().cast("array<int>")))
    return F.array_sort(F.array_distinct(F.flatten(one)))


def part_numbers(exports: DataFrame, order: str = "start_index") -> DataFrame:
    """part: 1, 2... within exports of one bag, null for an only one."""
    w = W.partitionBy("bag")
    return exports.withColumn("part", F.when(F.count("*").over(w) > 1, F.row_number().over(w.orderBy(order))))


#: The steps of ticks and of labels in seconds, and how many there may be.
TICK_STEPS, LABEL_STEPS, MOST_TICKS = (10, 20, 30), (10, 20, 30, 60, 120, 180, 300, 600, 900, 1800, 3600), 54


def time_ticks(summary: DataFrame) -> DataFrame:
    """(bag, tick_s, share, labelled): ticks at whole steps of a bag's span, at the finest step that gives at most
    MOST_TICKS, else every minute; share is a tick's place in the span, and the labelled ones are those at the least step of
    LABEL_STEPS with at most MOST_TICKS. A span below a millisecond has none."""
    ms = lambda c: F.floor(F.col(c) / 1_000_000)
    span = summary.groupBy("bag").agg(F.min("first_ts").alias("a"), F.max("last_ts").alias("b")).select("bag", ms("a").alias("a"), ms("b").alias("b")).where("b > a")
    step = F.lit(60)
    for s in reversed(TICK_STEPS):
        step = F.when(F.floor((F.col("b") - F.col("a")) / 1000.0 / s) <= MOST_TICKS, s).otherwise(step)
    span = span.withColumn("step", step)
    label = F.lit(LABEL_STEPS[-1])
    for s in reversed(LABEL_STEPS):
        both = F.when(F.lit(s) % F.col("step") == 0, s).otherwise(2 * s)  # a tick at a multiple of both steps
        held = F.floor(F.col("b") / (both * 1000)) - F.ceil(F.col("a") / (both * 1000)) + 1
        label = F.when((F.lit(s) >= F.col("step")) & (held <= MOST_TICKS), s).otherwise(label)
    first = F.ceil(F.col("a") / (F.col("step") * 1000)).cast("long") * F.col("step")
    last = F.floor(F.col("b") / 1000).cast("long")
    ticks = span.withColumn("label", label).withColumn("tick_s", F.explode(F.when(first <= last, F.sequence(first, last, F.col("step").cast("long")))))
    share = (F.col("tick_s") * 1000 - F.col("a")) / (F.col("b") - F.col("a"))
    return ticks.select("bag", "tick_s", share.alias("share"), (F.col("tick_s") % F.col("label") == 0).alias("labelled"))
