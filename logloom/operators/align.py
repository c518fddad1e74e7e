"""Aligning topics to one timeline, and summaries of timelines.

The nearest message comes from the union of ticks and messages in ranges of (segment, topic, time): two running windows inside
a range, and a carry of each range's first and last message. Places in a bag are numbered over ranges likewise, so a
topic or bag that holds most rows is spread over all tasks (numbering.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import numbering

#: Fixed value: 100 ms.
TOLERANCE = 100_000_000
SEGMENT = ["bag", "mcap_id"]
#: Rows of a bucket of indexes.
BUCKET = 1024


def by_number() -> list[Column]:
    """The order of a bag's segments: by number, then those that are none."""
    return [F.col("mcap_id").try_cast("int").asc_nulls_last(), F.col("mcap_id")]


def topic_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy(*SEGMENT, "topic").agg(F.count("*").alias("n"), F.min("log_time_ns").alias("first_ts"), F.max("log_time_ns").alias("last_ts"))


def reference_topics(messages: DataFrame) -> DataFrame:
    """(bag, mcap_id, topic, n, first_ts, last_ts, half_interval): each segment's topic of most messages; ties go to the earliest."""
    best = topic_counts(messages).groupBy(*SEGMENT).agg(F.max_by(F.struct("topic", "n", "first_ts", "last_ts"), F.struct("n", -F.col("first_ts"))).alias("r")).select(*SEGMENT, "r.*")
    return best.withColumn("half_interval", F.when(F.col("n") > 1, (F.col("last_ts") - F.col("first_ts")) / (F.col("n") - 1) / 2.0))


def uniform_timeline(messages: DataFrame) -> DataFrame:
    """(bag, mcap_id, ref_idx, ref_ts): ticks at half the reference topic's mean interval, from its first message up to its last.

    As in double arithmetic at this magnitude: the step is what the first tick gains by it. Fewer than two messages, or
    no interval, give the distinct message times themselves."""
    ref = reference_topics(messages)
    start = F.col("first_ts").cast("double")
    step = (start + F.col("half_interval")) - start
    regular = ref.where((F.col("n") > 1) & (F.col("half_interval") > 0)).withColumn("start", start).withColumn("step", step)
    ticks = F.ceil((F.col("last_ts").cast("double") - F.col("start")) / F.col("half_interval")).cast("long")
    regular = regular.select(*SEGMENT, "start", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(ticks - 1, F.lit(0)))).alias("ref_idx"))
    regular = regular.select(*SEGMENT, "ref_idx", (F.col("start") + F.col("ref_idx") * F.col("step")).cast("long").alias("ref_ts"))
    odd = ref.where((F.col("n") <= 1) | (F.col("half_interval") == 0)).select(*SEGMENT, F.lit(0).cast("long").alias("ref_idx"), F.col("first_ts").alias("ref_ts"))
    return regular.unionByName(odd)


def nearest_messages(ticks: DataFrame, messages: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(bag, mcap_id, ref_idx, ref_ts, topic, topic_ts): of every tick and topic of its segment the nearest message's time;
    the earlier on ties, null from `tolerance` on."""
    topics = messages.select(*SEGMENT, "topic").distinct()
    asked = ticks.join(topics, SEGMENT).select(*SEGMENT, "topic", F.col("ref_ts").alias("t"), "ref_idx", F.lit(None).cast("long").alias("v"))
    given = messages.select(*SEGMENT, "topic", F.col("log_time_ns").alias("t"), F.lit(None).cast("long").alias("ref_idx"), F.col("log_time_ns").alias("v")).distinct()
    both = numbering.with_neighbours(asked.unionByName(given), [*SEGMENT, "topic"], ["t", F.col("v").asc_nulls_last(), "ref_idx"], "v").where("ref_idx is not null")
    at, before, after = F.col("t"), F.col("before"), F.col("after")
    near = F.when(before.isNull(), after).when(after.isNull(), before).when(at - before <= after - at, before).otherwise(after)
    return both.select(*SEGMENT, "ref_idx", F.col("t").alias("ref_ts"), "topic", F.when(F.abs(near - at) < tolerance, near).alias("topic_ts"))


def with_missing_topics(aligned: DataFrame, expected: DataFrame) -> DataFrame:
    """aligned and, for topics of (bag, topic) that a segment lacks, rows of nulls."""
    ticks = aligned.select(*SEGMENT, "ref_idx", "ref_ts").distinct()
    lacking = ticks.select(*SEGMENT).distinct().join(expected, "bag").join(aligned.select(*SEGMENT, "topic").distinct(), [*SEGMENT, "topic"], "left_anti")
    return aligned.unionByName(ticks.join(lacking, SEGMENT).withColumn("topic_ts", F.lit(None).cast("long")).select(aligned.columns))


def max_distances(aligned: DataFrame) -> DataFrame:
    """Of each tick the largest distance to an aligned message; null if there is none."""
    return aligned.groupBy(*SEGMENT, "ref_idx", "ref_ts").agg(F.max(F.abs(F.col("topic_ts") - F.col("ref_ts"))).alias("max_distance"))


def alignment_stats(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("bag", "topic").agg(F.count("topic_ts").alias("n_aligned"), F.count("*").alias("n_ticks"), (F.count("topic_ts") / F.count("*")).alias("share"))


def wide(aligned: DataFrame, topics: list[str]) -> DataFrame:
    """One column for each topic, for files that need it."""
    return aligned.groupBy(*SEGMENT, "ref_idx", "ref_ts").pivot("topic", topics).agg(F.first("topic_ts"))


#: Texts that stand for no time in a lookup table.
NO_TIME = ["nan", "None", ""]


def present(text: Column) -> Column:
    """A time as text, null where it stands for none."""
    return F.when(~text.isin(NO_TIME), text)


def topic_map(aligned: DataFrame) -> DataFrame:
    """Of each tick a map from topic to its time as text; topics without one are null in it; times may be numbers or text."""
    return aligned.groupBy(*SEGMENT, "ref_idx", "ref_ts").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", present(F.col("topic_ts").cast("string")).alias("topic_ts"))))).alias("topics"))


def summaries(timeline: DataFrame, ts: str = "ref_ts") -> DataFrame:
    """(bag, mcap_id, start_index, count, first_ts, last_ts): segments in numeric order with the index at which each begins."""
    per = timeline.groupBy(*SEGMENT).agg(F.count("*").alias("count"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return numbering.running_sum(per, ["bag"], by_number(), "count", "start_index").select(*SEGMENT, "start_index", "count", "first_ts", "last_ts")


def bag_totals(summary: DataFrame) -> DataFrame:
    per = F.array_sort(F.collect_list(F.struct("start_index", "mcap_id", "count", "first_ts", "last_ts")))
    return summary.groupBy("bag").agg(F.sum("count").alias("total_count"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), per.alias("mcap_ranges"))


def global_index(timeline: DataFrame, ts: str = "ref_ts") -> DataFrame:
    """idx: a row's place in its bag, by time and then by segment; rows that share both are numbered in any order."""
    return numbering.numbered(timeline, ["bag"], [ts, *by_number()])


def buckets(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(F.floor(lo / BUCKET), F.floor(hi / BUCKET)))


def segment_of_index(points: DataFrame, summary: DataFrame, idx: str = "idx") -> DataFrame:
    """points (bag, idx) with the segment whose range holds idx, and the place in it.

    A segment is copied to each bucket of BUCKET indexes that it reaches, so the join is one of equal bags and buckets."""
    held = summary.where(F.col("count") > 0).select(F.col("bag").alias("_bag"), F.col("mcap_id").alias("_m"), F.col("start_index").alias("_s"), "count")
    held = held.withColumn("_k", buckets(F.col("_s"), F.col("_s") + F.col("count") - 1))
    inside = (F.col("bag") == F.col("_bag")) & (F.floor(F.col(idx) / BUCKET) == F.col("_k")) & (F.col(idx) >= F.col("_s")) & (F.col(idx) < F.col("_s") + F.col("count"))
    return points.join(held, inside, "left").select(*points.columns, F.col("_m").alias("mcap_id"), (F.col(idx) - F.col("_s")).alias("offset"))


def nearest_non_null(rows: DataFrame, by: list[str], idx: str, value: str, radius: int = 100) -> DataFrame:
    """found, found_at: the value at idx or the nearest one at most `radius` indexes off; the one before on ties.

    Buckets of indexes, with the values within `radius` of a bucket copied to it, are the unit of work."""
    span = max(4 * BUCKET, 4 * radius)
    bucket = lambda c: F.floor(c / span)
    given = rows.where(F.col(value).isNotNull()).select(*by, idx, F.struct(F.col(idx).alias("i"), F.col(value).alias("v")).alias("_g"))
    given = given.withColumn("_b", F.explode(F.sequence(bucket(F.col(idx) - radius), bucket(F.col(idx) + radius)))).withColumn("_asks", F.lit(False))
    asked = rows.withColumn("_g", F.lit(None).cast(given.schema["_g"].dataType)).withColumn("_b", bucket(F.col(idx))).withColumn("_asks", F.lit(True))
    own = W.partitionBy(*by, "_b")
    up, down = (own.orderBy(o, "_asks").rowsBetween(W.unboundedPreceding, W.currentRow) for o in (F.col(idx), F.desc(idx)))
    both = asked.unionByName(given, allowMissingColumns=True).withColumn("_l", F.last("_g", True).over(up)).withColumn("_r", F.last("_g", True).over(down)).where("_asks")
    left, right = F.col(idx) - F.col("_l.i"), F.col("_r.i") - F.col(idx)
    pick = F.when((left <= radius) & (right.isNull() | (left <= right)), F.col("_l")).when(right <= radius, F.col("_r"))
    return both.withColumn("found", pick["v"]).withColumn("found_at", pick["i"]).drop("_l", "_r", "_g", "_b", "_asks")


def reference_index_of(aligned: DataFrame, stamps: DataFrame) -> DataFrame:
    """stamps (bag, topic, ts) with the reference tick that has that time in any column: the first tick, then the first
    topic; a tick's own time counts as well. Times of no tick have nulls."""
    ticks = global_index(aligned.select(*SEGMENT, "ref_ts").distinct()).select("bag", "ref_ts", "idx")
    own = ticks.select("bag", F.col("ref_ts").alias("ts"), "ref_ts", "idx", F.lit("").alias("col"))
    other = aligned.where("topic_ts is not null").select("bag", F.col("topic_ts").alias("ts"), "ref_ts", F.col("topic").alias("col")).join(ticks, ["bag", "ref_ts"]).select("bag", "ts", "ref_ts", "idx", "col")
    first = own.unionByName(other).groupBy("bag", "ts").agg(F.min(F.struct("idx", "col", "ref_ts")).alias("m"))
    return stamps.join(first, ["bag", "ts"], "left").select(*stamps.columns, F.col("m.ref_ts").alias("ref_ts"), F.col("m.idx").cast("long").alias("ref_idx"))


def successive_differences(df: DataFrame, by: list[str], ts: str) -> DataFrame:
    return df.withColumn("step", F.col(ts) - F.lag(ts).over(W.partitionBy(*by).orderBy(ts)))


def in_bounds(idx: Column, n: Column) -> Column:
    return F.coalesce((idx >= 0) & (idx < n), F.lit(False))
