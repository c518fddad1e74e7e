"""Semantic search: filters, stride sample, nearest vectors, ranks, marks and the funnel of counts.

Per-group top-k is a rank filter, which Spark plans as WindowGroupLimit: each task keeps k rows of a group before the
shuffle. Many queries ask a metric index (vectorindex.py). The rank of a query runs over at most k rows for each model and bag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import time as t
from ..functions import vectors as v
from . import vectorindex

K = 100
#: Fixed value: columns that a manifest must have.
REQUIRED = ["topic", "timestamp_ns", "minute_of_day", "mcap_identifier", "reference_timestamp_index", "shard_id", "row_in_shard"]


def missing_columns(df: DataFrame, required: list[str] = REQUIRED) -> list[str]:
    return [c for c in required if c not in df.columns]


def in_minutes(df: DataFrame, lo: int = 0, hi: int = 1439) -> DataFrame:
    return df.where(F.col("minute_of_day").between(lo, hi))


def window_condition(windows: dict[str, list[tuple[int, int]]] | None, bag: str = "bag", mcap: str = "mcap_identifier") -> Column:
    """Whether a row's segment is in one of its bag's inclusive ranges; bags without an entry are not filtered, ids that are no numbers match none."""
    if not windows:
        return F.lit(True)
    number, out = F.col(mcap).try_cast("int"), ~F.col(bag).isin(list(windows))
    for name, ranges in windows.items():
        hit = F.lit(False)
        for lo, hi in ranges:
            hit = hit | number.between(lo, hi)
        out = out | ((F.col(bag) == name) & F.coalesce(hit, F.lit(False)))
    return out


def in_windows(df: DataFrame, windows: dict[str, list[tuple[int, int]]] | None) -> DataFrame:
    return df.where(window_condition(windows))


def in_windows_table(df: DataFrame, windows: DataFrame, mcap: str = "mcap_identifier") -> DataFrame:
    """The same for windows in a table (bag, lo, hi): distinct rows by a semi join, and bags without an entry by an anti join."""
    named = windows.select("bag").distinct()
    number = df.withColumn("_n", F.col(mcap).try_cast("int"))
    inside = number.join(windows, (number["bag"] == windows["bag"]) & (F.col("_n") >= windows["lo"]) & (F.col("_n") <= windows["hi"]), "left_semi")
    return inside.unionByName(number.join(named, "bag", "left_anti").select(number.columns)).drop("_n")


def in_topics(df: DataFrame, topics: list[str] | None) -> DataFrame:
    return df.where(F.col("topic").isin(topics)) if topics else df


def stride(df: DataFrame, every: int, by: list[str], order: list[str]) -> DataFrame:
    """Rows 0, every, 2 every... of each group; no fewer than every row for every < 2."""
    if every <= 1:
        return df
    nth = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("_nth", nth).where(F.col("_nth") % every == 0).drop("_nth")


def nearest(df: DataFrame, query: DataFrame | list[float], k: int = K, by: tuple[str, ...] = ("model", "bag"), tie: str = "id") -> DataFrame:
    """The k rows of each group with the least squared L2 distance: exact, with `distance`, `cosine` and `local_rank`."""
    vector = query.scalar() if isinstance(query, DataFrame) else F.array(*(F.lit(float(x)).cast("float") for x in query))
    held = df.withColumn("query", vector).where(F.col("query").isNotNull())
    held = held.withColumn("distance", v.squared_l2(F.col("embedding"), F.col("query")))
    ranked = held.withColumn("local_rank", F.row_number().over(W.partitionBy(*by).orderBy("distance", tie))).where(F.col("local_rank") <= k)
    return ranked.withColumn("cosine", v.cosine(F.col("embedding"), F.col("query"))).drop("query")


def query_rows(df: DataFrame, every: int = 100, id: str = "id") -> DataFrame:  # noqa: A002
    """(query_id, query): the rows whose id is divisible by `every`."""
    return df.where((F.col(id) % every == 0) & F.col("embedding").isNotNull()).select(F.col(id).alias("query_id"), F.col("embedding").alias("query"))


def nearest_to(df: DataFrame, queries: DataFrame, k: int = K, by: tuple[str, ...] = ("model", "bag"), tie: str = "id", clusters: int | None = None, slot: int = vectorindex.SLOT) -> DataFrame:
    """df's k nearest rows of each query (query_id, query) and group by squared L2 distance, exact, with query_id, `distance`,
    `cosine` and `local_rank`; `tie` names a row within its group. All vectors have one width; rows without one are left out."""
    near, _ = vectorindex.nearest(vectorindex.build(df, by, tie, clusters, slot), queries, k)
    return near.join(df, [*by, tie])


def ranked(df: DataFrame, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """1..n over all rows, of each query if there are several: the input has at most k rows for each of these, model and bag."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def search(manifest: DataFrame, query: DataFrame | list[float], minutes: tuple[int, int] = (0, 1439), windows: dict | None = None, topics: list[str] | None = None, every: int = 1, k: int = K) -> DataFrame:
    """The k nearest rows of each model and bag behind the filters, ranked; query: a vector, a row (query), or a table
    (query_id, query), each of whose queries has its own ranks."""
    df = in_topics(in_windows(in_minutes(manifest, *minutes), windows), topics)
    df = stride(df, every, ["model", "bag", "topic"], ["timestamp_ns", "id"])
    order = ["distance", "model", "bag", "local_rank"]
    if isinstance(query, DataFrame) and "query_id" in query.columns:
        return ranked(nearest_to(df, query, k), order, ("query_id",))
    return ranked(nearest(df, query, k), order)


def of_query(found: DataFrame) -> list[str]:
    return [c for c in ("query_id",) if c in found.columns]


def result_rows(found: DataFrame) -> DataFrame:
    """The projection that a client shows: times as text, the local time of day, the score."""
    return found.select(*of_query(found), "rank", "model", "bag", "topic", F.col("mcap_identifier").alias("mcap"), F.col("timestamp_ns").cast("string").alias("ts"), t.local_hhmm(F.col("timestamp_ns")).alias("minute_local"), F.col("distance").alias("score"))


def marks(found: DataFrame, index: Column) -> DataFrame:
    """(model, bag, topic, value, rank), with query_id if there is one: the best rank of every marked index; marks without a rank have 100."""
    best = found.groupBy(*of_query(found), "model", "bag", "topic", index.alias("value")).agg(F.min("rank").alias("rank"))
    return best.withColumn("rank", F.coalesce("rank", F.lit(100)))


def nested_marks(marked: DataFrame) -> DataFrame:
    """(model, bag, topics): a map from topic to its marks."""
    by = of_query(marked)
    per = marked.groupBy(*by, "model", "bag", "topic").agg(F.array_sort(F.collect_list(F.struct("value", "rank"))).alias("marks"))
    return per.groupBy(*by, "model", "bag").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", "marks")))).alias("topics"))


def funnel(manifest: DataFrame, windows: dict | None, topics: list[str] | None, minutes: tuple[int, int], every: int) -> DataFrame:
    """Counts after each filter in one pass, and after the stride sample of each model, bag and topic."""
    in_seg, in_top, in_min = window_condition(windows), F.col("topic").isin(topics) if topics else F.lit(True), F.col("minute_of_day").between(*minutes)
    per = manifest.groupBy("model", "bag", "topic").agg(F.count("*").alias("total"), F.count_if(in_seg).alias("after_mcap"), F.count_if(in_seg & in_top).alias("after_topic"), F.count_if(in_seg & in_top & in_min).alias("after_time"))
    sampled = F.ceil(F.col("after_time") / max(1, every))
    return per.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("total", "after_mcap", "after_topic", "after_time")), F.coalesce(F.sum(sampled), F.lit(0)).cast("long").alias("after_sample"))
