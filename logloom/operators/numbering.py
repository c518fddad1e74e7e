"""Row numbers, running sums and nearest values in groups of any size, without a task that has a whole group.

Rows are dealt to tasks by ranges of (group, order) and written; a row's number in that table gives its task and its place
in it. What a group needs from earlier tasks (how many rows, which sum, which last value) is one row for each group and task; it is
carried over the tasks and joined back. So a group that holds most rows is spread like all others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import tables

ROW, PART = "_row", "_part"


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """df as a table in the order of by and `order`, with _row (rising in that order) and _part (the task that wrote it)."""
    keys = [*by, *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(ROW, F.monotonically_increasing_id())
    return tables.written(rows, "ranged").withColumn(PART, F.shiftright(ROW, 33))


def earlier(by: Sequence[str]) -> W:
    return W.partitionBy(*by).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)


def later(by: Sequence[str]) -> W:
    return W.partitionBy(*by).orderBy(F.desc(PART)).rowsBetween(W.unboundedPreceding, -1)


def met(rows: DataFrame, carried: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with what is carried into their group and task; null is a group like any other."""
    names = {c: f"_by{i}" for i, c in enumerate([*by, PART])}
    other = carried.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, (rows[c].eqNullSafe(other[k]) for c, k in names.items()))
    return rows.join(other, same).drop(*names.values())


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "idx", first: int = 0) -> DataFrame:
    """`name`: first, first + 1... over each group's rows in order (long); order must settle ties."""
    rows = ranged(df, by, order)
    per = rows.groupBy(*by, PART).agg(F.count("*").alias("_n"), F.min(ROW).alias("_first"))
    per = per.select(*by, PART, "_first", F.coalesce(F.sum("_n").over(earlier(by)), F.lit(0)).alias("_before"))
    return met(rows, per, by).withColumn(name, F.col("_before") + F.col(ROW) - F.col("_first") + first).drop(ROW, PART, "_first", "_before")


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], value: str, name: str) -> DataFrame:
    """`name`: the sum of `value` over a group's rows before this one."""
    rows = ranged(df, by, order)
    per = rows.groupBy(*by, PART).agg(F.sum(value).alias("_sum"))
    per = per.select(*by, PART, F.coalesce(F.sum("_sum").over(earlier(by)), F.lit(0)).alias("_before"))
    own = F.sum(value).over(W.partitionBy(*by, PART).orderBy(ROW).rowsBetween(W.unboundedPreceding, -1))
    return met(rows.withColumn("_own", own), per, by).withColumn(name, (F.col("_before") + F.coalesce("_own", F.lit(0))).cast("long")).drop(ROW, PART, "_own", "_before")


def with_neighbours(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], value: str, before: str = "before", after: str = "after") -> DataFrame:
    """before, after: the last `value` that is not null up to a row and the first from it on, in its group."""
    rows = ranged(df, by, order)
    own = W.partitionBy(*by, PART)
    up, down = (own.orderBy(o).rowsBetween(W.unboundedPreceding, W.currentRow) for o in (ROW, F.desc(ROW)))
    near = rows.withColumn("_b", F.last(value, True).over(up)).withColumn("_a", F.last(value, True).over(down))
    given = F.when(F.col(value).isNotNull(), F.col(ROW))
    edges = rows.groupBy(*by, PART).agg(F.min_by(value, given).alias("_first"), F.max_by(value, given).alias("_last"))
    edges = edges.withColumn("_eb", F.last("_last", True).over(earlier(by))).withColumn("_ea", F.last("_first", True).over(later(by)))
    both = met(near, edges.select(*by, PART, "_eb", "_ea"), by)
    return both.withColumn(before, F.coalesce("_b", "_eb")).withColumn(after, F.coalesce("_a", "_ea")).drop(ROW, PART, "_b", "_a", "_eb", "_ea")
