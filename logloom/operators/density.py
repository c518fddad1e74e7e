"""Similarity of adjacent frames, its smoothing and resampling, and densities of marks on a timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as v

BINS, REACH, POINTS = 1000, 50, 1000


def adjacent_similarity(manifest: DataFrame) -> DataFrame:
    """(model, bag, topic, seq, ts, next_ts, similarity): cosine of each frame with the next; a group of n has n - 1."""
    w = W.partitionBy("model", "bag", "topic").orderBy("timestamp_ns", "id")
    both = manifest.select("model", "bag", "topic", (F.row_number().over(w) - 1).alias("seq"), F.col("timestamp_ns").alias("ts"), F.lead("timestamp_ns").over(w).alias("next_ts"), "embedding", F.lead("embedding").over(w).alias("_next"))
    return both.where("_next is not null").withColumn("similarity", v.cosine(F.col("embedding"), F.col("_next"))).drop("embedding", "_next")


def moving_average(series: DataFrame, by: list[str], seq: str = "seq", value: str = "similarity") -> DataFrame:
    """Box means of max(5, n / 200) values, only whole boxes: n - w + 1 of them, `seq` counting from 0."""
    sized = series.join(series.groupBy(*by).agg(F.count("*").alias("_n")), by).withColumn("_w", F.greatest(F.lit(5), F.floor(F.col("_n") / 200)).cast("int"))
    up = W.partitionBy(*by).orderBy(seq).rowsBetween(W.unboundedPreceding, W.currentRow)
    # a difference of running sums, as frames of a width that varies by group are not to be had
    summed = sized.withColumn("_s", F.sum(value).over(up)).withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(seq)))
    before = summed.select(*by, (F.col("_i") + F.col("_w")).alias("_i"), F.col("_s").alias("_b"))
    boxed = summed.where("_i >= _w").join(before, [*by, "_i"], "left")
    return boxed.select(*by, (F.col("_i") - F.col("_w")).alias("seq"), ((F.col("_s") - F.coalesce("_b", F.lit(0.0))) / F.col("_w")).alias("mean"))


def resampled(series: DataFrame, by: list[str], seq: str = "seq", value: str = "mean", points: int = POINTS) -> DataFrame:
    """(by, k, value): `points` evenly spaced values from the first to the last, interpolated between neighbours."""
    own = series.select(*by, F.col(seq).cast("long").alias("_i"), F.col(value).alias("_v"))
    at = F.col("k") * (F.col("_n") - 1) / F.lit(float(points - 1))
    asked = own.groupBy(*by).agg((F.max("_i") + 1).alias("_n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("_x", at)
    asked = asked.withColumn("_i", F.floor("_x")).withColumn("_j", F.least(F.col("_i") + 1, F.col("_n") - 1))
    ends = asked.join(own, [*by, "_i"]).withColumnRenamed("_v", "_a").join(own.select(*by, F.col("_i").alias("_j"), F.col("_v").alias("_b")), [*by, "_j"])
    return ends.select(*by, "k", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_x") - F.col("_i"))).alias("value"))


def heat_strip(similarity: DataFrame, points: int = POINTS) -> DataFrame:
    """(model, bag, topic, strip): `points` values of one minus similarity; long series are smoothed first."""
    by = ["model", "bag", "topic"]
    sized = similarity.join(similarity.groupBy(*by).agg(F.count("*").alias("_n")), by)
    short = resampled(sized.where(F.col("_n") < points), by, "seq", "similarity", points)
    long = resampled(moving_average(sized.where(F.col("_n") >= points).drop("_n"), by), by, "seq", "mean", points)
    both = short.unionByName(long).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", (1 - F.col("value")).alias("v")))).alias("s"))
    return both.select(*by, F.transform("s", lambda x: x["v"]).alias("strip"))


def mark_density(marks: DataFrame, by: list[str], position: str = "pos", rank: str = "rank", bins: int = BINS, reach: int = REACH) -> DataFrame:
    """(by, bin, score): tent kernels of marks at positions from 0 to 1; a mark touches only the bins within `reach`."""
    at = F.col(position) * bins
    lo, hi = F.greatest(F.lit(0), F.ceil(at - reach).cast("int")), F.least(F.lit(bins - 1), F.floor(at + reach).cast("int"))
    held = marks.select(*by, at.alias("_at"), v.rank_weight(F.col(rank)).alias("_w"), F.when(lo <= hi, F.sequence(lo, hi)).alias("_bins")).select(*by, "_at", "_w", F.explode_outer("_bins").alias("bin"))
    d = F.abs(F.col("bin") - F.col("_at"))
    return held.where(d < reach).groupBy(*by, "bin").agg(F.sum(F.col("_w") * (1 - d / reach)).alias("score"))


def density_maximum(marks: DataFrame, by: list[str], position: str = "pos", rank: str = "rank", reach: float = 0.05) -> DataFrame:
    """(by, peak): the largest density at any mark, at least 1. Marks meet by cells of `reach`, so each meets only those near it."""
    held = marks.select(*by, F.col(position).alias("_p"), v.rank_weight(F.col(rank)).alias("_w"))
    centres = held.select(*by, "_p").distinct().withColumn("_c", F.explode(F.array(*(F.floor(F.col("_p") / reach) + i for i in (-1, 0, 1)))))
    others = held.withColumn("_c", F.floor(F.col("_p") / reach)).select(*by, "_c", F.col("_p").alias("_q"), "_w").groupBy(*by, "_c", "_q").agg(F.sum("_w").alias("_w"))
    d = F.abs(F.col("_q") - F.col("_p"))
    return centres.join(others, [*by, "_c"]).where(d < reach).groupBy(*by, "_p").agg(F.sum(F.col("_w") * (1 - d / reach)).alias("_s")).groupBy(*by).agg(F.greatest(F.max("_s"), F.lit(1.0)).alias("peak"))
