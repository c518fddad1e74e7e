"""Messages, embedding manifest and positions as views over plain tables, in Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time as t

START = 1_704_067_200_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("bag_"), (F.col("user_id") % 4).cast("string")).alias("bag"), (F.dayofyear("ts") - 1).cast("string").alias("mcap_id"), F.concat(F.lit("/"), "event_type").alias("topic"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("log_time_ns"), F.col("event_id").alias("sequence"), "value",
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, ns = table(spark, sf_dir, "embeddings"), F.lit(START) + F.col("vec_id") * 173_000_000_000
    return e.select(
        F.lit("model_a").alias("model"), F.concat(F.lit("bag_"), (F.col("vec_id") % 4).cast("string")).alias("bag"), F.col("vec_id").alias("id"), F.concat(F.lit("/camera_"), F.col("label").cast("string")).alias("topic"),
        ns.alias("timestamp_ns"), t.minute_of_day(ns).alias("minute_of_day"), t.div(F.col("vec_id"), 50).cast("string").alias("mcap_identifier"), "embedding",
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("bag_"), (F.col("o_orderkey") % 4).cast("string")).alias("bag"), F.month("o_orderdate").cast("string").alias("mcap_id"),
        (F.lit(51.0) + (F.col("o_custkey") % 997) * F.lit(0.00013)).alias("lat"), (F.lit(12.0) + (F.col("o_orderkey") % 991) * F.lit(0.00017)).alias("lon"),
    )


def topics(messages: DataFrame) -> DataFrame:
    """(bag, topic, msg_type) with a type made up from the topic's name."""
    kind = F.when(F.col("topic").contains("c"), "sensor_msgs/msg/CompressedImage").when(F.col("topic").contains("v"), "novatel_oem7_msgs/msg/BESTPOS").otherwise("sensor_msgs/msg/Imu")
    return messages.select("bag", "topic").distinct().withColumn("msg_type", kind)


SQL = f"""
WITH v_messages AS (SELECT concat('bag_', CAST(user_id % 4 AS varchar)) AS bag, CAST(dayofyear(ts) - 1 AS varchar) AS mcap_id, concat('/', event_type) AS topic, epoch_us(ts) * 1000 AS log_time_ns, event_id AS sequence, value FROM events),
v_manifest AS (SELECT 'model_a' AS model, concat('bag_', CAST(vec_id % 4 AS varchar)) AS bag, vec_id AS id, concat('/camera_', CAST(label AS varchar)) AS topic, {START} + vec_id * 173000000000 AS timestamp_ns,
  CAST((({START} + vec_id * 173000000000) // 60000000000) % 1440 AS int) AS minute_of_day, CAST(vec_id // 50 AS varchar) AS mcap_identifier, embedding::double[] AS embedding FROM embeddings),
v_positions AS (SELECT concat('bag_', CAST(o_orderkey % 4 AS varchar)) AS bag, CAST(month(o_orderdate) AS varchar) AS mcap_id, 51.0::double + (o_custkey % 997) * 0.00013::double AS lat, 12.0::double + (o_orderkey % 991) * 0.00017::double AS lon FROM orders)
"""
