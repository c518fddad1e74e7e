"""Exports: planning ranges of a bag, selecting their messages, and writing them.

A plan row is (bag, name, start_index, end_index, windows); ends of a range in time are half-open unless asked for.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import messages as decoding
from ..functions import names
from ..sources import mcap
from .align import global_index, segment_of_index
from .spatial import islands


def range_scan(messages: DataFrame, topics: list[str] | None = None, start: int | None = None, end: int | None = None, inclusive_end: bool = False) -> DataFrame:
    """Messages of the topics in [start, end); either end may be open. All conditions reach the scan."""
    out = messages.where(F.col("topic").isin(topics)) if topics else messages
    out = out.where(F.col("log_time_ns") >= start) if start is not None else out
    if end is not None:
        out = out.where(F.col("log_time_ns") <= end if inclusive_end else F.col("log_time_ns") < end)
    return out


def message_at(messages: DataFrame, bag: str, topic: str, t: int) -> DataFrame:
    return range_scan(messages.where(F.col("bag") == bag), [topic], t, t + 1).orderBy("log_time_ns", "sequence").limit(1)


def windows_of_segments(chosen: DataFrame, summary: DataFrame) -> DataFrame:
    """(bag, lo, hi, start_index, end_index): runs of chosen segments that follow each other in the bag, as index ranges."""
    w = W.partitionBy("bag").orderBy("start_index")
    placed = summary.withColumn("pos", F.row_number().over(w) - 1)
    held = placed.join(chosen.select("bag", "mcap_id").distinct(), ["bag", "mcap_id"], "left_semi")
    runs = islands(held, ["bag"], "pos")
    first = placed.select("bag", F.col("pos").alias("lo"), "start_index")
    last = placed.select("bag", F.col("pos").alias("hi"), (F.col("start_index") + F.col("count") - 1).alias("end_index"))
    return runs.join(first, ["bag", "lo"]).join(last, ["bag", "hi"]).select("bag", "lo", "hi", "start_index", "end_index")


def planned(parts: DataFrame, timeline: DataFrame, summary: DataFrame) -> DataFrame:
    """parts (bag, start_index, end_index) with the times and segments of both ends; parts out of range are left out."""
    idx = global_index(timeline).select("bag", "idx", "ref_ts")
    held = parts.where("start_index >= 0 and start_index <= end_index")
    both = held.join(idx.select("bag", F.col("idx").alias("start_index"), F.col("ref_ts").alias("start_ts")), ["bag", "start_index"]).join(idx.select("bag", F.col("idx").alias("end_index"), F.col("ref_ts").alias("end_ts")), ["bag", "end_index"])
    for end in ("start", "end"):
        both = segment_of_index(both, summary, f"{end}_index").withColumnRenamed("mcap_id", f"{end}_mcap").drop("offset")
    return both


def export_messages(messages: DataFrame, plan: DataFrame, topics: list[str] | None = None, inclusive_end: bool = False) -> DataFrame:
    """Messages of planned parts with `part_mcap`, segments numbered densely in each part. The first and last segments
    are bounded in time, those between are whole. plan: bag, name, start_ts, end_ts, start_mcap, end_mcap."""
    m = messages.where(F.col("topic").isin(topics)) if topics else messages
    number = F.col("mcap_id").try_cast("int")
    lo, hi, n, ts = F.col("start_mcap").try_cast("int"), F.col("end_mcap").try_cast("int"), F.col("_n"), F.col("log_time_ns")
    # parts meet the list of segments, and messages only the parts of their own segment
    wanted = m.select("bag", "mcap_id").distinct().withColumn("_n", number).join(plan, "bag").where((n >= lo) & (n <= hi))
    joined = m.join(F.broadcast(wanted) if wanted.count() <= 100_000 else wanted, ["bag", "mcap_id"])
    below = ts <= F.col("end_ts") if inclusive_end else ts < F.col("end_ts")
    held = joined.where(((n != lo) | (ts >= F.col("start_ts"))) & ((n != hi) | below))
    numbers = held.select("name", "_n").distinct().withColumn("part_mcap", F.row_number().over(W.partitionBy("name").orderBy("_n")) - 1)
    return held.join(numbers, ["name", "_n"]).select("name", "part_mcap", *messages.columns)


def duplicate_names(exports: DataFrame) -> DataFrame:
    """exports whose trimmed name occurs more than once; blank names don't count."""
    name = F.trim("name")
    return exports.withColumn("_k", name).withColumn("_c", F.count("*").over(W.partitionBy("_k"))).where((F.col("_k") != "") & (F.col("_c") > 1)).drop("_k", "_c")


def export_names(windows: DataFrame) -> DataFrame:
    """name: the bag's, sanitised, with `_ids_a_to_b` over all of its windows (`_id_a` for one id), and `_partN` if there are several."""
    w = W.partitionBy("bag")
    lo, hi = F.min("lo").over(w), F.max("hi").over(w)
    suffix = F.when(F.count("*").over(w) > 1, F.concat(F.lit("_part"), F.row_number().over(w.orderBy("lo")).cast("string"))).otherwise("")
    ids = F.when(lo == hi, F.concat(F.lit("_id_"), lo.cast("string"))).otherwise(F.concat(F.lit("_ids_"), lo.cast("string"), F.lit("_to_"), hi.cast("string")))
    return windows.withColumn("name", F.concat(names.sanitised(F.col("bag")), ids, suffix))


def pcd_text(points: Column, with_colour: bool) -> Column:
    """An ASCII point cloud file, version 0.7, of structs x, y, z (r, g, b)."""
    rgb = lambda p: F.shiftleft(p["r"], 16).bitwiseOR(F.shiftleft(p["g"], 8)).bitwiseOR(p["b"])
    line = lambda p: F.concat(F.concat_ws(" ", *(p[c].cast("double").cast("string") for c in "xyz"), *([rgb(p).cast("string")] if with_colour else [])), F.lit("\n"))
    n = F.size(points).cast("string")
    fields = ("x y z rgb", "4 4 4 4", "F F F U", "1 1 1 1") if with_colour else ("x y z", "4 4 4", "F F F", "1 1 1")
    head = ["# .PCD v0.7 - Point Cloud Data", "VERSION 0.7", *(f"{k} {v}" for k, v in zip(("FIELDS", "SIZE", "TYPE", "COUNT"), fields, strict=True))]
    return F.concat_ws("\n", F.lit("\n".join(head)), F.concat(F.lit("WIDTH "), n), F.lit("HEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0"), F.concat(F.lit("POINTS "), n), F.concat(F.lit("DATA ascii\n"), F.array_join(F.transform(points, line), "")))


def raw_file_path(name: Column, mcap: Column, topic: Column, ts: Column, msg_type: Column, fmt: Column) -> Column:
    """`name/mcap/topic/ts.ext` with the extension that the message's type usually has; raw_files() knows the one it got."""
    ext = F.when(msg_type.endswith("CompressedImage"), names.image_extension(fmt)).when(msg_type.endswith("/Image"), "png").when(msg_type.endswith("PointCloud2"), "pcd")
    ext = F.coalesce(ext, F.when(msg_type.rlike("(NavSatFix|BESTPOS|Imu|Odometry|TFMessage)$"), "json").otherwise("txt"))
    return F.concat_ws("/", name, mcap.cast("string"), names.topic_file(topic), F.concat(ts.cast("string"), F.lit("."), ext))


def raw_files(plan_messages: DataFrame, definitions: dict[str, str]) -> DataFrame:
    """(path, content) of planned messages (name, part_mcap, topic, msg_type, log_time_ns, data) as files of their own: pictures,
    point clouds, JSON or text by type. Messages that are none, or empty, have no file; of two at one path one counts."""
    raw = plan_messages.withColumn("_f", decoding.raw_files(F.col("data"), F.col("msg_type"), definitions)).where("_f.content is not null")
    path = F.concat_ws("/", "name", F.col("part_mcap").cast("string"), names.topic_file(F.col("topic")), F.concat(F.col("log_time_ns").cast("string"), F.lit("."), F.col("_f.extension")))
    return raw.select(path.alias("path"), F.col("_f.content").alias("content"))


def mcap_files(plan_messages: DataFrame, definitions: dict[str, str]) -> DataFrame:
    """(path, content): a recording of each part and segment, `name/name_N.mcap`, in the order of time. One segment's
    messages, as one file of the source holds them, come to one task."""

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["log_time_ns", "sequence"], kind="stable")
        columns = ("topic", "msg_type", "log_time_ns", "publish_time_ns", "sequence", "data")
        name, part = pdf["name"].iloc[0], pdf["part_mcap"].iloc[0]
        content = mcap.encode(zip(*(pdf[c] for c in columns), strict=True), definitions, {"rosbag": {"name": name}})
        return pd.DataFrame({"path": [f"{name}/{name}_{part}.mcap"], "content": [content]})

    return plan_messages.groupBy("name", "part_mcap").applyInPandas(encode, "path string, content binary")


def write_files(files: DataFrame, root: str) -> int:
    """Write (path, content) below root, a folder that all executors reach, each file whole or not at all; their number."""
    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                target = Path(root) / path
                target.parent.mkdir(parents=True, exist_ok=True)
                draft = target.with_name(f".{target.name}-{uuid.uuid4().hex}")  # a task that runs again replaces the same file
                draft.write_bytes(content)
                draft.rename(target)
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.where(names.is_safe_path(F.col("path"))).mapInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0


def write_messages(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Messages by name and segment; a segment that is written again replaces only its own files."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("name", "part_mcap").parquet(path)


def write_tables(df: DataFrame, path: str, by: list[str]) -> None:
    """Upsert by whole partitions, as lookup tables, summaries, grids, boundaries and topics are kept."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_vectors(df: DataFrame, path: str, rows: int = 100_000) -> None:
    df.write.mode("append").option("compression", "zstd").option("maxRecordsPerFile", rows).partitionBy("model", "bag").parquet(path)


def write_topics(found: DataFrame, path: str) -> None:
    """A document {bag, topics: {topic: type}} for each bag of (bag, topic, msg_type), in a folder of its own; a bag that is
    written again replaces its own."""
    per = found.groupBy("bag").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("topic", "msg_type")))).alias("topics"))
    per.withColumn("of", F.col("bag")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("of").json(path)


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def bag_index(bags: DataFrame, manifest: DataFrame) -> DataFrame:
    """Bags that have embeddings, in order, with the time of this index."""
    return bags.select("bag").distinct().join(manifest.select("bag").distinct(), "bag", "left_semi").orderBy("bag").withColumn("updated_at", F.current_timestamp())
