"""Bag folders, segment files and the JSON and YAML documents beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators.align import present


def files(spark: SparkSession, root: str, pattern: str = "*.mcap") -> DataFrame:
    """(path, length, modified) of the files below root; listed by Spark, in any store, without their content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def segments(found: DataFrame) -> DataFrame:
    """(bag, mcap_id, path, length): bags are the files' folders; ids are the numbers behind the last underscore, numeric ones first."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rows = found.select(names.bag_key(folder).alias("bag"), names.mcap_id(F.col("path")).alias("mcap_id"), "path", "length")
    return rows.where(~F.col("bag").contains("EXCLUDED") & ~F.col("path").rlike("/(?:EXCLUDED|EXPORTED)/"))


def bags(segment_table: DataFrame) -> DataFrame:
    """(bag) in the order of base name and part."""
    b = segment_table.select("bag").distinct()
    return b.orderBy(names.base_bag(F.col("bag")), names.part_number(F.col("bag")).asc_nulls_first(), "bag")


def serving_bags(segment_table: DataFrame, manifest: DataFrame) -> DataFrame:
    return segment_table.select("bag").distinct().join(manifest.select("bag").distinct(), "bag", "left_semi")


def topics_of_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(bag, topic, msg_type) from metadata.yaml files: name and type lines follow each other in a topic's entry."""
    docs = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.yaml").load(path)
    docs = docs.select(names.bag_key(F.regexp_extract(F.input_file_name(), r"^(.*)/[^/]*$", 1)).alias("bag"), "value")
    entry = r"topic_metadata:\s*\n((?:[ \t]+[^\n]*\n?)+?)(?=\s*message_count|\s*-|\z)"
    rows = docs.select("bag", F.explode(F.regexp_extract_all("value", F.lit(entry), F.lit(1))).alias("e"))
    clean = lambda key: F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?m)^\s*{key}:\s*(.*)$", 1), "[\"']", ""))
    return rows.select("bag", clean("name").alias("topic"), F.coalesce(F.nullif(clean("type"), F.lit("")), F.lit("unknown")).alias("msg_type")).where("topic <> ''")


#: Fixed value: a topic's name in any text.
TOPIC_NAME = r"(\/[a-zA-Z0-9_][a-zA-Z0-9_/]*)"


def topics_of_text(text: DataFrame, column: str = "value") -> DataFrame:
    """(topic, msg_type): distinct topic names in any text, of unknown type."""
    found = text.select(F.explode_outer(F.regexp_extract_all(column, F.lit(TOPIC_NAME), F.lit(1))).alias("topic"))
    return found.where("topic is not null").distinct().withColumn("msg_type", F.lit("unknown"))


def lookup_tables(spark: SparkSession, path: str) -> DataFrame:
    """Wide lookup files of a bag, columns widened to their union, with the segment from the file's name; long form is aligned()."""
    wide = spark.read.option("mergeSchema", "true").parquet(path)
    return wide.withColumn("mcap_id", F.regexp_extract(F.col("_metadata.file_name"), r"([^_/]+)\.parquet$", 1))


def aligned(wide: DataFrame) -> DataFrame:
    """(mcap_id, ref_ts, topic, topic_ts) from wide lookup tables."""
    keep = {"Reference Timestamp", "Max Distance", "mcap_id"}
    topics = [c for c in wide.columns if c not in keep]
    return wide.select("mcap_id", F.col("Reference Timestamp").alias("ref_ts"), *(present(F.col(f"`{c}`").cast("string")).try_cast("long").alias(c) for c in topics)).unpivot(["mcap_id", "ref_ts"], topics, "topic", "topic_ts")


def parquet_stats(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Rows and the least and largest value of a column; the V2 Parquet source takes them from file footers."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.sources.useV1SourceList", "spark.sql.parquet.aggregatePushdown")}
    try:
        spark.conf.set("spark.sql.sources.useV1SourceList", "")
        spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        out = spark.read.parquet(path).agg(F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("largest"))
        out._jdf.queryExecution().executedPlan()  # planned while the settings hold
        return out
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


#: Files beside the models' folders.
NO_MODELS = [".DS_Store", "README.md", "completion.json"]


def models(manifest: DataFrame) -> DataFrame:
    return manifest.select("model").distinct().where(~F.col("model").isin(NO_MODELS))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)
