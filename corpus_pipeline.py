"""A corpus pipeline of five stages over `documents`, each one operator of logloom.llm.

Every stage is (spark, docs, sf_dir) -> DataFrame, is written as Parquet, and is read again as the next one's docs. All
but the last return the columns of documents:

1. quality: documents that the additive quality model scores below its cut go.
2. line_dedup: lines that are like an earlier line (Jaccard of words at least 0.8) go from the texts; n_chars follows.
3. near_dedup: of each component of SimHash fingerprints the document of the least doc_id stays.
4. decontaminate: documents that benchmark windows cover in at least a twentieth of their words go.
5. sentencepiece: up to two sampled segmentations of every text, with inclusion scores.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import common, linededup, pieces, quality, simhash, winnow


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, common.read(spark, sf_dir, "labels"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lines, removed = common.fresh(docs, "n_lines", "n_removed")
    out = linededup.dedup_lines(docs, counts=(lines, removed))
    length = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnow.remove_contaminated(docs, common.read(spark, sf_dir, "benchmark"))


def stage_sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.segmentations(docs, digest=True, chars=1 << 18)  # its workers share their executors with those of the stages before


STAGES = [
    ("quality", stage_quality),
    ("line_dedup", stage_line_dedup),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("sentencepiece", stage_sentencepiece),
]

#: Trained scores, similarity joins and sampling are not SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is a Parquet table in the shared folder. A stage's own tables, and the
    table that it has read, go once it is written; the last stage's input stays for the result."""
    docs = common.read(spark, sf_dir, "documents")
    path = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with common.tables_in(spark, f"{path}/{name}-tables"):
            stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        if k:
            common.drop_table(docs)
        docs = spark.read.parquet(f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
