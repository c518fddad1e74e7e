"""The queries opN_<name> over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, licenses, linededup, mpeg, packing, phrases, pieces, pii, quality, simhash, urlrules, variants, winnow
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_license_scan": lambda spark, d: licenses.op1(read(spark, d, "documents")),
        "op2_sentencepiece_topk": lambda spark, d: pieces.op2(read(spark, d, "documents")),
        "op3_simhash_near_dedup": lambda spark, d: simhash.op3(read(spark, d, "documents")),
        "op4_url_rules": lambda spark, d: urlrules.op4(read(spark, d, "pages")),
        "op5_chat_repair": lambda spark, d: chat.op5(read(spark, d, "conversations")),
        "op6_line_dedup": lambda spark, d: linededup.op6(read(spark, d, "documents")),
        "op7_quality_gam": lambda spark, d: quality.op7(read(spark, d, "documents"), read(spark, d, "labels")),
        "op8_mpeg_audio": lambda spark, d: mpeg.op8(read(spark, d, "documents")),
        "op9_pii_candidates": lambda spark, d: pii.op9(read(spark, d, "documents")),
        "op10_winnowing_decontamination": lambda spark, d: winnow.op10(read(spark, d, "documents"), read(spark, d, "benchmark")),
        "op11_phrase_collocations": lambda spark, d: phrases.op11(read(spark, d, "documents")),
        "op12_best_fit_packing": lambda spark, d: packing.op12(read(spark, d, "documents")),
        "op13_spelling_variants": lambda spark, d: variants.op13(read(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_rules": urlrules.ORACLE, "op10_winnowing_decontamination": winnow.ORACLE, "op11_phrase_collocations": phrases.ORACLE}
