"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Of every WINDOW = 13 consecutive words the least hash of its eight 6-word grams is kept, on both sides; so two texts that
share 13 words share a kept hash. Documents' kept hashes, each with the document's key alone, meet the benchmark's in one
join; only documents with hits are read again, and every hit is extended there: the windows that hold the hit gram are
compared with the benchmark's windows by 128 bits of hash. Items of fewer words are one window each; they are found by
their longest word instead, as no gram is sure to be kept there.

The benchmark side is broadcast only while it has at most common.BROADCAST_ROWS rows, and joined by shuffle beyond that.
Nulls and empty texts have no words; a repeated document row gives a row each time; a null item_id is no item. Other
columns, whatever their names, play no part and pass through remove_contaminated(). The items of a document come together
in one row, as their digest asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, GRAM = 13, 6
SPAN = WINDOW - GRAM + 1
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(common.lower_ascii(text), F.lit("")), NO_WORD), "")


def shifted(array: str, many: int, size: Column) -> list[Column]:
    return [F.slice(F.col(array), i + 1, size) for i in range(many)]


def with_grams(df: DataFrame) -> DataFrame:
    """words -> n, and of it the hashes of words, of all grams, and the kept ones (distinct)."""
    df = df.withColumn("n", F.size("words")).withColumn("word_h", F.transform("words", lambda w: F.xxhash64(w)))
    size = F.greatest(F.col("n") - GRAM + 1, F.lit(0))
    df = df.withColumn("gram_h", F.transform(F.arrays_zip(*(c.alias(f"g{i}") for i, c in enumerate(shifted("word_h", GRAM, size)))), lambda x: F.xxhash64(x)))
    size = F.greatest(F.col("n") - WINDOW + 1, F.lit(0))
    kept = F.transform(F.arrays_zip(*(c.alias(f"w{i}") for i, c in enumerate(shifted("gram_h", SPAN, size)))), lambda x: F.least(*(x[f"w{i}"] for i in range(SPAN))))
    return df.withColumn("kept", F.array_distinct(kept))


def window_key(words: Column, start: Column, length: Column) -> Column:
    """128 bits of the words from start on (0-based)."""
    own = F.array_join(F.slice(words, start + 1, length), " ")
    return F.struct(F.xxhash64(own).alias("h1"), F.xxhash64(F.lit("#"), own).alias("h2"))


def benchmark_side(benchmark: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, bool]:
    """probes (fp, of_word, backs, len): a hit hash, and how far before it its windows begin; windows (h1, h2, len, item);
    and whether there are items below the window's length."""
    items = common.table(with_grams(benchmark.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("item"), words_of(F.col(text)).alias("words"))).where("n > 0"), "winnow-items")
    short = not items.where(F.col("n") < WINDOW).isEmpty()
    length = F.least(F.col("n"), F.lit(WINDOW))
    windows = items.select("item", "words", length.alias("len"), F.explode(F.sequence(F.lit(0), F.col("n") - length)).alias("start"))
    windows = windows.select("item", "len", window_key(F.col("words"), F.col("start"), F.col("len")).alias("key")).select("key.h1", "key.h2", "len", "item").distinct()
    probes = items.where(F.col("n") >= WINDOW).select(F.explode("kept").alias("fp"), F.lit(False).alias("of_word"), F.sequence(F.lit(0), F.lit(SPAN - 1)).alias("backs"), F.lit(WINDOW).alias("len"))
    if short:
        at = F.array_position("sizes", F.array_max("sizes")).cast("int")
        own = items.where(F.col("n") < WINDOW).withColumn("sizes", F.transform("words", lambda w: F.length(w))).withColumn("at", at)
        own = own.select(F.element_at("word_h", F.col("at")).alias("fp"), F.lit(True).alias("of_word"), F.array(F.col("at") - 1).alias("backs"), F.col("n").alias("len"))
        probes = probes.unionByName(own)
    return probes.distinct(), windows, short


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return common.with_row_key(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, k1, k2, n_words, n_hit, items): of every row of docs its words, those inside an occurrence of a window, and
    the sorted items with such windows. k1 and k2 are hashes of key and text."""
    probes, windows, short = benchmark_side(benchmark, item, item_text)
    probes, windows = (common.table(x, "winnow-benchmark") for x in (probes, windows))
    rows = keyed(docs, key, text)
    marks = with_grams(rows.select("key", "k1", "k2", words_of(F.col("text")).alias("words"))).select("key", "k1", "k2", "n", "kept")
    marks = common.table(marks, "winnow-marks", dictionary=False)
    seen = marks.select("k1", "k2", F.explode_outer("kept").alias("fp"), F.lit(False).alias("of_word"))
    if short:
        words = rows.select("k1", "k2", F.explode_outer(words_of(F.col("text"))).alias("word"))
        seen = seen.unionByName(words.select("k1", "k2", F.xxhash64("word").alias("fp"), F.lit(True).alias("of_word")).where("word is not null"))
    hits = common.table(seen.join(common.sized(probes), ["fp", "of_word"]).distinct(), "winnow-hits")

    named = common.sized(hits.select("k1", "k2").distinct())
    held = rows.join(named, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    held = common.table(held.select("k1", "k2", words_of(F.col("text")).alias("words")), "winnow-held")
    grams = with_grams(held)
    places = grams.select("k1", "k2", "n", F.lit(False).alias("of_word"), F.posexplode_outer("gram_h").alias("at", "fp"))
    if short:
        places = places.unionByName(grams.select("k1", "k2", "n", F.lit(True).alias("of_word"), F.posexplode_outer("word_h").alias("at", "fp")))
    starts = places.join(hits, ["k1", "k2", "fp", "of_word"]).select("k1", "k2", "n", "len", "at", F.explode_outer("backs").alias("back"))
    starts = starts.withColumn("start", F.col("at") - F.col("back")).where("start >= 0 and start <= n - len").groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "len")).alias("starts"))
    tried = F.transform("starts", lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len"), window_key(F.col("words"), s["start"], s["len"]).alias("key")))
    found = held.join(starts, ["k1", "k2"]).select("k1", "k2", F.explode(tried).alias("t")).select("k1", "k2", "t.len", "t.start", "t.key.h1", "t.key.h2")
    found = common.table(found, "winnow-windows").join(common.sized(windows), ["h1", "h2", "len"])
    per = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "len")).alias("runs"), F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["len"] - 1))))
    per = per.select("k1", "k2", F.size(covered).cast("long").alias("n_hit"), "items")
    out = marks.select("key", "k1", "k2", F.col("n").cast("long").alias("n_words")).join(per, ["k1", "k2"], "left")
    return out.select("key", "k1", "k2", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


IS_CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def op10(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    items = F.col("items")
    return contamination(docs, benchmark).select(
        F.col("key").alias("doc_id"), "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), F.expr(IS_CONTAMINATED).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not contaminated. A document is named by its doc_id and text, so one without a doc_id is judged as well."""
    k1, k2 = common.fresh(docs, "k1", "k2")
    bad = contamination(docs, benchmark).where(IS_CONTAMINATED).select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct()
    bad = common.sized(common.table(bad, "winnow-contaminated"))
    ident = docs.withColumns({k1: F.xxhash64("doc_id", "text"), k2: F.xxhash64(F.lit("#"), "text", "doc_id")})
    return ident.join(bad, [k1, k2], "left_anti").select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
bl AS (SELECT item_id, w, least(len(w), 13) AS l FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS win FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM bl)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT rid, l, i, array_to_string(w[i:i + l - 1], ' ') AS win FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l)),
m AS (SELECT rid, i, dw.l, item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.win = bw.win),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM m) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN it USING (rid)
"""
