"""Pairs of documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8; exact, not sampled.

A set's shingles are put in one order for all documents, rare ones first; two sets that are alike share one of the first
n - ceil(0.8 n) + 1 in it. Which shingles are common is read from a sample and only decides that order, so it changes no
result. Of a shingle that many sets share, pairs with the least and greatest set are compared first; after that only pairs
that are not yet in one component are. A candidate pair is tried by BITS parity bits: bit b of a set tells whether an odd
number of its shingles hash to b, so that two sets' bits differ in no more places than they have shingles of one alone,
which is at most a ninth of both sizes' sum. Pairs that pass are compared by their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, SEED = 5, 42
BITS = 1024
#: One document in SAMPLE is read for common shingles, and of these the COMMON most frequent come last in the order.
SAMPLE, COMMON = 16, 500_000
#: Groups with more sets than this are compared by their ends first.
SMALL = 8
#: Pairs that are made in one step; bounds a task's memory.
STEP = 1 << 20


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted signed hashes of the different shingles; a shorter text is one shingle, an empty one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    n = max(1, len(words) - WORDS + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + WORDS]), SEED) for i in range(n)), np.uint64, n)
    return np.unique(h.view(np.int64))


def parity(own: np.ndarray) -> bytes:
    return np.packbits(np.bincount(own & (BITS - 1), minlength=BITS) & 1).tobytes()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is at least 0.8."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def prefix(own: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles in the common order: by count in the sample (often is sorted), then by hash."""
    if len(often) and len(own):
        at = np.minimum(np.searchsorted(often, own), len(often) - 1)
        own = own[np.argsort(np.where(often[at] == own, counts[at], 0), kind="stable")]
    return own[: len(own) - (4 * len(own) + 4) // 5 + 1] if len(own) else own


def hashes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series([shingle_set(t) for t in texts])


def common_shingles(docs: DataFrame, sample: int = SAMPLE, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles that several texts of a sample share, at most `most`."""

    drawn = docs.where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0).select("text")
    per = drawn.select(F.explode(F.pandas_udf(hashes, "array<long>")("text")).alias("s")).groupBy("s").count().where("count > 1")
    rows = per.orderBy(F.desc("count"), "s").limit(most).toPandas().sort_values("s")
    return rows["s"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)


def groups(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and sizes of the runs of a sorted array."""
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, int)
    return first, np.diff(np.append(first, len(s)))


def possible(n: np.ndarray, i: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of the sizes n may be alike if their first common shingle is at the places i."""
    rest = 1 + np.minimum(n[a] - 1 - i[a], n[b] - 1 - i[b])
    return (5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b])) & (9 * rest >= 4 * (n[a] + n[b]))


def candidates(s: np.ndarray, h: np.ndarray, n: np.ndarray, i: np.ndarray, c: np.ndarray, ends: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that share a shingle s (sorted). ends: all of small groups, of large ones those with the least and
    greatest set; else those of large groups whose components c differ."""
    first, size = groups(s)
    group = np.repeat(np.arange(len(first)), size)
    if ends:
        order = np.lexsort((h, group))
        h, n, i = h[order], n[order], i[order]
    else:
        low, high = (f.reduceat(c, first) if len(first) else c for f in (np.minimum, np.maximum))
        keep = ((low != high) & (size > SMALL))[group]
        s, h, n, i, c = s[keep], h[keep], n[keep], i[keep], c[keep]
        first, size = groups(s)
        group = np.repeat(np.arange(len(first)), size)
        order = np.lexsort((c, group))
        h, n, i, c = h[order], n[order], i[order], c[order]
    last = first + size - 1
    place = np.arange(len(h))

    def checked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = possible(n, i, a, b) & (h[a] != h[b])
        a, b = a[keep], b[keep]
        pairs = np.unique(np.stack([np.minimum(h[a], h[b]), np.maximum(h[a], h[b])]), axis=1)
        return pairs[0], pairs[1]

    if ends:
        large = size[group] > SMALL
        for d in range(1, SMALL):
            a = place[~large & (place + d <= last[group])]
            yield checked(a, a + d)
        for end in (first, last):
            a = place[large]
            yield checked(a, end[group[a]])
        return
    # of every set those of the later components of its group
    fresh = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (group[1:] != group[:-1])))) if len(c) else np.zeros(0, int)
    run = np.diff(np.append(fresh, len(c)))
    after = np.repeat(np.cumsum(run), run)
    todo = last[group] + 1 - after
    total = np.cumsum(todo)
    at = 0
    while at < len(h):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
        a = np.repeat(place[at:to], todo[at:to])
        nth = np.arange(len(a)) - np.repeat(np.cumsum(todo[at:to]) - todo[at:to], todo[at:to])
        yield checked(a, after[a] + nth)
        at = to


def by_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups of the first column, which is sorted and may go on in the next batch."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        kept = columns if kept is None else [np.concatenate(x) for x in zip(kept, columns, strict=True)]
        cut = int(np.searchsorted(kept[0], kept[0][-1], "left"))
        if cut:
            yield [c[:cut] for c in kept]
            kept = [c[cut:] for c in kept]
    if kept is not None:
        yield kept


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose shingle several sets have."""
    for s, h, n, i in by_shingle(batches):
        _, size = groups(s)
        keep = np.repeat(size > 1, size)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (s, h, n, i)], names=["s", "h", "n", "i"])


def pairs_of(rows: DataFrame, ends: bool) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in by_shingle(batches):
            for a, b in candidates(*columns, ends):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    ordered = rows.select("s", "h", "n", "i", "c").repartition("s").sortWithinPartitions("s")
    return ordered.mapInArrow(make, "a long, b long").distinct()


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (h, n, bits) may be alike by their parity bits."""

    def check(n_a: pd.Series, bits_a: pd.Series, n_b: pd.Series, bits_b: pd.Series) -> pd.Series:
        words = lambda x: np.frombuffer(b"".join(x), np.uint64).reshape(len(x), BITS // 64)
        return pd.Series(9 * np.bitwise_count(words(bits_a) ^ words(bits_b)).sum(axis=1).astype(np.int64) <= n_a + n_b)

    a, b = (sets.select(F.col("h").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab")
    both = pairs.join(a, "a").join(b, "b").where("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
    return both.where(F.pandas_udf(check, "boolean")("n_a", "bits_a", "n_b", "bits_b")).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (h, own) are alike."""

    def check(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([alike(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    a, b = (sets.select(F.col("h").alias(k), F.col("own").alias(f"own_{k}")) for k in "ab")
    both = pairs.join(a, "a").join(b, "b")
    return both.where(F.pandas_udf(check, "boolean")("own_a", "own_b")).select("a", "b")


def links(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) of h that join every pair of alike sets; from sets (k1, k2, h, n, bits, prefix) and docs (k1, k2, text)."""
    unique = sets.where("n > 0").groupBy("h").agg(*(F.any_value(c).alias(c) for c in ("n", "bits", "prefix")), F.min(F.struct("k1", "k2")).alias("k"))
    unique = common.table(unique, "shingle-sets", dictionary=False)
    rows = unique.select("h", "n", F.posexplode("prefix").alias("i", "s")).select("s", "h", "n", "i")
    rows = common.table(rows.repartition("s").sortWithinPartitions("s").mapInArrow(shared, "s long, h long, n int, i int"), "shingle-shared")
    chosen = unique.join(common.sized(rows.select("h").distinct()), "h", "left_semi").select("h", "k.k1", "k.k2")
    chosen = common.table(chosen, "shingle-chosen")
    texts = docs.join(common.sized(chosen), ["k1", "k2"]).select("h", "text").dropDuplicates(["h"])
    whole = common.table(texts.select("h", F.pandas_udf(hashes, "array<long>")("text").alias("own")), "shingle-whole")
    found = common.table(verified(common.table(plausible(pairs_of(rows.withColumn("c", F.col("h")), True), unique), "shingle-pairs"), whole), "shingle-links")
    of = common.components(found, "shingle-parts").select(F.col("node").alias("h"), F.col("root"))
    labelled = rows.join(common.sized(common.table(of, "shingle-of")), "h", "left").withColumn("c", F.coalesce("root", "h"))
    more = verified(common.table(plausible(pairs_of(labelled, False), unique), "shingle-pairs"), whole)
    return found.unionByName(more)
