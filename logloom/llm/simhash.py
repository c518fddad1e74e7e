"""Near-duplicate documents by SimHash, compared in bit-sliced blocks.

Every document gets a 64-bit fingerprint of its word shingles. Equal fingerprints are grouped first. Two different ones
within RADIUS = 2 bits differ in at most two of four 16-bit parts, so they agree on one of the six pairs of parts; each
pair of parts is a table keyed by 32 bits, and only fingerprints that share a key are compared. A key's fingerprints are
stored as bit planes: word p holds bit p of 64 of them, so that one XOR and a carry-save counter of three words advance
64 distances at once; a block all of whose distances exceed the radius is dropped from further planes. The links of a
block shrink to a spanning forest before they leave the task, and connected components join the rest. A key of very many
fingerprints is split before the shuffle: of three thirds of the other 32 bits one agrees as well, so each becomes three
keys of 42 bits or more, and no key has over 2^22 fingerprints.

Nulls and empty texts have fingerprint zero and are linked like any other. A null key column is never a component's
name unless all its members are null. A repeated row gives a row each time (keep_one() keeps one of them), an empty table none;
other columns pass through keep_one() under their own names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, shingles

SHINGLE, SEED, RADIUS = 3, 42, 2
PARTS = list(combinations(range(4), 2))  # of four 16-bit parts, two that agree
#: Pairs of a fingerprint and a block that are compared in one step; bounds a task's memory.
STEP = 1 << 15
#: Groups with more fingerprints than this are compared by a third of their remaining bits.
LARGE = 1 << 14
#: Keys that about so many fingerprints share, by a count of one fingerprint in SAMPLE, are split before the shuffle.
HEAVY, SAMPLE = 1 << 16, 64
ONE = np.uint64(1)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64 bits: bit b is set if it is set in over half of the shingles' XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both are ASCII only for bytes
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    count = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        count += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.int64)[0])


def fingerprints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """[blocks, 64] words: bit i of word p is bit p of the block's fingerprint i."""
    padded = np.zeros((-len(fps) // 64 * -64,), np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(-1, 64, 8).copy().view(np.uint64)[:, :, 0]


def within(queries: np.ndarray, block: np.ndarray, planes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For queries[i] against block[i] of planes: the places i that still have a neighbour, and a word with its bits."""
    alive = np.arange(len(queries))
    ones = np.zeros(len(queries), np.uint64)
    twos, over = ones.copy(), ones.copy()
    for p in range(64):
        d = planes[block, p] ^ (np.uint64(0) - (queries >> np.uint64(p) & ONE))
        carry = ones & d
        ones ^= d
        over |= twos & carry
        twos ^= carry
        if p % 8 == 7:
            far = over | (ones & twos) if radius == 2 else over
            keep = ~far != 0
            if not keep.all():
                alive, ones, twos, over, queries, block = (x[keep] for x in (alive, ones, twos, over, queries, block))
            if not len(alive):
                break
    return alive, ~(over | (ones & twos))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as a[i] - b[i]: each node to the least of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, label[x], label[y])
        np.minimum.at(new, label[y], label[x])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new[x], new[y]):
            break
        label = new
    linked = new != np.arange(len(nodes))
    return nodes[linked], nodes[new[linked]]


def links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within RADIUS among the fps of equal keys; both sorted by key. A forest of them is enough."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    size = np.diff(np.append(first, len(keys)))
    found_a, found_b = [], []
    for f, n in zip(first[size > LARGE].tolist(), size[size > LARGE].tolist(), strict=True):
        group = fps[f : f + n]
        varying = [b for b in range(64) if (group >> np.uint64(b) & ONE).min() != (group >> np.uint64(b) & ONE).max()]
        for third in range(RADIUS + 1):  # one third of the varying bits agrees
            mask = np.uint64(sum(1 << b for b in varying[third :: RADIUS + 1]))
            part = group & mask
            order = np.lexsort((group, part))
            a, b = blocks(part[order], group[order])
            found_a.append(a), found_b.append(b)
    small = np.repeat((size > 1) & (size <= LARGE), size)
    a, b = blocks(keys[small], fps[small])
    return np.concatenate([*found_a, a]), np.concatenate([*found_b, b])


def blocks(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if not len(keys):
        return none
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(first, len(keys)))
    per = -(-size // 64)
    start_block = np.cumsum(per) - per
    group = np.repeat(np.arange(len(first)), size)
    within_group = np.arange(len(keys)) - first[group]
    slot = (start_block[group] + within_group // 64) * 64 + within_group % 64
    padded = np.zeros(int(per.sum()) * 64, np.uint64)
    padded[slot] = fps
    valid = np.zeros(len(padded), np.uint8)
    valid[slot] = 1
    valid = np.packbits(valid.reshape(-1, 64), axis=1, bitorder="little").copy().view(np.uint64)[:, 0]
    planes = np.concatenate([planes_of(padded[i : i + (1 << 18)]) for i in range(0, len(padded), 1 << 18)])
    todo = per[group] - within_group // 64  # blocks from its own on
    edges_a, edges_b = [none[0]], [none[0]]
    total = np.cumsum(todo)
    at = 0
    while at < len(keys):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
        q = np.repeat(np.arange(at, to), todo[at:to])
        nth = np.arange(len(q)) - np.repeat(np.cumsum(todo[at:to]) - todo[at:to], todo[at:to])
        block = slot[q] // 64 + nth
        alive, word = within(fps[q], block, planes)
        q, block = q[alive], block[alive]
        word &= valid[block]
        own = slot[q] // 64 == block  # of its own block only what follows it
        here = (slot[q] % 64).astype(np.uint64)
        word = np.where(own, word & ~((ONE << here) | ((ONE << here) - ONE)), word)
        some = word != 0
        q, block, word = q[some], block[some], word[some]
        if len(q):
            bits = np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, j = np.nonzero(bits)
            a, b = forest(fps[q[i]], padded[block[i] * 64 + j])
            edges_a.append(a), edges_b.append(b)
        at = to
    a, b = np.concatenate(edges_a), np.concatenate(edges_b)
    return forest(a, b) if len(a) else none


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, fp) that are sorted by key; a key may go on in the next batch."""
    keys, fps = [], []

    def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        a, b = links(k, f)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(0).to_numpy(zero_copy_only=False)
        f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        keys.append(k), fps.append(f)
        cut = int(np.searchsorted(k, k[-1], "left"))  # the last key may go on
        if cut:
            k, f = np.concatenate(keys), np.concatenate(fps)
            cut = int(np.searchsorted(k, k[-1], "left"))
            yield out(k[:cut], f[:cut])
            keys, fps = [k[cut:]], [f[cut:]]
    if keys:
        yield out(np.concatenate(keys), np.concatenate(fps))


def candidate_keys(fps: DataFrame) -> DataFrame:
    """(key, rest, fp) for each of the six tables: the table's number above 32 bits of the fingerprint, and its other bits."""
    part = lambda i: F.shiftrightunsigned(F.col("fp"), 16 * i).bitwiseAND(F.lit(0xFFFF))
    both = lambda i, j: F.shiftleft(part(j), 16) + part(i)
    keys = [F.struct((F.lit(n << 32) + both(*p)).alias("key"), both(*(i for i in range(4) if i not in p)).alias("rest")) for n, p in enumerate(PARTS)]
    return fps.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.key", "k.rest", "fp")


def split_heavy(keyed: DataFrame, heavy_from: int = HEAVY, sample: int = SAMPLE) -> DataFrame:
    """(key, fp): heavy keys become three, each with a third of the other bits. Which are heavy changes no result."""
    counts = keyed.where(F.pmod(F.xxhash64("fp"), F.lit(sample)) == 0).groupBy("key").count()
    heavy = common.table(counts.where(F.col("count") > heavy_from // sample).select("key", F.lit(True).alias("heavy")), "simhash-heavy")
    if heavy.isEmpty():
        return keyed.select("key", "fp")
    third = lambda t: F.shiftrightunsigned("rest", 11 * t).bitwiseAND(F.lit(0x7FF))
    finer = F.array(*(F.col("key") + F.lit(t + 1 << 35) + F.shiftleft(third(t), 37) for t in range(3)))
    marked = keyed.join(common.sized(heavy), "key", "left")
    return marked.select(F.explode(F.when(F.col("heavy"), finer).otherwise(F.array("key"))).alias("key"), "fp")


def shingle_links(prints: DataFrame, named: DataFrame) -> DataFrame:
    """Links of fingerprints whose texts have five-word shingles with a Jaccard similarity of at least 0.8."""
    often, counts = shingles.common_shingles(named)

    def sets(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            own = [shingles.shingle_set(t) for t in texts]
            h = [xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in own]
            yield pd.DataFrame({"h": np.array(h, np.uint64).view(np.int64), "n": np.array([len(x) for x in own], np.int32), "bits": [shingles.parity(x) for x in own], "prefix": [shingles.prefix(x, often, counts) for x in own]})

    made = named.select("k1", "k2", F.pandas_udf(sets, "h long, n int, bits binary, prefix array<long>")(F.col("text")).alias("x")).select("k1", "k2", "x.*")
    made = common.table(made, "shingles", dictionary=False)
    links = shingles.links(made, named)
    fp_of = made.select("k1", "k2", "h").join(prints.select("k1", "k2", "fp").distinct(), ["k1", "k2"]).select("h", "fp").distinct()
    fp_of = common.table(fp_of, "shingle-prints")
    least = common.table(fp_of.groupBy("h").agg(F.min("fp").alias("least"), F.count("*").alias("n")), "shingle-least")
    same = fp_of.join(least.where("n > 1"), "h").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    one = lambda k: least.select(F.col("h").alias(k), F.col("least").alias(f"fp_{k}"))
    return links.join(one("a"), "a").join(one("b"), "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).unionByName(same)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", edited: bool = False) -> DataFrame:
    """(key, k1, k2, fp, component): of every row of docs its fingerprint and the least key that is reachable by links;
    k1 and k2 as in common.with_row_key. edited: links of shingle_links() count too."""
    named = common.with_row_key(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text")
    prints = common.table(named.select("key", "k1", "k2", F.pandas_udf(fingerprints, "long")(F.col("text")).alias("fp")), "simhash")
    unique = prints.groupBy("fp").agg(F.min("key").alias("least"))
    keyed = split_heavy(candidate_keys(unique.select("fp")))
    pairs = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")
    if edited:
        pairs = pairs.unionByName(shingle_links(prints, named.select("k1", "k2", "text")))
    member = common.table(common.components(pairs, "simhash-links"), "simhash-members")
    named = unique.join(member, unique["fp"] == member["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    of_root = named.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = named.join(of_root, "root").select("fp", "component")
    return prints.join(by_fp, "fp").select("key", "k1", "k2", "fp", "component")


def op3(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, of the least doc_id and, if rows of different texts have that, of the least hash; rows
    without a doc_id stay. Edited copies are of a component too: those alike in five-word shingles."""
    found = near_duplicates(docs, edited=True)
    k1, k2 = common.fresh(docs, "k1", "k2")
    least = found.where("key = component").groupBy("component").agg(F.min(F.struct("k1", "k2")).alias("k"), F.count("*").alias("n"))
    least = common.table(least.select("k.*", "n"), "simhash-kept")
    kept = least.select("k1", "k2").unionByName(found.where("key is null").select("k1", "k2").distinct())
    ident = docs.withColumns({k1: F.xxhash64("doc_id", "text"), k2: F.xxhash64(F.lit("#"), "text", "doc_id")})
    out = ident.join(common.sized(kept.select(F.col("k1").alias(k1), F.col("k2").alias(k2))), [k1, k2], "left_semi")
    if not least.where("n > 1").isEmpty():  # a kept row may be there more than once
        out = out.where("doc_id is not null").dropDuplicates([k1, k2]).unionByName(out.where("doc_id is null"))
    return out.select(*docs.columns)
