"""Phrase collocations from vertical positional inverted lists.

Texts are dealt to blocks of about BLOCK bytes, and every block becomes an inverted index: for each word the ascending
list of its positions, kept as gaps. A position is a word's number in its block; a mark between pieces and texts takes a number too, so
that what is adjacent is so within a piece. The lists of a frequent phrase of k words and those of the phrases that
start one word later are merge-joined by position, which gives the lists of the phrases of k + 1 words; a list's length
is its exact frequency, summed over blocks. A block is the unit of work however often a phrase occurs, so a frequent
word is one row in each block and no group holds all its places.

Each level takes two steps: frequencies of all extensions are counted without their lists, summed up in each block before they are
shuffled; then lists are made of frequent ones alone, and those of a block are packed together. Tasks learn of these by a bit map of at most BITS bits, which a join with the table of frequent phrases makes
exact; that table is broadcast only while it is small (common.sized). All parts of a frequent phrase are frequent, so
nothing is lost by extending those only.

Null texts are empty, a null language is `und`; empty texts, repeated rows and ties count as they are (repeated rows
repeatedly), an empty table has no phrases, and other columns play no part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words of a phrase at most, its least frequency, phrases reported for each language, and percent of a phrase's
#: frequency that a longer one needs to stand for it.
WORDS, LEAST, TOP, WITHIN = 5, 100, 2000, 100
#: Bytes of text in a block (a longer text is a block of its own), and bits of the map of frequent phrases.
BLOCK, BITS = 1 << 19, 1 << 25
#: Words of all texts for each part in which pairs are summed up.
PAIRS = 1 << 21
CHUNK = 32768  # bits in one row of a bit map, as bitmap_or_agg() takes them

BREAK = b"."
FLAT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + BREAK * 9)

POSTINGS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("at", pa.list_(pa.int32()))])


def lists_of(codes: np.ndarray, at: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """at grouped by code, each group in its order, and the groups' ends with a leading 0."""
    order = np.argsort(codes, kind="stable")
    return at[order], np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=many))])


def list_column(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists as the first value of each and then the gaps, which are small numbers."""
    first = ends[:-1][np.diff(ends) > 0]
    gaps = np.diff(values, prepend=0)
    gaps[first] = values[first]
    values = gaps
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))


def postings(block: int, texts: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
    """One block's inverted lists, language by language."""
    start = 0
    for lang, parts in texts.items():
        words = (b" " + BREAK + b" ").join(parts).translate(FLAT).replace(BREAK, b" " + BREAK + b" ").split(b" ")
        coded = pa.array(words, pa.binary()).dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        codes = codes[codes != names.index(b"")] if b"" in names else codes
        at, ends = lists_of(codes, np.arange(start, start + len(codes)), len(names))
        start += len(codes) + 1
        lists = list_column(at, ends)
        keep = pa.array([bool(n) and n != BREAK for n in names], pa.bool_())
        own = [pa.array(np.full(len(names), block)), pa.array([lang] * len(names), pa.string()), coded.dictionary.cast(pa.string()), lists]
        yield pa.RecordBatch.from_arrays(own, schema=POSTINGS).filter(keep)


def indexer(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, texts = TaskContext.get().partitionId() << 32, 0, defaultdict(list)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                own = text.as_py()
                if held and held + len(own) > size:
                    yield from postings(block, texts)
                    block, held, texts = block + 1, 0, defaultdict(list)
                texts[lang].append(own)
                held += len(own) + 1
        if held:
            yield from postings(block, texts)

    return index


PACKED = "block long, many long, places long, lists binary"


def pack_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists (block, id, at), those of a batch that share a block as one row."""
    for batch in batches:
        block, ids = (batch.column(i).to_numpy() for i in (0, 1))
        order = np.argsort(block, kind="stable")
        at = batch.column(2).take(pa.array(order))
        ids, lengths, gaps = ids[order], at.value_lengths().to_numpy(), at.flatten().to_numpy()
        starts = np.flatnonzero(np.diff(block[order], prepend=-1))
        ends = np.append(starts, len(ids))[1:]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        rows = [(int(block[order[i]]), j - i, int(upto[j] - upto[i]), pa.compress(ids[i:j].astype("<i8").tobytes() + lengths[i:j].astype("<i4").tobytes() + gaps[upto[i] : upto[j]].astype("<i4").tobytes(), codec="zstd", asbytes=True)) for i, j in zip(starts, ends, strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["block", "many", "places", "lists"])


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, lengths and gaps of a block's lists."""
    out = []
    for many, places, own in zip(*(table.column(c).to_pylist() for c in ("many", "places", "lists")), strict=True):
        data = pa.decompress(own, decompressed_size=12 * many + 4 * places, codec="zstd").to_pybytes()
        out.append([np.frombuffer(data, t, n, at) for t, n, at in (("<i8", many, 0), ("<i4", many, 8 * many), ("<i4", places, 12 * many))])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def joined(ids: np.ndarray, lengths: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merge join of a block's lists with themselves, one position on: rows of the phrase before and of the one after
    (as one key, in order), the position of each, and the places where a new key starts."""
    at = np.cumsum(gaps, dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    at -= np.repeat(at[first] - gaps[first], lengths)
    row = np.repeat(np.arange(len(ids)), lengths)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    next_to = np.flatnonzero(at[1:] == at[:-1] + 1)
    key = row[next_to] * len(ids) + row[next_to + 1]
    order = np.argsort(key, kind="stable")
    key = key[order]
    return key, at[next_to[order]], np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def extensions(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """p and s of each extension in a block, its positions one after another, and the extensions' ends with a leading 0."""
    ids, lengths, gaps = unpacked(table)
    key, at, first = joined(ids, lengths, gaps)
    return ids[key[first] // max(len(ids), 1)], ids[key[first] % max(len(ids), 1)], at, np.append(first, len(key))


def packed(p: np.ndarray, s: np.ndarray, c: np.ndarray) -> bytes:
    """Counted pairs in the order of p, which is kept as gaps."""
    columns = np.diff(p, prepend=0), s, c
    return pa.compress(b"".join(x.astype("<i8").tobytes() for x in columns), codec="zstd", asbytes=True)


def counter(parts: int) -> Callable[[pa.Table], pa.Table]:
    """A block's extensions with their counts, packed into one row for each of `parts` parts of all pairs."""

    def counted(table: pa.Table) -> pa.Table:
        p, s, _, ends = extensions(table)
        c, part = np.diff(ends), slot(p, s, 1 << 30) % parts
        order = np.lexsort([s, p, part])
        p, s, c, part = p[order], s[order], c[order], part[order]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(starts, len(part))[1:]
        rows = [packed(p[i:j], s[i:j], c[i:j]) for i, j in zip(starts, ends, strict=True)]
        return pa.table({"part": part[starts], "many": ends - starts, "pairs": pa.array(rows, pa.binary())})

    return counted


def summer(least: int) -> Callable[[pa.Table], pa.Table]:
    """The pairs of one part that occur at least `least` times over all blocks."""

    def summed(table: pa.Table) -> pa.Table:
        held = []
        for many, own in zip(table.column("many").to_pylist(), table.column("pairs").to_pylist(), strict=True):
            rows = np.frombuffer(pa.decompress(own, decompressed_size=24 * many, codec="zstd"), "<i8").reshape(3, many)
            held.append(np.stack([np.cumsum(rows[0]), rows[1], rows[2]]))
        p, s, c = np.concatenate(held, axis=1)
        order = np.lexsort([s, p])
        p, s, c = p[order], s[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])]))
        f = np.add.reduceat(c, first)
        return pa.table({"p": p[first], "s": s[first], "f": f}).filter(pa.array(f >= least))

    return summed


def slot(p: np.ndarray, s: np.ndarray, bits: int) -> np.ndarray:
    x = p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ s.astype(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(20)).astype(np.int64) & (bits - 1)


def bit_map(frequent: DataFrame, bits: int) -> np.ndarray:
    """Bit slot(p, s) is 1 for every row; of bounded size however many there are."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, np.uint8)
        for b in batches:
            own[slot(b.column(0).to_numpy(), b.column(1).to_numpy(), bits)] = 1
        rows = np.packbits(own, bitorder="little").reshape(-1, CHUNK // 8)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([rows[i].tobytes() for i in used], pa.binary())], names=["i", "m"])

    found = frequent.select("p", "s").mapInArrow(chunks, "i long, m binary").groupBy("i").agg(F.bitmap_or_agg("m").alias("m")).collect()
    out = np.zeros((bits // CHUNK, CHUNK // 8), np.uint8)
    for i, m in found:
        out[i] = np.frombuffer(m, np.uint8)
    return out.reshape(-1)


def lists_by(known: object, bits: int) -> Callable[[pa.Table], pa.Table]:
    """The lists of those extensions that the bit map knows."""

    def lists(table: pa.Table) -> pa.Table:
        p, s, at, ends = extensions(table)
        own, i = known.value, slot(p, s, bits)
        keep = (own[i >> 3] >> (i & 7).astype(np.uint8)) & 1 == 1
        block = table.column("block")[0].as_py()
        out = pa.table({"block": np.full(len(p), block), "p": p, "s": s, "at": list_column(at, ends)})
        return out.filter(pa.array(keep))

    return lists


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", words: int = WORDS, least: int = LEAST, block: int = BLOCK, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, n) and, for all phrases of up to `words` words that occur at least `least` times, (k, lang, phrase, f)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    index = common.table(rows.mapInArrow(indexer(block), "block long, lang string, word string, at array<int>"), "phrase-index")
    sizes = index.groupBy("lang", F.col("word").alias("phrase")).agg(F.sum(F.size("at")).alias("f"))
    sizes = common.table(sizes, "phrase-words")
    totals = common.table(sizes.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    parts = max(1, (totals.agg(F.sum("n")).first()[0] or 0) // PAIRS)
    level = common.table(sizes.where(F.col("f") >= least).select(F.monotonically_increasing_id().alias("id"), "lang", "phrase", F.col("phrase").alias("last"), "f"), "phrase-level")
    common.drop_table(sizes)
    lists = index.join(common.sized(level.select("lang", F.col("phrase").alias("word"), "id")), ["lang", "word"]).select("block", "id", "at")
    every = [level.select(F.lit(1).alias("k"), "lang", "phrase", "f")]
    read = index
    for k in range(2, words + 1):
        lists = common.table(lists.mapInArrow(pack_lists, PACKED), "phrase-lists", dictionary=False)
        common.drop_table(read)
        read = lists
        found = lists.groupBy("block").applyInArrow(counter(parts), "part long, many long, pairs binary")
        found = found.groupBy("part").applyInArrow(summer(least), "p long, s long, f long")
        pairs = common.table(found.withColumn("id", F.monotonically_increasing_id()), "phrase-pairs")
        before = level.select(F.col("id").alias("p"), "lang", F.col("phrase").alias("head"))
        after = level.select(F.col("id").alias("s"), "last")
        named = pairs.join(common.sized(before), "p").join(common.sized(after), "s")
        level = common.table(named.select("id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f"), "phrase-level")
        every.append(level.select(F.lit(k).alias("k"), "lang", "phrase", "f"))
        if k < words:
            known = spark.sparkContext.broadcast(bit_map(pairs, bits))
            longer = lists.groupBy("block").applyInArrow(lists_by(known, bits), "block long, p long, s long, at array<int>")
            lists = longer.join(common.sized(pairs.select("p", "s", "id")), ["p", "s"]).select("block", "id", "at")
    common.drop_table(read)
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return totals, out


def collocations(docs: DataFrame, top: int = TOP, within: int = WITHIN, **how: object) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases; how: see frequent_phrases()."""
    totals, phrases = frequent_phrases(docs, **how)
    phrases = common.table(phrases, "phrase-all")
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    of = phrases.select("lang", "phrase", "f")
    long = phrases.where("k > 1").withColumn("w", F.split("phrase", " "))
    cuts = long.select("k", "lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(1, F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    cuts = cuts.join(common.sized(of.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))), ["lang", "first"])
    cuts = cuts.join(common.sized(of.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))), ["lang", "rest"]).join(common.sized(totals), "lang")
    wide = {c: F.col(c).cast("decimal(38,0)") for c in "anlr"}  # products may pass 64 bits
    cuts = cuts.select("lang", "phrase", "a", "n", "l", "r", "cut", (1000 * wide["a"] * wide["n"]).alias("over"), (wide["l"] * wide["r"]).alias("under"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("over div under").alias("score"), "cut", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    # A longer phrase that stands for this one has a part, one word longer than this one, that does so too.
    ends = long.where("k > 2").select("lang", "k", F.explode(F.array(part(1, F.col("k") - 1), part(2, F.col("k") - 1))).alias("phrase"), F.col("f").alias("longer"))
    ends = ends.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(ends, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {within} * a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11(docs: DataFrame) -> DataFrame:
    return collocations(docs)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(t, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS r(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, n.n, CAST(1000 AS HUGEINT) * c.a * n.n // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM c JOIN n ON c.lang = n.lang JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
x AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN f q ON q.lang = b.lang AND q.k > b.k AND 100 * q.f >= 100 * b.a AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' ')),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM b WHERE (lang, phrase) NOT IN (SELECT lang, phrase FROM x))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000
"""
