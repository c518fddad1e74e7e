"""Spelling variants: words one edit apart, from a positional q-gram inverted index with a count filter.

A word of L code points, padded at both ends, has L + Q - 1 grams, and an edit spoils Q of them at most; so two words one
edit apart share at least max(L, L') - 1 grams, at the same place if they are equally long and else at the same place or
one further on in the longer word. With one order of grams for all words, rare ones first, such a pair also shares one of
the first Q + 1 grams of each (of several equal grams the leftmost comes first, which shifts keep). The index therefore
holds Q + 1 postings for each word; a posting list is keyed by gram, length and place, so that the limits of length and position
are part of the key. A word's lists are merged: the lists of its own length, and those of the words one longer at both
places. For what a merge brings together, shared grams are counted at all places, pairs below the bound are dropped, and
the others are verified by their code points.

Lists are short, as they are those of rare grams; one with more than LIST words is dealt to several tasks, its words that
ask going to each. What is shuffled are words, twelve short rows for each; pairs come up only when verified.

Null texts have no words, a null doc_id counts as an empty one; repeated rows count repeatedly, ties of n go to the first in
code-point order, an empty table has no words, and other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Code points of a word and its occurrences, at least; how many times more frequent a form is.
LENGTH, TIMES, RATIO = 6, 5, 5
#: One in DROP runs loses a code point.
DROP = 199
Q, LIST = 3, 1 << 14
NO_LETTER = "[^A-Za-zÀ-ÿ]+"


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """(word, n): the words of all texts, some of whose runs have lost a code point."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(F.split(common.lower_ascii(F.col(text)), NO_LETTER)).alias("run"))
    runs = runs.where(F.length("run") >= length).withColumn("h", F.crc32(F.concat_ws(":", "key", "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % DROP == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def code_points(words: list[str] | np.ndarray, length: int) -> np.ndarray:
    """A row of code points for each word; all have that length."""
    return np.array(words, dtype=f"<U{length}").view(np.uint32).reshape(-1, length).astype(np.int64)


def grams(points: np.ndarray) -> np.ndarray:
    """All padded grams of words of one length, as numbers."""
    padded = np.pad(points, ((0, 0), (Q - 1, Q - 1)))
    many = points.shape[1] + Q - 1
    out = np.zeros((len(points), many), np.int64)
    for i in range(Q):
        out = (out << 21) | padded[:, i : i + many]
    return out


def by_length(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        yield int(n), words[lengths == n]


def all_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for n, own in by_length(np.array(b.column(0).to_pylist(), object)):
            g = grams(code_points(own, n))
            at = np.broadcast_to(np.arange(g.shape[1]), g.shape).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, g.shape[1]), pa.string()), pa.array(g.reshape(-1)), pa.array(at.astype(np.int32))], names=["word", "gram", "at"])


def short_lists(words: DataFrame) -> DataFrame:
    """(gram, len, at, word, asks): the postings of each word's Q + 1 rarest grams, and the words that ask for them: of a
    list's own length all do, of the length below those that `asks` marks."""
    rows = words.select("word").mapInArrow(all_grams, "word string, gram long, at int")
    rows = common.table(rows, "variant-grams", dictionary=False)
    often = common.table(rows.groupBy("gram").agg(F.count("*").alias("often")), "variant-often")
    rows = rows.join(common.sized(often), "gram")
    first = rows.groupBy("word").agg(F.slice(F.array_sort(F.collect_list(F.struct("often", "gram", "at"))), 1, Q + 1).alias("g"))
    post = first.select("word", F.length("word").alias("len"), F.explode("g").alias("g")).select("word", "len", "g.gram", "g.at")
    one_on = [F.struct((F.col("len") + i).alias("len"), (F.col("at") + j).alias("at"), F.lit(i > 0).alias("asks")) for i, j in ((0, 0), (1, 0), (1, 1))]
    return post.select("gram", "word", F.explode(F.array(*one_on)).alias("p")).select("gram", "p.len", "p.at", "word", "p.asks")


def dealt(rows: DataFrame, size: int) -> DataFrame:
    """Lists of more than `size` words in parts: a word of the list goes to one, a word that asks to all of them. Words of
    the list itself ask too, so they go to their own part as such and to the other parts as words that ask."""
    key = ["gram", "len", "at"]
    many = rows.groupBy(*key).agg(F.count("*").alias("many")).where(F.col("many") > size).withColumn("parts", F.ceil(F.col("many") / size).cast("int"))
    many = common.sized(common.table(many.select(*key, "parts"), "variant-long"))
    rows = rows.join(many, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    rows = rows.withColumn("own", F.when(F.col("asks"), -1).otherwise(own)).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    return rows.select(*key, "part", "word", "asks", (~F.col("asks") & (F.col("own") != F.col("part"))).alias("elsewhere"))


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many grams rows of a and of b have in common, all with all; b's words are equally long or one longer, and then
    a gram may lie one further on."""
    count = np.zeros((len(a), len(b)), np.uint16)
    for i in range(a.shape[1]):
        hit = a[:, i, None] == b[None, :, i]
        if b.shape[1] > a.shape[1]:
            hit |= a[:, i, None] == b[None, :, i + 1]
        count += hit
    return count


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows (words by code points) are one edit apart, pair by pair."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    left = np.cumprod(a == b[:, :n], axis=1).sum(axis=1)
    right = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return left + right >= n


def near_in(asking: np.ndarray, listed: np.ndarray, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs of words that ask (of one length) and words of a list (of one length, the same or one more)."""
    if not len(asking) or not len(listed):
        return
    a, b = code_points(asking, len(asking[0])), code_points(listed, len(listed[0]))
    ga, gb = grams(a), grams(b)
    rows = max(1, step // len(b))
    for i in range(0, len(a), rows):
        x, y = np.nonzero(shared(ga[i : i + rows], gb) >= b.shape[1] - 1)
        ok = one_edit(a[i + x], b[y])
        yield asking[i + x[ok]], listed[y[ok]]


def lists_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Words, asks and elsewhere of each list; rows come sorted by list, which may go on in the next batch."""
    kept: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        columns = now if kept is None else [np.concatenate(x) for x in zip(kept, now, strict=True)]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in columns[:4]], axis=0)) + 1
        for start, end in zip([0, *cuts[:-1]], cuts, strict=True):
            if end - start > 1:
                yield [c[start:end] for c in columns[4:]]
        kept = [c[cuts[-1] if len(cuts) else 0 :] for c in columns]
    if kept is not None:
        yield kept[4:]


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs (a, b) of each list."""
    for word, asks, elsewhere in lists_of(batches):
        listed = word[~asks & ~elsewhere]
        for asking in (word[~asks], word[asks]):
            for a, b in near_in(asking, listed):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])


def near_pairs(words: DataFrame, size: int = LIST) -> DataFrame:
    """(a, b): all pairs of words that are one edit apart, both ways round."""
    key = ["gram", "len", "at", "part"]
    rows = dealt(common.table(short_lists(words), "variant-lists"), size)
    found = rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(merged, "a string, b string").distinct()
    found = common.table(found, "variant-near")
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(word, root) of words (word, form) that have a form: doubled steps along forms until none leads further."""
    now = common.table(forms.select("word", F.col("form").alias("root")), "variant-roots")
    for _ in range(max_rounds):
        step = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
        new = common.table(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        common.drop_table(now)
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now
    raise RuntimeError("forms lead in a circle")


def spelling_variants(words: DataFrame, ratio: int = RATIO, size: int = LIST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n), each of which comes once."""
    words = common.table(words.select("word", "n"), "variant-words")
    near = near_pairs(words, size).join(common.sized(words.select(F.col("word").alias("b"), F.col("n").alias("n_b"))), "b")
    per = near.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), "b")).alias("best"))
    out = words.join(per, "word", "left").withColumn("has", F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False)))
    out = out.select("word", F.when(F.col("has"), F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), -F.col("best.less")).alias("form_n"))
    out = common.table(out, "variant-forms")
    led = roots(out.where("form is not null"))
    return out.join(common.sized(led), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(docs: DataFrame) -> DataFrame:
    return spelling_variants(vocabulary(docs))
