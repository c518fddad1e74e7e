"""Near-duplicate lines by an exact set-similarity join, in DataFrame expressions only.

A line is the set of its words. It is removed if an earlier line has a Jaccard similarity of THRESHOLD = 0.8 or more with
it; earlier is by doc_id (null first), a hash of the document, and the line's place, whether or not that earlier
line is removed itself. Rows that repeat both doc_id and text count as one document, and blank lines stay. Nulls, empty
texts and empty tables have no lines; other columns pass through under their own names, whatever these are.

Documents are numbered in that order, and a line's number is its document's and its place in one. Equal lines meet in one
aggregate, which keeps the least number. Among the different ones the words of each are ordered by rarity: counts over all
different lines in 2^BUCKET_BITS hashed counters, a table of fixed size, give each a class, and hashes order a class. Two
sets with that similarity share a word among the first n - ceil(0.8 n) + 1 of each, so only those are joined, each with
earlier ones alone, under the length and positional filters and one of parity bits: bit b of a set tells whether an odd
number of its words hash to b, so two sets' bits differ in no more places than they have words of one alone, which is at
most a ninth of both sizes' sum. Of what is left, the words that both prefixes share, with all that may follow them, must
be enough (see `enough`), and the rest is verified on the whole sets. Up to three words a set can only match an equal one.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Jaccard threshold as a fraction, so that sizes are compared in whole numbers.
UP, DOWN = 4, 5
BUCKET_BITS = 17
SPACE = r"[\x20\x09-\x0D]+"
#: Sets of fewer words match only equal ones.
SMALLEST = 4
#: Sets of as many words have three times the parity bits, as the bits of long ones differ by chance no more than they may.
LONG = 32
#: Prefix words are joined in parts, by their codes' remainders from 0 to 7; the first part settles most of what is open.
PARTS = ((0, 2), (2, 5), (5, 8))
#: A set that is not settled first meets one in SHARE of the others, the same ones for all, and is held against those of near parity bits in NEAREST shares of what it met.
SHARE, NEAREST = 8, 3
#: Two 32-bit numbers in one.
WIDE = 1 << 32
#: monotonically_increasing_id() counts the rows of a partition in its low bits.
NTH = (1 << 33) - 1


#: The hashes of words fall into thirds at these.
CUTS = (-(1 << 64) // 6, (1 << 64) // 6)


def plain(line: Column) -> Column:
    """The line with spaces alone between its words. A single character is looked for, and splits, several times faster than a class."""
    other = line.contains("\t") | line.contains("\r") | line.contains("\x0b") | line.contains("\x0c") | line.contains("\n")
    return F.when(other, F.regexp_replace(line, SPACE, " ")).otherwise(line)


def split_words(line: Column) -> Column:
    """Words of a plain line, and empty strings."""
    return F.split(line, " ")


def words_of(line: Column) -> Column:
    return F.array_remove(split_words(line), "")


def bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))


def rarity(sets: DataFrame) -> list[int]:
    """Of each word counter a class from 0 to 127 that rises with its count in sets (line), four to a doubling: of the same
    size for any corpus, and small enough to stay in a processor's cache."""
    words = sets.select(F.explode_outer(split_words(F.col("line"))).alias("word")).select(bucket(F.xxhash64("word")).cast("int").alias("id"))
    level = F.least(F.floor(F.log2(F.col("count") + 1) * 4), F.lit(127)).cast("int")
    out = [0] * (1 << BUCKET_BITS)
    for at, of in words.groupBy("id").count().select("id", level).collect():
        out[at] = of
    return out


def with_codes(sets: DataFrame, levels: list[int]) -> DataFrame:
    """(id, n, bits, more, most, least, codes) of (id, line): the number of different words, parity bits, the four least hashes, and
    the words as sorted 63-bit codes, the 7 bits of a word's class above 56 of its hash.

    The table is a literal: as a column it would be copied into every row. No element that the sorts get may be null, or
    they compare boxed values. The thirds are ranges of the sorted hashes, found by two cuts sorted with them, so that each
    word is looked at once."""
    table = F.split(F.lit(",".join(map(str, levels))), ",").cast("array<tinyint>")
    shiftleft = lambda x, n: F.call_function("shiftleft", x.cast("long"), n)
    bit = lambda h: shiftleft(F.lit(1), F.shiftrightunsigned(h, 33).cast("int"))  # noqa: E731  by the low six bits of that
    zero = F.lit(0).cast("long")
    code = lambda h: F.coalesce(shiftleft(table[bucket(h)], F.lit(56)).bitwiseOR(F.shiftrightunsigned(h, 8)), zero)
    parity = lambda part: F.aggregate(part, zero, lambda acc, h: acc.bitwiseXOR(bit(h)))
    first, second = (F.lit(x).cast("long") for x in CUTS)
    df = sets.select("id", F.array_distinct(F.transform(words_of(F.col("line")), lambda w: F.xxhash64(w))).alias("h"))
    df = df.select("id", "h", F.size("h").alias("n"), F.sort_array(F.concat("h", F.array(first, second))).alias("cut"))
    df = df.select("id", "h", "n", "cut", F.array_position("cut", first).cast("int").alias("p"), F.array_position("cut", second).cast("int").alias("q"))
    low, middle, high = F.slice("cut", F.lit(1), F.col("p") - 1), F.slice("cut", F.col("p") + 1, F.col("q") - F.col("p") - 1), F.slice("cut", F.col("q") + 1, F.lit(2) + F.col("n") - F.col("q"))
    long = F.col("n") >= LONG
    df = df.select("id", "h", "n", "cut", F.when(long, parity(low)).otherwise(parity("h")).alias("rest"), F.when(long, parity(middle)).otherwise(zero).alias("more"), F.when(long, parity(high)).otherwise(zero).alias("most"))
    bits = F.col("rest").bitwiseXOR(F.col("more")).bitwiseXOR(F.col("most"))
    least = F.slice(F.filter(F.slice("cut", 1, 6), lambda h: (h != first) & (h != second)), 1, 4)
    return df.select("id", "n", bits.alias("bits"), "more", "most", least.alias("least"), F.sort_array(F.transform("h", code)).alias("codes"))


def fitting(n_a: Column, i_a: Column, n_b: Column, i_b: Column) -> Column:
    """Length and positional filters for sets of n words that share their i-th."""
    most = F.least(i_a, i_b) + 1 + F.least(n_a - i_a - 1, n_b - i_b - 1)
    return (n_a * DOWN >= n_b * UP) & (n_b * DOWN >= n_a * UP) & (most * (UP + DOWN) >= (n_a + n_b) * UP)


PARITY = ("bits", "more", "most")


def differing(n_a: Column, a: list[Column], n_b: Column, b: list[Column]) -> Column:
    """Parity bits (PARITY) that differ: no more than words of one set alone. `more` and `most` have those of a third of the
    words each, so that two long sets are compared by thirds."""
    bits, more, most = (x.bitwiseXOR(y) for x, y in zip(a, b, strict=True))
    thirds = F.bit_count(more) + F.bit_count(most) + F.bit_count(bits.bitwiseXOR(more).bitwiseXOR(most))
    return F.when((n_a >= LONG) & (n_b >= LONG), thirds).otherwise(F.bit_count(bits))


def near(n_a: Column, a: list[Column], n_b: Column, b: list[Column]) -> Column:
    """The filter of parity bits; sets of the similarity pass it always."""
    return differing(n_a, a, n_b, b) * (UP + DOWN) <= (n_a + n_b) * (DOWN - UP)


def prefix_length(n: Column) -> Column:
    return n - F.ceil(n * F.lit(UP) / F.lit(DOWN)).cast("int") + 1


def enough(shared: Column, n_a: Column, last_a: Column, n_b: Column, last_b: Column) -> Column:
    """Whether sets that share so many words of their prefixes, at most at the places last_a and last_b, may be alike. All
    shared words up to the end of the prefix that ends first are in both, so behind it one has no more than its words
    behind its prefix; and behind the last shared one no more can follow than either set has there."""
    most = F.least(F.greatest(n_a - prefix_length(n_a), n_b - prefix_length(n_b)), F.least(n_a - 1 - last_a, n_b - 1 - last_b))
    return (shared + most) * (UP + DOWN) >= (n_a + n_b) * UP


def verified(pairs: DataFrame, sets: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """The ids b of pairs (a, b) whose whole sets have the similarity."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = common.table(sets.select("id", "line").join(common.sized(named), "id", "left_semi"), "linededup-held", scratch)
    lines = lambda x: held.select(F.col("id").alias(x), F.col("line").alias(f"line_{x}"))
    both = pairs.join(lines("b"), "b").join(lines("a"), "a")
    words_a, words_b = (F.array_distinct(words_of(F.col(f"line_{x}"))) for x in "ab")
    alike = F.size(F.array_intersect(words_a, words_b)) * (UP + DOWN) >= (F.size(words_a) + F.size(words_b)) * UP
    return both.select("b", alike.alias("alike")).where("alike").select("b").distinct()


def with_earlier(sets: DataFrame, levels: list[int], scratch: list[DataFrame]) -> DataFrame:
    """(id) of the sets (id, line) that have a similar set with a lesser id.

    A set is first held against few others: any two of its four words of the least hashes, whatever their rarity, name a
    group, and of these groups' earliest sets, six at most, those that pass the parity filter are its candidates. This settles nearly
    all copies in pairs that grow with the number of sets; only the sets it leaves open are joined with all earlier ones that share
    words of the prefix, by some of the words at a time (PARTS). Near copies that are not like the earliest of their group may have
    very many others that they are like, and would meet all of these. So by the first words a set meets only one in SHARE of the others at first,
    which settles those that have many, and what is left then meets all of them; after both, every open set is held against those
    whose parity bits are nearest."""
    coded = with_codes(sets, levels)
    small, whole = F.col("n") < SMALLEST, F.col("n") >= SMALLEST
    prefix = F.transform(F.slice("codes", 1, prefix_length(F.col("n"))), lambda c: F.hash(c))
    index = coded.select("id", "n", *PARITY, F.when(small, F.col("codes")).alias("same"), F.when(whole, prefix).alias("prefix"), F.when(whole, F.col("least")).alias("least"))
    index = common.table(index, "linededup-prefixes", scratch, dictionary=False)

    same = index.where(small).groupBy("same").agg(F.min("id").alias("e"), F.count("*").alias("size")).where("size > 1")
    equal = index.where(small).join(same, "same").where("id > e").select(F.col("id").alias("b"))

    whole = index.where(whole)
    anchors = F.array(*(F.xxhash64(F.get("least", F.lit(i)), F.get("least", F.lit(j))) for i, j in combinations(range(4), 2)))
    rows = whole.select("id", F.explode_outer(anchors).alias("code"))
    earliest = rows.groupBy("code").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("last > a").select("code", "a")
    voted = common.table(rows.join(earliest, "code").where("id > a").select("a", F.col("id").alias("b")).distinct(), "linededup-voted", scratch)
    voted = common.table(passing(voted, whole), "linededup-pairs", scratch)
    done = common.table(verified(voted, sets, scratch), "linededup-settled", scratch)
    for share in (SHARE, 1):
        pairs = common.table(sharing(whole, done, PARTS[0], share), "linededup-pairs", scratch)
        of = F.pmod(F.hash("a"), F.lit(NEAREST))
        best = pairs.groupBy("b", of).agg(F.min(F.struct(F.col("differ") / (F.col("n_a") + F.col("n_b")), "a")).alias("m")).select("m.a", "b")
        settled = common.table(verified(best, sets, scratch), "linededup-settled", scratch)
        done = done.unionByName(settled)
    pairs = pairs.join(common.sized(settled), "b", "left_anti")
    for part in PARTS[1:]:
        pairs = pairs.unionByName(common.table(sharing(whole, done, part), "linededup-pairs", scratch))
    pairs = pairs.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"), F.max("last_a").alias("last_a"), F.max("last_b").alias("last_b"))
    pairs = pairs.where(enough(*(F.col(k) for k in ("shared", "n_a", "last_a", "n_b", "last_b")))).select("a", "b")
    rest = verified(common.table(pairs, "linededup-pairs", scratch), sets, scratch)
    return equal.unionByName(done).unionByName(rest).select(F.col("b").alias("id"))


def passing(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that pass the filters of lengths and of parity bits."""
    for k in "ab":
        pairs = pairs.join(whole.select(F.col("id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n", *PARITY))), k)
    n_a, n_b = F.col("n_a"), F.col("n_b")
    parity_a, parity_b = ([F.col(f"{c}_{k}") for c in PARITY] for k in "ab")
    return pairs.where((n_a * DOWN >= n_b * UP) & (n_b * DOWN >= n_a * UP) & near(n_a, parity_a, n_b, parity_b)).select("a", "b")


def sharing(whole: DataFrame, settled: DataFrame, part: tuple[int, int], share: int = 1) -> DataFrame:
    """(a, b, n_a, n_b, shared, last_a, last_b, differ): pairs of a set b that is not settled and an earlier one, both of `whole`, that share
    words of their prefixes whose codes leave one of the remainders from part[0] to part[1], that one out: how many, their last places, and the parity bits that differ. With a share only one earlier
    set in so many, by its number's hash, so that one side has no more rows than that.

    The joined rows are most of what is shuffled, so they are narrow: n and i in one number, a settled set, which is no b any
    more, by a negative id, and 32 bits of a code, whose collisions only add candidates. Both sides read the same columns,
    so that they are one exchange."""
    done = common.sized(settled.select(F.col("b").alias("id"), F.lit(True).alias("done")))
    sides = whole.join(done, "id", "left").select(F.coalesce(F.when(F.col("done"), -1 - F.col("id")), "id", F.lit(0)).alias("tag"), "n", *PARITY, F.posexplode_outer("prefix").alias("i", "code"))
    held = F.pmod("code", F.lit(PARTS[-1][1]))
    sides = sides.where((held >= part[0]) & (held < part[1])).select("tag", (F.col("n").cast("long") * WIDE + F.col("i")).alias("n_i"), *PARITY, "code")
    parity_a, parity_b = ([F.col(f"{k}.{c}") for c in PARITY] for k in "ab")
    tag_b = F.col("b.tag")
    n_a, i_a, n_b, i_b = (x for k in "ab" for x in (F.shiftright(f"{k}.n_i", 32), F.col(f"{k}.n_i").bitwiseAND(F.lit(WIDE - 1))))
    earlier = F.greatest("a.tag", -1 - F.col("a.tag"))
    few = sides if share == 1 else sides.where(F.pmod(F.hash(F.greatest("tag", -1 - F.col("tag"))), F.lit(share)) == 0)
    pairs = few.alias("a").join(sides.alias("b"), F.col("a.code") == F.col("b.code"))
    pairs = pairs.where((earlier < tag_b) & fitting(n_a, i_a, n_b, i_b) & near(n_a, parity_a, n_b, parity_b))
    return pairs.groupBy(earlier.alias("a"), tag_b.alias("b"), n_a.cast("int").alias("n_a"), n_b.cast("int").alias("n_b")).agg(F.count("*").alias("shared"), F.max(i_a).alias("last_a"), F.max(i_b).alias("last_b"), F.max(differing(n_a, parity_a, n_b, parity_b)).alias("differ"))


def numbered(docs: DataFrame, text: str, scratch: list[DataFrame]) -> tuple[DataFrame, int]:
    """(k1, k2, number) of every different document (doc_key, k1, k2), from 0 in this order, and a number of lines that none
    exceeds. A partition of the sorted rows counts its own; only the partitions' sizes come to the driver."""
    per = docs.groupBy("doc_key", "k1", "k2").agg((F.max(F.octet_length(text)) + 1).cast("long").alias("n"))
    per = common.table(per, "linededup-documents", scratch)
    order = per.repartitionByRange("doc_key", "k1", "k2").sortWithinPartitions("doc_key", "k1", "k2")
    order = common.table(order.select("k1", "k2", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(NTH)).alias("nth")), "linededup-order", scratch)
    starts, at = [], 0
    for part, size in sorted(tuple(r) for r in order.groupBy("part").count().collect()):
        starts.append((part, at))
        at += size
    starts = docs.sparkSession.createDataFrame(starts, "part int, start long")
    return order.join(F.broadcast(starts), "part").select("k1", "k2", (F.col("start") + F.col("nth")).alias("number")), per.agg(F.max("n")).first()[0] or 1


def lines_of(docs: DataFrame, text: str, *columns: str) -> DataFrame:
    lines = docs.select("k1", "k2", *columns, F.posexplode_outer(F.split(F.col(text), "\n")).alias("place", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("#"), "line")})


def removed_lines(docs: DataFrame, scratch: list[DataFrame], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, places): of each document with lines to remove, named by common.with_row_key, their places from 0. The
    tables in scratch are needed until it has been written."""
    docs = common.with_row_key(docs.select(F.col(key).alias("doc_key"), F.col(text).alias(text)), "doc_key", text).where(F.col(text).isNotNull())
    numbers, most = numbered(docs, text, scratch)
    at = F.col("number") * F.lit(most) + F.col("place")
    lines = lines_of(docs.join(common.sized(numbers), ["k1", "k2"]), text, "number")
    sets = lines.groupBy("h1", "h2").agg(F.min(at).alias("id"), F.count("*").alias("times"), F.first("line").alias("line")).withColumn("line", plain(F.col("line")))
    sets = common.table(sets, "linededup-sets", scratch)
    later = common.table(with_earlier(sets.select("id", "line"), rarity(sets), scratch), "linededup-later", scratch).withColumn("near", F.lit(True))
    marked = sets.select("id", "h1", "h2", "times").join(common.sized(later), "id", "left").where("times > 1 or near is not null")
    owner = numbers.select(F.col("number").alias("owner"), F.col("k1").alias("o1"), F.col("k2").alias("o2"))
    marked = marked.withColumn("owner", F.expr(f"id div {most}")).join(common.sized(owner), "owner")
    marked = marked.select("h1", "h2", "near", "o1", "o2", F.expr(f"cast(id % {most} as int)").alias("o_place"))
    found = lines_of(docs, text).select("h1", "h2", "k1", "k2", "place").join(common.sized(marked), ["h1", "h2"])
    found = found.where("near is not null or k1 <> o1 or k2 <> o2 or place <> o_place")
    return found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("place")).alias("places"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with the text less its removed lines, and two counts under the names `counts`, which docs may not have. A null
    text stays null, of no lines."""
    if taken := [c for c in counts if c in docs.columns]:
        raise ValueError(f"columns {taken} are there already; name others in `counts`")
    scratch: list[DataFrame] = []
    removed = common.table(removed_lines(docs, scratch, key, text), "linededup-removed")
    common.drop_tables(scratch)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(key, text).alias("k1"), F.xxhash64(F.lit("#"), text, key).alias("k2"))
    rows = rows.join(common.sized(removed, F.size("places") / 12), ["k1", "k2"], "left")
    whole = F.col("row").getField(text)
    lines = F.split(whole, "\n")
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("places", i)), "\n")
    new = F.when(F.col("places").isNull(), whole).otherwise(kept)
    columns = [(new if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return rows.select(*columns, F.coalesce(F.size(lines), F.lit(0)).alias(counts[0]), F.coalesce(F.size("places"), F.lit(0)).alias(counts[1]))


def op6(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.greatest("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))
