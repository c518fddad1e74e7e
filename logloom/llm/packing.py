"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

A document's ids, each document ending in id 0, are cut at SIZE only if there are more; the pieces then go into as few sequences of SIZE
as can be found. Pieces are dealt at random to shards of about SHARD pieces, so that shards are alike and of bounded
size whatever the table holds, and every shard is packed by itself: a shard has ISLANDS islands, each with a population of packings.
A generation crosses two packings: well-filled sequences of one go whole into the other, whose sequences that hold any of the same
pieces are dissolved, and what is displaced goes by best fit into the rest. After each epoch the islands' elites migrate along a
ring, which is a join of small rows. The first packing of each population is best fit by falling length, so none is worse.
Sequences of a shard's best packing that are filled less than FULL are dissolved and their pieces dealt to fewer shards
for a second run, since what one shard lacks another may have.

Tokens come word by word from a bounded table of words already seen: no token of this vocabulary spans white space or depends on what lies beyond
it, and a mark behind letters is a token by itself. A null text is an empty one, an empty text is one piece of one id, repeated rows
are packed each on their own, other columns play no part, and an empty table gives no rows. Ties are settled by the
order of a shard's pieces; a task that is run again gives the same rows.
"""

from __future__ import annotations

import random
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = "word_bpe_49k.json"
SIZE, END = 2048, 0
#: Pieces of a shard; islands, packings on each, generations of an epoch, epochs; fill below which sequences are dissolved.
SHARD, ISLANDS, PACKINGS, GENERATIONS, EPOCHS, FULL, SEED = 4096, 2, 4, 8, 2, 0.98, 11
#: Rounds of exchange in a crossing, and words whose ids a worker keeps.
SWAPS, SEEN = 4, 1_000_000
#: Letters up to U+00FF, which are one word of the tokenizer, and a run of marks, which is another; an apostrophe may not be.
PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, r long"


class Words(dict):
    """Little-endian ids of words already met (UTF-8); a word that is new is learned when it is asked for."""

    def __init__(self, path: str, most: int = SEEN):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.merges = self.tokenizer.model
        letters = [chr(c) for c in range(0x80, 0x100) if chr(c).isalpha()]
        self.bytes_as_text = str.maketrans({c: "".join(part for part, _ in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)) for c in letters})

    def __missing__(self, word: bytes) -> bytes:
        """Letters and a run of marks behind them are two words of the tokenizer, so `word,` needs no merging if `word` and
        `,` have been met."""
        m = PLAIN.fullmatch(word)
        if m and m[2]:
            out = self[m[1]] + self[m[2]]
        elif m:
            ids = [t.id for t in self.merges.tokenize(word.decode().lower().translate(self.bytes_as_text))]
            out = struct.pack(f"<{len(ids)}I", *ids)
        else:
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = out
        return out

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Of each text its ids and END. When there are too many words, those met later go: frequent words come first."""
        end = struct.pack("<I", END)
        for t in texts:
            yield b"".join(map(self.__getitem__, lowered(t).replace(b"\n", b" ").split(b" "))) + end
        if len(self) > self.most:
            for w in list(self)[self.most // 2 :]:
                del self[w]


def lowered(text: bytes) -> bytes:
    """A-Z lower-cased, as the tokenizer does later, so that fewer words differ; not beside special tokens, and not where a
    combining mark may join a small letter but not its capital."""
    return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()


@cache
def words_of(path: str) -> Words:
    return Words(path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def piecewise(path: str | None, size: int, step: int = 1 << 22) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, text) to pieces, about `step` bytes at a time; r is a random number, the same if a task is run again."""

    def pieces(own: Words, ids: list[object], texts: list[bytes], draw: random.Random, kind: pa.DataType) -> pa.RecordBatch:
        rows = []
        for i, whole in zip(ids, own.encode(texts), strict=True):
            view, cut = memoryview(whole), 4 * size
            rows += [(i, k, k * size, min(cut, len(view) - s) // 4, zlib.crc32(view[s : s + cut]), draw.getrandbits(62)) for k, s in enumerate(range(0, len(view), cut))]
        kinds = [kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "r"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, draw = words_of(path or vocabulary_path()), random.Random(SEED * 1_000_003 + TaskContext.get().partitionId())
        for batch in batches:
            ids, texts, held = [], [], 0
            for i, t in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                ids.append(i.as_py())
                texts.append(t.as_py())
                held += len(texts[-1])
                if held >= step:
                    yield pieces(own, ids, texts, draw, batch.column(0).type)
                    ids, texts, held = [], [], 0
            if ids:
                yield pieces(own, ids, texts, draw, batch.column(0).type)

    return make


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, r) of every row's pieces."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(piecewise(path, size), PIECES.format(id=docs.schema[key].dataType.simpleString()))


@dataclass
class Packing:
    """bin_of: each item's sequence; fill: what is in each sequence."""

    bin_of: np.ndarray
    fill: np.ndarray

    def value(self, size: int) -> tuple[int, float]:
        """Fewer sequences are better, then the more unequally filled."""
        used = self.fill[self.fill > 0]
        return -len(used), float(np.square(used / size).sum())


def best_fit(lengths: np.ndarray, bin_of: np.ndarray, fill: np.ndarray, items: np.ndarray, size: int) -> Packing:
    """Items, longest first, each into the fullest sequence that has room, or a new one. room[k] holds sequences with k
    left, and bit k of `open_` tells whether there are any."""
    left = size - fill
    room: dict[int, list[int]] = {}
    for b in np.flatnonzero((fill > 0) & (left > 0)).tolist():
        room.setdefault(int(left[b]), []).append(b)
    open_, next_, fills = sum(1 << k for k in room), len(fill), fill.tolist()
    for i in items[np.argsort(-lengths[items], kind="stable")].tolist():
        n = int(lengths[i])
        fitting = open_ >> n
        if fitting:
            k = n + (fitting & -fitting).bit_length() - 1
            b = room[k].pop()
            if not room[k]:
                open_ ^= 1 << k
        else:
            k, b, next_ = size, next_, next_ + 1
            fills.append(0)
        bin_of[i] = b
        fills[b] += n
        if k > n:
            held = room.setdefault(k - n, [])
            if not held:
                open_ |= 1 << (k - n)
            held.append(b)
    return Packing(bin_of, np.array(fills, np.int64))


def exchanged(p: Packing, lengths: np.ndarray, loose: np.ndarray, size: int) -> np.ndarray:
    """Fill sequences up by exchange: in each the item that a longer loose one of at most the room left replaces best, which
    sets the shorter one loose. Returns what is loose then; changes p."""
    loose = loose[np.argsort(lengths[loose], kind="stable")]
    placed = np.setdiff1d(np.arange(len(lengths)), loose)
    placed = placed[p.fill[p.bin_of[placed]] < size]
    if not len(loose) or not len(placed):
        return loose
    short = lengths[loose]
    best = np.searchsorted(short, lengths[placed] + size - p.fill[p.bin_of[placed]], "right") - 1
    gain = np.where(best >= 0, short[best] - lengths[placed], 0)
    order = np.argsort(-gain, kind="stable")
    order = order[gain[order] > 0]
    _, first = np.unique(p.bin_of[placed[order]], return_index=True)  # one item of each sequence
    order = order[np.sort(first)]
    _, first = np.unique(best[order], return_index=True)  # and each loose one once
    order = order[first]
    out, into = placed[order], loose[best[order]]
    bins = p.bin_of[out]
    p.bin_of[into] = bins
    p.fill[bins] += lengths[into] - lengths[out]
    return np.concatenate([np.delete(loose, best[order]), out])


def compact(p: Packing) -> Packing:
    used = p.fill > 0
    number = np.cumsum(used) - 1
    return Packing(number[p.bin_of], p.fill[used])


def crossed(a: Packing, b: Packing, lengths: np.ndarray, size: int, draw: np.random.Generator) -> Packing:
    """Well-filled sequences of b go whole into a; a's sequences with any of the same items are dissolved, and the least filled of
    the others too; what is displaced is first exchanged for shorter items of sequences with room, then goes in by best fit."""
    share = draw.uniform(0.1, 0.5)
    order = np.argsort(-(b.fill + draw.uniform(0, size / 64, len(b.fill))), kind="stable")
    taken = np.zeros(len(b.fill), bool)
    taken[order[: max(1, int(share * len(order)))]] = True
    injected = taken[b.bin_of]
    gone = np.zeros(len(a.fill), bool)
    gone[a.bin_of[injected]] = True
    worst = np.argsort(a.fill + draw.uniform(0, size / 8, len(a.fill)), kind="stable")
    gone[worst[: max(1, len(worst) // 50)]] = True
    fill = np.concatenate([np.where(gone, 0, a.fill), np.where(taken, b.fill, 0)])
    bin_of = np.where(injected, b.bin_of + len(a.fill), a.bin_of)
    child, loose = Packing(bin_of, fill), np.flatnonzero(gone[a.bin_of] & ~injected)
    for _ in range(SWAPS):
        loose = exchanged(child, lengths, loose, size)
    return compact(best_fit(lengths, child.bin_of, child.fill, loose, size))


def first_packings(lengths: np.ndarray, many: int, size: int, draw: np.random.Generator) -> list[Packing]:
    """Best fit by falling length, and by lengths that are blurred a little."""
    none = lambda: (np.zeros(len(lengths), np.int64), np.zeros(0, np.int64))
    out = [compact(best_fit(lengths, *none(), np.arange(len(lengths)), size))]
    for _ in range(many - 1):
        order = np.argsort(-(lengths * draw.uniform(0.8, 1, len(lengths))), kind="stable")
        parts = np.array_split(order, 4)  # within a part again by length, so that the four differ from one fall
        p = Packing(*none())
        for own in parts:
            p = best_fit(lengths, p.bin_of, p.fill, own, size)
        out.append(compact(p))
    return out


def evolved(lengths: np.ndarray, population: list[Packing], most: int, generations: int, size: int, draw: np.random.Generator) -> list[Packing]:
    """The population after some generations, best first; a child replaces the worst if it is better than that."""
    worth = lambda p: p.value(size)
    population = sorted(population, key=worth, reverse=True)[:most]
    bound = -(-int(lengths.sum()) // size)
    for _ in range(generations):
        for _ in range(len(population) // 2):
            if len(population[0].fill) == bound:
                return population
            i, j = draw.choice(len(population), 2, replace=False) if len(population) > 1 else (0, 0)
            child = crossed(population[i], population[j], lengths, size, draw)
            if worth(child) > worth(population[-1]):
                population = sorted([*population[:-1], child], key=worth, reverse=True)
    return population


def island_step(size: int, packings: int, generations: int, epoch: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows (shard, island, lengths, packings, used), one for each island: an epoch's evolution of each; used: sequences of the first packing. Packings travel as
    16-bit sequence numbers, one for each piece, so a shard has less than 65,536 pieces."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, used = [], []
            for row in batch.itertuples(index=False):
                lengths = np.frombuffer(row.lengths, "<i4").astype(np.int64)
                draw = np.random.default_rng([SEED, epoch, row.shard, row.island])
                if epoch:
                    own = [np.frombuffer(p, "<u2").astype(np.int64) for p in row.packings]
                    population = [Packing(p, np.bincount(p, lengths).astype(np.int64)) for p in own]
                else:
                    population = first_packings(lengths, packings, size, draw)
                population = evolved(lengths, population, packings, generations, size, draw)
                out.append([p.bin_of.astype("<u2").tobytes() for p in population])
                used.append(len(population[0].fill))
            yield batch.assign(packings=out, used=used)

    return step


def shard_lengths(table: pa.Table) -> pa.Table:
    lengths = np.sort(table.column("length").to_numpy())[::-1].astype("<i4")
    return pa.table({"shard": [table.column("shard")[0].as_py()], "lengths": [lengths.tobytes()]})


def laid_out(size: int, first: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """A shard's pieces in the sequences of its best packing: sequence_id and offset, and the sequence's fill."""

    def place(key: tuple, pieces: pa.Table, best: pa.Table) -> pa.Table:
        lengths = pieces.column("length").to_numpy()
        order = np.lexsort([pieces.column("r").to_numpy(), -lengths])  # as lengths were packed; pieces of one length stand for each other
        pieces, lengths = pieces.take(pa.array(order)), lengths[order]
        bins = np.frombuffer(best.column("best")[0].as_py(), "<u2").astype(np.int64)
        order = np.argsort(bins, kind="stable")
        lengths, bins = lengths[order], bins[order]
        ends = np.cumsum(lengths)
        starts = np.concatenate([[0], ends[np.flatnonzero(bins[1:] != bins[:-1])]]) if len(bins) else ends
        number = np.cumsum(np.concatenate([[0], bins[1:] != bins[:-1]])).astype(np.int64)
        fill = np.bincount(number, lengths).astype(np.int64)
        out = pieces.take(pa.array(order)).drop_columns(["shard"])
        shard = key[0].as_py()
        for name, values in (("sequence_id", number + ((first + shard) << 16)), ("offset", ends - lengths - starts[number]), ("fill", fill[number])):
            out = out.append_column(name, pa.array(values))
        return out

    return place


@dataclass(frozen=True)
class Plan:
    """What a packing run is told."""

    size: int = SIZE
    shard: int = SHARD
    islands: int = ISLANDS
    packings: int = PACKINGS
    generations: int = GENERATIONS
    epochs: int = EPOCHS


def packed(pieces: DataFrame, shards: int, first: int, plan: Plan) -> DataFrame:
    """The pieces with sequence_id, offset and fill; shards get the numbers from `first` on."""
    dealt = common.table(pieces.withColumn("shard", F.col("r") % F.lit(shards)), "packing-shards")
    now = dealt.select("shard", "length").groupBy("shard").applyInArrow(shard_lengths, "shard long, lengths binary")
    now = now.select("shard", F.explode(F.sequence(F.lit(0), F.lit(plan.islands - 1))).alias("island"), "lengths", F.array().cast("array<binary>").alias("packings"), F.lit(0).alias("used"))
    kind = "shard long, island int, lengths binary, packings array<binary>, used int"
    for epoch in range(plan.epochs):
        if epoch:  # the best half of each island goes to the next one of the ring as well
            elites = F.slice("packings", 1, max(1, plan.packings // 2))
            came = now.select("shard", ((F.col("island") + 1) % plan.islands).cast("int").alias("island"), elites.alias("came"))
            now = now.join(came, ["shard", "island"]).select("shard", "island", "lengths", F.array_distinct(F.concat("packings", "came")).alias("packings"), "used")
        step = island_step(plan.size, plan.packings, plan.generations, epoch)
        now = common.table(now.repartition("shard", "island").mapInPandas(step, kind), "packing-islands")
    best = now.select("shard", "used", F.col("packings")[0].alias("best"))
    best = best.groupBy("shard").agg(F.min(F.struct("used", "best")).alias("b")).select("shard", "b.best")
    kind = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long, fill long"
    return dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(laid_out(plan.size, first), kind)


def pack(pieces: DataFrame, plan: Plan | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) from token_pieces()."""
    plan = plan or Plan()
    pieces = common.table(pieces, "packing-pieces")
    full = F.col("length") == plan.size
    own = (F.monotonically_increasing_id() + F.lit(1 << 60)).alias("sequence_id")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = pieces.where(full).select("*", own, F.lit(0).cast("long").alias("offset")).select(columns)
    rest, shards = pieces.where(~full), -(-pieces.where(~full).count() // plan.shard)
    if not shards:
        return out
    placed = common.table(packed(rest, shards, 0, plan), "packing-first")
    kept = F.col("fill") >= FULL * plan.size
    loose = placed.where(~kept).drop("sequence_id", "offset", "fill")
    again = -(-loose.count() // plan.shard)
    if not again or shards == 1:
        return out.unionByName(placed.select(columns))
    second = common.table(packed(loose, again, shards, plan), "packing-second")
    return out.unionByName(placed.where(kept).select(columns)).unionByName(second.select(columns))


def op12(docs: DataFrame) -> DataFrame:
    return pack(token_pieces(docs))
