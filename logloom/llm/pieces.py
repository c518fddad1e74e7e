"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's segmentations into vocabulary pieces are the ways through a lattice; a way's probability is in proportion to the
product of its pieces' weights. Its K best ways under independent Gumbel perturbations are K draws without replacement.
They are found by A* search over regions of the lattice: a region's perturbed maximum is one truncated Gumbel draw at the
log of its mass (exact, from the backward sums), so the best region is always opened next. Opening one draws its best way,
splits what is left into the regions that leave this way at one of the next STEP decisions and one for the tail, and
draws their maxima below its own. The (K + 1)-th maximum is the threshold kappa of the inclusion score of each way,
1 - exp(-exp(log p - kappa)).

No piece crosses the start of a run of spaces or a line end, so a text's lattice is a chain of words' lattices. Those of
a batch's different words are built together in arrays and kept for later batches; a way is drawn for all words at once,
all randomness being hashed from the row's key, the draw and the place. Vocabularies with other pieces are refused.

Weights: a unigram model's scores times THETA; a BPE model has merge ranks for scores, and a piece of rank r gets the
Zipfian weight 1 / (r + 2), to the power THETA. Characters outside the vocabulary, and a literal U+2581, are spelled in byte
pieces. Decoding restores every text exactly. Null and empty texts have one segmentation, of no pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K, THETA, SEED, STEP = 2, 1.0, 7, 16
#: Characters of one batch of texts, and words whose lattices are kept.
CHARS, WORDS = 1 << 20, 100_000
#: Uniform numbers that are made for all texts of a batch at once; a text that needs more makes these itself.
READY = 64
#: Words whose lattices are built at once.
PORTION = 4096
SPACE = "▁"
WORD = re.compile(r" *[^ \n]+| +|\n")
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Of 64-bit counters, uniform numbers in (0, 1)."""
    x = np.atleast_1d(x)  # whole numbers wrap around silently in arrays only
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return ((x ^ (x >> U64(31))) >> U64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def counter(seed: int | np.ndarray, *parts: int | np.ndarray) -> np.ndarray:
    x = np.atleast_1d(np.asarray(seed, dtype=np.int64)).astype(U64)
    for p in parts:
        x = (x ^ np.asarray(p).astype(U64)) * U64(0x9E3779B97F4A7C15) + U64(0xD1B54A32D192ED03)
    return x


@dataclass
class Vocabulary:
    """Pieces as a trie in arrays: a hash table from (node, character) to node, and each node's piece and weight."""

    pieces: list[bytes]
    byte_ids: np.ndarray
    byte_weight: float
    chars: np.ndarray
    n_chars: int
    keys: np.ndarray
    children: np.ndarray
    piece: np.ndarray
    weight: np.ndarray
    sizes: np.ndarray = field(init=False)  # of the pieces' bytes, and where these begin in `flat`
    begin: np.ndarray = field(init=False)
    flat: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.pieces), np.uint8)

    def child(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        key = node * self.n_chars + char
        slot = (key * 0x9E3779B1) & (len(self.keys) - 1)
        found = self.keys[slot]
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found[open_] = self.keys[slot[open_]]
            open_ = open_[(found[open_] != key[open_]) & (found[open_] != -1)]
        return np.where(found == key, self.children[slot], -1)


def load(path: str = MODEL, theta: float = THETA) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    texts, scores = [sp.id_to_piece(i) for i in range(n)], np.array([sp.get_score(i) for i in range(n)])
    normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    if bad := [texts[i] for i in normal if SPACE in texts[i].lstrip(SPACE) or "\n" in texts[i]]:
        raise ValueError(f"pieces that go across words: {bad[:3]}")
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    if not all(sp.is_byte(int(i)) for i in byte_ids):
        raise ValueError("the vocabulary has no byte pieces")
    ranks = -scores[normal]
    is_rank = np.all(ranks == np.round(ranks))
    # single characters' scores in a BPE model may lie far below all ranks
    weights = theta * (-np.log(np.minimum(np.maximum(ranks, 0), n) + 2) if is_rank else scores[normal])
    pieces = [b""] * n
    for b, i in enumerate(byte_ids.tolist()):
        pieces[i] = bytes([b])
    alphabet = sorted({c for i in normal for c in texts[i]})
    number = {c: k for k, c in enumerate(alphabet)}
    chars = np.full(0x110000, -1, np.int32)
    for c, k in number.items():
        chars[ord(c)] = k
    chars[32], chars[ord(SPACE)] = number.get(SPACE, -1), -1
    nodes, piece, weight = {"": 0}, [-1], [0.0]
    edges: dict[tuple[int, int], int] = {}
    for i, w in zip(normal, weights.tolist(), strict=True):
        pieces[i] = texts[i].replace(SPACE, " ").encode()
        for k in range(1, len(texts[i]) + 1):
            if texts[i][:k] not in nodes:
                nodes[texts[i][:k]] = len(piece)
                piece.append(-1)
                weight.append(0.0)
            edges[nodes[texts[i][: k - 1]], number[texts[i][k - 1]]] = nodes[texts[i][:k]]
        piece[nodes[texts[i]]], weight[nodes[texts[i]]] = i, w
    size = 1 << (4 * len(edges)).bit_length()
    keys, children = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    for (node, c), to in edges.items():
        key = node * len(alphabet) + c
        slot = (key * 0x9E3779B1) & (size - 1)
        while keys[slot] != -1:
            slot = (slot + 1) & (size - 1)
        keys[slot], children[slot] = key, to
    return Vocabulary(pieces, byte_ids, float(min(weights.tolist(), default=0.0) - 2), chars, len(alphabet), keys, children, np.array(piece), np.array(weight))


@dataclass
class Lattices:
    """Edges of many words' lattices. Every word has a row for each character and one for its end; a row's edges lie together, the likeliest first."""

    v: Vocabulary
    index: dict[str, int] = field(default_factory=dict)
    start: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each word its first row
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of each row its first edge, and a last one
    row: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    to: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    what: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # piece, or below zero -1 - character
    logp: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cum: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    leave: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log of what the other edges of its row have, -inf without others

    def ends(self, rows: np.ndarray) -> np.ndarray:
        return self.first[rows] == self.first[rows + 1]

    def add(self, words: list[str]) -> None:
        """In portions whose arrays stay in a processor's cache."""
        rows, edges = len(self.first) - 1, len(self.row)
        parts: dict[str, list[np.ndarray]] = {}
        for k in range(0, len(words), PORTION):
            new = self.lattices(words[k : k + PORTION])
            own = len(new["first"])
            for name, by in (("start", rows), ("first", edges), ("row", rows), ("to", rows)):
                new[name] += new[name].dtype.type(by)
            rows, edges = rows + own, edges + len(new["row"])
            for name, values in new.items():
                parts.setdefault(name, [getattr(self, name)]).append(values)
        for w in words:
            self.index[w] = len(self.index)
        for name, values in parts.items():
            setattr(self, name, np.concatenate(values))

    def lattices(self, words: list[str]) -> dict[str, np.ndarray]:
        """The columns of the words alone; narrow types, as these are most of a task's memory."""
        v = self.v
        sizes = np.array([len(w) for w in words])
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum(sizes) - sizes + np.arange(len(words))  # rows: a word's characters and its end
        at = np.arange(len(code)) + np.repeat(np.arange(len(words)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))  # characters to the end
        char = v.chars[code].astype(np.int64)
        here = np.flatnonzero(char >= 0)
        node = v.child(np.zeros(len(here), np.int64), char[here])
        found: list[tuple[np.ndarray, ...]] = []
        length = 1
        while len(here):
            live = node >= 0
            here, node = here[live], node[live]
            hit = v.piece[node] >= 0
            found.append((here[hit], np.full(hit.sum(), length), v.piece[node[hit]], v.weight[node[hit]]))
            more = (left[here] > length) & (char[np.minimum(here + length, len(char) - 1)] >= 0)
            here, node = here[more], node[more]
            node = v.child(node, char[here + length])
            length += 1
        spelled = np.ones(len(code), bool)
        if found:
            spelled[found[0][0]] = False
        odd = np.flatnonzero(spelled)
        width = 1 + (code[odd] >= 0x80) + (code[odd] >= 0x800) + (code[odd] >= 0x10000)
        shown = np.where(code[odd] == 32, 32, code[odd])
        found.append((odd, np.ones(len(odd), np.int64), -1 - shown, width * v.byte_weight))
        pos, size, what, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(pos, kind="stable")
        row, to, what, weight = at[pos[order]], (at[pos] + size)[order], what[order], weight[order]
        total = int(sizes.sum()) + len(words)
        n = np.bincount(row, minlength=total)
        first = np.concatenate(([0], np.cumsum(n)))
        # backward sums, all rows of the same distance to their word's end at once
        near = np.argsort(left, kind="stable")
        of_level = np.concatenate(([0], np.cumsum(np.bincount(left)[1:]))).tolist()
        near_n = n[at[near]]
        cuts = np.concatenate(([0], np.cumsum(near_n)))
        edge = np.repeat(first[at[near]] - cuts[:-1], near_n) + np.arange(cuts[-1])
        target, own, beta = to[edge], weight[edge], np.zeros(total)
        for a, b in zip(of_level, of_level[1:], strict=False):
            if a < b:
                lo, hi = cuts[a], cuts[b]
                value, cut = own[lo:hi] + beta[target[lo:hi]], cuts[a:b] - lo
                top = np.maximum.reduceat(value, cut)
                beta[at[near[a:b]]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, near_n[a:b])), cut))
        logp = weight + beta[to] - beta[row]
        cum = np.exp(logp)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.log1p(-cum)  # log1mexp
        likely = np.flatnonzero(logp > -0.693)
        leave[likely] = log1mexp(logp[likely])
        leave[n[row] == 1] = -np.inf
        here, j = first[:-1][n > 1] + 1, 1
        while len(here):  # running sums within rows, so that no other word has a say in them
            cum[here] += cum[here - 1]
            j += 1
            here = here[n[row[here]] > j] + 1
        cum[first[1:][n > 0] - 1] = np.inf
        return {"start": begin, "first": first[1:], "row": row.astype(np.int32), "to": to.astype(np.int32), "what": what.astype(np.int32), "logp": logp, "cum": cum.astype(np.float32), "leave": leave}

    def draw(self, words: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A way through each word: the edges of all of them in order, and where each word's begin (and the end)."""
        rows, alive = self.start[words], np.arange(len(words))
        count, found = np.zeros(len(words), np.int64), []
        t = 0
        while len(alive):
            u = mix(counter(seeds[alive], t))
            e = self.first[rows]
            more = np.flatnonzero(u > self.cum[e])
            while len(more):
                e[more] += 1
                more = more[u[more] > self.cum[e[more]]]
            found.append((alive, e))
            count[alive] += 1
            rows = self.to[e]
            going = ~self.ends(rows)
            alive, rows = alive[going], rows[going]
            t += 1
        offsets = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(offsets[-1], np.int64)
        for t, (alive, e) in enumerate(found):
            out[offsets[alive] + t] = e
        return out, offsets


def log1mexp(x: float | np.ndarray) -> float | np.ndarray:
    """log(1 - exp(x)) for x <= 0."""
    with np.errstate(divide="ignore"):
        return np.where(x > -0.693, np.log(-np.expm1(np.minimum(x, 0))), np.log1p(-np.exp(np.minimum(x, 0))))


@dataclass(order=True)
class Region:
    """Ways that follow `way` up to decision `at`: with `tail`, those that leave it there or later; else those that take none of `without` there."""

    minus_max: float
    nth: int
    way: np.ndarray = field(compare=False)
    at: int = field(compare=False)
    before: float = field(compare=False)  # log p of what comes before
    tail: bool = field(compare=False)
    without: tuple[int, ...] = field(compare=False, default=())


def truncated(mass: np.ndarray, below: float, u: np.ndarray) -> np.ndarray:
    """Gumbel draws at locations `mass` that are at most `below`."""
    return -np.log(np.exp(-below) + np.exp(-mass) * -np.log(u))


def ways(l: Lattices, drawn: list[tuple[np.ndarray, np.ndarray]], words: slice, seed: int, ready: np.ndarray, k: int) -> list[tuple[np.ndarray, float, float, float]]:
    """The k ways (edges, log p, perturbed log p, inclusion score) through the words; drawn has a free way for each of them, and
    ready the first uniform numbers of the seed."""
    used = 0

    def uniform(n: int) -> np.ndarray:
        nonlocal used
        used += n
        return ready[used - n : used] if used <= len(ready) else mix(counter(seed, 0xA5, np.arange(used - n, used)))

    heap: list[Region] = []
    out: list[tuple[np.ndarray, float, float]] = []

    def split(way: np.ndarray, at: int, before: float, top: float, without: tuple[int, ...], holds_max: bool = False) -> None:
        """Regions of the ways that follow `way` to `at`, take none of `without` there if any, and are not `way` itself."""
        part = way[at : at + STEP]
        lp = l.logp[part]
        prefix = before + np.concatenate(([0.0], np.cumsum(lp)))
        mass = prefix[:-1] + l.leave[part]
        if without:
            row = l.row[part[0]]
            mass[0] = before + float(log1mexp(min(0.0, float(np.logaddexp.reduce(l.logp[list(without)]))))) if len(without) < l.first[row + 1] - l.first[row] else -np.inf
        rest = float(l.logp[way[at + STEP :]].sum()) if len(way) > at + STEP else 0.0
        tail = float(prefix[-1] + log1mexp(rest)) if len(way) > at + STEP and rest < 0 else -np.inf
        every = np.append(mass, tail)
        live = np.flatnonzero(every > -np.inf)
        if not len(live):
            return
        best = truncated(every[live], top, uniform(len(live)))
        if holds_max:  # the maximum of all is known: it lies in one of them, by their masses
            p = np.exp(every[live] - every[live].max())
            best[int(np.searchsorted(np.cumsum(p), uniform(1)[0] * p.sum()).clip(0, len(live) - 1))] = top
        top_few = np.argsort(-best, kind="stable")[: k + 1]  # others can be neither a way nor kappa: each region has a way at its maximum
        for g, j in zip(best[top_few].tolist(), live[top_few].tolist(), strict=True):
            if j == len(part):
                region = Region(-g, len(out) * 1_000_000 + used * 100 + j, way, at + STEP, float(prefix[-1]), True)
            else:
                region = Region(-g, len(out) * 1_000_000 + used * 100 + j, way, at + j, float(prefix[j]), False, without if without and j == 0 else (int(part[j]),))
            heapq.heappush(heap, region)

    edges, offsets = drawn[0]
    way = edges[offsets[words.start] : offsets[words.stop]]
    top = float(-np.log(-np.log(uniform(1)[0])))
    out.append((way, float(l.logp[way].sum()), top))
    split(way, 0, 0.0, top, ())
    while heap and len(out) < k:
        r = heapq.heappop(heap)
        if r.tail:
            split(r.way, r.at, r.before, -r.minus_max, (), holds_max=True)
            continue
        row = l.row[r.way[r.at]]
        fresh = [e for e in range(int(l.first[row]), int(l.first[row + 1])) if e not in r.without]
        p = np.exp(l.logp[fresh] - l.logp[fresh].max())
        e = fresh[int(np.searchsorted(np.cumsum(p), uniform(1)[0] * p.sum()).clip(0, len(fresh) - 1))]
        new = [e]
        while (b := int(l.first[l.to[e] + 1])) > (a := int(l.first[l.to[e]])):
            e = a + int(np.searchsorted(l.cum[a:b], uniform(1)[0]))
            new.append(e)
        word = words.start + int(l.ends(l.to[r.way[: r.at]]).sum())
        edges, offsets = drawn[len(out)]
        way = np.concatenate([r.way[: r.at], new, edges[offsets[word + 1] : offsets[words.stop]]])
        out.append((way, float(l.logp[way].sum()), -r.minus_max))
        split(way, r.at, r.before, -r.minus_max, (*r.without, int(new[0])))
    # a region's maximum is known without opening it
    kappa = -heap[0].minus_max if heap else -np.inf
    score = lambda lp: float(-np.expm1(-np.exp(min(700.0, lp - kappa)))) if kappa > -np.inf else 1.0
    return [(w, lp, g, score(lp)) for w, lp, g in out]


def to_ids(l: Lattices, way: np.ndarray) -> np.ndarray:
    what = l.what[way]
    odd = np.flatnonzero(what < 0)
    if not len(odd):
        return what
    parts, last = [], 0
    for i in odd.tolist():
        parts.append(what[last:i])
        parts.append(l.v.byte_ids[list(chr(-1 - int(what[i])).encode("utf-8", "surrogatepass"))])
        last = i + 1
    return np.concatenate([*parts, what[last:]])


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of pieces; the space before the first word, which encoding adds, goes."""
    n = v.sizes[ids]
    ends = np.cumsum(n)
    at = np.repeat(v.begin[ids] - ends + n, n)
    at += np.arange(len(at))
    return v.flat[at].tobytes().decode("utf-8", "replace")[1:]


def sample_batch(l: Lattices, texts: list[str], seeds: list[int], k: int) -> Iterator[list[tuple[np.ndarray, float, float, float]]]:
    """Of each text its ways (ids, log p, perturbed, inclusion)."""
    split = [WORD.findall(" " + t) if t else [] for t in texts]
    if len(l.index) > WORDS:
        l.__init__(l.v)
    flat = list(chain.from_iterable(split))
    if new := set(flat).difference(l.index):
        l.add(sorted(new))
    ends = np.concatenate(([0], np.cumsum([len(w) for w in split])))
    words = np.array(list(map(l.index.__getitem__, flat)), np.int64)
    base = np.repeat(np.array(seeds, np.int64), np.diff(ends))
    place = np.arange(len(words)) - np.repeat(ends[:-1], np.diff(ends))
    drawn = [l.draw(words, counter(base, place, s).view(np.int64)) for s in range(k)]
    ready = mix(counter(np.array(seeds, np.int64)[:, None], 0xA5, np.arange(READY)))
    for i, seed in enumerate(seeds):
        if ends[i] == ends[i + 1]:
            yield [(np.zeros(0, np.int64), 0.0, float(-np.log(-np.log(ready[i, 0]))), 1.0)]
        else:
            with np.errstate(over="ignore", divide="ignore"):
                found = ways(l, drawn, slice(int(ends[i]), int(ends[i + 1])), seed, ready[i], k)
            yield [(to_ids(l, w), lp, g, q) for w, lp, g, q in found]


SAMPLES = "sample int, n_pieces long, pieces binary, log_p double, perturbed double, inclusion double"


def segmentations(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, path: str = MODEL, theta: float = THETA, seed: int = SEED, digest: bool = False, chars: int = CHARS) -> DataFrame:
    """(key, sample, n_pieces, pieces, log_p, perturbed, inclusion): up to k distinct segmentations of each text.

    pieces holds the ids as little-endian numbers of 2 bytes (4, if the vocabulary needs them). With digest it is left
    out for its SHA-256 and whether it decodes to the text, so that the ids need not leave the task. chars: how many characters
    of texts are taken at once; fewer need less memory and a little more time, and the draws stay the same."""
    v = load(path, theta)
    dtype = "<u2" if len(v.pieces) <= 1 << 16 else "<u4"
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, " + (SAMPLES if not digest else SAMPLES.replace("pieces binary", "pieces_sha256 string, decodes boolean"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        l = Lattices(v)
        for batch in batches:
            texts = batch.column(1)
            at = 0
            while at < batch.num_rows:
                to, size = at, 0
                while to < batch.num_rows and (to == at or size + len(texts[to].as_py() or "") <= chars):
                    size += len(texts[to].as_py() or "")
                    to += 1
                part = batch.slice(at, to - at)
                plain = [t or "" for t in part.column(1).to_pylist()]
                rows: list[tuple] = []
                take: list[int] = []
                for i, found in enumerate(sample_batch(l, plain, part.column(2).to_pylist(), k)):
                    for s, (ids, lp, g, q) in enumerate(found):
                        raw = ids.astype(dtype).tobytes()
                        take.append(i)
                        rows.append((s, len(ids), *((hashlib.sha256(raw).hexdigest(), decode(ids, v) == plain[i]) if digest else (raw,)), lp, g, q))
                names = [x.split()[0] for x in schema.split(", ")]
                columns = [part.column(0).take(pa.array(take, pa.int32()))]
                types = [pa.int32(), pa.int64(), *((pa.string(), pa.bool_()) if digest else (pa.binary(),)), pa.float64(), pa.float64(), pa.float64()]
                columns += [pa.array([r[c] for r in rows], t) for c, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at = to

    return docs.select(key, text, F.xxhash64(F.lit(seed), F.col(key)).alias("seed")).mapInArrow(run, schema)


def op2(docs: DataFrame, path: str = MODEL) -> DataFrame:
    return segmentations(docs, path=path, digest=True)
