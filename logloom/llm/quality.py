"""Document quality by a generalised additive model with pairwise interactions.

Every feature is cut into at most BINS bins by the training sample's quantiles. Boosting goes through the features in
turn, ROUNDS times: a shallow tree on one feature's bins takes a small step along the gradient of the logistic loss and
is added to that feature's lookup table. Then the pairs that would reduce the loss most get two-way tables in the same way.
A score is the sum of table entries, looked up for whole batches at once, through the logistic function.

Features come from the text alone, the whole of it. Null and empty texts have all features zero and a score like any other;
a repeated row gives a row each time, an empty table none, and without labels every score is 0.5. Other columns pass
through keep_good() under their own names.
The model is fitted on at most TRAIN_ROWS labelled rows, chosen by a hash of the key; this bound is a parameter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

TRAIN_ROWS, BINS, ROUNDS, PAIRS, RATE = 12_000, 32, 60, 6, 0.1
CUT = 0.3
NAMES = ["log_bytes", "log_words", "word_length", "letters", "upper", "digits", "symbols", "space", "high", "entropy", "distinct_words", "top_word", "line_words", "repeated_lines", "symbol_words", "short_lines", "echoes"]
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
SYMBOLS = np.array([b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'-"])


def features(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(NAMES)
    n = len(data)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = hist[hist > 0] / n
    words, lines = data.split(), data.split(b"\n")
    counts, m = Counter(words), max(1, len(words))
    cased = max(1, int(hist[65:91].sum() + hist[97:123].sum()))
    odd = sum(c for w, c in counts.items() if not (w[-1:].isalnum() or w[-1] in b".,;:?'\"" or w[-1] > 127))
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), n / m, hist[LETTERS].sum() / n, hist[65:91].sum() / cased, hist[48:58].sum() / n, hist[SYMBOLS].sum() / n, hist[[9, 10, 11, 12, 13, 32]].sum() / n,
        hist[128:].sum() / n, float(-(share * np.log2(share)).sum()), len(counts) / m, max(counts.values(), default=0) / m, len(words) / len(lines), 1 - len(set(lines)) / len(lines), odd / m, sum(len(x) < 30 for x in lines) / len(lines), sum(map(eq, words, islice(words, 1, None))) / m,
    ]


@dataclass(frozen=True)
class Model:
    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            z += table[b[:, f]]
        for f, g, table in self.pairs:
            z += table[b[:, f], b[:, g]]
        return 1 / (1 + np.exp(-z))


def step(g: np.ndarray, h: np.ndarray, depth: int, ridge: float = 1.0) -> np.ndarray:
    """A tree over consecutive bins: each bin's Newton step, of gradients and curvatures summed by bin."""
    out = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth == 0 or len(g) < 2:
        return out
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = cg**2 / (ch + ridge) + (g.sum() - cg) ** 2 / (h.sum() - ch + ridge)
    k = int(gain.argmax()) + 1
    return np.concatenate([step(g[:k], h[:k], depth - 1), step(g[k:], h[k:], depth - 1)])


def step2(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree over a pair's bins: the best cut of the rows, then of the columns on either side."""
    best, out = -np.inf, None
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        ca, cb = np.cumsum(a.sum(1))[:-1], np.cumsum(b.sum(1))[:-1]
        gain = ca**2 / (cb + 1) + (a.sum() - ca) ** 2 / (b.sum() - cb + 1)
        k = int(gain.argmax()) + 1 if len(gain) else a.shape[0]
        parts = [np.broadcast_to(step(p.sum(0), q.sum(0), 1), p.shape) for p, q in ((a[:k], b[:k]), (a[k:], b[k:])) if len(p)]
        table = np.concatenate(parts)
        worth = float((table * a - table**2 * b / 2).sum())
        if worth > best:
            best, out = worth, table.T if flip else table
    return np.ascontiguousarray(out)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """x: rows of features; y: 0 or 1. With no rows, or of one class only, a constant."""
    if not len(y):
        return Model(0.0, [np.zeros(0)] * len(NAMES), [np.zeros(1)] * len(NAMES), [])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    mean = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(mean / (1 - mean))), cuts, [np.zeros(len(c) + 1) for c in cuts], [])
    bins, z = model.bins(x), np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, table in enumerate(model.tables):
            grad, hess = slopes()
            add = RATE * step(*(np.bincount(bins[:, f], v, len(table)) for v in (grad, hess)), depth=2)
            table += add
            z += add[bins[:, f]]
    grad, hess = slopes()

    def two_way(f: int, g: int, v: np.ndarray) -> np.ndarray:
        rows, cols = len(cuts[f]) + 1, len(cuts[g]) + 1
        return np.bincount(bins[:, f] * cols + bins[:, g], v, rows * cols).reshape(rows, cols)

    def worth(f: int, g: int) -> float:
        a, b = two_way(f, g, grad), two_way(f, g, hess)
        t = step2(a, b)
        return float((t * a - t**2 * b / 2).sum())

    every = sorted(((worth(f, g), f, g) for f in range(x.shape[1]) for g in range(f)), reverse=True)[:PAIRS]
    model.pairs.extend((f, g, np.zeros((len(cuts[f]) + 1, len(cuts[g]) + 1))) for _, f, g in every)
    for _ in range(ROUNDS // 2):
        for f, g, table in model.pairs:
            grad, hess = slopes()
            add = RATE * step2(two_way(f, g, grad), two_way(f, g, hess))
            table += add
            z += add[bins[:, f], bins[:, g]]
    return model


def features_series(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts])


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of labels.quality from rows that aren't held out."""
    own = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("label"))
    part = min(1.0, rows / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)))
    # the sample has about `rows` rows at any size of the tables, so that this broadcast is bounded; of rows that repeat
    # a doc_id one is taken, so that what comes back is bounded too
    sample = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sample = sample.select("doc_id", "label", F.pandas_udf(features_series, "array<double>")(F.col("text")).alias("x"))
    got = sorted((r["doc_id"], r["label"], tuple(r["x"])) for r in sample.collect())
    return fit(np.array([r[2] for r in got]).reshape(-1, len(NAMES)), np.array([r[1] for r in got], float))


def with_score(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a column `score`, which may not be there already."""
    if score in docs.columns:
        raise ValueError(f"column {score} is there already; give another name")

    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(model.scores(np.array([features(t) for t in texts]).reshape(-1, len(NAMES))))

    return docs.withColumn(score, F.pandas_udf(scores, "double")(F.col(text)))


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Documents of a score of at least cut. All columns stay as they are."""
    (name,) = common.fresh(docs, "quality_score")
    return with_score(docs, train(docs, labels), score=name).where(F.col(name) >= cut).drop(name)
