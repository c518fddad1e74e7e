"""Exact nearest vectors by a metric index.

Centroids are fitted on a bounded sample; every row belongs to its nearest one and keeps its distance from it. The rows of a group and
cluster, numbered by that distance, make shells of at most `slot` rows, each with its least and largest distance. By the triangle inequality
no row of a shell is nearer to a query than the gap between the query's distance from the centroid and the shell's
range. A query first visits shells in order of that bound until they hold k rows; their k-th distance then is a limit, and only shells
whose bound is within it are visited as well, in each only the rows whose own distance is. So nothing is missed, whatever the centroids.

A shell is the unit of work: its rows are shuffled once for each of the two rounds, however many queries ask, and followed by the queries that
visit it, which stream past. Groups, clusters and hot vectors of any size are many shells. What grows with queries is the number of visits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import tables
from . import numbering

#: Rows of the sample that centroids are fitted on, centroids at most, rows of a shell.
SAMPLE, CLUSTERS, SLOT = 8192, 256, 4096


def centroids_of(vectors: np.ndarray, many: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from rows that each lie farthest from those chosen before, so copies of one vector give one centroid; a centroid
    without rows stays where it is."""
    if not len(vectors):
        return np.zeros((1, 1))
    chosen, far = [0], distances(vectors, vectors[0])
    while len(chosen) < many and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(vectors, vectors[chosen[-1]]))
    out = vectors[chosen].copy()
    for _ in range(rounds):
        own = nearest_centroid(vectors, out)[0]
        count = np.bincount(own, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, own, vectors)
        out[count > 0] = sums[count > 0] / count[count > 0, None]
    return out


def distances(vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows from one vector."""
    return np.sqrt(np.square(vectors - to).sum(axis=1))


def nearest_centroid(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    products = np.square(centroids).sum(axis=1)[None, :] - 2 * vectors @ centroids.T
    own = products.argmin(axis=1)
    return own, np.sqrt(np.square(vectors - centroids[own]).sum(axis=1))


def stacked(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64)


@dataclass(frozen=True)
class VectorIndex:
    """rows (by..., tie, embedding, cluster, dist, slot); shells (by..., cluster, slot, rows, lo, hi)."""

    rows: DataFrame
    shells: DataFrame
    centroids: np.ndarray
    by: tuple[str, ...]
    tie: str


def build(df: DataFrame, by: tuple[str, ...], tie: str, clusters: int | None = None, slot: int = SLOT) -> VectorIndex:
    """Rows without a vector are left out; all vectors have one width, and `tie` names a row within its group."""
    rows = df.where(F.col("embedding").isNotNull()).select(*by, tie, "embedding")
    sample = [r[0] for r in rows.select("embedding", F.xxhash64(*by, tie).alias("h")).orderBy("h").limit(SAMPLE).collect()]
    vectors = np.array(sample, np.float64) if sample else np.zeros((0, 1))
    centroids = centroids_of(vectors, clusters or min(CLUSTERS, max(1, int(np.sqrt(rows.count()) / 8))))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                own, dist = nearest_centroid(stacked(b["embedding"]), centroids)
                yield b.assign(cluster=own.astype(np.int32), dist=dist)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*by, tie, "embedding")), "cluster int, dist double"])
    held = numbering.numbered(rows.mapInPandas(assign, schema), [*by, "cluster"], ["dist", tie], "slot").withColumn("slot", F.floor(F.col("slot") / slot))
    shells = held.groupBy(*by, "cluster", "slot").agg(F.count("*").alias("rows"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    return VectorIndex(held, tables.written(shells, "vector-shells"), centroids, by, tie)


def bounded(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, by..., cluster, slot, rows, from_centroid, bound, at_once): every shell by the bound of each query."""

    centroids = index.centroids
    many = len(centroids)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                far = np.sqrt(np.square(stacked(b["query"])[:, None, :] - centroids[None]).sum(axis=2))
                yield pd.DataFrame({"query_id": np.repeat(b["query_id"].to_numpy(), many), "cluster": np.tile(np.arange(many, dtype=np.int32), len(b)), "from_centroid": far.reshape(-1)})

    kind = dict(queries.dtypes)["query_id"]
    measured = queries.select("query_id", "query").mapInPandas(measure, f"query_id {kind}, cluster int, from_centroid double")
    at = F.col("from_centroid")
    both = measured.join(index.shells, "cluster").withColumn("bound", F.greatest(F.lit(0.0), at - F.col("hi"), F.col("lo") - at))
    before = W.partitionBy("query_id", *index.by).orderBy("bound", "from_centroid", "slot").rowsBetween(W.unboundedPreceding, -1)
    return both.withColumn("at_once", F.coalesce(F.sum("rows").over(before), F.lit(0)) < k).select("query_id", *index.by, "cluster", "slot", "rows", "from_centroid", "bound", "at_once")


def reach(limit: np.ndarray | float, at: np.ndarray | float) -> np.ndarray | float:
    """A distance and a little more, for what rounding may have taken from a bound."""
    return limit * (1 + 1e-9) + 1e-9 * (1 + at)


def nearest_in(e: np.ndarray, norms: np.ndarray, dist: np.ndarray, names: pd.Series, asks: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """Of each query that visits a shell the rows that may be among its k nearest: all up to the k-th distance, with ties."""
    found, numbers, near, alike = [], [], [], []
    for number, q, at, limit in zip(asks["query_id"], asks["vector"], asks["from_centroid"], asks["limit"], strict=True):
        q = np.asarray(q, np.float64)
        span = reach(limit, at)
        a, b = np.searchsorted(dist, at - span, "left"), np.searchsorted(dist, at + span, "right")
        d = np.square(e[a:b] - q).sum(axis=1)
        kept = np.arange(len(d)) if len(d) <= k else np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        if len(kept):
            found.append(a + kept)
            numbers.append(np.full(len(kept), number))
            near.append(d[kept])
            alike.append(e[a + kept] @ q / (norms[a + kept] * (np.sqrt(q @ q) or 1.0)))
    if found:
        yield pd.DataFrame({"name": names.iloc[np.concatenate(found)].to_numpy(), "query_id": np.concatenate(numbers), "distance": np.concatenate(near), "cosine": np.concatenate(alike)})


def visited(index: VectorIndex, visits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, by..., tie, distance, cosine) from visits (query_id, by..., cluster, slot, from_centroid, limit)."""
    key = [*index.by, "cluster", "slot"]
    kinds = dict(index.rows.dtypes)
    number = dict(queries.dtypes)["query_id"]
    none = lambda kind: F.lit(None).cast(kind)
    asks = visits.join(queries.select("query_id", F.col("query").alias("vector")), "query_id")
    asks = asks.select(*key, F.lit(True).alias("asks"), none(kinds[index.tie]).alias("name"), "query_id", "vector", "from_centroid", "limit")
    rows = index.rows.select(*key, F.lit(False).alias("asks"), F.col(index.tie).alias("name"), none(number).alias("query_id"), F.col("embedding").alias("vector"), F.col("dist").alias("from_centroid"), F.lit(0.0).alias("limit"))
    both = rows.unionByName(asks).repartition(*key).sortWithinPartitions(*key, "asks", "from_centroid")
    by = list(index.by)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        parts: list[pd.DataFrame] = []
        shell: tuple | None = None
        for batch in batches:
            for own, group in batch.groupby(key, sort=False, dropna=False):
                own = tuple("" if pd.isna(x) else x for x in own) + tuple(pd.isna(x) for x in own)
                if own != now:
                    now, parts, shell = own, [], None
                asking = group["asks"].to_numpy(bool)
                if not asking.all():
                    parts.append(group[~asking])
                if asking.any() and parts:
                    if shell is None:
                        held = pd.concat(parts)
                        e = stacked(held["vector"])
                        norms = np.sqrt(np.square(e).sum(axis=1))
                        shell = (e, np.where(norms == 0, 1.0, norms), held["from_centroid"].to_numpy(), held["name"])
                    for found in nearest_in(*shell, group[asking], k):
                        yield found.assign(**{c: group[c].iloc[0] for c in by})[["query_id", *by, "name", "distance", "cosine"]]

    schema = ", ".join([f"query_id {number}", *(f"`{c}` {kinds[c]}" for c in by), f"name {kinds[index.tie]}", "distance double, cosine double"])
    return both.mapInPandas(look, schema).withColumnRenamed("name", index.tie)


def best(found: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("query_id", *index.by).orderBy("distance", index.tie))
    return found.withColumn("local_rank", place).where(F.col("local_rank") <= k)


def second_visits(index: VectorIndex, bounds: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """Visits of the second round: shells not yet seen whose bound is within the k-th distance found so far."""
    limits = best(first, index, k).groupBy("query_id", *index.by).agg(F.count("*").alias("many"), F.max("distance").alias("most"))
    limits = limits.select("query_id", *(F.col(c).alias(f"_{c}") for c in index.by), F.when(F.col("many") >= k, F.sqrt("most")).otherwise(F.lit(float("inf"))).alias("limit"))
    limits = limits.withColumnRenamed("query_id", "_query_id")
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("query_id", *index.by)))
    rest = bounds.where("not at_once").join(limits, same).where(F.col("bound") <= reach(F.col("limit"), F.col("from_centroid")))
    return rest.select(*bounds.columns, "limit")


def nearest(index: VectorIndex, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k nearest rows (query_id, by..., tie, distance, cosine, local_rank) of each query (query_id, query) and group, and
    the visits (query_id, by..., cluster, slot, rows...) that found them."""
    queries = queries.where(F.col("query").isNotNull())
    bounds = tables.written(bounded(index, queries, k), "vector-bounds")
    once = bounds.where("at_once").withColumn("limit", F.lit(float("inf")))
    first = tables.written(visited(index, once, queries, k), "vector-first")
    again = second_visits(index, bounds, first, k)
    found = best(first.unionByName(visited(index, again, queries, k)), index, k)
    return found, once.unionByName(again)
