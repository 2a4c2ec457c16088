"""Approximate nearest neighbours on low-dimensional stable projections.

Vectors are projected to a few dimensions by Gaussian (2-stable) directions.
For a pair at distance d the squared projected distance over d squared follows
a chi-square law with as many degrees of freedom as there are projections.
The projected vectors of each block of the table are indexed by a kd-tree.
A query takes projected neighbours in ascending order of projected distance
and verifies each in the original space; it stops when the chi-square law says
that a vector nearer than the k-th best would, with probability `sure`, have
appeared by now: chi2cdf(r^2 / best_k^2) >= sure, r being the projected
distance reached.

Queries are a stated part of the table. They are dealt in bounded chunks to
every block (queries against all rows, in blocks); each block gives at most k
rows per query, and the best k over the blocks remain. Every vector is indexed.

Contract: vectors that are null, zero, of another length than the most usual
one, or that hold null or non-finite components take no part. A null id takes
no part. Rows that repeat an id are candidates each, but never for a query of
that id; of different vectors of one id, the first in the order of their components
is its query. Ties in distance go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUT = "query_id bigint, vec_id bigint, score double"
LEAF = 128


def chi2_cdf(x: float, m: int) -> float:
    """Regularised lower incomplete gamma P(m/2, x/2) by its series."""
    a, z = m / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-15 and n < 10_000:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, m: int) -> float:
    low, high = 0.0, 10.0 * m + 100
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, m) < p else (low, mid)
    return high


def directions(dim: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


class KdTree:
    """Median splits on the widest side; leaves are ranges of one permutation, each with its box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.order = np.arange(len(points))
        self.leaves: list[tuple[int, int]] = []
        todo = [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                self.leaves.append((a, b))
                continue
            own = points[self.order[a:b]]
            axis = int(np.argmax(np.ptp(own, axis=0)))
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
            todo += [(a + mid, b), (a, a + mid)]
        sorted_points = points[self.order]
        self.low = np.array([sorted_points[a:b].min(0) for a, b in self.leaves])
        self.high = np.array([sorted_points[a:b].max(0) for a, b in self.leaves])

    def nearest(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Batches of points in ascending order of leaf distance: (next bound, rows, squared projected distances).

        No point that is still to come lies nearer than the bound.
        """
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        bound = np.einsum("ij,ij->i", gap, gap)
        by = np.argsort(bound, kind="stable")
        for k, leaf in enumerate(by.tolist()):
            a, b = self.leaves[leaf]
            rows = self.order[a:b]
            off = self.points[rows] - q
            yield float(bound[by[k + 1]]) if k + 1 < len(by) else math.inf, rows, np.einsum("ij,ij->i", off, off)


def search(tree: KdTree, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, projected: np.ndarray, k: int, stop: float) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest found: verified in the original space until the stopping test holds.

    stop: the chi-square quantile; the test is r^2 >= stop * best_k^2.
    """
    best, found, wait_rows, wait_far = np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for bound, rows, far in tree.nearest(projected):
        # points of opened leaves that lie beyond the bound wait for their turn
        rows, far = np.append(wait_rows, rows), np.append(wait_far, far)
        limit = stop * best[k - 1] ** 2 if len(best) >= k else math.inf
        due = far <= min(bound, limit)
        wait_rows, wait_far = rows[~due], far[~due]
        own = rows[due]
        own = own[ids[own] != query_id]
        if len(own):
            off = vectors[own] - query
            best, found = np.append(best, np.sqrt(np.einsum("ij,ij->i", off, off))), np.append(found, own)
            keep = np.lexsort((ids[found], best))[:k]
            best, found = best[keep], found[keep]
        if len(best) >= k and bound >= stop * best[k - 1] ** 2 and not (wait_far < stop * best[k - 1] ** 2).any():
            break
    return ids[found], best


def _search_blocks(k: int, stop: float, axes: np.ndarray):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        arrays = []
        for t in (left, right):
            v = t.column("v").combine_chunks()
            arrays.append((t.column("vec_id").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)))
        (ids, vectors), (query_ids, queries) = arrays
        tree = KdTree(vectors @ axes)
        out = [search(tree, vectors, ids, q, i, p, k, stop) for i, q, p in zip(query_ids.tolist(), queries, queries @ axes, strict=True)]
        n = [len(x[0]) for x in out]
        return pa.table({"query_id": pa.array(np.repeat(query_ids, n)), "vec_id": pa.array(np.concatenate([x[0] for x in out])), "score": pa.array(np.concatenate([x[1] for x in out]))})

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (doubles) of the vectors that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ok)
    length = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    return good.filter(F.size("v") == (length[0]["dim"] if length else 0))


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10, projections: int = 16, sure: float = 0.99, seed: int = 7, block_rows: int = 16384, query_rows: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`.

    A task holds one block of vectors and one chunk of queries, both bounded.
    """
    good = usable(vectors, id_col, vector_col)
    shape = good.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    blocks, chunks = max(1, -(-shape["n"] // block_rows)), max(1, -(-shape["q"] // query_rows))
    axes = directions(shape["dim"] or 1, projections, seed)
    # rows are dealt evenly, whatever their ids
    spread = F.xxhash64(F.col("vec_id"), F.col("v"))
    base = good.withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int"))
    queries = good.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    dealt = queries.withColumn("chunk", F.pmod(spread, F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    base = base.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    near = base.groupBy("block", "chunk").cogroup(dealt.groupBy("block", "chunk")).applyInArrow(_search_blocks(k, chi2_quantile(sure, projections), axes), OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
