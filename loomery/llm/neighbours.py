"""Nearest neighbours by collision counting over query-centred windows.

Each block of vectors keeps one sorted array per random projection.  A query
opens a window around its own projection in every array and counts, for each
vector, the windows that hold it.  Vectors with enough collisions are
verified with the exact measure.  The windows grow with the search radius
(virtual rehashing: no array is built anew) until the k-th best vector found
lies within the radius for which the windows were made.

The largest inner product is turned into the least distance by one more
component, sqrt(M^2 - |x|^2) with M the largest norm of the block.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width of a window in standard deviations of a projected difference at the search radius.
WINDOW = 0.8
#: How many standard deviations under its mean a true neighbour's collision count may lie.
SLACK = 0.9
#: Growth of the radius between rounds.
GROWTH = 1.06


def usable(vector: str) -> Column:
    """True for vectors that are not null, hold only finite numbers and are not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def projections(dim: int, count: int, seed: int) -> np.ndarray:
    """``count`` unit vectors of ``dim`` components, orthogonal within each run of ``dim``."""
    rng = np.random.default_rng(seed)
    parts = [np.linalg.qr(rng.standard_normal((dim, dim)))[0].T for _ in range(-(-count // dim))]
    return np.vstack(parts)[:count]


class CollisionIndex:
    """Sorted projection arrays over one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, count: int, seed: int = 7):
        self.ids, self.vectors = ids, vectors
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.top = float(norms.max(initial=0.0))
        lifted = np.hstack([vectors, np.sqrt(np.maximum(self.top - norms, 0))[:, None]])
        self.axes = projections(lifted.shape[1], count, seed)
        values = (lifted @ self.axes.T).T
        self.order = np.argsort(values, axis=1, kind="stable")
        self.values = np.take_along_axis(values, self.order, axis=1)
        self.mean = vectors.mean(axis=0) if len(vectors) else None
        self.cov = np.cov(vectors, rowvar=False).reshape(vectors.shape[1], -1) if len(vectors) > 1 else None

    def first_radii(self, queries: np.ndarray, k: int) -> np.ndarray:
        """Where the k-th neighbours would lie if inner products were normal, and a little more."""
        reach = min(max(k / len(self.ids), 1e-9), 0.5)
        t = math.sqrt(-2 * math.log(reach))
        z = t - (2.30753 + 0.27061 * t) / (1 + 0.99229 * t + 0.04481 * t * t)
        spread = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", queries, self.cov, queries, optimize=True), 0)) if self.cov is not None else 0.0
        base = np.einsum("ij,ij->i", queries, queries) + self.top
        return 1.02 * np.sqrt(np.maximum(base - 2 * (queries @ self.mean + z * spread), 1e-12))

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, positions and inner products of the k nearest found, best first.

        A row with a query's own id is not its answer.  All queries that are
        still open widen their windows together, round by round.
        """
        n, m = len(self.ids), len(self.axes)
        at = queries @ self.axes[:, :-1].T
        p = math.erf(WINDOW / math.sqrt(2))
        least = max(1, math.floor(m * p - SLACK * math.sqrt(m * p * (1 - p))))
        base, scale = np.einsum("ij,ij->i", queries, queries) + self.top, WINDOW / math.sqrt(self.axes.shape[1])
        state = [(np.zeros(n, dtype=np.int32), self.ids == i, np.zeros(0, dtype=np.int64), np.zeros(0)) for i in own]
        radius = self.first_radii(queries, k)
        active = np.arange(len(queries))
        lo = hi = np.zeros((len(queries), m), dtype=np.int64)
        first = True
        while len(active):
            half = radius[active] * scale
            left, right = lo.copy(), hi.copy()
            for j, v in enumerate(self.values):
                left[active, j] = np.searchsorted(v, at[active, j] - half, "left")
                right[active, j] = np.searchsorted(v, at[active, j] + half, "right")
            still = []
            for i in active:
                if first:
                    ring = [o[a:b] for o, a, b in zip(self.order, left[i], right[i], strict=True)]
                else:
                    ring = [o[a:b] for o, a, b in zip(self.order, left[i], lo[i], strict=True)] + [o[a:b] for o, a, b in zip(self.order, hi[i], right[i], strict=True)]
                counts, verified, found, scores = state[i]
                counts += np.bincount(np.concatenate(ring), minlength=n).astype(np.int32)
                new = np.flatnonzero((counts >= least) & ~verified)
                verified[new] = True
                found = np.concatenate([found, new])
                scores = np.concatenate([scores, self.vectors[new] @ queries[i]])
                if len(found) > k:
                    best = np.lexsort((self.ids[found], -scores))[:k]
                    found, scores = found[best], scores[best]
                state[i] = (counts, verified, found, scores)
                if not (len(found) >= k and base[i] - 2 * scores.min() <= radius[i] ** 2 or verified.all()):
                    still.append(i)
            lo, hi, first = left, right, False
            active = np.array(still, dtype=np.int64)
            radius[active] *= GROWTH
        out = []
        for _, _, found, scores in state:
            best = np.lexsort((self.ids[found], -scores))
            out.append((found[best], scores[best]))
        return out


def _found(index: CollisionIndex, asked: pa.RecordBatch, k: int, batch_queries: int) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score) of the nearest rows of one block for the queries of a batch."""
    own = asked.column("id").to_numpy()
    values = asked.column("v").flatten().to_numpy().reshape(len(own), -1)
    for at in range(0, len(own), batch_queries):
        part = slice(at, at + batch_queries)
        hits = index.search(own[part], values[part], k)
        query = np.repeat(own[part], [len(x) for x, _ in hits])
        found = np.concatenate([index.ids[x] for x, _ in hits])
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(found), pa.array(np.concatenate([s for _, s in hits]))], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, count: int = 64, block_rows: int = 8192, batch_queries: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product for each row of ``queries``.

    Returns query_id, rank (from 1), vec_id and score in double precision,
    nearest first, ties to the smaller id.  Rows with a null id, and vectors
    that are null, zero or hold null or non-finite components, take no part;
    a row with a query's own id is never its answer; repeated rows are
    answers each on its own; vectors are compared only with vectors of their
    length; an empty table of either kind gives an empty result.

    Vectors are dealt once into blocks of about ``block_rows``; only the
    queries, a stated set, are copied to the blocks.  A block's rows come
    sorted, its vectors before its queries: its arrays are built once and the
    queries stream past them, ``batch_queries`` at a time.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable("v"))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable("v"))
    blocks = max(1, -(-own.count() // block_rows))
    place = [F.size("v").alias("dim"), F.col("block"), F.col("is_query"), F.col("id"), F.col("v")]
    dealt = own.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "is_query": F.lit(False)}).select(*place)
    copied = asked.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "is_query": F.lit(True)}).select(*place)
    cells = dealt.unionByName(copied).repartition(blocks, "dim", "block").sortWithinPartitions("dim", "block", "is_query")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, index = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("dim", "block", "is_query")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if cell != tuple(keys[a, :2]):
                    cell, held, index = tuple(keys[a, :2]), [], None
                part = batch.slice(a, b - a)
                if not keys[a, 2]:
                    held.append((part.column("id").to_numpy(), part.column("v").flatten().to_numpy().reshape(b - a, -1)))
                elif held:
                    if index is None:
                        index = CollisionIndex(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), count)
                    yield from _found(index, part, k, batch_queries)

    near = cells.mapInArrow(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
