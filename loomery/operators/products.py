"""Scores of all pairs of two sides of vectors, by blocks of either side that meet in tasks.

Either side is dealt by hash and copied to the blocks of the other, so a task
has a bounded block of both.  In it, a matrix product finds the pairs that can
count, whose scores are then computed anew, term by term, as SQL does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of a block of either side, least rows worth a block, and rows of either side in one matrix product.
ROWS, LEAST, TILE = 16_384, 2_048, (1_024, 4_096)
#: What rounding may change in a rank; scores are ranked by nine digits.
MARGIN = 3e-9


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in double precision, which of them are whole); a row that is null or holds one is 0."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    width = max(0, int(size.max(initial=0)))
    whole = size == width
    values = lists.filter(pa.array(whole)).flatten()
    flat = pc.fill_null(values.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.zeros((int(whole.sum()), 0))
    out = np.zeros((len(size), width))
    out[whole] = flat
    if values.null_count:
        broken = values.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).any(axis=1)
        at = np.flatnonzero(whole)[broken]
        whole[at], out[at] = False, 0.0
    return out, whole


def dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows ``i`` of one and ``j`` of the other, summed from the first component on."""
    out = np.zeros(len(i))
    for d in range(a.shape[1]):
        out += a[i, d] * b[j, d]
    return out


def dealt(left: DataFrame, right: DataFrame, by: tuple[str, ...], keys: tuple[Column, Column], sizes: tuple[int, int], most: int = ROWS):
    """Both sides grouped for cogroup by ``by`` and a grid of blocks; ``sizes`` are the rows of the largest group of either."""
    workers = left.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-sizes[0] // ROWS), min(workers, sizes[0] // LEAST))
    m = max(1, -(-sizes[1] // most))
    own = lambda key, parts: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    grid = [*by, "block_a", "block_b"]
    a = left.withColumn("block_a", own(keys[0], n)).withColumn("block_b", every(m))
    b = right.withColumn("block_b", own(keys[1], m)).withColumn("block_a", every(n))
    tasks = max(n * m, workers)
    return a.repartition(tasks, *grid).groupBy(*grid), b.repartition(tasks, *grid).groupBy(*grid)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = ROWS) -> DataFrame:
    """(query_id, id, score): cosines of at least the ``k`` best of each query; both sides are (id, v).

    A row's own id is left out.  The order is that of scores rounded to nine
    digits, then of ids; a cosine that is no number comes first, one of a null
    vector is null and comes last, as in SQL.
    """

    def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asked = left.column("id").to_numpy(), right.column("id").to_numpy()
        (v, v_whole), (q, q_whole) = matrix(left.column("v")), matrix(right.column("v"))
        if v.shape[1] != q.shape[1]:  # one side has only nulls here
            v, q = (x if x.shape[1] else np.zeros((len(x), max(v.shape[1], q.shape[1]))) for x in (v, q))
        every = lambda x: np.arange(len(x))
        v_norm, q_norm = (np.sqrt(dots(x, x, every(x), every(x))) for x in (v, q))
        found = []
        with np.errstate(all="ignore"):
            unit_v, unit_q = v / v_norm[:, None], q / q_norm[:, None]
            for a in range(0, len(asked), TILE[0]):
                some = slice(a, a + TILE[0])
                size = len(asked[some])
                bar = np.full(size, -np.inf)
                held = [np.zeros(0, dtype=np.int64)] * 2 + [np.zeros(0)]
                for b in range(0, len(ids), TILE[1]):
                    near = unit_q[some] @ unit_v[b : b + TILE[1]].T
                    near[np.isnan(near)] = np.inf
                    near[:, ~v_whole[b : b + TILE[1]]] = -np.inf
                    near[~q_whole[some]] = -np.inf
                    twins = np.flatnonzero(np.isin(ids[b : b + TILE[1]], asked[some]))
                    near[:, twins] = np.where(asked[some][:, None] == ids[b + twins], -np.inf, near[:, twins])
                    if near.shape[1] > k and not np.isfinite(bar).any():
                        bar = np.maximum(bar, np.partition(near, -k, axis=1)[:, -k] - MARGIN)
                    i, j = np.nonzero(near >= bar[:, None])
                    other = asked[a + i] != ids[b + j]
                    i, j = i[other], b + j[other]
                    score = dots(q, v, a + i, j) / q_norm[a + i] / v_norm[j]
                    rank = np.where(np.isnan(score), np.inf, np.round(score, 9))
                    rank = np.where(v_whole[j] & q_whole[a + i], rank, -np.inf)
                    i, j, rank = (np.concatenate(x) for x in zip(held, (i, j, rank), strict=True))
                    order = np.lexsort((ids[j], -rank, i))
                    i, j, rank = i[order], j[order], rank[order]
                    place = np.arange(len(i)) - np.searchsorted(i, i)
                    kept = place < k
                    last = place == k - 1
                    bar[i[last]] = rank[last] - MARGIN
                    held = [i[kept], j[kept], rank[kept]]
                found.append((a + held[0], held[1]))
            i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 2
            score = dots(q, v, i, j) / q_norm[i] / v_norm[j]
        return pa.table({"query_id": right.column("id").take(pa.array(i)), "id": left.column("id").take(pa.array(j)), "score": pa.array(score, mask=~(v_whole[j] & q_whole[i]))})

    sizes = vectors.count(), queries.count()
    a, b = dealt(vectors, queries, (), (F.col("id"), F.col("id")), sizes, min(block, ROWS))
    kinds = queries.schema["id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    return a.cogroup(b).applyInArrow(best, f"query_id {kinds[0]}, id {kinds[1]}, score double")


def largest(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """(pos, source_doc, similarity): the largest inner product of a row (pos, source_doc, vector) with its source's (source_doc, vector); no row without one."""

    def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (v, v_whole), (w, w_whole) = matrix(left.column("vector")), matrix(right.column("vector"))
        rows, w = np.flatnonzero(v_whole), w[w_whole]
        if not len(w) or not len(rows):
            return left.select(["pos", "source_doc"]).slice(0, 0).append_column("similarity", pa.array([], pa.float64()))
        top, at = np.full(len(rows), -np.inf), np.zeros(len(rows), dtype=np.int64)
        for a in range(0, len(rows), TILE[0]):
            for b in range(0, len(w), TILE[1]):
                near = v[rows[a : a + TILE[0]]] @ w[b : b + TILE[1]].T
                near[np.isnan(near)] = np.inf
                place = near.argmax(axis=1)
                value = near[np.arange(len(place)), place]
                more = value > top[a : a + TILE[0]]
                top[a : a + TILE[0]][more], at[a : a + TILE[0]][more] = value[more], b + place[more]
        return left.select(["pos", "source_doc"]).take(pa.array(rows)).append_column("similarity", pa.array(dots(v, w, rows, at)))

    # equal vectors of a source give the same products
    sources = sources.where("source_doc is not null and vector is not null").distinct()
    pairs = pairs.where("source_doc is not null")
    size = lambda rows: rows.groupBy("source_doc").count().agg(F.max("count")).first()[0] or 0
    a, b = dealt(pairs, sources, ("source_doc",), (F.col("pos"), F.col("vector")), (size(pairs), size(sources)))
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("pos", "source_doc"))
    return a.cogroup(b).applyInArrow(best, f"{kinds}, similarity double").groupBy("pos", "source_doc").agg(F.max("similarity").alias("similarity"))
