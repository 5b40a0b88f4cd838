"""Hard negatives by a vector-approximation file.

Rows are dealt to blocks.  A block keeps its vectors and, dimension by
dimension, the number of the cell that each component lies in.  For an anchor
a table gives the least and the largest product of every cell of every
dimension; a row's sums of these bound its score from below and above, and
only rows whose bounds may enter what is asked for are scored exactly: first
the best rows of the anchor's label, then the best of other labels within the
window of scores below each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize

#: Bits of a cell's number, and rows of a block.
BITS, BLOCK_ROWS = 6, 8192


class Approximations:
    """The vectors of one block, ordered by label, and the cells of their components."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        cells = 1 << BITS
        least, most = self.vectors.min(axis=0), self.vectors.max(axis=0)
        # cell c of a dimension holds the whole numbers from edges[c] to edges[c + 1] - 1
        width = -(-(most - least + 1) // cells)
        edges = least + np.arange(cells + 1)[:, None] * width
        self.low, self.high = edges[:-1], np.minimum(edges[1:] - 1, most)
        self.cells = (self.vectors - least) // width + np.arange(len(least)) * cells

    def bounds(self, anchor: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest scores that the cells of rows a to b allow."""
        one, two = anchor * self.low, anchor * self.high
        cells = self.cells[a:b]
        return tuple(f(one, two).T.ravel().take(cells).sum(axis=1) for f in (np.minimum, np.maximum))

    def own(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right"))

    def best(self, rows: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[order]], score[order]

    def positives(self, own: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the ``k`` best rows of the anchor's label but its own."""
        a, b = self.own(label)
        rows = a + np.flatnonzero(self.ids[a:b] != own)
        if len(rows) > k:
            low, high = (x[rows - a] for x in self.bounds(anchor, a, b))
            rows = rows[high >= np.partition(low, -k)[-k]]
        return self.best(rows, self.vectors[rows] @ anchor, k)

    def negatives(self, label: int, anchor: np.ndarray, tops: np.ndarray, k: int, least: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each score of ``tops`` the ``k`` best rows of other labels with least * top <= 100 * score <= most * top."""
        low, high = self.bounds(anchor, 0, len(self.ids))
        a, b = self.own(label)
        other = np.ones(len(self.ids), dtype=bool)
        other[a:b] = False
        exact = np.zeros(len(self.ids), dtype=np.int64)
        known = np.zeros(len(self.ids), dtype=bool)
        out = []
        for top in tops:
            maybe = np.flatnonzero(other & (100 * high >= least * top) & (100 * low <= most * top))
            sure = low[maybe][(100 * low[maybe] >= least * top) & (100 * high[maybe] <= most * top)]
            if len(sure) >= k:
                maybe = maybe[high[maybe] >= np.partition(sure, -k)[-k]]
            new = maybe[~known[maybe]]
            exact[new], known[new] = self.vectors[new] @ anchor, True
            score = exact[maybe]
            inside = (100 * score >= least * top) & (100 * score <= most * top)
            out.append(self.best(maybe[inside], score[inside], k))
        return out


Answer = Callable[[Approximations, dict], Iterator[tuple]]


def asked_in_blocks(rows: DataFrame, asked: DataFrame, answer: Answer, schema: str, block_rows: int) -> DataFrame:
    """``answer`` of every row of ``asked`` (id, label, v, tops) in every block of ``rows`` (id, label, v).

    A block comes sorted, its rows before what is asked, so its cells are made
    once and what is asked streams past them.
    """
    blocks = max(1, -(-rows.count() // block_rows))
    place = [F.size("v").alias("dim"), F.col("block"), F.col("is_asked"), F.col("id"), F.col("label"), F.col("v"), F.col("tops")]
    dealt = rows.withColumns({"block": F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"), "is_asked": F.lit(False), "tops": F.lit(None).cast("array<long>")}).select(*place)
    copied = asked.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "is_asked": F.lit(True)}).select(*place)
    cells = dealt.unionByName(copied).repartition(blocks, "dim", "block").sortWithinPartitions("dim", "block", "is_asked")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("dim", "block", "is_asked")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            found = []
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if cell != tuple(keys[a, :2]):
                    cell, held, block = tuple(keys[a, :2]), [], None
                part = batch.slice(a, b - a)
                own, label, v = part.column("id").to_numpy(), part.column("label").to_numpy(), part.column("v").flatten().to_numpy().reshape(b - a, -1)
                if not keys[a, 2]:
                    held.append((own, label, v))
                elif held:
                    if block is None:
                        block = Approximations(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    tops = part.column("tops").to_pylist()
                    for i in range(b - a):
                        found += answer(block, {"id": int(own[i]), "label": int(label[i]), "v": v[i], "tops": tops[i]})
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return cells.mapInArrow(run, schema)


def first(rows: DataFrame, k: int, by: list[str], score: str, row: str) -> DataFrame:
    """The ``k`` first rows for each ``by`` by falling score, ties to the smaller id, with their rank."""
    order = W.partitionBy(*by).orderBy(F.desc(score), row)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scaled(rows: DataFrame, factor: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, v) of the rows that take part: every component as floor(factor * x).

    Rows without an id or a label, and vectors that are null, without
    components, or hold null or non-finite ones, take no part.
    """
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("long"))
    return rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(v) > 0) & finite).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"))


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each row of ``anchors`` and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels in the window below.

    Both tables are (id, label, v) with whole components; a score is their
    inner product, a whole number of 64 bits.  A negative is in the window if
    least * positive_score <= 100 * negative_score <= most * positive_score.
    Ties go to the smaller id.  Returns anchor_id, positive_id, rank,
    negative_id, positive_score and negative_score.  A row with an anchor's
    own id is never its positive; repeated rows are positives and negatives
    each on its own; of several anchors of one id the least by label and
    vector is asked; vectors are compared only with vectors of their length;
    an empty table gives an empty result.
    """
    rows = materialize(rows.select("id", "label", "v"), "scaled-vectors")
    anchors = anchors.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.*")
    none = anchors.withColumn("tops", F.lit(None).cast("array<long>"))

    def near(block: Approximations, asked: dict) -> Iterator[tuple]:
        ids, scores = block.positives(asked["id"], asked["label"], asked["v"], positives)
        yield np.full(len(ids), asked["id"]), ids, scores

    def hard(block: Approximations, asked: dict) -> Iterator[tuple]:
        for top, (ids, scores) in zip(asked["tops"], block.negatives(asked["label"], asked["v"], np.array(asked["tops"], dtype=np.int64), negatives, least, most), strict=True):
            yield np.full(len(ids), asked["id"]), np.full(len(ids), top), ids, scores

    found = asked_in_blocks(rows, none, near, "anchor_id long, positive_id long, positive_score long", block_rows)
    pairs = materialize(first(found, positives, ["anchor_id"], "positive_score", "positive_id").drop("rank"), "positives")
    tops = pairs.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("tops"))
    found = asked_in_blocks(rows, anchors.join(tops, "id"), hard, "anchor_id long, positive_score long, negative_id long, negative_score long", block_rows)
    ranked = first(found, negatives, ["anchor_id", "positive_score"], "negative_score", "negative_id")
    return pairs.join(ranked, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
