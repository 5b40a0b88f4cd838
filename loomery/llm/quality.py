"""Quality by co-training two views of a document: its text and its metadata.

Each view has a logistic classifier.  In every round each view scores all
documents without a label and labels those that it is surest of; these join
the training rows of the other view.  Both are then calibrated on held-out
labels and joined by a logistic regression of the two calibrated scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import lower_ascii, mix64, prefix_hash, span_hash, text_slices, word_spans
from .repetition import per_row, repeated
from .shared import drop_materialized, materialize, small_side

#: Hashed slots of each metadata text column, and of the words of a text.
SLOTS, WORD_SLOTS = 64, 256
#: Columns of the text view: its words and 15 measures of its making.
TEXT_WIDTH = WORD_SLOTS + 15
TEXT_COLUMNS = ("source", "lang")
#: Columns of the metadata view: its text columns and two of the length.
METADATA_WIDTH = len(TEXT_COLUMNS) * SLOTS + 2
#: Rows that a Newton step standardises at once, so that a fit holds its sample once.
FIT_ROWS = 1024
#: Logit from which a view may label a document: a probability of 0.95.
SURE = math.log(19)


def text_view(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which words each text holds, as shares of hashed slots, and what its bytes say of its making; one row per text.

    The text's length is left to the metadata view.
    """
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)

    def share(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask)])
        return (upto[offsets[1:]] - upto[offsets[:-1]]) / size

    start, end, row = word_spans(buf, offsets)
    words = np.bincount(row, minlength=n)
    some = np.maximum(words, 1).astype(np.float64)
    keys = mix64(span_hash(prefix_hash(buf), start, end))
    own = per_row(keys, row)
    _, first = np.unique(own, return_index=True)
    distinct = np.bincount(row[first], minlength=n) / some
    same = np.zeros(len(keys), dtype=bool)
    if len(keys) > 1:
        same[1:] = own[1:] == own[:-1]
    thrice = np.zeros(len(keys), dtype=bool)
    if len(keys) > 2:
        step = np.uint64(0xD1342543DE82EF95)
        whole = row[:-2] == row[2:]
        window = per_row((keys[:-2] * step + keys[1:-1]) * step + keys[2:], row[:-2])
        thrice[:-2][whole] = repeated(window[whole])
    last = buf[end - 1] if len(end) else np.zeros(0, dtype=np.uint8)
    upper, lower = (buf >= 65) & (buf <= 90), (buf >= 97) & (buf <= 122)
    symbol = np.isin(buf, np.frombuffer(b"#*$%&|<>@^~=+{}[]\\/_", dtype=np.uint8))
    shout = upper[start] & upper[np.minimum(start + 1, np.maximum(len(buf) - 1, 0))] if len(start) else np.zeros(0, dtype=bool)
    lines = share(buf == 10) * size + 1
    mean = lambda mask: np.bincount(row, weights=mask, minlength=n) / some
    # words as they are read: lower-cased, without a mark of ASCII at their ends
    content = prefix_hash(lower_ascii(buf))
    mark = np.isin(buf, np.frombuffer(b",.!?;:\"'()", dtype=np.uint8)) if len(buf) else np.zeros(1, dtype=bool)
    stop = end - (mark[end - 1] & (end - start > 1)) if len(end) else end
    slot = (mix64(span_hash(content, start, stop)) % np.uint64(WORD_SLOTS)).astype(np.int64)
    held = np.bincount(row * WORD_SLOTS + slot, minlength=n * WORD_SLOTS).reshape(n, WORD_SLOTS)
    measures = np.stack(
        [
            distinct, mean(same), mean(thrice), mean(np.minimum(end - start, 40)) / 10, mean(shout), mean((last == 33) | (last == 63)), mean((last == 46) | (last == 44)),
            mean(symbol[end - 1]) if len(end) else np.zeros(n), share(upper), share(lower), share((buf >= 48) & (buf <= 57)), share(symbol), share(buf >= 128), np.minimum(some / lines, 200) / 50,
            (words == 0).astype(np.float64),
        ],
        axis=1,
    )
    return np.hstack([np.sqrt(held / some[:, None]), measures])


def metadata_view(batch: pa.RecordBatch) -> np.ndarray:
    """Hashed ``source`` and ``lang`` and the stated length; columns that are missing or null add nothing."""
    n, parts = batch.num_rows, []
    for name in TEXT_COLUMNS:
        block = np.zeros((n, SLOTS))
        if name in batch.schema.names:
            column = batch.column(name)
            known = ~np.asarray(column.is_null())
            at = 0
            for first, buf, offsets in text_slices(column.cast(pa.string())):
                slot = mix64(span_hash(prefix_hash(buf), offsets[:-1], offsets[1:])) % np.uint64(SLOTS)
                rows = np.arange(first, first + len(slot))
                block[rows[known[rows]], slot[known[rows]].astype(np.int64)] = 1
                at += len(slot)
        parts.append(block)
    chars = np.zeros(n)
    if "n_chars" in batch.schema.names:
        chars = np.nan_to_num(batch.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64))
    chars = np.log1p(np.maximum(chars, 0))
    parts.append(np.stack([chars / 10, np.maximum(0, 5 - chars) / 5], axis=1))
    return np.hstack(parts)


class Logistic:
    """L2-regularised logistic regression by Newton steps on standardised columns."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray):
        self.mean, self.scale, self.w = mean, scale, w

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 25) -> Logistic:
        parts = [slice(a, a + FIT_ROWS) for a in range(0, len(x), FIT_ROWS)]
        mean = x.mean(axis=0, dtype=np.float64)
        scale = np.sqrt(sum(((x[p] - mean) ** 2).sum(axis=0) for p in parts) / len(x))
        scale[scale < 1e-9] = 1.0
        w = np.zeros(x.shape[1] + 1)
        ridge = np.full(len(w), l2)
        ridge[-1] = 1e-3
        for _ in range(steps):
            grad, hess = ridge * w, np.diag(ridge)
            for part in parts:
                z = np.column_stack([(x[part] - mean) / scale, np.ones(len(x[part]))])
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                grad += z.T @ (p - y[part])
                hess += (z * (p * (1 - p) + 1e-6)[:, None]).T @ z
            move = np.linalg.solve(hess, grad)
            w = w - move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-9))
            if np.abs(move).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        w = self.w[:-1] / self.scale
        return np.clip(x @ w + (self.w[-1] - self.mean @ w), -30, 30)


class CoTrained:
    """Two calibrated views and the regression that joins them."""

    def __init__(self, views: list[Logistic], platt: list[Logistic], joint: Logistic):
        self.views, self.platt, self.joint = views, platt, joint

    @classmethod
    def fit(cls, labelled: list[np.ndarray], y: np.ndarray, surest: Callable[[list[Logistic], float], list[tuple[list[np.ndarray], np.ndarray]]], rounds: int = 4) -> CoTrained | None:
        """``labelled`` holds one matrix per view; None if a class is missing.

        ``surest`` takes the classifiers of a round and the share of good
        labels, and gives for each view the rows (one matrix per view) that it
        labels and these labels.
        """
        held = np.arange(len(y)) % 4 == 3
        if any(len(set(y[m])) < 2 for m in (held, ~held)):
            return None
        x = [[v[~held]] for v in labelled]
        t = [[y[~held].astype(np.float64)] for _ in labelled]
        views = [Logistic.fit(x[v][0], t[v][0]) for v in (0, 1)]
        for _ in range(rounds):
            given = surest(views, float(y.mean()))
            if not any(len(labels) for _, labels in given):
                break
            for v, (rows, labels) in enumerate(given):
                x[1 - v].append(rows[1 - v])
                t[1 - v].append(labels)
            views = [Logistic.fit(np.vstack(x[v]), np.concatenate(t[v])) for v in (0, 1)]
        truth = y[held].astype(np.float64)
        platt = [Logistic.fit(views[v].logit(labelled[v][held])[:, None], truth) for v in (0, 1)]
        scores = np.stack([platt[v].logit(views[v].logit(labelled[v][held])[:, None]) for v in (0, 1)], axis=1)
        return cls(views, platt, Logistic.fit(scores, truth))

    def scores(self, views: list[np.ndarray]) -> np.ndarray:
        """Columns: the text view's, the metadata view's and the joint probability of good quality."""
        logits = np.stack([self.platt[v].logit(self.views[v].logit(views[v])[:, None]) for v in (0, 1)], axis=1)
        return 1 / (1 + np.exp(-np.column_stack([logits, self.joint.logit(logits)])))


def _both_views(batch: pa.RecordBatch) -> list[np.ndarray]:
    text = [text_view(buf, offsets) for _, buf, offsets in text_slices(batch.column("text"))]
    return [np.vstack(text) if text else np.zeros((0, TEXT_WIDTH)), metadata_view(batch)]


def view_columns(docs: DataFrame) -> list[str]:
    return ["doc_id", "text", *(c for c in (*TEXT_COLUMNS, "n_chars") if c in docs.columns)]


def view_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, a, b): the text view and the metadata view of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel().astype(np.float32))) for m in _both_views(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], names=["doc_id", "a", "b"])

    return docs.select(*view_columns(docs)).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, a array<float>, b array<float>")


def matrices(rows: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    """The two views of rows (a, b) as matrices."""
    columns = (rows.column(c) for c in ("a", "b"))
    flat = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns)
    return [c.flatten().to_numpy().reshape(rows.num_rows, width) for c, width in zip(flat, (TEXT_WIDTH, METADATA_WIDTH), strict=True)]


class Pool:
    """All documents without a label.  Their views are written once; every round scores the whole of them in Spark.

    ``views`` is (row, doc_id, a, b) and ``known`` (doc_id, ...) the labelled
    ones, both written tables.  The driver sees only what a round adds:
    ``pseudo`` rows a view.
    """

    def __init__(self, views: DataFrame, known: DataFrame, pseudo: int):
        self.views, self.known, self.pseudo = views, known, pseudo
        self.taken: set[int] = set()

    def logits(self, models: list[Logistic]) -> DataFrame:
        """(row, doc_id, by_text, by_metadata) of the unlabelled rows."""
        held = self.views.sparkSession.sparkContext.broadcast(models)  # two bounded models

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = [pa.array(m.logit(x)) for m, x in zip(held.value, matrices(batch), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *scores], names=["row", "doc_id", "by_text", "by_metadata"])

        kind = self.views.schema["doc_id"].dataType.simpleString()
        scored = self.views.mapInArrow(run, f"row long, doc_id {kind}, by_text double, by_metadata double")
        return scored.join(small_side(self.known.select("doc_id")), "doc_id", "left_anti")

    def surest(self, models: list[Logistic], good: float) -> list[tuple[list[np.ndarray], np.ndarray]]:
        """For each view, the rows that it is surest of, in the shares of the classes, and their labels.

        Ties go by a hash of the doc_id; rows that an earlier round has used are passed over.
        """
        scored = materialize(self.logits(models), "sure")
        asked = [(v, wanted, max(1, int(self.pseudo * part))) for v in (0, 1) for wanted, part in ((1, good), (0, 1 - good))]
        lists = []
        for v, wanted, n in asked:
            sure = F.col(("by_text", "by_metadata")[v]) * (2 * wanted - 1)
            best = scored.select("row", "doc_id", sure.alias("sure")).where(F.col("sure") >= SURE).orderBy(F.desc("sure"), F.xxhash64("doc_id"), "row").limit(n + len(self.taken))
            # a list is bounded by what the rounds add in all
            lists.append([r.row for r in best.collect() if r.row not in self.taken][:n])
        drop_materialized(scored)
        rows = sorted({r for each in lists for r in each})
        self.taken.update(rows)
        held = self.views.where(F.col("row").isin(rows)).select("row", "a", "b").toArrow()
        both, ids = matrices(held), held.column("row").to_numpy()
        order = np.argsort(ids)
        at = [order[np.searchsorted(ids[order], np.array(each, dtype=np.int64))] for each in lists]
        out = []
        for v in (0, 1):
            own = np.concatenate([at[2 * v], at[2 * v + 1]])
            out.append(([m[own] for m in both], np.repeat([1.0, 0.0], [len(at[2 * v]), len(at[2 * v + 1])])))
        return out


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, rounds: int = 4, pseudo: int = 400) -> CoTrained | None:
    """Fit on at most ``max_labelled`` labelled rows, taken by hash of their ids, and the ``pseudo`` that each view adds in a round from all others."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = materialize(known, "known")
    if known.select("quality").distinct().count() < 2:
        drop_materialized(known)
        return None
    views = materialize(view_rows(docs).withColumn("row", F.monotonically_increasing_id()), "views")
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.orderBy(*by_hash).limit(max_labelled)
    # both sides are bounded by max_labelled, two numbers a row
    picked = views.select("row", "doc_id").join(F.broadcast(chosen), "doc_id").orderBy(*by_hash, "row").limit(max_labelled).select("row", "quality")
    sample = views.join(F.broadcast(picked), "row").select("row", "doc_id", "a", "b", "quality").toArrow()
    sample = sample.sort_by([("doc_id", "ascending"), ("row", "ascending")])
    order = np.random.default_rng(0).permutation(sample.num_rows)
    y = sample.column("quality").to_numpy()[order]
    labelled = [m[order] for m in matrices(sample)]
    del sample
    model = CoTrained.fit(labelled, y, Pool(views, known, pseudo).surest, rounds)
    drop_materialized(views, known)
    return model


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_labelled: int = 8000, rounds: int = 4, pseudo: int = 400) -> DataFrame:
    """Every row of ``docs`` with text_score, metadata_score, quality_score and kept.

    ``kept`` is false where the joint probability of good quality is under
    ``threshold``.  Null and empty texts are scored as such; null metadata
    adds nothing; a null doc_id stays; repeated rows are scored each on its
    own; all columns of ``docs`` stay.  Of several labels of a document the
    worst counts.  Without labels of both kinds every score is one half and
    all is kept; an empty table gives an empty result.
    """
    model = fit_quality(docs, labels, max_labelled, rounds, pseudo)
    pa.default_memory_pool().release_unused()  # what the sample took; the driver needs it later
    added = ("text_score", "metadata_score", "quality_score", "kept")
    held = docs.sparkSession.sparkContext.broadcast(model)  # a bounded model

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            scores = own.scores(_both_views(batch)) if own else np.full((batch.num_rows, 3), 0.5)
            extra = [pa.array(scores[:, 0]), pa.array(scores[:, 1]), pa.array(scores[:, 2]), pa.array(scores[:, 2] >= threshold)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *added])

    plain = docs.drop(*added)
    kinds = (T.DoubleType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*plain.schema.fields, *map(T.StructField, added, kinds)])
    return plain.mapInArrow(run, schema)
