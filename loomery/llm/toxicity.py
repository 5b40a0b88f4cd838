"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w.x - t[k]) with one weight vector for all thresholds
t[0] <= t[1] <= ...; the expected severity is the sum of these over k.
Features are words and the first 4, 5 and 6 bytes of longer words, lower-cased
and hashed to 64 bits, with the log of their count.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import lower_ascii, mix64, prefix_hash, span_hash, text_slices, word_spans
from .shared import materialize

STEMS = (4, 5, 6)
#: Probability of any toxicity from which a row is flagged.
FLAG = 0.4


def features(column: pa.Array, vocabulary: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bounds, feature hashes, counts): each row's distinct features, of ``vocabulary`` if given."""
    for first, buf, offsets in text_slices(column):
        n = len(offsets) - 1
        start, end, row = word_spans(buf, offsets)
        prefix = prefix_hash(lower_ascii(buf))
        # ASCII punctuation after a word is not part of its key
        stop = end
        for _ in range(2):
            last = buf[np.maximum(stop - 1, 0)] if len(buf) else stop
            mark = ((last == 44) | (last == 46) | (last == 33) | (last == 63)) & (stop > start + 1)
            stop = stop - mark
        keys, rows = [mix64(span_hash(prefix, start, stop))], [row]
        for k in STEMS:
            long = stop - start > k
            keys.append(mix64(span_hash(prefix, start[long], start[long] + k) ^ np.uint64(k)))
            rows.append(row[long])
        key, at = np.concatenate(keys), np.concatenate(rows)
        if vocabulary is not None:
            slot = np.searchsorted(vocabulary, key)
            own = vocabulary[np.minimum(slot, len(vocabulary) - 1)] == key if len(vocabulary) else np.zeros(len(key), dtype=bool)
            key, at = slot[own].astype(np.uint64), at[own]
        order = np.lexsort((key, at))
        key, at = key[order], at[order]
        head = np.ones(len(key), dtype=bool)
        if len(key):
            head[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
        where = np.flatnonzero(head)
        count = np.diff(np.append(where, len(key)))
        yield first, np.concatenate([[0], np.cumsum(np.bincount(at[head], minlength=n))]), key[head], count


def feature_rows(docs: DataFrame, label: str, vocabulary: np.ndarray | None = None) -> DataFrame:
    """(label, ids, counts) of each row of ``docs`` (text and ``label``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, bounds, key, count in features(batch.column("text"), vocabulary):
                at = pa.array(bounds.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(label).slice(first, len(bounds) - 1), pa.ListArray.from_arrays(at, pa.array(key.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(count.astype(np.int32)))],
                    names=[label, "ids", "counts"],
                )

    kind = docs.schema[label].dataType.simpleString()
    return docs.select(label, "text").mapInArrow(run, f"{label} {kind}, ids array<long>, counts array<int>")


def select_vocabulary(rows: DataFrame, positive: Column, size: int, min_rows: int = 4) -> np.ndarray:
    """The ``size`` features whose share differs most between positive and other rows, by z score."""
    n, n_pos = rows.agg(F.count("*"), F.coalesce(F.sum(positive.cast("long")), F.lit(0))).first()
    if not n or n_pos in (0, n):
        return np.zeros(0, dtype=np.uint64)
    per = rows.select(positive.cast("long").alias("pos"), F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df"), F.sum("pos").alias("hit"))
    rate = n_pos / n
    z = (F.col("hit") - F.col("df") * rate) / F.sqrt(F.col("df") * rate * (1 - rate) + F.lit(1.0))
    best = per.where(F.col("df") >= min_rows).select("id", F.abs(z).alias("z")).where("z > 2.5").orderBy(F.desc("z"), "id").limit(size)
    return np.sort(np.array([r.id for r in best.collect()], dtype=np.int64).view(np.uint64))


class OrdinalRegression:
    """Cumulative-link model on sparse rows; fitted by AdaGrad on a bounded sample."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, bounds: np.ndarray, ids: np.ndarray, values: np.ndarray, grade: np.ndarray, size: int, l2: float = 0.2, steps: int = 500) -> OrdinalRegression:
        n, levels = len(grade), int(grade.max(initial=0))
        w = np.zeros(size)
        above = np.stack([grade > k for k in range(max(levels, 1))], axis=1).astype(np.float64)
        share = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3) if n else np.full(1, 1e-3)
        t = np.maximum.accumulate(np.log((1 - share) / share))
        row = np.repeat(np.arange(n), np.diff(bounds))
        gw, gt = np.full(size, 1e-6), np.full(len(t), 1e-6)
        for _ in range(steps if n else 0):
            x = np.bincount(row, weights=values * w[ids], minlength=n)
            off = 1 / (1 + np.exp(-np.clip(x[:, None] - t, -30, 30))) - above
            dw = np.bincount(ids, weights=values * off.sum(axis=1)[row], minlength=size) + l2 * w
            dt = -off.sum(axis=0)
            gw += dw * dw
            gt += dt * dt
            w -= 0.3 * dw / np.sqrt(gw)
            t = np.maximum.accumulate(t - 0.3 * dt / np.sqrt(gt))
        return cls(w, t)

    def above(self, bounds: np.ndarray, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold k."""
        x = np.bincount(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), weights=values * self.weights[ids], minlength=len(bounds) - 1)
        return 1 / (1 + np.exp(-np.clip(x[:, None] - self.thresholds, -30, 30)))


def graded_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): ``toxic`` as an ordered grade from 0, the worst of a document's; rows without a grade or doc_id are left out."""
    return labels.where((F.col("toxic") >= 0) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("grade"))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """The texts of at most ``limit`` labelled documents, by hash of their ids."""
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # at most ``limit`` rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit_severity(docs: DataFrame, labels: DataFrame, max_labelled: int = 30_000, max_features: int = 8192) -> tuple[np.ndarray, OrdinalRegression]:
    """Vocabulary and model from a bounded sample of labelled documents (doc_id, grade).

    The grades are those of the labels: one threshold for each grade above 0,
    so 0/1 labels give one and a finer scale as many as it has steps.  What
    is gathered is bounded by ``max_labelled`` rows of at most
    ``max_features`` features.
    """
    sample = materialize(labelled_sample(docs, labels, max_labelled), "toxicity-sample")
    vocabulary = select_vocabulary(feature_rows(sample, "grade"), F.col("grade") > 0, max_features)
    rows = feature_rows(sample, "grade", vocabulary).toPandas()
    counts = [len(x) for x in rows["ids"]]
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    ids = np.concatenate([*rows["ids"], np.zeros(0)]).astype(np.int64)
    values = np.log1p(np.concatenate([*rows["counts"], np.zeros(0)]).astype(np.float64))
    return vocabulary, OrdinalRegression.fit(bounds, ids, values, rows["grade"].to_numpy(dtype=np.int64), len(vocabulary))


def score_severity(docs: DataFrame, vocabulary: np.ndarray, model: OrdinalRegression) -> DataFrame:
    """doc_id, expected_severity, severity (the likeliest grade) and is_toxic for every row."""
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, model.weights, model.thresholds))  # a bounded model

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights, thresholds = held.value
        own = OrdinalRegression(weights, thresholds)
        for batch in batches:
            for first, bounds, ids, count in features(batch.column("text"), words):
                p = own.above(bounds, ids.astype(np.int64), np.log1p(count))
                grade = np.diff(np.hstack([np.ones((len(p), 1)), p, np.zeros((len(p), 1))]) * -1, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(p)), pa.array(p.sum(axis=1)), pa.array(grade.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] >= FLAG)],
                    names=["doc_id", "expected_severity", "severity", "is_toxic"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_severity double, severity int, is_toxic boolean")


def grade_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 30_000, max_features: int = 8192) -> DataFrame:
    """Fit on ``labels`` (doc_id, toxic) and grade every row of ``docs`` (doc_id, text).

    ``toxic`` is 0 for clean and 1, 2, ... for ordered grades.  A null or empty text has no features and gets the prior; a null doc_id
    stays; repeated rows are graded each on its own; other columns are left
    out.  Of several labels of one document the worst counts.  Without
    labels of both kinds nothing is graded toxic; an empty table of documents
    gives an empty result.
    """
    vocabulary, model = fit_severity(docs, graded_labels(labels), max_labelled, max_features)
    return score_severity(docs, vocabulary, model)
