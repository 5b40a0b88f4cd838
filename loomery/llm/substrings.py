"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are told apart only by their first ``threshold`` bytes, most
significant digit first, and a group of one leaves the sort at once:

1. the first digit of a suffix is the least gram (by hash) of its window, its
   anchor; equal windows have equal anchors at equal distances, so one row
   for each anchor stands for all suffixes that share it, and anchors whose
   windows are all found again are settled as repeated;
2. the second digit is the part that all windows of a slab have in common, a
   slab being the suffixes at up to ``SLAB`` neighbouring distances before an
   anchor; a slab whose whole extent is found again is settled as repeated;
3. the last digit is the whole window, for what is left at the edges of
   repeats.

What is still together then are exactly the windows found twice or more.
Digits are compared by 128-bit hashes, counted by partial aggregation, so a
string in a third of all documents needs no task of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import mix64, prefix_hash, span_hash, text_slices
from .shared import drop_materialized, materialize, small_side

#: Bytes of an anchor gram, suffixes of a slab, and bytes that are ordered at once.
GRAM, SLAB, SEGMENT = 64, 32, 2 << 20
KEY = ["k1", "k2"]


def least_grams(buf: np.ndarray, offsets: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first window, last window, gram hash), positions within the row.

    Windows of ``threshold`` bytes that start from the first to the last all
    have the leftmost least gram at the anchor.
    """
    n, span = len(buf), threshold - GRAM + 1
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(4)) + (np.zeros(0, dtype=np.uint64),)
    if n < threshold:
        return none
    starts = np.arange(n - GRAM + 1)
    grams = mix64(span_hash(prefix_hash(buf), starts, starts + GRAM))
    low = np.uint64((1 << 24) - 1)
    least = (grams & ~low) | starts.astype(np.uint64)
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    anchor = (least & low).astype(np.int64)
    window = np.arange(len(anchor))
    row = np.searchsorted(offsets, window, side="right") - 1
    inside = window + threshold <= offsets[row + 1]
    window, anchor, row = window[inside], anchor[inside], row[inside]
    if not len(window):
        return none
    head = np.ones(len(window), dtype=bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(head)
    last = window[np.append(at[1:], len(window)) - 1]
    own = row[at]
    return own, anchor[at] - offsets[own], window[at] - offsets[own], last - offsets[own], grams[anchor[at]]


def anchors(buf: np.ndarray, offsets: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, ...]]:
    """:func:`least_grams`, with a long text taken in overlapping segments."""
    if len(offsets) > 2 or len(buf) <= SEGMENT:
        yield least_grams(buf, offsets, threshold)
        return
    for start in range(0, len(buf) - threshold + 1, SEGMENT):
        part = buf[start : start + SEGMENT + threshold - 1]
        row, anchor, first, last, gram = least_grams(part, np.array([0, len(part)]), threshold)
        yield row, anchor + start, first + start, last + start, gram


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts with a key of 96 bits: rows of one key are equal in doc_id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.col("doc_id").cast("long") if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else F.xxhash64("doc_id")
    return docs.select("doc_id", text.alias("text"), F.coalesce(own, F.xxhash64(text)).alias("k1"), F.hash(text).alias("k2"))


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _digest(data: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(data)
    return _signed(x >> 64), _signed(x & 0xFFFFFFFFFFFFFFFF)


def anchor_rows(docs: DataFrame, threshold: int) -> DataFrame:
    """First digit: (gram, u, k1, k2, p, s0, s1), a row for each anchor.

    u is the hash of the bytes of all windows of the anchor and of where
    they lie about it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy() for k in KEY)
            for first, buf, offsets in text_slices(batch.column("text")):
                data = memoryview(buf)
                for row, anchor, s0, s1, gram in anchors(buf, offsets, threshold):
                    own, base = row + first, offsets[row]
                    about = ((anchor - s0) << 16 | (s1 - anchor + threshold)).tolist()
                    u = [xxhash.xxh3_64_intdigest(data[a:b], x) for a, b, x in zip((base + s0).tolist(), (base + s1 + threshold).tolist(), about, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram.view(np.int64)), pa.array(np.array(u, dtype=np.uint64).view(np.int64)), pa.array(k1[own]), pa.array(k2[own]), *(pa.array(x.astype(np.int32)) for x in (anchor, s0, s1))],
                        names=["gram", "u", "k1", "k2", "p", "s0", "s1"],
                    )

    return _keyed(docs).select(*KEY, "text").mapInArrow(run, "gram long, u long, k1 long, k2 int, p int, s0 int, s1 int")


def slab_rows(docs: DataFrame, state: DataFrame, threshold: int) -> DataFrame:
    """Second digit: (c1, c2, u, k1, k2, x) for the slabs about the anchors of ``state``.

    The slab of x holds the windows that start at x - SLAB + 1 .. x.  c is
    the hash of what they share, u that of their whole extent; where the
    extent leaves the text u is the hash of the place, which no other has.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy() for k in KEY)
            for i, (text, found) in enumerate(zip(batch.column("text"), batch.column("anchors"), strict=True)):
                data = memoryview(text.as_buffer())
                size = len(data)
                spots = {a["p"] - m * SLAB for a in found.as_py() for m in range((a["p"] - a["s1"]) // SLAB, (a["p"] - a["s0"]) // SLAB + 1)}
                x = sorted(spots)
                rows = []
                for at in x:
                    low, high = at - SLAB + 1, at + threshold
                    whole = data[low:high] if low >= 0 and high <= size else b"%d:%d:%d" % (k1[i], k2[i], at)
                    rows.append((*_digest(data[max(at, 0) : low + threshold]), _signed(xxhash.xxh3_64_intdigest(whole))))
                if rows:
                    columns = np.array(rows, dtype=np.int64).T
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c) for c in columns), pa.array(np.full(len(x), k1[i])), pa.array(np.full(len(x), k2[i])), pa.array(x, pa.int32())],
                        names=["c1", "c2", "u", "k1", "k2", "x"],
                    )

    joined = _keyed(docs).drop("doc_id").join(small_side(state), KEY)
    return joined.select(*KEY, "text", "anchors").mapInArrow(run, "c1 long, c2 long, u long, k1 long, k2 int, x int")


def window_rows(docs: DataFrame, state: DataFrame, threshold: int) -> DataFrame:
    """Last digit: (w1, w2, k1, k2, s) for every window of the slabs of ``state``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy() for k in KEY)
            for i, (text, found) in enumerate(zip(batch.column("text"), batch.column("slabs"), strict=True)):
                data = memoryview(text.as_buffer())
                x = np.array(found.as_py(), dtype=np.int64)
                s = np.unique((x[:, None] - np.arange(SLAB)).ravel())
                s = s[(s >= 0) & (s + threshold <= len(data))]
                hashes = np.array([_digest(data[at : at + threshold]) for at in s.tolist()], dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(np.full(len(s), k1[i])), pa.array(np.full(len(s), k2[i])), pa.array(s.astype(np.int32))],
                    names=["w1", "w2", "k1", "k2", "s"],
                )

    joined = _keyed(docs).drop("doc_id").join(small_side(state), KEY)
    return joined.select(*KEY, "text", "slabs").mapInArrow(run, "w1 long, w2 long, k1 long, k2 int, s int")


def _alike(rows: DataFrame, digit: list[str], extent: list[str], place: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Sort one digit: (places whose whole extent is found again, one place of each extent still in question).

    Rows equal in ``extent`` are equal in all their windows.  Of a group of
    equal digits one row for each extent goes on to the next digit, if there
    are several extents.
    """
    kinds = materialize(rows.groupBy(*extent).agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("one")), label)
    again = materialize(kinds.where("n > 1").select(*extent), f"{label}-again")
    split = materialize(kinds.groupBy(*digit).agg(F.count("*").alias("kinds")).where("kinds > 1").select(*digit), f"{label}-split")
    return rows.join(small_side(again), extent, "left_semi").select(*place), kinds.join(small_side(split), digit, "left_semi").select("one.*")


def repeated_starts(docs: DataFrame, threshold: int) -> DataFrame:
    """(k1, k2, first, last): runs of starts of windows that are found twice or more."""
    every = materialize(anchor_rows(docs, threshold), "anchors")
    twice = materialize(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    rows = materialize(every.join(small_side(twice), "gram", "left_semi"), "repeated-anchors")
    drop_materialized(every)
    first = ["gram"], ["gram", "u"], [*KEY, "p", "s0", "s1"]
    whole, left = _alike(rows, *first, "anchor-kinds")
    found = whole.select(*KEY, F.col("s0").alias("first"), F.col("s1").alias("last"))

    state = left.groupBy(*KEY).agg(F.collect_set(F.struct("p", "s0", "s1")).alias("anchors"))
    rows = materialize(slab_rows(docs, materialize(state, "split-anchors"), threshold), "slabs")
    second = ["c1", "c2"], ["c1", "c2", "u"], [*KEY, "x"]
    whole, left = _alike(rows, *second, "slab-kinds")
    found = found.unionByName(whole.select(*KEY, (F.col("x") - (SLAB - 1)).alias("first"), F.col("x").alias("last")))

    state = left.groupBy(*KEY).agg(F.collect_set("x").alias("slabs"))
    rows = materialize(window_rows(docs, materialize(state, "split-slabs"), threshold), "windows")
    twice = materialize(rows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"), "repeated-windows")
    edges = rows.join(small_side(twice), ["w1", "w2"], "left_semi").select(*KEY, F.col("s").alias("first"), F.col("s").alias("last"))
    return found.unionByName(edges)


def merged_spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [first, last)."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    head = np.ones(len(first), dtype=bool)
    head[1:] = first[1:] > last[:-1]
    at = np.flatnonzero(head)
    return first[at], last[np.append(at[1:], len(first)) - 1]


def merged_rows(starts: DataFrame, threshold: int) -> DataFrame:
    """(k1, k2, starts): the maximal runs of bytes of each text, which may reach over its ends."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            lists = []
            for found in batch.column("starts"):
                low, high = merged_spans(*(found.values.field(k).to_numpy().astype(np.int64) + add for k, add in ((0, 0), (1, threshold))))
                lists.append([{"first": a, "last": b} for a, b in zip(low.tolist(), high.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(lists, kind)], names=["k1", "k2", "starts"])

    each = starts.groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("starts"))
    return each.mapInArrow(run, "k1 long, k2 int, starts array<struct<first:int,last:int>>")


def remove_repeats(docs: DataFrame, threshold: int = 400) -> DataFrame:
    """Remove every byte that lies in a string of ``threshold`` bytes found elsewhere too.

    Returns doc_id, n_bytes, n_removed, n_spans, spans (start and end of each
    maximal removed run) and kept (the other bytes, which need not be whole
    characters).  Strings are judged on the input and do not cross texts; the
    same string at another place of its own text counts.  A null text is
    empty; a null doc_id stays; repeated rows repeat each other's strings;
    other columns are left out; an empty table gives an empty result.
    """
    if threshold < GRAM + SLAB:
        raise ValueError(f"threshold must be at least {GRAM + SLAB}")
    starts = repeated_starts(docs, threshold)
    spans = materialize(merged_rows(starts, threshold), "repeat-spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept, lists = [], [], [], []
            for text, found in zip(batch.column("text"), batch.column("starts"), strict=True):
                data = memoryview(text.as_buffer())
                if found.is_valid:
                    runs = found.values
                    # a slab may reach over the ends of its text
                    low, high = (np.clip(runs.field(k).to_numpy().astype(np.int64), 0, len(data)) for k in (0, 1))
                    edges = np.concatenate([[0], np.stack([low, high], axis=1).ravel(), [len(data)]]).tolist()
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    lists.append([{"start": a, "end": b} for a, b in zip(low.tolist(), high.tolist(), strict=True)])
                else:
                    kept.append(bytes(data))
                    lists.append([])
                sizes.append(len(data))
                removed.append(len(data) - len(kept[-1]))
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(x) for x in lists], pa.int64()), pa.array(lists, spans_type), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = _keyed(docs).join(small_side(spans), KEY, "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")


