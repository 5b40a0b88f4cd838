"""Removal of repeated word sequences found through difference-cover anchors.

A difference cover holds, for every distance, two residues of its period that
lie so far apart.  Any two equal windows therefore have a place within their
first period at which both have an anchor, a position whose residue is in the
cover, and the shorter word sequences that start there are equal too.  Only
these are hashed:

1. anchors whose sequence is found nowhere else are dropped;
2. an anchor whose whole surroundings (all windows that hold its sequence) are
   found again settles all these windows as repeated;
3. of equal anchors in different surroundings one for each is extended: its
   windows are hashed and compared.

Before rows are dealt by their sequence, each held batch sends equal rows once
and at most ``KINDS`` surroundings of one sequence, so a sequence in a third of
all documents is a small share of any task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import BASES, mix64, prefix_hash, span_hash, span_keys, text_slices, word_spans
from .shared import drop_materialized, materialize, small_side
from .substrings import KEY, _keyed, merged_rows, merged_spans

#: Perfect difference covers by their period.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
#: Anchors that are held before they are compared and sent on, words hashed at once, surroundings of a sequence that a held batch sends.
HELD, SEGMENT, KINDS = 1 << 20, 1 << 17, 4

ROWS = "key long, near long, k1 long, at long, state int"


def cover_of(window: int) -> tuple[int, tuple[int, ...]]:
    """The period and the cover for windows of so many words: the longest period that leaves a sequence of over a third of them."""
    return max((v, d) for v, d in COVERS.items() if 3 * (window - v + 1) > window)


def word_keys(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of every word, and the row of each."""
    start, end, row = word_spans(buf, offsets)
    return span_keys(buf, start, end, 0), span_keys(buf, start, end, 1), row


def anchors(h1: np.ndarray, h2: np.ndarray, row: np.ndarray, rows: int, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, place in its text, hash of the sequence, hash of the surroundings) of every anchor, segment by segment."""
    period, cover = cover_of(window)
    gram = window - period + 1
    chosen = np.isin(np.arange(period), cover)
    count = np.bincount(row, minlength=rows)
    begin = np.cumsum(count) - count
    for a in range(0, len(row), SEGMENT):
        index = np.arange(a, min(a + SEGMENT, len(row)))
        first, n = begin[row[index]], count[row[index]]
        p = index - first
        good = chosen[p % period] & (n >= window) & (p <= n - gram)
        index, first, n, p = index[good], first[good], n[good], p[good]
        if not len(index):
            continue
        low, high = max(0, a - period), min(len(row), a + SEGMENT + window + period)
        left, right = np.minimum(p, period - 1), np.minimum(period - 1, n - window - p) + window
        one, two = prefix_hash(h1[low:high], BASES[0]), prefix_hash(h2[low:high], BASES[1])
        at = index - low
        key = mix64(span_hash(one, at, at + gram, BASES[0]))
        about = span_hash(two, at - left, at + right, BASES[1]) ^ (left << 16 | right).astype(np.uint64)
        yield row[index], p, key, mix64(about)


def asked_rows(key: np.ndarray, near: np.ndarray, k1: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """The held rows as :func:`fates` takes them.

    Bit 0 of ``state``: the row is known to be found again.  Bit 1: its key
    has several surroundings for sure.  Rows that need not meet others have a
    key of their own.
    """
    order = np.lexsort((near, key))
    key, near, k1, at = key[order], near[order], k1[order], at[order]
    own_key = np.ones(len(key), dtype=bool)
    own_key[1:] = key[1:] != key[:-1]
    kind = own_key.copy()
    kind[1:] |= near[1:] != near[:-1]
    heads = np.flatnonzero(kind)
    twice = (np.diff(np.append(heads, len(key))) > 1)[np.cumsum(kind) - 1]
    # which of its key's surroundings a row has, from 0
    nth = np.cumsum(kind) - 1
    nth = nth - nth[np.flatnonzero(own_key)][np.cumsum(own_key) - 1]
    most = np.maximum.reduceat(nth, np.flatnonzero(own_key))[np.cumsum(own_key) - 1]
    state = twice.astype(np.int32) | ((most >= KINDS) & kind).astype(np.int32) << 1
    alone = ~kind | (nth >= KINDS)
    place = mix64(k1.view(np.uint64) ^ mix64(at.view(np.uint64)))
    key = np.where(alone, place, key)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(near.view(np.int64)), pa.array(k1), pa.array(at), pa.array(state)], names=["key", "near", "k1", "at", "state"])


def held(parts: Iterable[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """(key, near, k1, at) arrays gathered up to ``HELD`` rows, then as :func:`asked_rows`."""
    kept, size = [], 0
    for part in parts:
        kept.append(part)
        size += len(part[0])
        if size >= HELD:
            yield asked_rows(*(np.concatenate(x) for x in zip(*kept, strict=True)))
            kept, size = [], 0
    if size:
        yield asked_rows(*(np.concatenate(x) for x in zip(*kept, strict=True)))


def _place(k2: np.ndarray, p: np.ndarray) -> np.ndarray:
    return k2.astype(np.int64) << 32 | p


def anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """Every anchor of ``docs``: key is its sequence, near its surroundings."""

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy() for k in KEY)
            for first, buf, offsets in text_slices(batch.column("text")):
                for row, p, key, near in anchors(*word_keys(buf, offsets), len(offsets) - 1, window):
                    yield key, near, k1[first + row], _place(k2[first + row], p)

    return _keyed(docs).select(*KEY, "text").mapInArrow(lambda batches: held(parts(batches)), ROWS)


def fates(rows: DataFrame) -> DataFrame:
    """(k1, k2, p, again, differs) of the rows that are found again or that are the first of their surroundings where a key has several."""
    dealt = rows.repartition(F.col("key"))
    kind = W.partitionBy("key", "near").orderBy("k1", "at")
    whole = kind.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    own = W.partitionBy("key")
    seen = dealt.withColumns({"nth": F.row_number().over(kind), "n": F.count("*").over(whole), "known": F.max(F.col("state").bitwiseAND(1)).over(whole)})
    seen = seen.withColumns({"low": F.min("near").over(own), "high": F.max("near").over(own), "sure": F.max(F.col("state").bitwiseAND(2)).over(own)})
    again, differs = (F.col("n") > 1) | (F.col("known") > 0), ((F.col("low") != F.col("high")) | (F.col("sure") > 0)) & (F.col("nth") == 1)
    k2, p = F.shiftright("at", 32).cast("int"), F.col("at").bitwiseAND(0xFFFFFFFF).cast("int")
    return seen.select("k1", k2.alias("k2"), p.alias("p"), again.alias("again"), differs.alias("differs")).where("again or differs")


def window_rows(docs: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """The windows that hold the anchors of ``places`` (k1, k2, places), as :func:`fates` takes them."""
    period, _ = cover_of(window)

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy() for k in KEY)
            for i, (text, found) in enumerate(zip(batch.column("text"), batch.column("places"), strict=True)):
                buf = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                h1, h2, _ = word_keys(buf, np.array([0, len(buf)]))
                p = found.values.to_numpy().astype(np.int64)
                starts = np.unique((p[:, None] - np.arange(period)).ravel())
                starts = starts[(starts >= 0) & (starts <= len(h1) - window)]
                for a in range(0, len(h1), SEGMENT):
                    s = starts[(starts >= a) & (starts < a + SEGMENT)]
                    if len(s):
                        one, two = (mix64(span_hash(prefix_hash(h[a : a + SEGMENT + window], b), s - a, s - a + window, b)) for h, b in zip((h1, h2), BASES, strict=True))
                        yield one, two, np.full(len(s), k1[i]), _place(np.full(len(s), k2[i]), s)

    joined = _keyed(docs).drop("doc_id").join(small_side(places), KEY)
    return joined.select(*KEY, "text", "places").mapInArrow(lambda batches: held(parts(batches)), ROWS)


def runs_of(places: DataFrame, back: int) -> DataFrame:
    """(k1, k2, first, last): maximal runs of the starts ``back`` words before each of ``places`` up to it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, found in zip(*(batch.column(c) for c in (*KEY, "places")), strict=True):
                p = found.values.to_numpy().astype(np.int64)
                first, end = merged_spans(np.maximum(p - back, 0), p + 1)
                n = len(first)
                yield pa.RecordBatch.from_arrays([pa.array([k1.as_py()] * n, pa.int64()), pa.array([k2.as_py()] * n, pa.int32()), pa.array(first.astype(np.int32)), pa.array((end - 1).astype(np.int32))], names=[*KEY, "first", "last"])

    return places.mapInArrow(run, "k1 long, k2 int, first int, last int")


def repeated_starts(docs: DataFrame, window: int) -> DataFrame:
    """(k1, k2, first, last): runs of starts of windows that are found twice or more; a run may reach over the last start of its text."""
    gathered = lambda rows, which: rows.where(which).groupBy(*KEY).agg(F.collect_list("p").alias("places"))
    found = materialize(fates(anchor_rows(docs, window)), "anchor-fates")
    settled = materialize(runs_of(gathered(found, "again"), cover_of(window)[0] - 1), "settled-runs")
    differ = materialize(gathered(found, "differs"), "open-anchors")
    drop_materialized(found)
    edges = gathered(fates(window_rows(docs, differ, window)), "again")
    return settled.unionByName(runs_of(edges, 0))


def remove_repeated_words(docs: DataFrame, window: int = 35) -> DataFrame:
    """Remove every word that lies in a sequence of ``window`` words found elsewhere too.

    Words are the runs of characters outside [\\x20\\x09-\\x0D], as they are.
    Returns doc_id, n_words, n_removed, spans (first word and end of each
    maximal removed run) and kept, the other words joined by one space.
    Sequences are judged on the input and do not cross texts; the same one at
    another place of its own text counts.  A null text has no words; a null
    doc_id stays; repeated rows repeat each other's sequences; other columns
    are left out; an empty table gives an empty result.
    """
    if window < 10:
        raise ValueError("window must be at least 10")
    spans = materialize(merged_rows(repeated_starts(docs, window), window), "repeat-spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, removed, kept, lists = [], [], [], []
            for text, found in zip(batch.column("text"), batch.column("starts"), strict=True):
                # on bytes, split() takes exactly [\x20\x09-\x0D] as blanks
                words = bytes(text.as_buffer()).split()
                runs = [(x["first"], min(x["last"], len(words))) for x in found.as_py() or ()]
                edges = [0, *(e for r in runs for e in r), len(words)]
                left = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]] if runs else words
                sizes.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
                lists.append([{"start": a, "end": b} for a, b in runs])
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(lists, kind), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = _keyed(docs).join(small_side(spans), KEY, "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string")
