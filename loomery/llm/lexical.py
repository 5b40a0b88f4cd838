"""Ranked lexical search by sort-based accumulation.

Items are asked in blocks of bounded size.  For a block each document gives
the places and counts of the block's terms that it holds; document
frequencies are counted from these.  Every task then scores a range of the
documents: the arrays (item, document, impact) of all terms that match are
concatenated, ordered by a radix sort of packed keys, summed where keys are
equal, and a heap for each item keeps the best.  Scores are whole numbers, so
the order of adding is no matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import TERM_BYTES, lower_ascii, span_keys, text_slices, word_spans
from .shared import materialize

#: (item, term) pairs that one block of items may have, unless a single item has more.
BLOCK_TERMS = 1 << 17
#: (item, document, impact) triples that are sorted at once, unless a single document gives more.
TRIPLES = 1 << 20

MATCHED = "doc_id long, n long, terms array<int>, counts array<int>, docs long, words long"


def terms_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, end, row): maximal runs of digits, letters and characters beyond ASCII in the lower-cased text."""
    text = lower_ascii(buf)
    return text, *word_spans(text, offsets, TERM_BYTES)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, h1, h2, asked): how often each item asks for a term, known by 128 bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("item_id").to_numpy()
            for first, buf, offsets in text_slices(batch.column("text")):
                text, start, end, row = terms_of(buf, offsets)
                keys = [span_keys(text, start, end, family).view(np.int64) for family in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(own[first + row]), *map(pa.array, keys)], names=["item_id", "h1", "h2"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").distinct()
    return rows.mapInArrow(run, "item_id long, h1 long, h2 long").groupBy("item_id", "h1", "h2").agg(F.count("*").alias("asked"))


def dealt(pairs: DataFrame) -> tuple[DataFrame, int]:
    """``pairs`` with ``block``, and how many blocks there are: enough that none has over ``BLOCK_TERMS`` pairs of several items."""
    per = materialize(pairs.groupBy("item_id").agg(F.count("*").alias("n")), "asked-items")
    blocks = max(1, math.ceil((per.agg(F.sum("n")).first()[0] or 0) * 1.25 / BLOCK_TERMS))
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")
        over = per.groupBy(block.alias("block")).agg(F.sum("n").alias("n"), F.count("*").alias("items")).where((F.col("n") > BLOCK_TERMS) & (F.col("items") > 1))
        if over.isEmpty():
            return pairs.withColumn("block", block), blocks
        blocks *= 2


class Asked:
    """The terms of one block and the items that ask for each."""

    def __init__(self, item: np.ndarray, h1: np.ndarray, h2: np.ndarray, asked: np.ndarray):
        self.items, place = np.unique(item, return_inverse=True)
        order = np.lexsort((place, h2, h1))
        h1, h2 = h1[order], h2[order]
        head = np.ones(len(h1), dtype=bool)
        head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        at = np.flatnonzero(head)
        self.h1, self.h2 = h1[at], h2[at]
        self.bounds = np.append(at, len(h1))
        self.place, self.asked = place[order], asked[order]

    def find(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which spans are terms of the block, their numbers)."""
        if not len(self.h1):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        key = span_keys(text, start, end, 0).view(np.int64)
        at = np.minimum(np.searchsorted(self.h1, key), len(self.h1) - 1)
        maybe = np.flatnonzero(self.h1[at] == key)
        at = at[maybe]
        good = self.h2[at] == span_keys(text, start[maybe], end[maybe], 1).view(np.int64)
        return maybe[good], at[good]


def matched(docs: DataFrame, asked: Asked) -> DataFrame:
    """(doc_id, n, terms, counts) of the documents that hold terms of the block; rows with ``docs`` and ``words`` have totals of all."""
    lists = lambda values, bounds: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.astype(np.int32)))
    blank = lambda n, kind: pa.nulls(n, kind)
    names = ["doc_id", "n", "terms", "counts", "docs", "words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several = pa.list_(pa.int32())
        for batch in batches:
            holding = words = 0
            for first, buf, offsets in text_slices(batch.column("text")):
                text, start, end, row = terms_of(buf, offsets)
                n = np.bincount(row, minlength=len(offsets) - 1)
                holding, words = holding + int((n > 0).sum()), words + len(row)
                spans, term = asked.find(text, start, end)
                pair, count = np.unique(row[spans] * np.int64(len(asked.h1)) + term, return_counts=True)
                own, term = np.divmod(pair, max(1, len(asked.h1)))
                own, begin = np.unique(own, return_index=True)
                bounds = np.append(begin, len(pair))
                columns = [batch.column("doc_id").take(pa.array(first + own)), pa.array(n[own].astype(np.int64)), lists(term, bounds), lists(count, bounds), blank(len(own), pa.int64()), blank(len(own), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            totals = [blank(1, pa.int64()), blank(1, pa.int64()), blank(1, several), blank(1, several), pa.array([holding], pa.int64()), pa.array([words], pa.int64())]
            yield pa.RecordBatch.from_arrays(totals, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MATCHED)


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """A stable order of whole numbers below 2**bits, by their 16-bit digits from the last to the first."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


class Best:
    """The ``k`` best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, {}
        #: what a score must reach to matter
        self.bar = np.ones(items, dtype=np.int64)

    def add(self, item: np.ndarray, doc: np.ndarray, missing: np.ndarray, score: np.ndarray) -> None:
        """Sums ordered by item."""
        good = np.flatnonzero(score >= self.bar[item])
        item, doc, missing, score = item[good], doc[good], missing[good], score[good]
        edges = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
        for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            s = score[a:b]
            at = np.arange(a, b)
            if b - a > self.k:
                at = at[s >= np.partition(s, -self.k)[-self.k]]
                at = at[np.lexsort((doc[at], missing[at], -score[at]))[: self.k]]
            own = int(item[a])
            new = zip((-score[at]).tolist(), missing[at].tolist(), doc[at].tolist(), strict=True)
            self.heaps[own] = heapq.nsmallest(self.k, [*self.heaps.get(own, ()), *new])
            if len(self.heaps[own]) == self.k:
                self.bar[own] = -self.heaps[own][-1][0]


def best_documents(hits: DataFrame, asked: Asked, weight: np.ndarray, docs: int, words: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): the ``k`` best of each item in each range of ``hits``."""
    fan = np.diff(asked.bounds)
    item_bits = max(1, (len(asked.items) - 1).bit_length())

    def scored(doc: np.ndarray, missing: np.ndarray, m: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray, best: Best) -> None:
        """One chunk: ``row`` counts from the first document of ``doc``."""
        impact = weight[term] * ((1_000_000_000 * count) // (1000 * count + 8 * m[row]))
        reps = fan[term]
        upto = np.cumsum(reps)
        index = np.arange(upto[-1] if len(upto) else 0) + np.repeat(asked.bounds[term] - (upto - reps), reps)
        doc_bits = max(1, (len(doc) - 1).bit_length())
        keys = asked.place[index] << doc_bits | np.repeat(row, reps)
        values = np.repeat(impact, reps) * asked.asked[index]
        order = radix_order(keys, item_bits + doc_bits)
        keys = keys[order]
        head = np.flatnonzero(np.diff(keys, prepend=-1))
        if len(head):
            sums, keys = np.add.reduceat(values[order], head), keys[head]
            own = keys & ((1 << doc_bits) - 1)
            best.add(keys >> doc_bits, doc[own], missing[own], sums)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(asked.items), k)
        for batch in batches:
            missing = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            doc, n = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("n").to_numpy()
            m = 25 + (75 * n * docs) // words
            lists = batch.column("terms")
            bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            term, count = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "counts"))
            work = np.concatenate([[0], np.cumsum(fan[term])])[bounds]
            at = 0
            while at < len(doc):
                upto = int(np.searchsorted(work, work[at] + TRIPLES, side="right")) - 1
                upto = min(max(upto, at + 1), len(doc))
                part = slice(bounds[at], bounds[upto])
                row = np.repeat(np.arange(upto - at), np.diff(bounds[at : upto + 1]))
                scored(doc[at:upto], missing[at:upto], m[at:upto], row, term[part], count[part], best)
                at = upto
        rows = [(int(asked.items[i]), None if miss else d, -s) for i, heap in best.heaps.items() for s, miss, d in heap]
        item, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, doc, score)], names=["item_id", "doc_id", "score"])

    return hits.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item_id long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` highest-scoring rows of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    Returns item_id, rank (from 1), doc_id and score, of scores above 0 only;
    equal scores by ascending doc_id.  Terms are runs of digits, letters and
    characters beyond ASCII with A-Z lower-cased, known by 128-bit hashes.  A
    null or empty text has no terms and is found by nothing; documents without
    a doc_id are found and come after others of their score; repeated rows
    are documents each on its own.  Items without an id are left out, equal
    rows of items count once, and different texts of one item_id are one item.
    Other columns are left out; an empty table of either kind gives an empty
    result.
    """
    spark = docs.sparkSession
    pairs, blocks = dealt(materialize(item_terms(items), "asked-terms"))
    found = None
    for block in range(blocks):
        own = pairs.where(F.col("block") == block).toPandas()
        asked = Asked(*(own[c].to_numpy(dtype=np.int64) for c in ("item_id", "h1", "h2", "asked")))
        rows = materialize(matched(docs, asked), "matched-terms")
        total = rows.where("docs is not null").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
        hits = rows.where("docs is null")
        if not total.words or not len(asked.items):
            continue
        # a row for each term of the block at most
        df = hits.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toPandas()
        weight = np.zeros(len(asked.h1), dtype=np.int64)
        weight[df["term"].to_numpy(dtype=np.int64)] = [math.floor(1000 * math.log((2 * total.docs + 2) / (2 * d + 1))) for d in df["df"].tolist()]
        part = best_documents(hits, asked, weight, total.docs, total.words, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
