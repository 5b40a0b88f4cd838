"""Quality rules from the repeats inside each text, found with suffix arrays over its words.

The suffixes of all texts of a slice are ordered together by prefix doubling;
words carry their text's number, so suffixes of different texts never tie.
The ranks of every doubling give the longest common prefix of neighbours.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import mix64, span_keys, text_slices, word_spans

_SALT = np.uint64(0xA0761D6478BD642F)


def per_row(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal keys of one row."""
    return mix64(keys ^ (row.astype(np.uint64) + np.uint64(1)) * _SALT)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Where a key is found twice or more."""
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[inverse] > 1


def roomy(keys: np.ndarray) -> np.ndarray:
    """How many keys are less than each key: g equal keys share the first of g numbers."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    head = np.ones(len(keys), dtype=bool)
    head[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), dtype=np.int32)
    out[order] = np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))
    return out


def doubled_ranks(words: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 2**k words, k = 0, 1, ... until no two tie.

    ``end`` is where the text of each word ends.  Suffixes that tie have all
    2**k words: of two that start alike in one text, only one can end there.
    """
    levels = [roomy(words)]
    tied = np.flatnonzero(repeated(levels[0]))
    width = 1
    while len(tied):
        rank = levels[-1]
        ahead = tied + width
        nxt = np.where(ahead < end[tied], rank[np.minimum(ahead, len(rank) - 1)] + 1, 0)
        base = rank[tied]
        sub = np.lexsort((nxt, base))
        b, n = base[sub], nxt[sub]
        head = np.ones(len(sub), dtype=bool)
        head[1:] = b[1:] != b[:-1]
        fresh = head.copy()
        fresh[1:] |= n[1:] != n[:-1]
        index = np.arange(len(sub))
        place = np.maximum.accumulate(np.where(fresh, index, 0)) - np.maximum.accumulate(np.where(head, index, 0))
        new = rank.copy()
        new[tied[sub]] = b + place
        levels.append(new)
        again = ~fresh
        again[:-1] |= ~fresh[1:]
        tied = np.sort(tied[sub[again]])
        width *= 2
    return levels


def longest_repeats(words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each word, the most words from it on that are found again elsewhere in its text.

    ``words`` are keys of :func:`per_row` order; texts are runs of ``row``.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    end = np.searchsorted(row, row, side="right")
    levels = doubled_ranks(words, end)
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        ia, ib = np.minimum(a, n - 1), np.minimum(b, n - 1)
        width = 1 << k
        # equal ranks of a level are equal stretches of its full width
        same = inside & (levels[k][ia] == levels[k][ib]) & (ia != ib) & (ia + width <= end[ia]) & (ib + width <= end[ib]) & (row[ia] == row[ib])
        step = np.where(same, width, 0)
        common += step
        a, b = a + step, b + step
    out = np.zeros(n, dtype=np.int64)
    out[order[:-1]] = common
    out[order[1:]] = np.maximum(out[order[1:]], common)
    return out


def covered(length: np.ndarray) -> np.ndarray:
    """Positions inside the union of the spans [i, i + length[i])."""
    n = len(length)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, np.arange(n), (length > 0).astype(np.int64))
    np.add.at(edge, np.arange(n) + length, -(length > 0).astype(np.int64))
    return np.cumsum(edge)[:n] > 0


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_words", "longest_repeat"]


def measures(buf: np.ndarray, offsets: np.ndarray, min_repeat: int) -> dict[str, np.ndarray]:
    """The counts of :func:`repetition_rules` for the texts of one slice."""
    n = len(offsets) - 1
    start, end, row = word_spans(buf, offsets)
    words = span_keys(buf, start, end)
    out = {"n_words": np.bincount(row, minlength=n)}
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    out["word_chars"] = np.bincount(row, weights=points[end] - points[start], minlength=n).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(np.isin(buf, np.frombuffer(b"#*$%&|<>", dtype=np.uint8)))])
    out["n_symbols"] = symbols[offsets[1:]] - symbols[offsets[:-1]]

    # lines with a word, by their exact bytes
    breaks = np.flatnonzero(buf == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    line_start, line_row = line_start[line_row < n], line_row[line_row < n]
    # an empty text shares its offset with the next one; its line has no word anyway
    stop = np.searchsorted(breaks, line_start)
    line_end = np.minimum(np.append(breaks, len(buf))[stop], offsets[np.minimum(line_row + 1, n)])
    has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    ls, le, lr = line_start[has_word], line_end[has_word], line_row[has_word]
    keys = per_row(span_keys(buf, ls, le), lr)
    _, first = np.unique(keys, return_index=True)
    out["n_dup_lines"] = np.bincount(lr, minlength=n) - np.bincount(lr[first], minlength=n)

    step = np.uint64(0xD1342543DE82EF95)
    hit = np.zeros(len(words), dtype=bool)
    if len(words) >= 3:
        whole = row[:-2] == row[2:]
        windows = per_row((words[:-2] * step + words[1:-1]) * step + words[2:], row[:-2])
        twice = np.zeros(len(windows), dtype=bool)
        twice[whole] = repeated(windows[whole])
        for k in range(3):
            hit[k : len(hit) - 2 + k] |= twice
    out["n_repeat_words"] = np.bincount(row[hit], minlength=n)

    length = longest_repeats(per_row(words, row), row)
    long = np.where(length >= min_repeat, length, 0)
    out["repeat_words"] = np.bincount(row[covered(long)], minlength=n)
    out["longest_repeat"] = np.zeros(n, dtype=np.int64)
    np.maximum.at(out["longest_repeat"], row, length)
    return out


def repetition_rules(
    docs: DataFrame, min_repeat: int = 8, max_covered: float = 0.4, max_longest: float = 1 / 6, short: int = 50
) -> DataFrame:
    """Measure every text of ``docs`` (doc_id, text) and decide whether it is kept.

    ``repeat_words`` counts the words inside maximal repeated substrings of
    ``min_repeat`` words or more, ``longest_repeat`` the words of the longest
    repeat.  A text of under ``short`` words, or with more than half of its
    words in repeated three-word windows, fails the base rules.  Of the rest,
    those are kept whose repeats cover at most ``max_covered`` of the words
    and whose longest is at most ``max_longest`` of them.  The base rule alone
    bounds the covered words by a half, and two copies side by side cover
    twice the longest: each limit is below what the others imply.  A null or empty
    text has no words and fails; a null doc_id stays; repeated rows are
    measured each on its own; other columns are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean, kept boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, buf, offsets in text_slices(batch.column("text")):
                m = measures(buf, offsets, min_repeat)
                failed = (m["n_words"] < short) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                good = (m["repeat_words"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_longest * m["n_words"])
                columns = [ids.slice(first, len(offsets) - 1), *(pa.array(m[k].astype(np.int64)) for k in MEASURES), pa.array(failed), pa.array(good & ~failed)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *MEASURES, "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)

