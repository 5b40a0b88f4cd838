"""Vectorised text kernels that run inside Arrow batches.

All of them read the UTF-8 bytes of an Arrow string column in place, in
slices of bounded size, so a task's memory does not follow its row count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that one slice holds, unless a single text is longer.
SLICE_BYTES = 1 << 20

#: Longest span hashed by powers of a base modulo 2**64; from 1,024 bytes on there are texts that collide for every base.
LONG_SPAN = 512

_BASE = 0x9E3779B97F4A7C15 | 1
#: Odd bases of independent hash families.
BASES = (_BASE, 0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit words so that every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the largest n asked for."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def prefix_hash(items: np.ndarray, base: int = _BASE) -> np.ndarray:
    """S with S[e] - S[s], times the inverse power of s, the hash of items[s:e]."""
    out = np.zeros(len(items) + 1, dtype=np.uint64)
    np.cumsum((items.astype(np.uint64) + np.uint64(1)) * powers(base, len(items)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hashes of spans of at most ``LONG_SPAN`` items."""
    return (prefix[end] - prefix[start]) * powers(pow(base, -1, 1 << 64), len(prefix))[start]


def span_keys(buf: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit hashes of spans of any length, in order and apart from each other; families are independent."""
    out = np.empty(len(start), dtype=np.uint64)
    size = end - start
    data = memoryview(buf)
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]], family)
    short = np.flatnonzero(size <= LONG_SPAN)
    s, e = start[short], end[short]
    at = 0
    while at < len(short):
        upto = int(np.searchsorted(e, s[at] + SLICE_BYTES, side="right"))
        prefix = prefix_hash(buf[s[at] : e[upto - 1]], BASES[family])
        out[short[at:upto]] = mix64(span_hash(prefix, s[at:upto] - s[at], e[at:upto] - s[at], BASES[family]))
        at = upto
    return out


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        upto = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        upto = min(max(upto, row + 1), len(column))
        yield row, raw[offsets[row] : offsets[upto]], offsets[row : upto + 1] - offsets[row]
        row = upto


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; every other byte as it is."""
    return buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)


#: Bytes of words, and of terms: 0-9, A-Z, a-z and every byte of other characters than those of ASCII.
WORD_BYTES = ~np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
TERM_BYTES = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def word_spans(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of bytes of a kind; runs end with their row."""
    inside = kind[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] |= inside[first]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] |= inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(buf: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, row) of every word in order."""
    text = lower_ascii(buf) if lower else buf
    start, end, row = word_spans(buf, offsets)
    return span_keys(text, start, end), row


def shingle_sets(column: pa.Array, words: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes, bounds): row first+i owns hashes[bounds[i]:bounds[i+1]].

    A text with fewer words than a shingle has one hash for its whole word
    sequence; a text without words has none.
    """
    step = np.uint64(0xD1342543DE82EF95)
    for first, buf, offsets in text_slices(column):
        n = len(offsets) - 1
        h, row = word_hashes(buf, offsets)
        per = np.bincount(row, minlength=n)
        ends = np.cumsum(per)
        if len(h) >= words:
            m = len(h) - words + 1
            sh = np.zeros(m, dtype=np.uint64)
            for k in range(words):
                sh = sh * step + h[k : k + m]
            whole = row[:m] == row[words - 1 :]
            sh, sh_row = mix64(sh[whole]), row[:m][whole]
        else:
            sh, sh_row = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=row.dtype)
        short = np.flatnonzero((per > 0) & (per < words))
        if len(short):
            extra = np.empty(len(short), dtype=np.uint64)
            for i, r in enumerate(short):
                acc = int(per[r])
                for x in h[ends[r] - per[r] : ends[r]]:
                    acc = (acc * int(step) + int(x)) & 0xFFFFFFFFFFFFFFFF
                extra[i] = acc
            sh, sh_row = np.concatenate([sh, mix64(extra)]), np.concatenate([sh_row, short])
            order = np.argsort(sh_row, kind="stable")
            sh, sh_row = sh[order], sh_row[order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(sh_row, minlength=n))])
        for r in range(n):
            sh[bounds[r] : bounds[r + 1]].sort()
        keep = np.ones(len(sh), dtype=bool)
        if len(sh):
            keep[1:] = (sh[1:] != sh[:-1]) | (sh_row[1:] != sh_row[:-1])
        sh, sh_row = sh[keep], sh_row[keep]
        yield first, sh, np.concatenate([[0], np.cumsum(np.bincount(sh_row, minlength=n))])
