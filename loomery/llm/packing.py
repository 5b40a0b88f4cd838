"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised and cut where they are read.  Pieces that fill a
sequence alone never meet another piece; the rest are dealt round-robin
into shards of bounded size and each shard is packed by vector best-fit.
"""

from __future__ import annotations

import functools
import json
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def _byte_ranks(tokenizer, vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Ranks of a byte-level BPE from its vocabulary, whose symbols stand for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbol = dict(zip((chr(b) for b in plain), plain, strict=True)) | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    return {bytes(symbol[c] for c in token): i for token, i in vocabulary.items() if token not in special}


class PieceEncoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    The ids are those of ``tokenizers`` for the file at ``path`` with
    ``add_special_tokens=False``.  Where the file is a plain byte-level BPE
    (no normaliser, merges in the order of their ids), tiktoken merges the same
    pairs in the same order in a fifth of the time, and encodes every text
    that holds none of the added tokens; those texts, and other kinds of
    files, take the tokenizer itself.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick = self._quick()

    def _quick(self):
        file = json.loads(self.tokenizer.to_str())
        model, split = file["model"], file["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or file["normalizer"] or (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) != ("ByteLevel", False, True):
            return None
        made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if made != list(range(256, 256 + len(made))):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=_byte_ranks(self.tokenizer, model["vocab"]), special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        if self.quick is None or any(t in text for t in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.quick(text)
        return np.array(ids, dtype="<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process: its tables outlive a task."""
    return PieceEncoder(path)


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all but the first have ``capacity`` ids."""
    start, length = 0, n if n <= capacity else (n % capacity or capacity)
    while start < n:
        yield start, length
        start, length = start + length, capacity


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and cut long documents.

    Returns doc_id, piece, start, length, ids_crc32 and, if asked for, the
    ids themselves as little-endian unsigned 32-bit bytes.  A null or empty
    text has the single id ``end_id``; a null doc_id stays null; repeated
    rows give repeated pieces; other columns are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    tail = int(end_id).to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, piece, start, length, crc, own = [], [], [], [], [], []
                for i, text in enumerate(part.column("text")):
                    ids = encoder.encode(text.as_py() or "") + tail
                    for k, (first, n) in enumerate(cut(len(ids) // 4, capacity)):
                        data = ids[4 * first : 4 * (first + n)]
                        row.append(i)
                        piece.append(k)
                        start.append(first)
                        length.append(n)
                        crc.append(zlib.crc32(data))
                        if with_ids:
                            own.append(data)
                columns = [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * with_ids, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(demand: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray, int]:
    """Vector best-fit decreasing: (bin of each item, order in which items were placed, bins).

    ``demand`` is items x resources.  Of the open bins where every resource
    suffices, ``norm`` takes the one whose normalised residual after placing
    has the least weighted norm, ``dot`` the one whose residual has the
    largest weighted dot product with the demand; ties go to the oldest bin.
    """
    if (demand > capacity).any():
        raise ValueError("an item exceeds a capacity")
    share = demand / capacity
    order = np.lexsort((np.arange(len(demand)), -(share * weights).sum(axis=1)))
    left = np.empty((len(demand), demand.shape[1]), dtype=np.float64)
    owner = np.empty(len(demand), dtype=np.int64)
    live = np.empty(len(demand), dtype=np.int64)
    least = np.minimum.accumulate(demand[order[::-1], 0])[::-1]
    used = n_live = 0
    for step, item in enumerate(order):
        bins = live[:n_live]
        rest = left[bins] - demand[item]
        fits = np.flatnonzero((rest >= 0).all(axis=1)) if n_live else bins
        if len(fits):
            rest = rest[fits] / capacity
            if rule == "dot":
                score = -(((rest + share[item]) * share[item]) * weights).sum(axis=1)
            else:
                score = ((rest * rest) * weights).sum(axis=1)
            chosen = int(bins[fits[int(np.argmin(score))]])
        else:
            chosen, used = used, used + 1
            left[chosen] = capacity
            live[n_live] = chosen
            n_live += 1
        left[chosen] -= demand[item]
        owner[item] = chosen
        # bins that the least item still to come cannot enter are closed
        if step % 64 == 63 and step + 1 < len(order):
            bins = live[:n_live]
            still = bins[left[bins, 0] >= least[step + 1]]
            n_live = len(still)
            live[:n_live] = still
    return owner, order, used


def pack(
    pieces: DataFrame,
    capacity: int = 2048,
    max_documents: int | None = None,
    max_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02),
    rule: str = "norm",
    shard_rows: int = 16_384,
) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (with a ``length`` of at most ``capacity``).

    A sequence keeps three budgets: ``capacity`` tokens, ``max_documents``
    pieces and ``max_attention`` for the sum of squared lengths; the last two
    default to what the token budget implies.  Pieces are packed in shards of
    about ``shard_rows`` rows, so no task grows with the input; a shard costs
    at most a few part-filled sequences.  ``pieces`` should be a written
    table: its row order decides the shards and must be the same in a retry.
    """
    limits = np.array([capacity, max_documents or capacity, max_attention or float(capacity) ** 2], dtype=np.float64)
    weight = np.array(weights, dtype=np.float64)
    rows = pieces.count()
    shards = max(1, -(-rows // shard_rows))
    out = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["shard"].iloc[0])
        frame = frame.drop(columns="shard").reset_index(drop=True)
        length = frame["length"].to_numpy(dtype=np.float64)
        full = length >= capacity
        bins = np.empty(len(frame), dtype=np.int64)
        offset = np.zeros(len(frame), dtype=np.int64)
        rest = np.flatnonzero(~full)
        demand = np.stack([length[rest], np.ones(len(rest)), length[rest] ** 2], axis=1)
        owner, order, used = best_fit(demand, limits, weight, rule)
        bins[rest] = owner
        bins[full] = used + np.arange(int(full.sum()))
        filled = np.zeros(used, dtype=np.int64)
        for item in order:
            offset[rest[item]] = filled[owner[item]]
            filled[owner[item]] += int(length[rest[item]])
        return frame.assign(sequence_id=bins + (shard << 40), offset=offset)

    dealt = pieces.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, out)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, **options) -> DataFrame:
    """Tokenise, cut and pack ``docs``; one row per piece with its sequence and place.

    An empty table gives an empty result.
    """
    return pack(materialize(token_pieces(docs, tokenizer, capacity), "pieces"), capacity, **options)
