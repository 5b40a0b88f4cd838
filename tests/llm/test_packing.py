import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from loomery.llm import packing
from loomery.llm.queries import byte_bpe


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe())


def test_texts_give_the_tokenizers_ids(tokenizer):
    texts = ["", "a", " a", "a ", "a  b", "don't stop", "x\n y", "x \ny", " x y", "été naïve 中文 test", "1234 5678,90", "a<|endoftext|>b", "<|endoftext|> <|endoftext|>x", "<|endoftext", "tab\tsep end", "\x1f x \x1c", "emoji 😀 !? ...", " \n"]
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "é", "'s", "'", "1", "中", ".", "\u3000", "\u200b", "X", "!!", "the", "ing", "😀", "\x85", "\xa0", "<|endoftext|>", "<|", "\u0301", "ß", "٣", "Ⅳ"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(20_000)]
    texts += [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}. '{chr(c)} \n{chr(c)}x" for c in range(1, 0x3000)]
    encoder = packing.PieceEncoder(byte_bpe())
    assert encoder.quick is not None
    for t, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encoder.encode(t), dtype="<u4").tolist() == want.ids, t


def test_files_of_other_kinds_take_the_tokenizer():
    import public_tokenizers

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.PieceEncoder(path)
    assert encoder.quick is None
    assert np.frombuffer(encoder.encode("Some words  HERE"), dtype="<u4").tolist() == Tokenizer.from_file(path).encode("Some words  HERE", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 4096, 5000])
def test_cut_leaves_only_the_first_piece_short(n):
    got = list(packing.cut(n, 2048))
    assert [s for s, _ in got] == list(np.cumsum([0] + [x for _, x in got[:-1]])) and sum(x for _, x in got) == n
    assert all(x == 2048 for _, x in got[1:]) and len(got) == -(-n // 2048)


def test_packing_is_whole_and_within_capacity(spark, odd, odd_rows, tokenizer):
    rows = packing.pack_documents(odd, byte_bpe(), 64, shard_rows=40).collect()
    want = []
    for r in odd_rows:
        ids = np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(r[0], k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 64))]
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.1 * -(-sum(r.length for r in rows) // 64) + 3
    assert packing.pack_documents(odd.limit(0), byte_bpe()).count() == 0


def test_documents_and_attention_bind_in_a_packed_table(spark, odd):
    rows = packing.pack_documents(odd, byte_bpe(), 64, max_documents=3, max_attention=3000.0 + 64**2, shard_rows=400).collect()
    free = packing.pack_documents(odd, byte_bpe(), 64, shard_rows=400).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r.length)
    assert all(len(b) <= 3 and sum(b) <= 64 and sum(x * x for x in b) <= 3000 + 64**2 for b in bins.values())
    assert sorted((r.doc_id is None, r.doc_id, r.piece, r.ids_crc32) for r in rows if r.doc_id) == sorted((r.doc_id is None, r.doc_id, r.piece, r.ids_crc32) for r in free if r.doc_id)
    bound = max(-(-sum(map(sum, bins.values())) // 64), -(-len(rows) // 3), -(-sum(x * x for b in bins.values() for x in b) // (3000 + 64**2)))
    assert len({r.sequence_id for r in free}) <= len(bins) <= 1.1 * bound + 2


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_budget_holds(rule):
    rng = np.random.default_rng(1)
    demand = np.stack([rng.integers(1, 70, 400), np.ones(400), np.zeros(400)], axis=1).astype(float)
    demand[:, 2] = demand[:, 0] ** 2
    capacity = np.array([100.0, 3.0, 6000.0])
    owner, order, used = packing.best_fit(demand, capacity, np.array([1.0, 0.5, 0.5]), rule)
    total = np.zeros((used, 3))
    np.add.at(total, owner, demand)
    assert (total <= capacity).all() and sorted(order) == list(range(400))
    assert used <= 1.25 * np.ceil(demand.sum(axis=0) / capacity).max()
    with pytest.raises(ValueError):
        packing.best_fit(np.array([[101.0, 1, 1]]), capacity, np.ones(3))
