import random
import re
from collections import Counter

import numpy as np
import pytest
from loomery.llm import cover

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    texts = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def found(df):
    rows = df.collect()
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=str)


def corpus(seed):
    """Passages at every residue and distance, copies, near copies, loops and edges."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [fresh(n) for n in (33, 34, 35, 36, 40, 55, 80)]
    texts = []
    for p in passages:
        for _ in range(40 if len(p) in (40, 80) else 9):
            texts.append(fresh(rng.randrange(50)) + p + fresh(rng.randrange(50)))
    base = fresh(150)
    for _ in range(30):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        texts.append(t[rng.randrange(8) : 150 - rng.randrange(8)])
    texts += [["la"] * n for n in (34, 35, 36, 90)] + [fresh(5) + (fresh(12) * 6) + fresh(9), passages[3] + fresh(1) + passages[3], passages[6][:35], passages[6][45:]]
    rng.shuffle(texts)
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(t)) for i, t in enumerate(texts)]
    return [*rows, (900, None), (901, ""), (902, " \n"), (903, "few words"), rows[3], rows[4], (None, rows[5][1]), (None, None)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("window", [35, 10])
def test_repeats_match_brute_force(spark, seed, window):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "other") for r in rows], "doc_id long, text string, kept string").repartition(5)
    assert found(cover.remove_repeated_words(docs, window)) == brute(rows, window)


def test_every_pair_of_residues_shares_an_anchor():
    for period, residues in cover.COVERS.items():
        for a in range(period):
            for b in range(period):
                assert any((a + k) % period in residues and (b + k) % period in residues for k in range(period))


def test_short_segments_give_the_same_anchors(monkeypatch):
    many = [t for _, t in corpus(7) if t]
    buf = np.frombuffer("\n".join(many).encode(), dtype=np.uint8)
    keys = cover.word_keys(buf, np.array([0, len(buf)]))
    whole = [np.concatenate(x) for x in zip(*cover.anchors(*keys, 1, 35), strict=True)]
    monkeypatch.setattr(cover, "SEGMENT", 64)
    parts = [np.concatenate(x) for x in zip(*cover.anchors(*keys, 1, 35), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_a_batch_sends_each_row_once_and_few_surroundings_of_a_key():
    key = np.array([5] * 10 + [6] * 3 + [7], dtype=np.uint64)
    near = np.array([1, 1, 2, 3, 4, 5, 6, 7, 8, 8, 1, 1, 1, 9], dtype=np.uint64)
    got = cover.asked_rows(key, near, np.arange(14), np.arange(14)).to_pydict()
    asked = [(k, n, s) for k, n, s in zip(got["key"], got["near"], got["state"], strict=True) if k in (5, 6, 7)]
    assert asked == [(5, 1, 3), (5, 2, 2), (5, 3, 2), (5, 4, 2), (6, 1, 1), (7, 9, 0)]
    assert len(got["key"]) == 14 and len(set(got["key"])) == 3 + 8


def test_empty_table(spark):
    assert cover.remove_repeated_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0
