import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from loomery.llm import jaccard, quality, repetition, substrings
from loomery.llm.components import connected_components
from loomery.llm.kernels import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def shingles(t):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same or common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common) and None not in (rows[i][0], rows[j][0]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_copies():
    """Chains and a large group of near copies, a passage in many texts, sets at the threshold."""
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    base = fresh(100)
    for _ in range(90):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(100)] = f"n{rng.randrange(10**6)}"
        texts.append(t)
    chain = fresh(80)
    for k in range(12):
        texts.append(list(chain))
        chain = chain[4:] + fresh(4)
    passage = fresh(30)
    texts += [fresh(rng.randrange(0, 40)) + passage + fresh(rng.randrange(0, 40)) for _ in range(70)]
    for extra in (0, 1, 2, 20, 25, 33, 34, 40):
        texts.append(base[:96] + fresh(extra))
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [3, 24])
def test_components_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rows = near_copies()
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == sorted(brute_components(rows))


def test_hot_families_of_short_texts_match_brute_force(spark):
    family = lambda name, n, k, first: [(first + i, " ".join([f"{name}{j}" for j in range(n)] + [f"own{first + i}"] * (i != k))) for i in range(31)]
    rows = family("b", 8, 15, 0) + family("c", 7, 14, 100) + family("d", 9, 15, 200)
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == sorted(brute_components(rows))


def test_whole_set_meets_a_longer_prefix_past_its_own(spark):
    words = [f"t{i}" for i in range(1500)]
    hashes = next(shingle_sets(pa.array(words), 1))[1]
    words = [words[i] for i in hashes.argsort()]
    shared, own = words[:15], iter(words[15:])
    more = lambda n: [next(own) for _ in range(n)]
    rows = [(1000, shared), (1001, shared + more(5))]
    for first in (0, 2000):
        rows += [(first + i, [shared[0], shared[4], shared[5], *more(17)]) for i in range(15)]
        rows.append((first + 20, shared[1:4] + more(17)))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, words=1).collect()}
    assert found == {i: 1000 if i == 1001 else i for i, _ in rows}


def test_components_of_odd_rows(odd, odd_rows):
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(odd).collect()}
    want = {w for w in brute_components([r[:2] for r in odd_rows]) if w[0] is not None}
    assert {f for f in found if f[0] is not None} == want
    assert (None, len(shingles(odd_rows[6][1])), 6) in found and (None, 0, None) in found
    assert jaccard.jaccard_components(odd).count() == len(odd_rows)
    assert jaccard.jaccard_components(odd.limit(0)).count() == 0
    kept = [r.doc_id for r in jaccard.keep_one(odd).collect()]
    assert 7 not in kept and 6 in kept


def test_connected_components(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    links = spark.createDataFrame(path + star + [(7, 7), (None, 3), (40, 39)], "u long, v long")
    found = dict(map(tuple, connected_components(links).collect()))
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert connected_components(links.limit(0)).count() == 0


def brute_repeats(texts, n):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if count[d[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((len(d), sum(gone), len(spans), spans, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def repeats(seed):
    rng = random.Random(seed)
    alphabet = "abcdé \n" if seed % 2 else "ab"
    fresh = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [fresh(rng.choice([99, 100, 101, 150, 400])) for _ in range(5)]
    texts = [fresh(rng.randrange(300)) + rng.choice(shared)[rng.randrange(3) :] + fresh(rng.randrange(300)) for _ in range(25)]
    texts += ["ab" * 300, "x" * 101, "x" * 100, "x" * 99, texts[0], texts[0][1:], None, "", texts[3] + texts[3]]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_match_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(substrings, "GRAM", 16 if seed == 2 else 64)
    monkeypatch.setattr(substrings, "SEGMENT", 200)
    texts = repeats(seed)
    rows = substrings.remove_repeats(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, u int"), 100).orderBy("doc_id").collect()
    got = [(r.n_bytes, r.n_removed, r.n_spans, [tuple(s) for s in r.spans], bytes(r.kept)) for r in rows]
    assert got == brute_repeats(texts, 100)


def test_repeats_of_odd_rows(odd, odd_rows):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in substrings.remove_repeats(odd, 400).collect()), key=str)
    want = sorted(((d[0], *w[:2]) for d, w in zip(odd_rows, brute_repeats([r[1] for r in odd_rows], 400), strict=True)), key=str)
    assert got == want and any(w[2] for w in want)
    assert substrings.remove_repeats(odd.limit(0)).count() == 0


def test_pipeline_stages_match_plain_versions(spark, odd, odd_rows, tmp_path):
    sf = str(tmp_path)
    odd.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i not in (23, 24)), 0) for i in range(28)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{sf}/documents.parquet")
    inputs = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        inputs[name] = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        out = stage(spark, docs, sf)
        assert out.columns == odd.columns, name
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.schema(odd.schema).parquet(f"{sf}/{name}")
    names = list(stages)
    inputs[names[-1]] = [(r.doc_id, r.text, r.source) for r in docs.collect()]

    # the classifier: rows go or stay as they are
    scored = quality.classify_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert Counter(inputs["line dedup"]) == Counter((r.doc_id, r.text, r.source) for r in scored.where("kept").collect())
    # lines of ten documents go
    blanks = " \t\n\x0b\x0c\r"
    key = lambda x: lower(x.strip(blanks))
    seen = Counter(k for _, t, _ in inputs["line dedup"] for k in {key(x) for x in (t or "").split("\n")})
    cut = lambda t: t if t is None else "\n".join(x for x in t.split("\n") if not key(x) or seen[key(x)] < 10)
    assert Counter(inputs["n-gram Jaccard join"]) == Counter((d, cut(t), s) for d, t, s in inputs["line dedup"])
    # the least of each component stays
    rows = inputs["n-gram Jaccard join"]
    least = {d: c for d, _, c in brute_components([r[:2] for r in rows]) if d is not None}
    assert Counter(inputs["source mixing"]) == Counter(r for r in rows if r[0] is None or least[r[0]] == r[0])
    # every document with a source of some words is in the mix, as often as its quota has epochs, or once more
    words = lambda t: len(WORD.findall(t or ""))
    tokens, times = Counter(), Counter(inputs["best-fit packing"])
    for _, t, s in inputs["source mixing"]:
        tokens[s] += words(t)
    assert set(times) == {r for r in inputs["source mixing"] if tokens[r[2]]}
    once = Counter(inputs["source mixing"])
    for s in tokens:
        epochs = [times[r] / once[r] for r in times if r[2] == s]
        assert not epochs or max(epochs) - min(epochs) <= 1
    # packing: whole texts, in pieces, within capacity
    from loomery.llm.queries import byte_bpe
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(byte_bpe()), Counter()
    for d, t, _ in inputs["best-fit packing"]:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want.update((d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    packed = stages["best-fit packing"](spark, docs, sf).collect()
    assert Counter(tuple(r)[:5] for r in packed) == want
    held = Counter()
    for r in packed:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 2048
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def test_shared_passages_do_not_multiply_candidates(spark, monkeypatch):
    """Texts put together from a pool of passages: rows are exact, and twice the texts take under three times the candidates."""
    made = {}
    write = jaccard.materialize

    def counted(df, label):
        out = write(df, label)
        if label == "candidates":
            made["n"] = out.count()
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    rng = random.Random(12)
    pool = [[f"p{i}w{rng.randrange(10**6)}" for _ in range(25)] for i in range(60)]
    texts = [[w for i in rng.sample(range(60), 8) for w in pool[i]] + [f"own{k}"] for k in range(360)]
    rows, n = [(i, " ".join(t)) for i, t in enumerate(texts)], []
    for part in (rows[:180], rows):
        found = jaccard.jaccard_components(spark.createDataFrame(part, "doc_id long, text string")).collect()
        assert sorted(map(tuple, found)) == sorted(brute_components(part))
        n.append(made["n"])
    assert n[1] <= 3 * n[0] + 50, n


def alternating(size):
    """A word on which powers of any base collide with those of its complement modulo 2**64."""
    bits = np.zeros(1, dtype=np.uint8)
    while len(bits) < size:
        bits = np.concatenate([bits, 1 - bits])
    return ["".join(x[b] for b in bits[:size]) for x in ("ab", "ba")]


@pytest.mark.parametrize("size", [1024, 2048, 100_000])
def test_long_words_and_lines_are_not_mixed_up(spark, size):
    one, two = alternating(size)
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_components(docs).collect())) == [(1, 1, 1), (2, 1, 2)]
    docs = spark.createDataFrame([(1, f"{one}\n{two}"), (2, f"{one}\n{one}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_dup_lines) for r in repetition.repetition_rules(docs).collect()) == [(1, 0), (2, 1)]


def test_a_cloud_of_copies_around_a_text_that_is_not_there_makes_few_candidates(spark, monkeypatch):
    """Each copy changes four words of a text of 150; hardly two of them are near enough to each other."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(250):
        t = list(base)
        for at in rng.sample(range(5, 145), rng.choice([1, 4, 4, 4, 4, 4, 4])):
            t[at] = f"n{rng.randrange(10**9)}"
        rows.append((i, " ".join(t)))
    made = []
    plain = jaccard.cross_candidates
    monkeypatch.setattr(jaccard, "cross_candidates", lambda *args: (made.append(plain(*args)), made[0])[1])
    monkeypatch.setattr(jaccard, "leaders", lambda groups, sizes, percent: plain_leaders(groups, sizes, percent).where("u % 3 = 0"))
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == sorted(brute_components(rows))
    assert made[0].count() < 0.15 * 250 * 249 / 2


plain_leaders = jaccard.leaders
