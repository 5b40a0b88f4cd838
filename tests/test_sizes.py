"""Searches whose work must not be a product of row by row: against brute force, and by their plans."""

import math
import random

import pytest
from loomery.operators import curate, evaluate, search
from loomery.sources import readers


def cosine(a, b):
    if a is None or b is None:
        return None
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else math.nan


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_vectors_meet_in_blocks(spark):
    """copies, a zero vector (no number, first as in SQL; an error before) and a null one (last); no row-by-row product."""
    rnd = random.Random(3)
    rows = {i: [rnd.uniform(-1, 1) for _ in range(5)] for i in range(80)}
    rows |= {80 + i: rows[3] for i in range(6)} | {90: [0.0] * 5, 91: None}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 10 in (0, 1)")
    order = lambda q, i: (lambda s: (2, 0, i) if s is None else (0, 0, i) if math.isnan(s) else (1, -round(s, 9), i))(cosine(rows[q], rows[i]))
    for k in (4, 200):
        want = sorted((q, n, i) for q in rows if q % 10 in (0, 1) for n, i in enumerate(sorted((i for i in rows if i != q), key=lambda i: order(q, i))[:k], 1))
        found = search.vector_topk(df, asked, k, block=7)
        assert sorted((r.query_id, r["rank"], r.id) for r in found.collect()) == want
        assert "FlatMapCoGroupsInArrow" in plan(found) and "NestedLoop" not in plan(found) and "CartesianProduct" not in plan(found)


def test_best_similarity_of_a_source_is_found_in_blocks(spark):
    """no pair of a row and a window is a row."""
    rnd = random.Random(4)
    vector = lambda: [rnd.uniform(-1, 1) for _ in range(4)]
    pairs = [(i, rnd.choice([1, 2, 9, None]), vector()) for i in range(60)] + [(60, 1, None)]
    sources = [(rnd.choice([1, 2, None]), vector()) for _ in range(50)] + [(1, None)]
    best = {(p, s): max((sum(map(float.__mul__, v, w)) for t, w in sources if v and w and s is not None and t == s), default=None) for p, s, v in pairs}
    out = curate.grounded(spark.createDataFrame(pairs, "pos long, source_doc long, vector array<double>"), spark.createDataFrame(sources, "source_doc long, vector array<double>"))
    assert {(r.pos, r.source_doc): r.similarity for r in out.collect()} == {k: v if v is None else pytest.approx(v) for k, v in best.items()}
    assert "FlatMapCoGroupsInArrow" in plan(out) and "zip_with" not in plan(out)


def test_labels_are_counted_not_listed(spark):
    """F8: the same measures as by listed pairs."""
    rnd = random.Random(5)
    rows = spark.createDataFrame([(i, rnd.choice([1, 2, 3, None])) for i in range(60)] + [(60, 7)], "id long, label int")
    asked = rows.where("id % 4 = 0")
    results = spark.createDataFrame([(q, n, i) for q in range(0, 64, 4) for n, i in enumerate(rnd.sample(range(60), 6), 1)], "query_id long, rank long, id long").where("query_id <> id")
    truth = rows.selectExpr("id", "label").join(asked.selectExpr("id as query_id", "label"), "label").where("id <> query_id")
    assert evaluate.label_metrics(results, rows, asked, 5).collect() == evaluate.retrieval_metrics(results, truth, 5).collect()


def test_bm25_makes_no_row_of_a_posting(spark):
    """the same scores as by postings, in many small chunks and with empty texts; words are exploded only to be counted."""
    rnd = random.Random(6)
    docs = [(i, " ".join(rnd.choice(["a", "b", "c", "de", "fg", "h", f"w{i % 7}"]) for _ in range(rnd.randint(0, 30)))) for i in range(90)] + [(90, None), (91, docs_copy := "a b c de"), (92, docs_copy)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame([(1, "a de w3 w3"), (2, "unknown"), (3, None), (4, "h fg c"), (5, "w1 w2 A")], "item_id long, text string")
    want = search.ranked(search.bm25_scores(d, q, "doc_id", "text", "item_id", "text").where("score > 0"), 7)
    key = lambda rows: sorted((r.query_id, r["rank"], r.id, round(r.score, 8)) for r in rows)
    found = search.bm25_topk(d, q, 7)
    assert key(found.collect()) == key(want.collect())
    assert "Generate explode" not in plan(found) and "MapInArrow" in plan(found)


def test_items_are_found_by_a_word_that_they_hold(spark):
    """the same as asking every text for every item."""
    rnd = random.Random(7)
    word = lambda: rnd.choice(["a", "bb", "Ccc", "ΣΑΣ", "x" * 9])
    docs = [(f"s{i}", rnd.choice([" ", "\n", "　", "  "]).join(word() for _ in range(rnd.randint(0, 12)))) for i in range(120)] + [("n", None), ("e", "")]
    items = [(i, " ".join(word() for _ in range(rnd.randint(0, 4)))) for i in range(40)] + [(40, " bb "), (41, None), (42, "c bb C"), (43, "")]
    found = search.holding(spark.createDataFrame(docs, "id string, text string"), spark.createDataFrame(items, "query_id long, item string"), 9)
    assert sorted((r.query_id, r.id) for r in found.collect()) == sorted((q, i) for i, t in docs for q, x in items if t is not None and x is not None and x in t)


def test_texts_go_to_a_tokenizer_in_parts():
    """not a whole Arrow batch at once."""
    texts = ["ab", "", "cdef", "g" * 20, "h"]
    assert list(curate.by_size(texts, 6)) == [["ab", "", "cdef"], ["g" * 20], ["h"]] and list(curate.by_size([], 6)) == []


def test_small_files_leave_together():
    """a batch of rows, not a batch for every file."""
    held = readers.gathered([("a", 3), ("b", 3), ("c", 9), ("d", 1)], lambda x: x[1], 2, 7)
    assert list(held) == [[("a", 3), ("b", 3)], [("c", 9)], [("d", 1)]]
