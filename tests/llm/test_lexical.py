import math
import random
import re
from collections import Counter

import numpy as np
from loomery.llm import lexical
from loomery.llm.lexical import radix_order, rank_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, k=10):
    held = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    n_docs, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = {}
    for i, t in set(items):
        if i is not None:
            asked.setdefault(i, Counter()).update(TERM.findall(lower(t)))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, c in held:
            n = sum(c.values())
            if not n:
                continue
            m = 25 + (75 * n * n_docs) // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w, q in terms.items() if c[w])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r, None if miss else d, -s) for r, (s, miss, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = [f"W{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)] + ["Été", "ÉTÉ", "x_y", "a-b", "日本"]
    make = lambda most: " ".join(rng.choice(words) for _ in range(rng.randrange(most)))
    docs = [(i, make(80)) for i in range(n)]
    docs += [(n + i, docs[5][1] + " the tail") for i in range(40)] + [docs[3], docs[3], (None, docs[4][1]), (None, None), (n + 50, ""), (n + 51, "-- \x00 --"), (n + 52, " ".join(rng.choice(words) for _ in range(30000)))]
    items = [(i, make(12) + " the") for i in range(25)] + [(30, None), (31, ""), (None, "w1 w2"), (32, "never-seen"), (33, "W1 w1 W1 tail"), (33, "Été"), (34, "W2"), (34, "W2")]
    return docs, items


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_ranks_are_those_of_brute_force(spark):
    docs, items = corpus(300)
    got = rank_documents(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == brute(docs, items)


def test_small_blocks_and_chunks_give_the_same_rows(spark, monkeypatch):
    docs, items = corpus(120, 8)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 40)
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 3)
    assert lexical.dealt(lexical.item_terms(i))[1] > 2
    assert rows(rank_documents(d, i, 3)) == want


def test_ties_go_to_the_smaller_id(spark):
    docs = [(i, "same words here") for i in range(50, 0, -1)]
    got = rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "words")], "item_id long, text string"), 5)
    assert rows(got) == brute(docs, [(1, "words")], 5)
    docs.append((99, "other"))
    got = rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "other same")], "item_id long, text string"), 5)
    assert rows(got) == brute(docs, [(1, "other same")], 5)


def test_empty_tables(spark):
    none = lambda key: spark.createDataFrame([], f"{key} long, text string")
    one = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rank_documents(none("doc_id"), one).count() == 0
    assert rank_documents(one.withColumnRenamed("item_id", "doc_id"), none("item_id")).count() == 0


def test_radix_order():
    keys = np.random.default_rng(2).integers(0, 1 << 40, 5000)
    keys[:2000] = keys[2000:4000]
    assert (radix_order(keys, 40) == np.argsort(keys, kind="stable")).all()
    assert (radix_order(keys & 7, 3) == np.argsort(keys & 7, kind="stable")).all()
