import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from loomery.llm import lines, mixing
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def test_lines_match_brute_force(odd, odd_rows):
    found = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in lines.dedup_lines(odd, min_docs=10).collect()]
    n = Counter()
    for r in odd_rows:
        n.update({key(x) for x in (r[1] or "").split("\n")})
    want = []
    for r in odd_rows:
        split = (r[1] or "").split("\n")
        stay = [x for x in split if not key(x) or n[key(x)] < 10]
        want.append((r[0], len(split), len(split) - len(stay), "\n".join(stay)))
    assert sorted(found, key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) >= 22


def test_lines_keep_clashing_columns_and_empty_tables(spark, odd):
    out = lines.dedup_lines(odd.where("doc_id < 2"), min_docs=2)
    assert {"row", "h1", "gone", "k1"} <= set(out.columns) and out.columns.count("n_lines") == 1
    assert {r["row"] for r in out.collect()} == {"other"}
    assert lines.dedup_lines(odd.limit(0)).count() == 0


def test_line_runs_are_the_same_for_any_batches(odd):
    one = {(r.h1, r.h2) for r in lines.line_counts(odd).where("n_docs >= 10").collect()}
    runs = lines.LineRuns(odd.sparkSession, 10, fanout=2)
    for k in range(5):
        runs.add(odd.where(F.pmod(F.hash("text"), F.lit(5)) == k))
    assert {(r.h1, r.h2) for r in runs.frequent().collect()} == one and one
    assert all(len(level) < 2 for level in runs.levels)


def test_line_dedup_runs_no_python(odd):
    plan = lines.dedup_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def counted(odd):
    return odd.select("doc_id", "source", "epoch", mixing.count_words(F.col("text")).alias("n_tokens"))


def test_mix_uses_every_document_and_keeps_quotas(odd):
    docs = counted(odd)
    weights = {r.sid: r for r in mixing.mix_weights(docs, 0.97, 6.0).collect()}
    rows = mixing.mix(docs, 0.97, 6.0, block_tokens=500).collect()
    tokens, times = defaultdict(int), Counter()
    for r in rows:
        tokens["" if r.source is None else "=" + r.source] += r.n_tokens
        times[(r.doc_id, r.source, r.n_tokens)] += 1
    have = Counter((r.doc_id, r.source, r.n_tokens) for r in docs.collect())
    assert all(times[k] >= n for k, n in have.items())
    largest = max(k[2] for k in have)
    for sid, w in weights.items():
        assert w.quota - largest < tokens[sid] <= w.quota
    share = [w.quota / sum(x.quota for x in weights.values()) for w in weights.values()]
    entropy = -sum(p * math.log(p) for p in share) / math.log(len(share))
    assert entropy == pytest.approx(0.97, abs=0.01) or max(w.quota / w.tokens for w in weights.values()) == pytest.approx(6.0, rel=0.01)


def test_repetition_limit_wins(spark):
    docs = spark.createDataFrame([(i, "big", 10) for i in range(200)] + [(1000, "small", 10), (1001, None, 0)], "doc_id long, source string, n_tokens long")
    weights = {r.sid: r for r in mixing.mix_weights(docs, 1.0, 3.0).collect()}
    assert set(weights) == {"=big", "=small"}
    assert weights["=small"].quota / weights["=small"].tokens == pytest.approx(3.0, abs=0.11)
    with pytest.raises(ValueError):
        mixing.mix_weights(docs, 0.9, 2.0, budget=10_000)


def test_blocks_hold_each_source_by_weight(spark):
    docs = spark.createDataFrame([(i, "a" if i % 4 else "b", 5 + i % 3) for i in range(4000)], "doc_id long, source string, n_tokens long")
    mixed = mixing.with_positions(mixing.mix(docs, 0.95, 4.0, block_tokens=4000)).collect()
    per, places = defaultdict(Counter), defaultdict(list)
    for r in mixed:
        per[r.block][r.source] += r.n_tokens
        places[r.block].append(r.position)
    share = [c["a"] / (c["a"] + c["b"]) for c in per.values()]
    assert len(per) > 5 and max(share) - min(share) < 0.03
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())


def test_mixing_stage_keeps_the_order_of_the_mix(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "MIX_BLOCK", 1000)
    docs = spark.createDataFrame([(i, "a" if i % 4 else "b", "some words " * (2 + i % 3)) for i in range(2000)], "doc_id long, source string, text string")
    counts = docs.select("doc_id", "source", mixing.count_words(F.col("text")).alias("n_tokens"))
    mixed = mixing.with_positions(mixing.mix(counts, corpus_pipeline.MIX_ENTROPY, corpus_pipeline.MIX_REPETITION, block_tokens=1000))
    want = [r.doc_id for r in mixed.orderBy("block", "position").collect()]
    assert [r.doc_id for r in corpus_pipeline.mixing_stage(spark, docs, "").collect()] == want and len(want) >= 2000


def test_mix_of_nothing(odd):
    assert mixing.mix(counted(odd).limit(0)).count() == 0

