"""Summaries of runs and streams, evaluation sets, augmented pairs and reports on small cases."""

import json

from loomery.operators import curate as Q
from loomery.operators import evaluate as E
from loomery.sources.sinks import write_report

RUN = "label string, failure string, expected_found boolean, first_token double, total double"


def test_runs_without_a_token_count_with_no_time(spark):
    rows = [("a", "none", True, 1.0, 3.0), ("a", "timeout", None, None, 5.0), ("a", "none", False, 0.5, None), ("b", "http_error", None, None, None)]
    found = {r.label: tuple(r)[1:] for r in E.run_summary(spark.createDataFrame(rows, RUN)).collect()}
    assert found == {"a": (3, 1, 1, 0.5, 2.667), "b": (1, 1, 0, 0.0, 0.0)}
    assert E.run_summary(spark.createDataFrame([], RUN)).collect() == []


def test_speed_counts_from_the_first_token(spark):
    kind = "request long, first_token double, total double, answer string"
    rows = [(1, 1.0, 3.0, "abcd"), (2, None, 4.0, None), (3, 2.0, 2.0, "xy")]
    speed = {r.request: (r.n_chars, r.chars_per_sec) for r in E.stream_speed(spark.createDataFrame(rows, kind)).collect()}
    assert speed == {1: (4, 2.0), 2: (0, 0.0), 3: (2, 2000.0)}
    assert tuple(E.stream_summary(spark.createDataFrame(rows, kind)).first()) == (3, 1.0, 3.0, 667.3)
    assert tuple(E.stream_summary(spark.createDataFrame([], kind)).first()) == (0, None, None, None)


def test_an_evaluation_set_counts_within_its_domains(spark):
    kind = "pos long, domain string, question string, answer string, source_doc string, place long, note string"
    rows = [(i, ("Law & Order", "finance", "other", None)[i % 4], f"q{i}", None if i == 4 else "x" * i, f"d{i}", -i, "n") for i in range(4000)]
    found = E.evaluation_set(spark.createDataFrame(rows, kind).repartition(7).drop("place"), ("Law & Order", "finance"), "50%set").collect()
    assert sorted(r.id for r in found) == sorted(f"50%set_{d}_{n:03d}" for d in ("laworder", "finance") for n in range(1, 1001))
    by = {r.id: r for r in found}
    assert by["50%set_laworder_002"].expected is None and by["50%set_laworder_002"].difficulty == "easy"
    assert by["50%set_finance_1000"].query == "q3997" and by["50%set_finance_1000"].difficulty == "hard"
    assert E.evaluation_set(spark.createDataFrame([], kind).drop("place"), ("finance",), "s").collect() == []


def test_augmentations_get_no_variants(spark):
    kind = "pos long, question string, answer string, instruction string, is_augmented boolean, note string"
    pairs = spark.createDataFrame([(1, "a", "x", "a", False, "n"), (2, "b", "y", "b", True, "n"), (3, "c", None, "c", None, None), (None, "d", "z", "d", False, "n")], kind)
    variants = spark.createDataFrame([(1, "A"), (1, "AA"), (2, "B"), (3, "C"), (3, None), (9, "Z"), (None, "D")], "pos long, variant string")
    rows = Q.augmented(pairs, variants)
    assert rows.columns == pairs.columns and rows.count() == 7
    new = sorted((r.pos, r.question, r.instruction, r.answer, r.note) for r in rows.collect() if r.is_augmented and r.pos != 2)
    assert new[:2] == [(1, "A", "A", "x", "n"), (1, "AA", "AA", "x", "n")] and new[2][:4] == (3, "C", "C", None)
    assert Q.augmented(pairs, variants.limit(0)).count() == 4


def test_a_report_is_one_file_and_can_be_replaced(spark, tmp_path):
    path = str(tmp_path / "report")
    for label in ("first", "second"):
        write_report(spark.createDataFrame([(label, 3, {"timeout": 1})], "label string, n_runs int, failures map<string, int>"), path)
    files = list((tmp_path / "report").glob("part-*"))
    assert len(files) == 1
    assert json.loads(files[0].read_text()) == {"label": "second", "n_runs": 3, "failures": {"timeout": 1}}
