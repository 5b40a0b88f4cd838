"""Reading and writing files, and the streams."""

import json

import pytest
from loomery.functions.signals import markdown_table
from loomery.sources import files, sinks
from loomery.streaming import flows
from pyspark.sql import functions as F


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.md").write_text("intro\n# The title \ntext\n# Second", encoding="utf-8")
    (tmp_path / "b c.txt").write_text("﻿plain # not a title", encoding="utf-8")
    (tmp_path / "k.txt").write_bytes("한국어 문서".encode("cp949"))
    (tmp_path / "none.md").write_text("", encoding="utf-8")
    (tmp_path / "odd.txt").write_bytes(b"%PDF-1.7 not text")
    (tmp_path / "deck.pptx").write_bytes(b"PK\x03\x04....")
    (tmp_path / "old.bin").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"x")
    (tmp_path / "what.xyz").write_bytes(b"?")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.txt").write_text("not read")
    return str(tmp_path)


def test_scan_resolves_formats_by_content_before_names(spark, folder):
    found = {r.name: r.format for r in files.scan_folder(spark, folder).collect()}
    assert found == {"a.md": "md", "b c.txt": "txt", "k.txt": "txt", "odd.txt": "pdf", "deck.pptx": "pptx", "old.bin": "ole", "what.xyz": None}
    assert [r.name for r in files.scan_folder(spark, folder, formats=("pdf",)).collect()] == ["odd.txt"]
    assert {r.name for r in files.scan_folder(spark, folder, names=("a.md", "k.txt", "not there")).collect()} == {"a.md", "k.txt"}


def test_texts_have_titles_and_their_encoding(spark, folder):
    got = {r.doc_id: (r.title, r.content) for r in files.text_documents(files.scan_folder(spark, folder)).collect()}
    assert got == {"a.md": ("The title", "intro\n# The title \ntext\n# Second"), "b c.txt": ("b c", "plain # not a title"), "k.txt": ("k", "한국어 문서")}


def test_html(spark):
    page = """<html><head><title> A &amp; B </title><style>p {x}</style></head><body><nav>menu</nav><h1>Top</h1><p>One <b>bold</b>
      line</p><script>var x = "<p>no</p>";</script><h3>Sub</h3><div>two<br>three</div>
      <table><tr><th>h1</th><th>h2</th></tr><tr><td>1</td><td></td></tr></table>tail</body></html>"""
    rows = [(1, page), (2, "<h1>Only <i>this</i></h1>"), (3, "no tags"), (4, None), (5, "")]
    got = {r.name: (r.title, r.content, r.tables) for r in files.html_documents(spark.createDataFrame(rows, "name long, text string")).collect()}
    assert got[1] == ("A & B", "# Top\nOne bold line\n### Sub\ntwo\nthree\nh1\nh2\n1\ntail", [[["h1", "h2"], ["1", ""]]])
    assert got[2] == ("Only this", "# Only this", []) and got[3] == (None, "no tags", []) and got[4] == got[5] == (None, "", [])
    tables = files.html_documents(spark.createDataFrame(rows[:1], "name long, text string")).select(markdown_table(F.col("tables")[0]).alias("t"))
    assert tables.first().t == "| h1 | h2 |\n| --- | --- |\n| 1 |  |"


def test_pairs_of_both_dialects(spark, tmp_path):
    path = tmp_path / "qa.json"
    path.write_text(json.dumps([{"question": "q1", "answer": "a1", "source_doc": "d", "extra": 1}, {"instruction": "i2", "output": "o2", "category": "c"}, {"output": "neither"}, {"instruction": "i3", "input": "more", "output": "o3"}]))
    got = sorted(map(tuple, files.read_pairs(spark, str(path)).collect()))
    assert got == [("i2", "o2", "i2", "", "c"), ("i3", "o3", "i3", "", ""), ("q1", "a1", "q1", "d", "")]
    got = {r.question: r.answer for r in files.read_instructions(spark, str(path)).where("instruction <> ''").collect()}
    assert got == {"i2": "o2", "i3\nmore": "o3"}


def test_round_trips_of_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("q", "a", None, "d", "c"), ("q2", "a\nb", "i2", "d", "")], "question string, answer string, instruction string, source_doc string, category string")
    sinks.write_pairs(pairs, f"{tmp_path}/pairs")
    assert sorted(map(tuple, files.read_training(spark, f"{tmp_path}/pairs", pairs.schema).collect()), key=str) == sorted(map(tuple, pairs.collect()), key=str)
    sinks.write_alpaca(pairs, f"{tmp_path}/alpaca")
    assert {(r.instruction, r.input, r.output) for r in files.read_training(spark, f"{tmp_path}/alpaca").collect()} == {("q", "", "a"), ("i2", "", "a\nb")}
    assert sinks.write_training(pairs.select(F.to_json(F.struct("question")).alias("j")), "j", f"{tmp_path}/train") == 2
    with pytest.raises(ValueError):
        sinks.write_training(pairs.limit(0), "question", f"{tmp_path}/nothing")
    sinks.write_corpus(pairs, pairs.limit(1), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/corpus.parquet").count() == 2 and spark.read.parquet(f"{tmp_path}/qa.parquet").count() == 1


def test_questions_profiles_and_manifests(spark, tmp_path):
    (tmp_path / "q.txt").write_text("  one \n\n \ntwo\n")
    assert [r.question for r in files.read_questions(spark, f"{tmp_path}/q.txt").collect()] == ["one", "two"]
    by = spark.range(1).select(F.create_map(F.lit("c"), F.array(F.lit("x"), F.lit("y"))).alias("m"))
    assert sorted(map(tuple, files.flatten_categories(by, "m").collect())) == [("c", "x"), ("c", "y")]
    (tmp_path / "p.json").write_text('{"name": "n",\n "keywords": ["k"]}')
    (tmp_path / "bad.json").write_text("{broken")
    assert tuple(files.read_profile(spark, f"{tmp_path}/p.json").first()) == ("n", None, ["k"])
    assert files.read_profile(spark, f"{tmp_path}/bad.json").first().name is None
    assert files.read_manifest(spark, f"{tmp_path}/bad.json").count() == 0 and files.read_manifest(spark, f"{tmp_path}/not-there.json").count() == 0


def test_hashes_are_saved_only_after_success(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a")
    (tmp_path / "in" / "b.txt").write_text("b")
    seen = []
    note = lambda df: seen.append(sorted(r.name for r in df.collect()))
    args = (spark, f"{tmp_path}/in", f"{tmp_path}/state")
    with pytest.raises(ZeroDivisionError):
        flows.process_changes(*args, lambda df: 1 / 0)
    flows.process_changes(*args, note)
    flows.process_changes(*args, note)
    (tmp_path / "in" / "a.txt").write_text("changed")
    (tmp_path / "in" / "c.txt").write_text("c")
    flows.process_changes(*args, note)
    assert seen == [["a.txt", "b.txt"], [], ["a.txt", "c.txt"]]


def test_a_gap_of_exactly_the_limit_keeps_a_session(spark, tmp_path):
    rows = [(1, 0), (1, 3600), (1, 7201), (2, 0)]
    events = spark.createDataFrame(rows, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    events.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    got = flows.run_once(flows.sessions(stream), f"{tmp_path}/run", "complete").collect()
    assert sorted((r.user_id, r.n_events) for r in got) == [(1, 1), (1, 2), (2, 1)]
