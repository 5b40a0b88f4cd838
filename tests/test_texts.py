"""Readers, tables in texts, sections with context, nouns, reranking, subsequences."""

import random
import time

import pytest
from loomery.functions import chunking, nouns, signals
from loomery.operators import evaluate, routing, search, textindex
from loomery.sources import readers, sinks
from pyspark.sql import functions as F


def test_a_broken_file_of_each_format_is_a_row_and_the_rest_goes_on(spark, tmp_path):
    good = {
        "a.txt": "plain text", "b.md": "intro\n# Title \nbody", "c.html": "<h1>Top</h1><p>one</p><table><tr><td>1</td></tr></table>", "d.json": '{"title": "T", "content": "C"}', "e.json": "[1, 2]",
        "f.jsonl": '{"a": 1}\n\n{"a": 2}\n', "g.csv": "x,y\n1,2\n", "h.txt": "한국어".encode("cp949"), "i.txt": "﻿marked", "j.txt": "wide".encode("utf-16"),
    }
    bad = {"A.txt": b"\xff0\xff\xff", "B.md": b"\x810", "C.html": b"<p>\xff\xff", "D.json": "{", "F.jsonl": '{"a": 1}\n{', "G.csv": 'x,y\n1,2,3\n"open', "K.pdf": b"%PDF-1.4"}
    for name, body in (good | bad).items():
        (tmp_path / name).write_bytes(body.encode() if isinstance(body, str) else body)
    got = {r.name: r for r in readers.read_folder(spark, str(tmp_path)).collect()}
    assert set(got) == set(good) | set(bad)
    assert all(got[n].error is None for n in good) and all(got[n].error and got[n].content is None for n in bad)
    assert {n: (got[n].title, got[n].content) for n in ("b.md", "d.json", "e.json", "h.txt", "i.txt", "j.txt")} == {"b.md": ("Title", good["b.md"]), "d.json": ("T", "C"), "e.json": ("e", "[1, 2]"), "h.txt": ("h", "한국어"), "i.txt": ("i", "marked"), "j.txt": ("j", "wide")}
    assert got["g.csv"].tables == [[["x", "y"], ["1", "2"]]] and got["c.html"].tables == [[["1"]]]
    assert got["K.pdf"].error == "LookupError: no reader for pdf"
    own = readers.READERS | {"pdf": lambda name, content: (name, f"{len(content)} bytes", [])}
    rows = spark.createDataFrame([("K.pdf", "pdf", b"%PDF"), ("n.txt", "txt", None), (None, "txt", b"x"), ("o", None, b"x")], "name string, format string, content binary")
    assert sorted(((r.name, r.content, r.error) for r in readers.read_files(rows, own).collect()), key=str) == [("K.pdf", "4 bytes", None), ("n.txt", "", None), ("o", None, "LookupError: no reader for None"), (None, "x", None)]


@pytest.mark.parametrize(("content", "name"), [(b"abc", "utf-8"), (b"\xef\xbb\xbfabc", "utf-8-sig"), ("한국".encode("cp949"), "euc-kr"), ("똠".encode("cp949"), "euc-kr"), ("x".encode("utf-16"), "utf-16")])
def test_encodings(content, name):
    assert readers.encoding_of(content) == name


def test_tables_in_texts(spark):
    texts = [None, "", "no table", "| a | b |\n|---|:-:|\n| 1 | 2 |\n|  | x y |", "t\n  |one|\nend\n|two|  \n| three |", "|", "| open\nclosed |", "|\n\n|x|", "\n".join(f"| {i} |" for i in range(3000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", signals.table_blocks(F.col("t")).alias("b"))
    got = {r.i: r.b for r in rows.collect()}

    def plain(text):
        out, held = [], []
        for line in [*(x.strip() for x in (text or "").split("\n")), ""]:
            if line.startswith("|") and line.endswith("|"):
                held.append(line)
            elif held:
                out.append("\n".join(held))
                held = []
        return out

    assert got == {i: plain(t) for i, t in enumerate(texts)}
    parts = rows.where("i in (3, 4)").select("i", F.explode("b").alias("b")).select("i", signals.table_parts(F.col("b")).alias("p")).collect()
    assert sorted((r.i, r.p.head, r.p.rows) for r in parts if r.i == 3) == [(3, ["a", "b"], [["1", "2"], ["", "x y"]])]
    assert sorted(r.p.rows for r in parts if r.i == 4) == [[["one"]], [["two"], ["three"]]] and all(r.p.head is None for r in parts if r.i == 4)


def test_chunks_know_their_sections():
    body = lambda c, n: (c * 9 + " ") * (n // 10)
    text = f"Ⅰ. One\n{body('a', 300)}\nⅡ. Two\nlost\n1. In\n{body('b', 900)}\n2. Side\n{body('c', 15_000)}\nⅢ. Three\nshort"
    got = chunking.context_chunks(text, 1000)
    assert [(i, c) for i, c, _, _ in got[:3]] == [("section_0_chunk_0", "[Ⅰ. One]"), ("section_1_chunk_0", "[Ⅱ. Two > 1. In]"), ("section_1_chunk_1", "[Ⅱ. Two > 2. Side]")]
    assert all(len(p) <= 12_000 and len(c) <= 1000 for _, _, p, c in got)
    assert got[1][2] == got[-1][2] and len(got[1][2]) == 12_000 and got[1][2].startswith("Ⅱ. Two\nlost")
    assert {c for _, c, _, _ in got[3:]} == {"[Ⅱ. Two]"} and not any("Three" in c for _, _, _, c in got)
    plain = "word " * 500
    assert [c for _, _, _, c in chunking.context_chunks(plain, 1000)] == [p for _, _, p, _ in chunking.context_chunks(plain, 1000)] == chunking.section_chunks(plain, 1000)
    small = "1. a\n2. b\n3. c"
    assert chunking.context_chunks(small, 1000) == [("chunk_0", "", small, small)]


def test_planted_nouns_are_found(spark):
    rng = random.Random(4)
    syllables = [chr(c) for c in range(0xAC00, 0xD7A4, 97)]
    planted = sorted({"".join(rng.choice(syllables) for _ in range(rng.choice([2, 2, 3, 4]))) for _ in range(80)})
    particles = ["", "은", "는", "이", "가", "을", "를", "에", "에서", "으로", "와", "과", "도"]
    texts = [" ".join(rng.choice(planted) + rng.choice(particles) for _ in range(40)) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in [*texts, None, "", "a 가 나"]], "text string")
    got = nouns.noun_counts(rows, "text", pattern="[가-힣]+")
    found = {r.noun: r.n for r in got.collect()}
    hit = set(found) & set(planted)
    assert len(hit) >= 0.9 * len(planted) and len(hit) >= 0.9 * len(found)
    stop = planted[0]
    assert stop not in {r.noun for r in nouns.noun_counts(rows, "text", pattern="[가-힣]+", stops=(stop,)).collect()}
    assert nouns.noun_counts(rows.limit(0), "text").count() == 0


def test_reranked_ties_go_by_falling_text_then_id(spark):
    pool = spark.createDataFrame([(1, i, 1.0 / i) for i in range(1, 7)] + [(2, 1, 0.5)], "query_id long, id long, score double")
    bodies = spark.createDataFrame([(1, "x b"), (2, "x c"), (3, "x c"), (4, "x y z"), (5, None), (6, "none")], "id long, body string")
    asked = spark.createDataFrame([(1, "X y"), (3, "unused")], "query_id long, question string")
    got = sorted(map(tuple, search.rerank(pool, bodies, asked, search.term_overlap, 5).select("query_id", "rank", "id", "rerank_score").collect()))
    assert got == [(1, 1, 4, 1.0), (1, 2, 3, 0.5), (1, 3, 2, 0.5), (1, 4, 1, 0.5), (1, 5, 6, 0.0), (2, 1, 1, 0.0)]


def test_longest_common_subsequences():
    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(30))] for _ in range(2))
        assert evaluate.longest_common(a, b) == table(a, b)
    long = [[str(rng.randrange(300)) for _ in range(2000)] for _ in range(2)]
    began = time.time()
    evaluate.longest_common(*long)
    assert time.time() - began < 1


def test_a_report_is_one_file(spark, tmp_path):
    sinks.write_report(spark.createDataFrame([(3, "x")], "pairs long, note string"), f"{tmp_path}/report")
    assert len(list((tmp_path / "report").glob("part-*"))) == 1
    assert tuple(spark.read.json(f"{tmp_path}/report").select("pairs", "note").first()) == (3, "x")


def test_the_index_finds_what_a_scan_finds_and_skips_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK", 8)
    monkeypatch.setattr(textindex, "SPREAD", 100)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(["The", "of"] * rng.randrange(1, 4) + [words[int(rng.paretovariate(0.6)) % 300] for _ in range(rng.randrange(40))])) for i in range(600)]
    docs += [(1000, None), (1001, ""), (1002, "w7 w7 w7 rare")]
    queries = [(1, "the rare w7"), (2, "w1 W2 w2 w250"), (3, "of the w9"), (4, "unknown"), (5, None), (6, "the")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    index = textindex.TextIndex(spark, f"{tmp_path}/index").build(d, "doc_id", "text", 4)
    plain = lambda df: sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.collect())
    assert plain(index.topk(q, 5)) == plain(search.bm25_topk(d, q, 5))
    asked = index._asked(q, "item_id", "text")
    assert index.needed(asked, 3).count() < index._read("blocks").join(asked, ["bucket", "term"]).count()
    # another object reads what is there; a new build replaces it
    assert plain(textindex.TextIndex(spark, f"{tmp_path}/index").topk(q, 2)) == plain(search.bm25_topk(d, q, 2))
    index.build(d.limit(0), "doc_id", "text")
    assert index.topk(q, 5).count() == 0


def test_query_sets_of_several_blocks_give_the_same_rows(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)], "vec_id long, embedding array<float>")
    plain = lambda df: sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in df.collect())
    assert plain(search.vector_topk(rows, rows, 4, block=7)) == plain(search.vector_topk(rows, rows, 4)) and len(plain(search.vector_topk(rows, rows, 4, block=7))) == 240
    queries = spark.createDataFrame([(i, f"a word{i} here") for i in range(9)], "query_id long, query string")
    skills = spark.createDataFrame([(f"s{i}", f"WORD{i}", i) for i in range(9)] + [("r", r"regex:word[3-5]", 50)], "skill string, trigger string, priority int")
    found = lambda block: sorted(map(tuple, routing.match_skills(queries, skills, block=block).collect()))
    assert found(3) == found(100) and len(found(3)) == 12


def test_a_plain_piece_that_looks_like_a_heading_names_no_section(spark):
    """only where a section begins is there a title; other spaces than ASCII's come off like SQL's."""
    body = "x" * 1596 + "5. And so on " + "y" * 2000
    made = f"Ⅰ. One\n· {'a' * 300}\nⅡ. Two\n· {'b' * 300}\nⅢ. Three\n{body}"
    pieces = chunking.context_chunks(made, 2000)
    assert [(c[0], c[1]) for c in pieces if c[0].startswith("section_2")] == [("section_2_chunk_0", "[Ⅲ. Three]"), ("section_2_chunk_1", "[Ⅲ. Three]"), ("section_2_chunk_2", "[Ⅲ. Three]")]
    assert any(c[3].startswith("5. And") for c in chunking.context_chunks(made.replace("x" * 1596, "x" * 1591), 2000))
    rows = spark.createDataFrame([(1, made.replace("x" * 1596, "x" * 1591)), (2, "1. short text"), (3, "\x85"), (4, "　\t")], "doc_id long, text string")
    got = sorted((r.doc_id, r.chunk_index, r.title) for r in chunking.chunk_sections(rows, 2000).collect())
    assert got == [(1, 0, "Ⅰ. One"), (1, 1, "Ⅲ. Three"), (1, 2, None), (1, 3, None), (2, 0, None), (3, 0, None)]
    assert chunking.section_chunks("Ⅰ. " + "a" * 600 + "\x85　\nⅡ. " + "b" * 600 + "\nⅢ. " + "c" * 600, 700)[0] == "Ⅰ. " + "a" * 600 + "\x85"
