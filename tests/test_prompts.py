"""Prompts, lines of decisions, hooks and token limits on small cases."""

import re

import pytest
from loomery.functions import prompts as P
from loomery.operators import corpus, curate, sessions, upkeep
from loomery.operators.hooks import POST_SEARCH, POST_SYNTHESIS, PRE_QUERY, Hooks, on_column, on_values
from loomery.plans import catalog
from loomery.plans.prompts import vocabulary
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def rules(text, most=4):
    """The plain reading of what core_rules keeps."""
    lines = (text or "").split("\n")
    heads = [i for i, line in enumerate(lines) if line == "규칙:" or (line.startswith("답변 구조") and line.endswith(":"))]
    kept = []
    for line in (x.strip() for x in lines[heads[0] + 1 if heads else 0 :]):
        if line.startswith(("{", "[참고", "질문:", "답변:", "##")) or len(kept) == most:
            break
        if line:
            kept.append(line.replace("{", "{{").replace("}", "}}"))
    return "\n".join(kept)


def test_core_rules_and_joined_prompts(spark):
    texts = [
        None, "", "\n \n", "a\nb\nc\nd\ne", "x\n규칙:\n one {a}\n\n two\n## next\nthree", "답변 구조 (short):\n{history}\nz", "규칙: not alone\nq", "규칙:", "x\n규칙:\n[참고 문서]\ny", "a\r\nb", "질문: q", "답변 구조:\n1\n2\n답변: x",
        "intro\n규칙:\n1\n2\n규칙:\n3\n4\n5",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in rows.select("i", P.core_rules(F.col("t")).alias("r"), P.joined_prompt(F.lit("A {history} B"), F.col("t")).alias("j"), P.joined_prompt(F.lit("A"), F.col("t")).alias("k"), P.joined_prompt(F.lit(None), F.col("t")).alias("n")).collect():
        want = rules(texts[r.i])
        added = P.RULES_TITLE + want + "\n" if want else ""
        assert (r.r, r.j, r.k, r.n) == (want, f"A {added}{{history}} B", f"{added}A", None)


def test_question_prompts(spark):
    none = F.lit(None).cast("string")
    lines = "\n".join(P.ANSWER_LINES)
    plain = P.question_prompt(F.lit("T"), F.lit("x" * 11), F.lit("Q?"), F.lit("S"), F.lit(None).cast("array<string>"), none, most=10)
    assert one(spark, plain) == f"# 시스템 지시사항\nS\n\n# 문서: T\n{'x' * 10}\n\n[이하 생략...]\n\n# 질문\nQ?\n{lines}"
    whole = P.question_prompt(F.lit("T"), none, none, none, F.array(F.lit("|a|"), F.lit("|b|")), F.lit("Part 2/5"), told=("go",))
    assert one(spark, whole) == "# 시스템 지시사항\n\n\n# 문서: T (Part 2/5)\n\n\n## 관련 표\n|a|\n\n|b|\ngo"


def test_steps_and_excerpts(spark):
    none = F.lit(None).cast("string")
    assert one(spark, P.last_steps(F.lit("p"), F.lit("abcdef"), 3)) == "p\n...(이전 단계 생략)\ndef"
    assert [one(spark, P.last_steps(F.lit("p"), c, 3)) for c in (F.lit("abc"), F.lit(""), none)] == ["p\nabc", "p", "p"]
    assert [one(spark, P.gathered(c, 3)) for c in (F.lit("abcd"), F.lit("ab"), F.lit(""), none)] == ["bcd", "ab", P.NOTHING_GATHERED, P.NOTHING_GATHERED]
    assert [one(spark, P.excerpt(c, 2)) for c in (F.lit("abc"), none)] == [P.EXCERPT + "ab\n\n", ""]


@pytest.mark.parametrize(
    ("intent", "mode", "reason", "want"),
    [("fact", "agent", " r ", "[의도] 사실 확인 → agent 경로 (r)"), (None, "chitchat", None, "[라우팅] → 잡담 직답 경로"), ("other", "x", "", "[의도] other → 단순 RAG 경로"), (None, None, None, "[라우팅] → agent 경로"), ("", "general", " ", "[의도] → 일반 지식 직답 경로")],
)
def test_intent_lines(spark, intent, mode, reason, want):
    assert one(spark, P.intent_line(*(F.lit(x).cast("string") for x in (intent, mode, reason)))) == want


def test_persona_lines(spark):
    text = lambda x: F.lit(x).cast("string")
    assert one(spark, P.persona_line(text("a"), text("b"), F.array(F.lit("low"), F.lit("mix")), text(None), F.lit(0.5))) == "Persona: a+b (composition, trigger=low, mix, conf=0.50)"
    assert one(spark, P.persona_line(text(None), text(""), F.lit(None).cast("array<string>"), text(None), F.lit(None).cast("double"))) == "Persona: default+? (composition, trigger=n/a, conf=0.00)"
    assert one(spark, P.persona_line(text("a"), text(None), F.lit(None).cast("array<string>"), text("sure"), F.lit(1))) == "Persona: a (composition skip: sure, conf=1.00)"


def test_hooks_run_in_order_and_failures_keep_what_was_there(spark):
    rows = spark.createDataFrame([("  a  B ",), (None,), ("boom",)], "query string")

    def fails(value):
        if value == "boom" or value is None:
            raise RuntimeError
        return value + "!"

    hooks = Hooks(("squash_query", "unknown"))
    for hook in (lambda r: r.select("missing"), lambda r: r + 1, lambda r: None, on_values("query", fails), on_column("query", F.upper)):
        hooks.add(PRE_QUERY, hook)
    assert hooks.count(PRE_QUERY) == 6 and hooks.count(POST_SYNTHESIS) == 0
    assert [r.query for r in hooks.run(PRE_QUERY, rows).collect()] == ["A B!", None, "BOOM"]
    assert hooks.run(POST_SYNTHESIS, rows) is rows
    off = Hooks(("squash_query",), enabled=False)
    assert off.run(PRE_QUERY, rows) is rows
    hooks.clear(PRE_QUERY)
    assert hooks.count(PRE_QUERY) == 0
    hooks.add(POST_SEARCH, lambda r: r)
    hooks.clear()
    assert hooks.count(POST_SEARCH) == 0


def test_built_in_hooks(spark):
    rows = spark.createDataFrame([([("a", 1), (None, 2), ("a", 3), ("", 4), ("b", 5)], "<b>x</b> < y <>"), ([], ""), (None, None)], "sources array<struct<doc_id: string, n: int>>, answer string")
    hooks = Hooks(("distinct_sources", "plain_answer"))
    got = hooks.run(POST_SYNTHESIS, hooks.run(POST_SEARCH, rows)).collect()
    assert [[s.n for s in r.sources] if r.sources is not None else None for r in got] == [[1, 2, 5], [], None]
    assert [r.answer for r in got] == [re.sub("<[^>]+>", "", "<b>x</b> < y <>"), "", None]


def test_token_limits_keep_whole_rows(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(vocabulary())
    texts = [None, "", "one", "한국어 텍스트", "word " * 40, "x" * 500, "<|endoftext|>"] + ["a b c"] * 3
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "i int, t string, n string")
    got = sorted((r.i, r.n_tokens, r.n) for r in curate.fitting(rows, "t", vocabulary(), 20).collect())
    assert got == [(i, n, "kept") for i, t in enumerate(texts) if t is not None and (n := len(own.encode(t).ids)) <= 20]
    assert curate.fitting(rows.limit(0), "t", vocabulary(), 20).count() == 0


def test_places_of_pairs_do_not_meet(spark):
    rows = [(c, t, r, f"{c}/{t}") for c, t in ((1, 10_000), (2, 0)) for t, r in ((t, "user"), (t + 1, "assistant"))]
    got = curate.qa_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len({r.pos for r in got}) == 2 and sorted(r.question for r in got) == ["1/10000", "2/0"]


def test_summaries_read_no_more_than_they_keep(spark):
    rows = [(c, t, ("user", "assistant", "system")[t % 3], None if t % 5 == 0 else "w" * (t * 7 % 23)) for c in (1, 2) for t in range(30 if c == 1 else 5)]
    got = sessions.compressed(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 3, 40).collect()
    label = {"user": "User", "assistant": "Assistant", "system": "System"}
    want = "\n".join(f"{label[r]}: {x or ''}" for c, t, r, x in rows if c == 1 and t < 27)[:40]
    assert [r.text for r in got if r.turn == -1] == [want] and sum(r.conv_id == 1 for r in got) == 4 and sum(r.conv_id == 2 for r in got) == 5


@pytest.mark.parametrize("promoted", [0, 2, 3, 7])
def test_versions_that_stay(spark, promoted):
    runs = [(i, i % 2 == 0 and i // 2 < promoted, i == 5) for i in range(16)]
    got = {r.run_id for r in upkeep.retained_versions(spark.createDataFrame(runs, "run_id long, promoted boolean, current boolean"), 3).collect()}
    last = sorted(i for i, p, _ in runs if p)[-3:]
    assert got == {i for i, p, c in runs if c or promoted <= 3 or i in last}


def test_samples_take_turns_over_groups(spark):
    rows = [(i, "abc"[min(i % 7, 2)]) for i in range(70)] + [(100, "d")]
    got = [(r.i, r.g) for r in corpus.coverage_sample(spark.createDataFrame(rows, "i long, g string"), 9, "g", "i").collect()]
    turns = [(k, i, g) for g in "abcd" for k, i in enumerate(sorted(i for i, h in rows if h == g), 1)]
    assert got == [(i, g) for _, i, g in sorted(turns)[:9]]


def test_the_query_of_token_limits_takes_some_rows_and_leaves_some(spark, data):
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(vocabulary())
    chats = curate.chat_messages(curate.qa_pairs(spark.read.parquet(f"{data}/conversations.parquet")), "Answer briefly.").collect()
    sizes = {r.pos: len(own.encode(r.messages).ids) for r in chats}
    got = {r.pos: r.n_tokens for r in catalog.queries()["token_limit"](spark, data).collect()}
    assert got == {pos: n for pos, n in sizes.items() if n <= 512} and 0 < len(got) < len(sizes)
