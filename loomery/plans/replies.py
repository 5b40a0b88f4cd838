"""Queries over model replies, made from the events: each reply shape in turn, around the event's own type.

The SQL states what each shape must give, so it shares nothing with the parsers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import replies as R
from ..functions import text as X
from .registry import QUERIES, ORACLES, query, table

Case = tuple[str, Sequence]


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, list):
        return "[" + ", ".join(map(_literal, x)) + "]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def _filled(column: str, kind: str) -> str:
    """The expected value of a column around the event's type."""
    if kind == "VARCHAR":
        return f"replace({column}, '{{v}}', event_type) AS {column}"
    if kind == "VARCHAR[]":
        return f"array_to_string(list_transform({column}, lambda x: replace(x, '{{v}}', event_type)), '|') AS {column}"
    return f"CAST({column} AS {kind}) AS {column}"


def made(spark: SparkSession, sf_dir: str, cases: Sequence[Case]) -> DataFrame:
    """(event_id, event_type, reply): reply k of the stated, bounded list for the events of remainder k."""
    shapes = F.broadcast(spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k long, shape string"))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_id") % len(cases)).alias("k"))
    return rows.join(shapes, "k").select("event_id", "event_type", F.replace("shape", F.lit("{v}"), F.col("event_type")).alias("reply"))


def expected(cases: Sequence[Case], columns: dict[str, str]) -> str:
    values = ", ".join(f"({k}, {', '.join(map(_literal, c[1]))})" for k, c in enumerate(cases))
    return f"SELECT event_id, {', '.join(_filled(c, k) for c, k in columns.items())} FROM events JOIN (VALUES {values}) AS v(k, {', '.join(columns)}) ON k = event_id % {len(cases)}"


def reply_query(name: str, cases: Sequence[Case], columns: dict[str, str], read: Callable[[Column], Column]) -> None:
    """Register ``name``: the fields of ``read`` for every made reply."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = made(spark, sf_dir, cases).select("event_id", read(F.col("reply")).alias("r"))
        field = (lambda c: F.col("r")) if len(columns) == 1 else (lambda c: F.col(f"r.{c}"))
        return got.select("event_id", *((F.array_join(field(c), "|") if k.endswith("[]") else field(c)).alias(c) for c, k in columns.items()))

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, expected(cases, columns)


FENCE = "```json\n%s\n```"
reply_query(
    "qa_reply",
    [
        ('{"instruction": "{v}?", "output": "it is {v}"}', ("{v}?", "it is {v}")),
        (FENCE % '{"question": "{v}?", "answer": "a {v}"}', ("{v}?", "a {v}")),
        ('[{"instruction": "first {v}", "answer": "x"}, {"instruction": "second", "output": "y"}]', ("first {v}", "x")),
        ('{"data": [{"question": "d {v}", "output": "z"}]}', ("d {v}", "z")),
        ('{"data": {"question": "e {v}", "answer": "w"}}', ("e {v}", "w")),
        ('{"items": [{"question": "i {v}", "answer": "u"}]}', ("i {v}", "u")),
        ('{"items": {"instruction": "j", "question": "not this", "output": "o {v}", "answer": "nor this"}}', ("j", "o {v}")),
        ('{"question": "no answer {v}"}', (None, None)),
        ("plain words about {v}", (None, None)),
        ("[]", (None, None)),
        ('{"data": []}', (None, None)),
        ('{"other": 1}', (None, None)),
    ],
    {"instruction": "VARCHAR", "output": "VARCHAR"},
    R.qa_reply,
)
reply_query(
    "judge_score",
    [
        ('{"score": 4, "reason": "{v}"}', (4,)),
        (FENCE % '{"score": 2.9}', (2,)),
        ('{"score": 9, "reason": "none"}', (None,)),
        ("Score: 3 for {v}", (3,)),
        ("점수는 5점", (5,)),
        ("I would say 2 here, {v}", (2,)),
        ("between 2 and 3", (None,)),
        ("no number for {v}", (None,)),
        ("rated 42 of 100", (None,)),
        ('{"score": "5"}', (5,)),
    ],
    {"score": "BIGINT"},
    R.judge_score,
)
reply_query(
    "judge_fraction",
    [('{"score": 4}', (0.8,)), ('{"score": 9}', (1.0,)), ('{"score": -2}', (0.0,)), ('sure: {"score": 3, {v}', (0.6,)), ("nothing on {v}", (0.0,)), ('{"reason": "{v}"}', (0.0,))],
    {"fraction": "DOUBLE"},
    R.judge_fraction,
)
reply_query(
    "paraphrase_reply",
    [
        ('{"questions": [" one {v} ", "two", 3, ""]}', (["one {v}", "two"],)),
        (FENCE % '["only {v}"]', (["only {v}"],)),
        ('{"questions": "no list"}', ([],)),
        ("no json {v}", ([],)),
    ],
    {"questions": "VARCHAR[]"},
    R.paraphrases,
)
reply_query(
    "multi_query_reply",
    [
        ('<think>{ not this }</think> {"queries": ["The {v}", "what is  THE {v}", "other {v}", "Other  {v}", "third", "fourth", "fifth"]}', (["The {v}", "other {v}", "third"],)),
        ('text {"queries": ["  spaced {v} ", 7, " "]} text', (["spaced {v}"],)),
        ('{"queries": "none"}', ([],)),
        ("none of {v}", ([],)),
    ],
    {"queries": "VARCHAR[]"},
    lambda c: R.multi_queries(c, F.concat(F.lit("What is the "), F.col("event_type")), 3),
)
reply_query(
    "intent_reply",
    [
        ('{"intent": " Factual ", "confidence": 0.8, "reason": "{v}"}', ("factual", 0.8, "{v}")),
        ('{"intent": "shopping", "confidence": 3}', ("ambiguous", 1.0, "")),
        ('so: {"intent": "general", "confidence": "high", "reason": "r {v}"} ok', ("general", 0.5, "r {v}")),
        ('{"intent": "chitchat", "confidence": -1}', ("chitchat", 0.0, "")),
        ('{"intent": "exploratory", "confidence": "0.25"}', ("exploratory", 0.25, "")),
        ("I think {v}", ("ambiguous", 0.0, "fallback: unreadable")),
    ],
    {"intent": "VARCHAR", "confidence": "DOUBLE", "reason": "VARCHAR"},
    R.intent_decision,
)
reply_query(
    "sufficiency_reply",
    [
        ('{"sufficient": true}', (True, None)),
        ('{"sufficient": "Yes "}', (True, None)),
        ('{"sufficient": "no", "suggestion": " more on {v} "}', (False, "more on {v}")),
        ('{"sufficient": false, "suggested_query": ["first {v}", "second"]}', (False, "first {v}")),
        ('{"suggestion": ""}', (True, None)),
        ('{"sufficient": 0}', (False, None)),
        ('{"sufficient": null}', (True, None)),
    ],
    {"sufficient": "BOOLEAN", "suggested_query": "VARCHAR"},
    R.sufficiency,
)
reply_query(
    "verdict_reply",
    [
        ('{"verdict": "fail", "issues": ["no source for {v}", " "], "repair_hint": "cite {v}"}', ("FAIL", ["no source for {v}"], True)),
        ('{"verdict": "FAIL", "issues": "one issue"}', ("FAIL", ["one issue"], False)),
        ('{"verdict": "Partial", "repair_hint": "some"}', ("PARTIAL", [], False)),
        ('{"verdict": "who knows", "issues": {"a": 1}}', ("PASS", [], False)),
        ('{"verdict": 3}', ("PASS", [], False)),
        ("unreadable {v}", ("PASS", [], False)),
    ],
    {"verdict": "VARCHAR", "issues": "VARCHAR[]", "repair": "BOOLEAN"},
    R.verdict,
)
reply_query(
    "plan_reply",
    [
        ('{"strategy": "compare", "steps": [{"tool": "Search", "args": {"q": "{v}"}}, {"tool": "delete"}, {"tool": "lookup"}, {"tool": "compare"}]}', ("compare", ["search", "lookup"])),
        ('{"strategy": "magic", "steps": [{"tool": "search", "args": [1]}, 7, {"tool": "compare", "args": null}]}', ("fact", ["compare"])),
        ('{"steps": "none"}', ("fact", [])),
        ("no plan for {v}", ("fact", ["search"])),
    ],
    {"strategy": "VARCHAR", "tools": "VARCHAR[]"},
    R.plan_steps,
)
reply_query(
    "clarifier_reply",
    [
        ('{"questions": ["Which {v}?", 4, " ", "When?", "Why?"]}', (["Which {v}?", "When?"],)),
        ('{"questions": []}', (["What exactly?", "Which document?"],)),
        ("lost {v}", (["What exactly?", "Which document?"],)),
    ],
    {"questions": "VARCHAR[]"},
    lambda c: R.clarifying_questions(c, ("What exactly?", "Which document?")),
)
reply_query(
    "judge_line",
    [("VERDICT: pass | good {v}", ("PASS", "good {v}")), ("so\nverdict : Partial  half", ("PARTIAL", "half")), ("VERDICT: FAIL", ("FAIL", "")), ("it is fine, {v}", ("FAIL", "unparsed"))],
    {"verdict": "VARCHAR", "reason": "VARCHAR"},
    R.judge_line,
)
reply_query(
    "react_parse",
    [
        ("Thought: look for {v}\nAction: Search\nAction Input: {\"q\":\"{v}\"}\nObservation: x", ("look for {v}", "search", '{"q":"{v}"}', None)),
        ("생각: hm\n행동: lookup\n행동 입력: \"plain {v}\"", ("hm", "lookup", '{"query":"plain {v}"}', None)),
        ("Thought: done\nFinal Answer: <think>x</think>It is {v}.<eos>\nThought: again", ("done", None, None, "It is {v}.")),
        ("Action: compare", (None, "compare", "{}", None)),
        ("A longer text on {v} without marks", (None, None, None, "A longer text on {v} without marks")),
        ("short", (None, None, None, None)),
        ("", (None, None, None, None)),
    ],
    {"thought": "VARCHAR", "action": "VARCHAR", "action_input": "VARCHAR", "final_answer": "VARCHAR"},
    R.react_step,
)


BATCHES: list[Case] = [
    ('{"scores": [{"id": 0, "score": 4}, {"id": 1, "score": 9}, {"id": 2, "score": 1}, {"id": 2, "score": 3}, {"id": 7, "score": 5}]}', ([4, 0, 3],)),
    ('```json\n[{"id": 1, "score": "2"}]\n```', ([0, 2, 0],)),
    ('{"items": [{"id": 2, "score": 5}]}', ([0, 0, 5],)),
    ("no scores for {v}", ([0, 0, 0],)),
]


def batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scores of every batch reply."""
    rows = made(spark, sf_dir, BATCHES).withColumn("n", F.lit(3))
    return R.batch_scores(rows, "event_id", "reply", "n")


QUERIES["batch_scores"] = batch_scores
ORACLES["batch_scores"] = (
    f"WITH e AS (SELECT event_id, s FROM events JOIN (VALUES {', '.join(f'({k}, {c[1][0]})' for k, c in enumerate(BATCHES))}) AS v(k, s) ON k = event_id % {len(BATCHES)}) "
    "SELECT event_id, CAST(i AS BIGINT) AS id, CAST(s[i + 1] AS BIGINT) AS score FROM e, unnest(range(0, 3)) AS u(i)"
)

SCORED: list[Case] = [('{"score": 4}', (4,)), ("score 2", (2,)), ("3", (3,)), ("none for {v}", (0,))]


def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that score three or more."""
    return R.keep_scored(made(spark, sf_dir, SCORED), "reply").select("event_id", F.col("score").cast("long").alias("score"))


QUERIES["score_threshold"], ORACLES["score_threshold"] = score_threshold, expected(SCORED, {"score": "BIGINT"}) + " WHERE score >= 3"


@query(r"""SELECT doc_id, md5(CASE WHEN length(t) > 8000 THEN substr(t, 1, 4000) || chr(10) || '...' || chr(10) || right(t, 4000) ELSE t END) AS digest
FROM (SELECT doc_id, trim(regexp_replace(regexp_replace('<think>' || coalesce(text, '') || '</think> <|im_start|>' || coalesce(text, ''), '(?s)<think>.*?</think>', '', 'g'), '<\|[^|>]*\|>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents)""")
def spoken_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts behind a thought that holds them too: without the thought, marks, and the middle of long ones."""
    text = F.coalesce("text", F.lit(""))
    said = X.strip_thinking(F.concat(F.lit("<think>"), text, F.lit("</think> <|im_start|>"), text))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.middle_cut(said).cast("binary")).alias("digest"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 4.0 WHEN 1 THEN 2.0 WHEN 2 THEN 5.0 WHEN 3 THEN NULL ELSE 3.0 END AS score FROM events""")
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of judges' replies of five shapes around the events' own texts."""
    i, props = F.col("event_id") % 5, F.regexp_replace("props", r"\d", "x")
    fenced = F.concat(F.lit('```json\n{"score": 4, "why": "'), F.col("event_type"), F.lit('"}\n```'))
    reply = F.when(i == 0, fenced).when(i == 1, F.concat(props, F.lit(" Score: 2 of many"))).when(i == 2, F.concat(props, F.lit(" a plain 5."))).when(i == 3, F.concat(props, F.lit(" 4 or 5"))).otherwise(F.concat(F.lit('{"score": 9} 점수 3 '), props))
    return table(spark, sf_dir, "events").select("event_id", X.reply_score(reply).alias("score"))
