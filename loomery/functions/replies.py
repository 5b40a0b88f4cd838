"""Column functions that read a model's reply: JSON of several shapes, scores, decisions and plans.

All of them are built-in expressions over the variant type; a reply that
cannot be read gives null or the stated default, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import let, strip

#: Intents, planner strategies and tools, verdicts, and words for "enough".
INTENTS = ("factual", "comparative", "analytical", "procedural", "exploratory", "chitchat", "general", "ambiguous")
STRATEGIES, TOOLS = ("fact", "compare", "decompose"), ("search", "lookup", "compare")
VERDICTS = ("PASS", "FAIL", "PARTIAL")
YES = ("true", "yes", "예", "충분")


def unfence(c: Column) -> Column:
    """Without a code fence at the text's own start and end."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(kind_of(v), F.lit("OBJECT")), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(F.startswith(kind_of(v), F.lit("ARRAY")), F.lit(False))


def is_text(v: Column) -> Column:
    return F.coalesce(kind_of(v) == "STRING", F.lit(False))


def text_of(v: Column) -> Column:
    return get(v, "$", "string")


def items_of(v: Column, path: str = "$") -> Column:
    """The elements of a JSON list, else none."""
    return F.coalesce(get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def braces(c: Column) -> Column:
    """The JSON from the first { to the last }, else null."""
    body = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(body != "", F.try_parse_json(body))


def _texts(values: Column) -> Column:
    return F.filter(F.transform(F.filter(values, is_text), lambda x: strip(text_of(x))), lambda t: t != "")


def qa_reply(c: Column) -> Column:
    """struct(instruction, output) of a reply: an object, the first of a list, or either below data or items; else null."""

    def inner(v: Column) -> Column:
        own = get(v, "$.instruction").isNotNull() | get(v, "$.question").isNotNull()
        below = lambda key: F.when(is_array(get(v, f"$.{key}")), get(v, f"$.{key}[0]")).when(is_object(get(v, f"$.{key}")), get(v, f"$.{key}"))
        return F.when(is_object(v) & own, v).when(is_array(v), get(v, "$[0]")).when(get(v, "$.data").isNotNull(), below("data")).when(get(v, "$.items").isNotNull(), below("items"))

    def pair(r: Column) -> Column:
        question = F.coalesce(get(r, "$.instruction"), get(r, "$.question"))
        answer = F.coalesce(get(r, "$.output"), get(r, "$.answer"))
        return F.when(question.isNotNull() & answer.isNotNull(), F.struct(text_of(question).alias("instruction"), text_of(answer).alias("output")))

    return let(F.try_parse_json(unfence(c)), lambda v: let(inner(v), pair))


def judge_score(c: Column) -> Column:
    """The score 1-5 of a judge's reply: its JSON, else a digit after a key word, else a lone digit, else null."""

    def score(t: Column) -> Column:
        number = F.floor(get(F.try_parse_json(t), "$.score", "double"))
        named = F.regexp_extract(t, r"(?i)(?:score|점수)\D{0,10}([1-5])", 1)
        digits = F.regexp_extract_all(t, F.lit(r"(?U)\b([1-5])\b"), F.lit(1))
        lone = F.when(F.size(digits) == 1, digits[0])
        return F.coalesce(F.when(number.between(1, 5), number), F.nullif(named, F.lit("")).try_cast("long"), lone.try_cast("long"))

    return let(unfence(c), score)


def judge_fraction(c: Column) -> Column:
    """A score of 0-5 over 5: from the JSON, else from a "score": digit in the text, else 0."""
    read = F.try_parse_json(c)
    number = F.when(is_object(read), F.coalesce(get(read, "$.score", "double"), F.when(get(read, "$.score").isNull(), 0.0)))
    loose = F.nullif(F.regexp_extract(c, r'"score"\s*:\s*(\d)', 1), F.lit("")).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.coalesce(F.floor(number), loose, F.lit(0.0)))) / 5.0


def batch_scores(replies: DataFrame, batch: str, reply: str, size: str) -> DataFrame:
    """(``batch``, id, score) for each id from 0 to ``size`` - 1: its last valid score of 1-5, else 0."""
    v = F.try_parse_json(unfence(F.col(reply)))
    listed = F.when(is_array(v), items_of(v)).otherwise(items_of(F.coalesce(get(v, "$.scores"), get(v, "$.items"))))
    each = replies.select(batch, F.posexplode(listed).alias("at", "item"))
    each = each.select(batch, "at", get(F.col("item"), "$.id", "bigint").alias("id"), get(F.col("item"), "$.score", "bigint").alias("score")).where("score between 1 and 5")
    last = each.groupBy(batch, "id").agg(F.max_by("score", "at").alias("score"))
    asked = replies.select(batch, F.explode(F.sequence(F.lit(0).cast("long"), F.col(size).cast("long") - 1)).alias("id"))
    return asked.join(last, [batch, "id"], "left").na.fill(0, ["score"])


def paraphrases(c: Column) -> Column:
    """The texts of a list, or of an object's questions."""
    return let(F.try_parse_json(unfence(c)), lambda v: _texts(F.when(is_array(v), items_of(v)).otherwise(items_of(get(v, "$.questions")))))


def _plain(c: Column) -> Column:
    return F.array_join(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda x: x != ""), " ")


def multi_queries(c: Column, query: Column, n: int = 3) -> Column:
    """At most ``n`` queries of a reply that differ from ``query`` and from each other but for case and blanks."""
    texts = _texts(items_of(get(braces(F.regexp_replace(c, r"(?s)<think>.*?</think>", "")), "$.queries")))
    pairs = lambda t: F.transform(t, lambda x: F.struct(_plain(x).alias("norm"), x.alias("text")))
    fresh = lambda p: F.filter(p, lambda x, i: (x["norm"] != _plain(query)) & (F.array_position(F.transform(p, lambda y: y["norm"]), x["norm"]) == i + 1))
    return let(texts, lambda t: let(pairs(t), lambda p: F.transform(F.slice(fresh(p), 1, n), lambda x: x["text"])))


def intent_decision(c: Column) -> Column:
    """struct(intent, confidence, reason): unknown intents are ambiguous, confidence is within 0 and 1 (0.5 if unreadable)."""

    def decide(v: Column) -> Column:
        intent = F.lower(strip(F.coalesce(get(v, "$.intent", "string"), F.lit(""))))
        sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(get(v, "$.confidence", "double"), F.lit(0.5))))
        read = F.struct(F.when(intent.isin(*INTENTS), intent).otherwise("ambiguous").alias("intent"), sure.alias("confidence"), F.substring(F.coalesce(get(v, "$.reason", "string"), F.lit("")), 1, 300).alias("reason"))
        lost = F.struct(F.lit("ambiguous").alias("intent"), F.lit(0.0).alias("confidence"), F.lit("fallback: unreadable").alias("reason"))
        return F.when(is_object(v), read).otherwise(lost)

    return let(braces(c), decide)


def sufficiency(c: Column) -> Column:
    """struct(sufficient, suggested_query): yes-words and true are enough, as is nothing at all; of several suggestions the first."""

    def decide(v: Column) -> Column:
        flag, hint = get(v, "$.sufficient"), F.coalesce(get(v, "$.suggestion"), get(v, "$.suggested_query"))
        truth = F.coalesce(get(flag, "$", "boolean"), get(flag, "$", "double") != 0, F.lit(False))
        enough = F.when(flag.isNull() | F.is_variant_null(flag), True).when(is_text(flag), F.lower(strip(text_of(flag))).isin(*YES)).otherwise(truth)
        first = F.when(is_array(hint), get(hint, "$[0]", "string")).otherwise(text_of(hint))
        return F.struct(enough.alias("sufficient"), F.nullif(strip(first), F.lit("")).alias("suggested_query"))

    return let(braces(c), decide)


def verdict(c: Column) -> Column:
    """struct(verdict, issues, repair): unknown verdicts pass; only a FAIL with a hint is repaired."""

    def decide(v: Column) -> Column:
        said = F.upper(strip(F.when(is_text(get(v, "$.verdict")), get(v, "$.verdict", "string"))))
        kind = F.when(said.isin(*VERDICTS), said).otherwise("PASS")
        raw = get(v, "$.issues")
        many = F.filter(F.transform(items_of(raw), lambda x: F.substring(text_of(x), 1, 300)), lambda t: strip(t) != "")
        issues = F.when(is_text(raw), F.when(strip(text_of(raw)) != "", F.array(text_of(raw))).otherwise(F.array().cast("array<string>"))).otherwise(many)
        hint = strip(F.substring(F.coalesce(get(v, "$.repair_hint", "string"), F.lit("")), 1, 500))
        return F.struct(kind.alias("verdict"), issues.alias("issues"), ((kind == "FAIL") & (hint != "")).alias("repair"))

    return let(braces(c), decide)


def plan_steps(c: Column, most: int = 3) -> Column:
    """struct(strategy, tools): of the first ``most`` steps those with a known tool; an unreadable plan is one search."""

    def read(v: Column) -> Column:
        strategy = F.when(get(v, "$.strategy", "string").isin(*STRATEGIES), get(v, "$.strategy", "string")).otherwise("fact")
        args = lambda x: F.coalesce(is_object(get(x, "$.args")) | get(x, "$.args").isNull() | F.is_variant_null(get(x, "$.args")), F.lit(True))
        steps = F.filter(F.slice(items_of(get(v, "$.steps")), 1, most), lambda x: is_object(x) & args(x))
        tools = F.filter(F.transform(steps, lambda x: F.lower(strip(F.coalesce(get(x, "$.tool", "string"), F.lit(""))))), lambda t: t.isin(*TOOLS))
        return F.when(is_object(v), F.struct(strategy.alias("strategy"), tools.alias("tools"))).otherwise(F.struct(F.lit("fact").alias("strategy"), F.array(F.lit("search")).alias("tools")))

    return let(braces(c), read)


def clarifying_questions(c: Column, default: tuple[str, ...], most: int = 2) -> Column:
    """At most ``most`` questions of 300 characters; the default ones if the reply has none."""
    found = F.transform(_texts(items_of(get(braces(c), "$.questions"))), lambda t: F.substring(t, 1, 300))
    return let(found, lambda q: F.slice(F.when(F.size(q) > 0, q).otherwise(F.array(*map(F.lit, default))), 1, most))


def judge_line(c: Column) -> Column:
    """struct(verdict, reason) of ``VERDICT: X | reason``; other lines fail."""
    pattern = r"(?i)VERDICT\s*:\s*(PASS|PARTIAL|FAIL)\s*\|?\s*([^\r\n]*)"
    said = F.upper(F.regexp_extract(c, pattern, 1))
    return F.struct(F.when(said != "", said).otherwise("FAIL").alias("verdict"), F.when(said != "", F.substring(strip(F.regexp_extract(c, pattern, 2)), 1, 300)).otherwise("unparsed").alias("reason"))


#: The marks of a step, in two languages.
_THOUGHT, _ACTION, _INPUT, _SEEN, _FINAL = "Thought|생각", "Action|행동", "Action Input|행동 입력", "Observation|관찰", "Final Answer|최종 답변"


def react_step(c: Column) -> Column:
    """struct(thought, action, action_input, final_answer) of a reasoning step; what is not there is null.

    A final answer hides an action.  A text without any part is an answer as
    a whole, unless it has no mark and is shorter than ten characters.  An
    input that is no JSON object becomes one with the text as its query.
    """
    part = lambda pattern: F.nullif(strip(F.regexp_extract(c, pattern, 1)), F.lit(""))
    final = part(rf"(?is)(?:{_FINAL})\s*:\s*(.+)")
    for left in (r"(?s)<think>.*?</think>", r"(?i)</?(?:end_of_turn|start_of_turn|channel|pad|eos|bos|sep|cls|mask|unk)\|?>", rf"(?is)\n\s*(?:{_THOUGHT}|{_ACTION}|{_INPUT}|{_SEEN})\s*:.*"):
        final = F.regexp_replace(final, left, "")
    final = strip(final)
    thought = part(rf"(?is)(?:{_THOUGHT})\s*:\s*(.+?)(?=\n(?:{_ACTION}|{_FINAL})\s*:|\z)")
    action = F.when(~F.regexp_like(c, F.lit(rf"(?is)(?:{_FINAL})\s*:\s*.")), F.lower(part(rf"(?i)(?:{_ACTION})\s*:\s*(\S+)")))
    raw = part(rf"(?is)(?:{_INPUT})\s*:\s*(.+?)(?=\n(?:{_THOUGHT}|{_SEEN}|{_FINAL})\s*:|\z)")
    bare = F.regexp_replace(F.regexp_replace(raw, r'^"+|"+$', ""), r"^'+|'+$", "")
    given = F.coalesce(F.to_json(braces(raw)), F.when(bare != "", F.to_json(F.struct(bare.alias("query")))), F.lit("{}"))
    marked = F.regexp_like(c, F.lit(rf"(?i)(?:{_ACTION}|{_FINAL}|{_THOUGHT})\s*:"))
    empty = F.coalesce(thought, action, F.nullif(final, F.lit(""))).isNull()
    whole = F.when(empty & (strip(c) != "") & (marked | (F.length(strip(c)) >= 10)), strip(c))
    return F.struct(thought.alias("thought"), action.alias("action"), F.when(action.isNotNull(), given).alias("action_input"), F.coalesce(F.nullif(final, F.lit("")), whole).alias("final_answer"))


def keep_scored(rows: DataFrame, reply: str, least: float = 3.0) -> DataFrame:
    """Rows whose reply scores ``least`` or more, with ``score``; an unreadable reply scores 0."""
    return rows.withColumn("score", F.coalesce(judge_score(F.col(reply)), F.lit(0))).where(F.col("score") >= least)


def weak_rows(rows: DataFrame, scores: str, metric: str = "llm_judge", least: float = 0.5) -> DataFrame:
    """Rows whose ``metric`` in the map ``scores`` is under ``least``; a missing one counts 0."""
    return rows.where(F.coalesce(F.element_at(scores, metric), F.lit(0.0)) < least)


def domain_ids(rows: DataFrame, domain: str, order: str) -> DataFrame:
    """Add ``id``: the domain and a running number within it, of three digits or more."""
    n = F.row_number().over(W.partitionBy(domain).orderBy(order))
    return rows.withColumn("id", F.format_string("%s_%03d", F.col(domain), n))
