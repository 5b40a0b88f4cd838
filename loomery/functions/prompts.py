"""Texts put together for a model, and lines that say what a request was taken for.

All are expressions of columns.  A null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Characters of a document, of a source beside a pair, of earlier steps and of what a last answer gets.
CONTENT_CHARS, SOURCE_CHARS, STEP_CHARS, GATHERED_CHARS = 12_000, 3000, 6000, 3000
#: Heads and marks of a question prompt.
SYSTEM, DOCUMENT, CUT, TABLES, QUESTION = "# 시스템 지시사항\n", "\n# 문서: ", "\n\n[이하 생략...]", "\n## 관련 표\n", "\n# 질문\n"
#: What a model is told to do with one question.
ANSWER_LINES = (
    "\n# 지시사항",
    "위 문서 내용만을 근거로 질문에 답변하세요.",
    "반드시 아래 JSON 형식으로만 응답하세요:",
    '{"instruction": "질문 내용", "output": "상세한 답변"}',
    "",
    "코드 블록, 마크다운 서식, JSON 외의 텍스트를 포함하지 마세요.",
    "추론 과정이나 부가 설명을 추가하지 마세요.",
)
#: The title of a scored pair's source, and marks of earlier steps and of none.
EXCERPT, STEPS_CUT, NOTHING_GATHERED = "## 원본 문서 (발췌)\n", "...(이전 단계 생략)\n", "(수집된 정보 없음)"
#: Names of intents, of ways to answer, and the heads of a routing line.
INTENTS = {"fact": "사실 확인", "compare": "비교/대조", "explain": "설명·해설", "howto": "절차/방법", "ambiguous": "모호 — 명확화 필요"}
PATHS, OTHER_PATH = {"agent": "agent 경로", "chitchat": "잡담 직답 경로", "general": "일반 지식 직답 경로"}, "단순 RAG 경로"
ROUTED, MEANT = "[라우팅]", "[의도] "
#: Where a persona's rules begin, what ends them, how many count, and the title they get in another's prompt.
RULES_HEAD, RULES_END, RULE_LINES, RULES_TITLE = r"^(규칙:|답변 구조[^\n]*:)$", r"^(\{|\[참고|질문:|답변:|##)", 4, "\n\n## 추가 분석 지침 (secondary)\n"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _named(names: dict[str, str], c: Column, other: Column) -> Column:
    out = other
    for key, name in names.items():
        out = F.when(c == key, name).otherwise(out)
    return out


def question_prompt(title: Column, content: Column, question: Column, system: Column, tables: Column, part: Column, told: tuple[str, ...] = ANSWER_LINES, most: int = CONTENT_CHARS) -> Column:
    """A document and what to do with it: the text cut at ``most`` characters and marked, its tables, a question if there is one.

    ``part`` says which piece of the document it is (null: the whole);
    ``tables`` is an array of texts, ``told`` the lines at the end.
    """
    body = F.concat(F.substring(_text(content), 1, most), F.when(F.length(_text(content)) > most, CUT).otherwise(""))
    name = F.concat(_text(title), F.when(_text(part) != "", F.concat(F.lit(" ("), part, F.lit(")"))).otherwise(""))
    shown = F.when(F.size(tables) > 0, F.concat(F.lit(TABLES), F.array_join(tables, "\n\n")))
    asked = F.when(question.isNotNull(), F.concat(F.lit(QUESTION), question))
    lines = F.array(F.concat(F.lit(SYSTEM), _text(system)), F.concat(F.lit(DOCUMENT), name, F.lit("\n"), body), shown, asked, *map(F.lit, told))
    return F.array_join(F.array_compact(lines), "\n")


def excerpt(source: Column, most: int = SOURCE_CHARS) -> Column:
    """The head of a source under its title, for a prompt that has a pair scored; empty without a source."""
    return F.when(_text(source) != "", F.concat(F.lit(EXCERPT), F.substring(source, 1, most), F.lit("\n\n"))).otherwise("")


def numbered_pairs(pairs: Column) -> Column:
    """An array of (question, answer) as the list that has several pairs scored at once."""
    one = lambda p, i: F.concat(F.lit("["), i.cast("string"), F.lit("] 질문: "), _text(p["question"]), F.lit("\n    답변: "), _text(p["answer"]), F.lit("\n"))
    return F.array_join(F.transform(pairs, one), "")


def last_steps(prompt: Column, steps: Column, most: int = STEP_CHARS) -> Column:
    """``prompt`` with the end of the steps so far below it; cut steps are marked, none add nothing."""
    said = _text(steps)
    tail = F.when(F.length(said) > most, F.concat(F.lit(STEPS_CUT), F.substring(said, -most, most))).otherwise(said)
    return F.when(said != "", F.concat(prompt, F.lit("\n"), tail)).otherwise(prompt)


def gathered(steps: Column, most: int = GATHERED_CHARS) -> Column:
    """What a forced last answer is based on: the end of the steps, or a word that there are none."""
    return F.when(_text(steps) == "", NOTHING_GATHERED).when(F.length(steps) > most, F.substring(steps, -most, most)).otherwise(steps)


def intent_line(intent: Column, mode: Column, reason: Column) -> Column:
    """A routing decision in words: what was meant, the way it goes (null: the agent's), and why."""
    head = F.when(intent.isNull(), ROUTED).otherwise(strip(F.concat(F.lit(MEANT), _named(INTENTS, intent, intent))))
    way = F.concat(F.lit("→ "), _named(PATHS, F.coalesce(mode, F.lit("agent")), F.lit(OTHER_PATH)))
    why = F.when(strip(_text(reason)) != "", F.concat(F.lit("("), strip(_text(reason)), F.lit(")")))
    return F.concat_ws(" ", head, way, why)


def persona_line(primary: Column, second: Column, triggers: Column, skipped: Column, confidence: Column) -> Column:
    """Which personas answer and why: ``second`` is null where one works alone, ``skipped`` says why it does."""
    name = lambda c, other: F.when(_text(c) == "", other).otherwise(c)
    sure = F.format_string("%.2f", F.coalesce(confidence.cast("double"), F.lit(0.0)))
    why = F.array_join(F.coalesce(triggers, F.array().cast("array<string>")), ", ")
    alone = F.concat(F.lit("Persona: "), name(primary, "default"), F.lit(" (composition skip: "), name(skipped, "n/a"), F.lit(", conf="), sure, F.lit(")"))
    both = F.concat(F.lit("Persona: "), name(primary, "default"), F.lit("+"), name(second, "?"), F.lit(" (composition, trigger="), name(why, "n/a"), F.lit(", conf="), sure, F.lit(")"))
    return F.when(second.isNull(), alone).otherwise(both)


def core_rules(template: Column, most: int = RULE_LINES) -> Column:
    """The first lines of a prompt's rules, or of the whole prompt without such a part, with its braces doubled."""
    text = _text(template)
    # (?d): only a line feed ends a line
    found = F.regexp_instr(text, F.lit(f"(?md){RULES_HEAD}"))
    head = F.regexp_substr(text, F.lit(f"(?md){RULES_HEAD}"))
    part = F.when(found > 0, F.substr(text, found + F.length(head), F.length(text))).otherwise(text)
    lines = F.filter(F.transform(F.split(part, "\n"), strip), lambda x: x != "")
    ends = F.array_position(F.transform(lines, lambda x: F.regexp_like(x, F.lit(RULES_END))), True)
    kept = F.slice(lines, F.lit(1), F.least(F.when(ends > 0, ends - 1).otherwise(F.size(lines)), F.lit(most)).cast("int"))
    return F.array_join(F.transform(kept, lambda x: F.replace(F.replace(x, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))), "\n")


def joined_prompt(primary: Column, second: Column) -> Column:
    """``primary`` with the rules of ``second`` ahead of its history; null without a primary prompt, as it is without rules."""
    rules = core_rules(second)
    added = F.concat(F.lit(RULES_TITLE), rules, F.lit("\n"))
    at = F.instr(primary, "{history}")
    inside = F.concat(F.substr(primary, F.lit(1), at - 1), added, F.substr(primary, at, F.length(primary)))
    return F.when(primary.isNull() | (rules == ""), primary).when(at > 0, inside).otherwise(F.concat(added, primary))
