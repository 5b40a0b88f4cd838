"""Signals in a request: corpus keywords, forms of question, roles, names and benchmark intents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

#: Openings of commands, and nouns that name nothing by themselves.
COMMANDS = (
    "설명하시오", "설명하세요", "설명해줘", "설명해 줘", "설명해주세요", "설명해 주세요", "설명해", "설명하라", "논하시오", "논하세요", "논하라",
    "서술하시오", "서술하세요", "서술하라", "서술해", "제시하시오", "제시하세요", "제시하라", "제시해", "기술하시오", "기술하세요", "기술하라", "기술해",
    "요약하시오", "요약하세요", "요약해줘", "요약해 줘", "요약해", "정리하시오", "정리하세요", "정리해줘", "정리해 줘", "정리해",
    "분석하시오", "분석하세요", "분석해줘", "분석해", "비교하시오", "비교하세요", "비교해줘", "비교해",
)
REFERENTS = ("주제", "내용", "항목", "사항", "내역", "이것", "그것", "저것", "이들", "그들", "여러 가지", "여러가지", "몇 가지", "몇가지", "세 가지", "세가지", "두 가지", "두가지", "각 단계", "각 항목")
PARTICLES = ("은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "만", "이나", "그", "저", "그것", "이것", "저것")
#: Words that ask for a table, and words that ask for reasons.
TABULAR = ("표로", "표 형식", "표를", "표 보여", "표 만들", "비교해", "비교 ", "대비", "대조", "차이", " vs ", " vs.", "v.s.", "tabular", "table")
ANALYTICAL = ("왜", "이유", "원인", "배경", "시사점", "영향", "분석", "why", "reason", "cause", "implication")
#: The persona of each intent, and words of a corpus name that say nothing.
PERSONAS = {"factual": "researcher", "comparative": "comparator", "analytical": "analyst", "procedural": "procedural", "exploratory": "analyst"}
NAME_STOPLIST = ("및", "또는", "그리고", "관련", "전용", "기반", "위한", "대한", "통한")
#: Words of benchmark questions by intent, in order of precedence.
BENCHMARK_INTENTS = (
    ("compare", ("차이", "비교", "다른 점", "차이점", "vs", "대비", "각각")),
    ("howto", ("어떻게", "방법", "절차", "어떤 순서", "하려면", "방안")),
    ("lookup", ("무엇", "어떤 서류", "얼마", "몇", "언제", "어디", "누구", "어느")),
)


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(c, F.lit(w))
    return hit


def has_keyword(query: Column, keywords: Column) -> Column:
    """Whether a keyword of two characters or more is in the query: ASCII ones between other characters than letters and digits, others anywhere."""
    low = F.lower(query)
    quoted = lambda k: F.regexp_replace(k, r"([^a-z0-9\s])", r"\\$1")
    bounded = lambda k: F.rlike(low, F.concat(F.lit("(?:^|[^a-z0-9])"), quoted(k), F.lit("(?:[^a-z0-9]|$)")))
    found = lambda k: F.when(F.octet_length(k) == F.length(k), bounded(k)).otherwise(F.contains(low, k))
    return F.coalesce(F.exists(F.filter(F.transform(keywords, F.lower), lambda k: F.length(k) >= 2), found), F.lit(False))


def command_without_object(query: Column) -> Column:
    """A command on a noun that names nothing, without any Latin word or number."""
    low = F.lower(query)
    return any_of(low, COMMANDS) & ~F.regexp_like(low, F.lit("[A-Za-z0-9]{2,}")) & any_of(low, REFERENTS)


def in_domain_gate(query: Column, intent: Column, confidence: Column, keywords: Column, cap: float = 0.5) -> Column:
    """struct(confidence, matched): general and chit-chat decisions are at most ``cap`` sure if up to three corpus keywords, or a bare command, say otherwise."""

    def gate(matched: Column) -> Column:
        open_to = intent.isin("general", "chitchat") & ((F.size(matched) > 0) | command_without_object(query))
        none = F.array().cast("array<string>")
        return F.struct(F.when(open_to, F.least(confidence, F.lit(cap))).otherwise(confidence).alias("confidence"), F.when(open_to, matched).otherwise(none).alias("matched"))

    low = F.lower(query)
    good = lambda k: (F.length(strip(k)) >= 2) & ~F.lower(strip(k)).isin(*PARTICLES) & F.contains(low, F.lower(strip(k)))
    return let(F.slice(F.filter(keywords, good), 1, 3), gate)


def composed_persona(intent: Column, confidence: Column, query: Column, reason: Column, sure: float = 0.7) -> Column:
    """struct(persona, second): comparator and analyst work together on an unsure decision, or where the text asks for the other's work."""
    persona = F.element_at(F.create_map(*(F.lit(x) for pair in PERSONAS.items() for x in pair)), intent)
    text = F.lower(F.concat_ws("\n", F.coalesce(query, F.lit("")), F.coalesce(reason, F.lit(""))))
    unsure = F.coalesce(confidence, F.lit(1.0)) < sure
    second = F.when((persona == "comparator") & (unsure | any_of(text, ANALYTICAL)), "analyst").when((persona == "analyst") & (unsure | any_of(text, TABULAR)), "comparator")
    return F.struct(persona.alias("persona"), second.alias("second"))


def asks_for_table(c: Column) -> Column:
    return any_of(F.lower(c), TABULAR)


def asks_for_reasons(c: Column) -> Column:
    return any_of(F.lower(c), ANALYTICAL)


def name_tokens(c: Column) -> Column:
    """Words of a corpus name of two characters or more, without function words."""
    parts = F.split(F.coalesce(c, F.lit("")), r"""(?U)[\s,()\[\]<>'"·•\-/]+""")
    return F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin(*NAME_STOPLIST))


def merged_keywords(keywords: Column, name: Column) -> Column:
    """Keywords and then the name's words; of spellings that differ in case the first stays."""

    def first(all_: Column) -> Column:
        low = F.transform(all_, F.lower)
        return F.filter(all_, lambda k, i: (k != "") & (F.array_position(low, F.lower(k)) == i + 1))

    return let(F.concat(F.coalesce(keywords, F.array().cast("array<string>")), name_tokens(name)), first)


def benchmark_intent(c: Column) -> Column:
    out = F.lit("explain")
    for name, words in reversed(BENCHMARK_INTENTS):
        out = F.when(any_of(c, words), name).otherwise(out)
    return out


def override_profile(own: Column, other: Column) -> Column:
    """The override where it is not blank."""
    return F.coalesce(F.nullif(strip(other), F.lit("")), own)


def epochs(n: Column) -> Column:
    return F.when(n < 100, 3).when(n < 500, 2).otherwise(1)


def learning_rate(n: Column) -> Column:
    return F.when(n < 100, 5e-5).when(n < 500, 1e-4).otherwise(2e-4)


def markdown_table(rows: Column) -> Column:
    """A table of text cells: the first row is its head, other rows are padded or cut to the head's width; nothing without a head."""

    def table(r: Column) -> Column:
        width = F.size(r[0])
        line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
        fitted = lambda cells: F.slice(F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0)))), F.lit(1), width)
        body = F.transform(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), lambda cells: line(fitted(cells)))
        return F.array_join(F.concat(F.array(line(r[0]), line(F.array_repeat(F.lit("---"), width))), body), "\n")

    return let(rows, lambda r: F.when((F.size(r) > 0) & (F.size(F.get(r, F.lit(0))) > 0), table(r)).otherwise(""))


def table_blocks(text: Column) -> Column:
    """Blocks of neighbouring lines that open and close with a bar, each line without the blanks around it."""

    def blocks(lines: Column) -> Column:
        bar = F.transform(lines, lambda x: F.startswith(x, F.lit("|")) & F.endswith(x, F.lit("|")))
        at = F.sequence(F.lit(1), F.size(lines))
        is_bar = lambda b, i: F.coalesce(F.try_element_at(b, i), F.lit(False))
        first = let(bar, lambda b: F.filter(at, lambda i: is_bar(b, i) & ~F.when(i > 1, is_bar(b, F.greatest(i - 1, F.lit(1)))).otherwise(False)))
        last = let(bar, lambda b: F.filter(at, lambda i: is_bar(b, i) & ~is_bar(b, i + 1)))
        return F.zip_with(first, last, lambda a, z: F.array_join(F.slice(lines, a, z - a + 1), "\n"))

    return let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), blocks)


def table_parts(block: Column) -> Column:
    """(head, rows) of a block of :func:`table_blocks`: the cells of its first line, if the second is a rule, and of the others."""
    cells = lambda line: F.transform(F.split(F.regexp_replace(line, r"^\|\s*|\s*\|$", ""), r"\s*\|\s*"), strip)

    def parts(lines: Column) -> Column:
        ruled = F.coalesce(F.regexp_like(F.get(lines, F.lit(1)), F.lit(r"^\|(\s*:?-+:?\s*\|)+$")), F.lit(False))
        body = F.when(ruled, F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0)))).otherwise(lines)
        return F.struct(F.when(ruled, cells(lines[0])).alias("head"), F.transform(body, cells).alias("rows"))

    return let(F.split(block, "\n"), parts)


def part_labels(n: Column) -> Column:
    """``Part i/n`` for each of n chunks; null for a single one."""
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.when(n > 1, F.concat(F.lit("Part "), i.cast("string"), F.lit("/"), n.cast("string"))))


def with_tables(content: Column, tables: Column) -> Column:
    """A text and its tables, blank lines between them."""
    return F.when(F.size(tables) > 0, F.concat(content, F.lit("\n\n"), F.array_join(tables, "\n\n"))).otherwise(content)


def message_text(content: Column) -> Column:
    """The text of a message that is JSON text or a list of typed parts."""
    parts = F.filter(F.from_json(content, "array<struct<type:string,text:string>>"), lambda p: p["type"] == "text")
    return F.when(F.startswith(F.ltrim(content), F.lit("[")), F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")).otherwise(content)


def observation(ids: Column, scores: Column) -> Column:
    """How many results, their best score and the first three ids of 24 characters."""
    short = F.array_join(F.transform(F.slice(ids, 1, 3), lambda x: F.substring(x, 1, 24)), ", ")
    return F.when(F.size(ids) == 0, "0 results").otherwise(F.format_string("%d results, best %.3f: %s", F.size(ids), F.array_max(scores), short))


def context_prefix(title: Column, text: Column, most: int = 300) -> Column:
    """``text`` under its context line, which is cut at ``most`` characters."""
    return F.when(F.coalesce(title, F.lit("")) == "", text).otherwise(F.concat(F.lit("[Context] "), F.when(F.length(title) > most, F.concat(F.substring(title, 1, most), F.lit("…"))).otherwise(title), F.lit("\n\n"), text))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def unit_score(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
