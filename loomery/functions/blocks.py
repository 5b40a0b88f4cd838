"""Texts that a model or a reader gets: samples, sources, documents, skills; and what chooses them.

Sources are arrays of structs with doc_id, name, score and content, best first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Titles and labels of the blocks.
SAMPLE, FOOTER, NOTHING, FOUND = "[청크 ", "\n\n---\n**📚 참고 문서**\n", "관련 문서를 찾을 수 없습니다.", "문서 "
PRIOR, PRIOR_LABEL, ADDONS = "[이전 대화 참조 문서]", "[이전 문서 ", "[도메인 스킬]"
LISTED, NONE_LISTED = "개 문서:", "인덱싱된 문서가 없습니다."
#: Characters cut from samples, previews, found texts, prior texts and listed texts, and lines of a footer and a listing.
SAMPLE_CHARS, PREVIEW_CHARS, FOUND_CHARS, PRIOR_CHARS, LIST_CHARS, FOOTER_LINES, LIST_LINES = 800, 160, 500, 300, 80, 5, 50
#: What a binary word-processor file leaves of its marks.
_CJK = r"㐀-䶿一-鿿"
ARTEFACTS = rf"[{_CJK}]\n[\u0080-ɏ]\n|[{_CJK}][ࠀ-৿]|[Ȁ-˿]|(?<=[가-힣\d\s])[{_CJK}](?=[\n\s가-힣])|(?<=[가-힣])[{_CJK}](?=$)|[Ⰰ-ⱟ]|[\x{{F0000}}-\x{{FFFFF}}]"


def _number(i: Column) -> Column:
    return (i + 1).cast("string")


def sample_block(texts: Column, most: int = SAMPLE_CHARS) -> Column:
    """Texts under their numbers, longer ones cut and marked."""

    def one(t: Column, i: Column) -> Column:
        plain = strip(F.coalesce(t, F.lit("")))
        return F.concat(F.lit(SAMPLE), _number(i), F.lit("]\n"), F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most), F.lit("..."))).otherwise(plain))

    return F.array_join(F.transform(texts, one), "\n\n")


def source_footer(sources: Column) -> Column:
    """The first sources as a numbered list with previews; empty without any."""

    def one(s: Column, i: Column) -> Column:
        preview = F.replace(strip(F.coalesce(s["content"], F.lit(""))), F.lit("\n"), F.lit(" "))
        cut = F.when(F.length(preview) > PREVIEW_CHARS, F.concat(F.substring(preview, 1, PREVIEW_CHARS), F.lit("…"))).otherwise(preview)
        return F.concat(_number(i), F.lit(". `"), F.coalesce(s["doc_id"], F.lit("?")), F.lit("` · score "), F.format_string("%.2f", F.coalesce(s["score"], F.lit(0.0))), F.lit(" — "), cut)

    lines = F.concat(F.array(F.lit(FOOTER)), F.transform(F.slice(sources, 1, FOOTER_LINES), one))
    return F.when(F.size(sources) > 0, F.array_join(lines, "\n")).otherwise("")


def found_block(sources: Column, label: str = "") -> Column:
    """Sources as an agent reads them: the file's name, else the id, the score and the head of the text."""

    def one(s: Column, i: Column) -> Column:
        name = F.coalesce(F.nullif(strip(F.coalesce(s["name"], F.lit(""))), F.lit("")), s["doc_id"])
        return F.concat(F.lit(f"[{label} " if label else "["), F.lit(FOUND), _number(i), F.lit(" | doc:"), name, F.format_string("] (유사도: %.2f)\n", s["score"]), F.substring(F.coalesce(s["content"], F.lit("")), 1, FOUND_CHARS))

    return F.when(F.size(sources) > 0, F.array_join(F.transform(sources, one), "\n\n")).otherwise((f"({label}) " if label else "") + NOTHING)


def prior_block(sources: Column, most: int = 3) -> Column:
    """The sources of the turn before, for the next prompt; empty without any."""
    one = lambda s, i: F.concat(F.lit(PRIOR_LABEL), _number(i), F.lit("] (ID: "), F.coalesce(s["doc_id"], F.lit("?")), F.lit(")\n"), F.substring(F.coalesce(s["content"], F.lit("")), 1, PRIOR_CHARS))
    return F.when(F.size(sources) > 0, F.array_join(F.concat(F.array(F.lit(PRIOR)), F.transform(F.slice(sources, 1, most), one)), "\n\n")).otherwise("")


def addon_block(skills: Column) -> Column:
    """The texts that skills (name, addon) add to a prompt; skills with a blank one are left out, no skills give nothing."""
    told = F.filter(skills, lambda s: strip(F.coalesce(s["addon"], F.lit(""))) != "")
    lines = F.transform(told, lambda s: F.concat(F.lit("## "), s["name"], F.lit("\n"), strip(s["addon"])))
    return F.when(F.size(skills) > 0, F.array_join(F.concat(F.array(F.lit(ADDONS)), lines), "\n")).otherwise("")


def listing(previews: Column) -> Column:
    """How many documents there are and the first of them, (doc_id, content) in order."""
    n = F.size(previews)
    lines = F.transform(F.slice(previews, 1, LIST_LINES), lambda p: F.concat(F.lit("- "), p["doc_id"], F.lit(": "), F.substring(F.coalesce(p["content"], F.lit("")), 1, LIST_CHARS), F.lit("...")))
    more = F.when(n > LIST_LINES, F.array(F.concat(F.lit("  ... 외 "), (n - LIST_LINES).cast("string"), F.lit("개")))).otherwise(F.array().cast("array<string>"))
    return F.when(n > 0, F.array_join(F.concat(F.array(F.concat(F.lit("총 "), n.cast("string"), F.lit(LISTED))), lines, more), "\n")).otherwise(NONE_LISTED)


def union_tools(first: Column, second: Column) -> Column:
    """Both sets of tools together, in order; null, which allows all, if either is null."""
    return F.when(first.isNotNull() & second.isNotNull(), F.array_sort(F.array_union(first, second)))


def chosen_stream(model: Column, aliases: dict[str, str], agent: bool = True) -> Column:
    """auto, agent or rag: what a model's name asks for; unknown names and a switched-off agent give auto."""
    out = F.lit("auto")
    for name, stream in aliases.items():
        if stream != "agent" or agent:
            out = F.when(model == name, stream).otherwise(out)
    return out


def override_events(score: Column, threshold: Column, trigger: Column, label: str, reasoning: Column) -> Column:
    """(type, content) of the events that correct a route: a thought if reasoning is shown, then the route."""
    by_word = F.format_string("corpus 키워드 매칭(유사도 %.2f)", score)
    by_vector = F.format_string("corpus 유사도 %.2f ≥ 임계 %.2f", score, threshold)
    thought = F.concat(F.lit("의도 보정: "), F.when(trigger == "keyword", by_word).otherwise(by_vector), F.lit(f" — {label} 분류 무시하고 단순 RAG로 정정"))
    event = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("content"))
    route = event("route", F.lit("simple"))
    return F.when(reasoning, F.array(event("thought", thought), route)).otherwise(F.array(route))


def without_artefacts(c: Column) -> Column:
    """A text without the marks that a binary word-processor file leaves; three line breaks or more become two."""
    return strip(F.regexp_replace(F.regexp_replace(c, ARTEFACTS, ""), r"\n{3,}", "\n\n"))
