"""Cutting texts into chunks: fixed windows, blank-line boundaries, headed sections.

Texts without a blank line have a closed form and stay in the JVM.  Only texts
with blank lines or headings pass through a small Python helper.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Heading shapes, the largest sections first.
HEADINGS = (
    r"(?m)^[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ][.．]\s*.+",
    r"(?m)^(?!(?:19|20)\d{2}[.．])\d{1,2}[.．]\s+\S.+",
    r"(?m)^(?:\(\d+\)|\d+\))\s+\S.+",
    r"(?m)^[가-힣][.．)]\s+\S.+",
    r"(?m)^[□■○●◦]\s+.+",
)
MERGE_BELOW, DROP_BELOW = 500, 200
#: Unicode's spaces, which SQL's trim takes off, and all that comes off the edges of a piece.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
EDGES = SPACES + "\t\n\x0b\x0c\r"
#: Characters of a title and of a parent section.
TITLE_CHARS, PARENT_CHARS = 60, 12_000


def starts(size: Column, chunk: int, overlap: int) -> Column:
    """Chunk starts of a text of ``size`` characters that has no blank line."""
    step = chunk - overlap
    last = F.when(size <= chunk, 0).otherwise(F.ceil((size - chunk) / F.lit(step)))
    return F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda k: k * step)


def windows(text: Column, chunk: int = 512, overlap: int = 64) -> Column:
    """Windows at every multiple of the step below the length; the last may lie within the one before."""
    step = chunk // 4 * 3 if overlap >= chunk else chunk - overlap
    size = F.length(text)
    at = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / F.lit(step)).cast("int")), lambda k: k * step)
    return F.when(size > 0, F.transform(at, lambda p: F.substr(text, p + 1, F.lit(chunk)))).otherwise(F.array().cast("array<string>"))


def blank_line_spans(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of chunks that end at the last blank line of their second half, if there is one."""
    at, size = 0, len(text)
    while size > chunk and at + chunk < size:
        end = text.rfind("\n\n", at + chunk // 2, at + chunk)
        end = end if end > at else at + chunk
        yield at, end
        at = end - overlap if end - overlap > at else end
    if at < size or not size:
        yield at, size


def chunk_documents(docs: DataFrame, chunk: int = 512, overlap: int = 102, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, start, contents) of every document with a text that is not blank."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).where(F.regexp_like("text", F.lit(r"(?U)\S")))
    broken = F.contains("text", F.lit("\n\n"))
    plain = rows.where(~broken).select(id_col, "text", F.posexplode(starts(F.length("text"), chunk, overlap)).alias("chunk_index", "start"))
    plain = plain.select(id_col, F.col("chunk_index").cast("long").alias("chunk_index"), "start", F.substr("text", (F.col("start") + 1).cast("int"), F.lit(chunk)).alias("contents"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(d, k, a, t[a:b]) for d, t in zip(batch[id_col], batch["text"], strict=True) for k, (a, b) in enumerate(blank_line_spans(t, chunk, overlap))], columns=[id_col, "chunk_index", "start", "contents"])

    kind = docs.schema[id_col].dataType.simpleString()
    return plain.unionByName(rows.where(broken).mapInPandas(run, f"{id_col} {kind}, chunk_index long, start long, contents string"))


def _pieces(text: str, size: int) -> list[str]:
    return [text[a:b] for a, b in blank_line_spans(text, size, min(500, size // 5))]


def _cut_at(text: str, at: list[int]) -> list[str]:
    edges = [*at, len(text)]
    return [text[a:b].strip(EDGES) for a, b in zip(edges, edges[1:], strict=False)]


def _headed(text: str, least: int) -> list[int]:
    for pattern in HEADINGS:
        found = [m.start() for m in re.finditer(pattern, text)]
        if len(found) >= least:
            return found
    return []


def _gather(parts: list[str], size: int) -> list[str]:
    """Neighbours put together while they fit."""
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(part) + 2 <= size:
            out[-1] += "\n\n" + part
        else:
            out.append(part)
    return out


def section_chunks(text: str, size: int) -> list[str]:
    """The chunks of :func:`headed_chunks`."""
    return [chunk for chunk, _ in headed_chunks(text, size)]


def headed_chunks(text: str, size: int) -> list[tuple[str, bool]]:
    """(chunk, whether it begins where a section does) along the headings of the largest level found three times or more.

    Small sections wait in a buffer that takes in what follows while it
    fits.  A full buffer is emitted; the section that did not fit starts the
    next one if it is small, else it is emitted too.
    """
    at = _headed(text, 3)
    if not at:
        return [(p, False) for p in _pieces(text, size)]
    parts = [p for p in ([text[: at[0]].strip(EDGES)] + _cut_at(text, at)) if p]
    merged: list[str] = []
    held = ""
    for part in parts:
        if held and len(held) + 2 + len(part) <= size:
            held += "\n\n" + part
            continue
        if held:
            merged.append(held)
            held = ""
        if len(part) < MERGE_BELOW:
            held = part
        else:
            merged.append(part)
    if held and merged and len(merged[-1]) + len(held) + 2 <= size:
        merged[-1] += "\n\n" + held
    elif held:
        merged.append(held)
    out = [piece for part in merged for piece in _within(part, size)]
    return [p for p in out if len(p[0].strip(EDGES)) >= DROP_BELOW] or [(p, k == 0) for k, p in enumerate(_pieces(text, size))]


def _within(part: str, size: int) -> list[tuple[str, bool]]:
    """A section as it is if it fits, else along its inner headings, else in plain pieces, of which only the first begins where the section does."""
    if len(part) <= size:
        return [(part, True)]
    inner = _headed(part, 2)
    out: list[tuple[str, bool]] = []
    for piece in _gather(_cut_at(part, inner), size) if inner else [part]:
        out += [(piece, True)] if len(piece) <= size else [(p, k == 0) for k, p in enumerate(_pieces(piece, size))]
    return out


def _title(text: str) -> str:
    """The heading that a text opens with, if it does."""
    line = text.strip(EDGES).split("\n", 1)[0].strip(EDGES)
    return line[:TITLE_CHARS] if any(re.match(p, line) for p in HEADINGS) else ""


def context_chunks(text: str, size: int) -> list[tuple[str, str, str, str]]:
    """(chunk id, context, parent, contents) along two levels of headings.

    The large sections are those of :func:`section_chunks` before small ones
    are put together.  The context names the large section and, where a chunk
    opens with another heading, that one; the parent is the large section, cut
    at its end.  Texts without sections, or with small ones only, are cut as
    there, each chunk its own parent.
    """
    at = _headed(text, 3)
    found = []
    for k, section in enumerate(p for p in [text[: at[0]].strip(EDGES), *_cut_at(text, at)] if p) if at else ():
        major = _title(section)
        for i, (piece, opens) in enumerate(_within(section, size)):
            if len(piece.strip(EDGES)) < DROP_BELOW:
                continue
            minor = _title(piece) if opens else ""
            names = [major, minor] if minor not in ("", major) else [major]
            found.append((f"section_{k}_chunk_{i}", f"[{' > '.join(names)}]" if major else "", section[:PARENT_CHARS], piece))
    return found or [(f"chunk_{i}", "", c, c) for i, c in enumerate(section_chunks(text, size))]


def chunk_with_context(docs: DataFrame, size: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, chunk_id, context, parent, contents) of every document with a text that is not blank."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, *c) for d, t in zip(batch[id_col], batch["text"], strict=True) for k, c in enumerate(context_chunks(t, size))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "chunk_id", "context", "parent", "contents"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).where(F.regexp_like("text", F.lit(f"[^{EDGES}]")))
    return rows.mapInPandas(run, f"{id_col} {kind}, chunk_index long, chunk_id string, context string, parent string, contents string")


def chunk_sections(docs: DataFrame, size: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, contents, title): section-aware chunks; title is the heading that a chunk opens with, of a section or of one within it."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, c, _title(c) or None if opens else None) for d, t in zip(batch[id_col], batch["text"], strict=True) for k, (c, opens) in enumerate(headed_chunks(t, size))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "contents", "title"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).where(F.regexp_like("text", F.lit(f"[^{EDGES}]")))
    return rows.mapInPandas(run, f"{id_col} {kind}, chunk_index long, contents string, title string")


def auto_chunk_size(text: Column, context: int = 12_000) -> Column:
    """A chunk size from a text's length and the density of its paragraphs."""
    size, ceiling = F.length(text), context - 2000
    long = F.filter(F.split(text, "\n\n"), lambda p: F.length(F.regexp_replace(p, r"(?U)^\s+|\s+$", "")) > 20)
    mean = F.when(F.size(long) > 0, F.aggregate(long, F.lit(0), lambda a, p: a + F.length(p)) / F.size(long)).otherwise(350.0)
    scale = F.greatest(F.lit(0.7), F.least(F.lit(1.3), mean / 350))
    target = F.greatest(F.lit(3), F.ceil(F.sqrt(size / F.lit(2000))))
    raw = F.floor(size / target * scale)
    return F.when(size <= ceiling, ceiling).otherwise(F.greatest(F.lit(2000), F.least(raw, F.lit(ceiling)))).cast("long")


def auto_questions(text: Column) -> Column:
    """How many questions a chunk is good for, from its length, numbers and list items."""
    numbers = F.regexp_count(text, F.lit(r"\d{4}[년.]|\d+[%원건명개호조억만대]|\d+[.,]\d+"))
    items = F.regexp_count(text, F.lit(r"(?m)^\s*[-•·◦▪]\s|^\s*\d+[.)]\s|^\s*[가-힣][.)]\s|^\s*[oO]\s|^\s*\(\d+\)"))
    raw = F.length(text) / 1200 + F.least(numbers * 0.3, F.lit(3.0)) + F.least(items * 0.2, F.lit(2.0))
    return F.greatest(F.lit(3), F.least(F.bround(raw), F.lit(15))).cast("long")
