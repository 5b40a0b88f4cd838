"""Column functions over text: cleaning, tokens, n-grams, identifiers and patterns.

All of them are built-in expressions, so plans that use them run in the JVM.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of answers that say nothing.
REJECT_PATTERNS = (
    "(?i)i don't know",
    "(?i)not (available|provided|mentioned|found)",
    "(?i)the document does not contain",
    "(?:알|확인할|파악할|판단할) 수 없",
    "정보.{0,8}(?:없|부족|찾을 수 없)",
    "(?:문서|자료|내용)에서?.{0,12}(?:찾을 수 없|포함되어 있지 않|언급되지 않|다루고 있지 않)",
)
#: Parts and openings of questions by type, in order of precedence.
QUESTION_TYPES = (
    ("what", ("무엇", "뭐", "어떤", "무슨"), "what "),
    ("how", ("어떻게", "얼마나"), "how "),
    ("why", ("왜", "어째서"), "why "),
    ("when", ("언제",), "when "),
    ("where", ("어디",), "where "),
    ("who", ("누가", "누구"), "who "),
    ("yes-no", ("인가요", "인지", "나요", "습니까", "is it", "does it", "can "), None),
)
#: Shapes of acronyms and standard names, without their boundaries.
ACRONYM_PATTERNS = (r"\d+G", r"Wi[Ff]i\s*\d+[A-Z]*", r"IEEE\s+\d+(?:\.\d+)*(?:[a-z]+)?", r"WPA\s*\d+", r"Sub-?\d+", r"FR\d+", r"[A-Z][a-z]{1,3}[A-Z][a-z]?", r"[A-Z]{2,6}")
#: Acronyms that say nothing about a domain.
ACRONYM_STOPLIST = (
    "TV USB PDF HTML XML JSON CSV URL URI OK OR AND NOT IF IS AT IN ON BY TO AM PM DC AC OS PC NO YES "
    "EU UN US UK KR JP CN ID IP IT AAA AA BBB BB CCC CC DDD DD"
).split()


#: White space of any script, spelt out: quicker than asking for it as a property.
BLANKS = r"[ \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def tokens(c: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), BLANKS), lambda x: x != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body's lambdas use it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def char_ngrams(c: Column, n: int) -> Column:
    """All n-character substrings in order; none of a shorter text."""
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substr(t, i, F.lit(n)))
    return let(c, lambda t: F.when(F.length(t) >= n, grams(t)).otherwise(F.array().cast("array<string>")))


def bigrams(c: Column) -> Column:
    """Character bigrams, lower-cased, without spaces."""
    return char_ngrams(F.lower(F.replace(c, F.lit(" "), F.lit(""))), 2)


def bigram_overlap(a: Column, b: Column) -> Column:
    """Shared distinct bigrams over those of the richer text; 0 if either has none."""
    x, y = F.array_distinct(bigrams(a)), F.array_distinct(bigrams(b))
    most = F.greatest(F.size(x), F.size(y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / most)


def word_ngrams(words: Column, n: int) -> Column:
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    return let(words, lambda w: F.when(F.size(w) >= n, grams(w)).otherwise(F.array().cast("array<string>")))


def question_type(c: Column) -> Column:
    q, out = F.lower(strip(c)), F.lit("other")
    for name, parts, opening in reversed(QUESTION_TYPES):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(q, F.lit(p))
        if opening:
            hit = hit | F.startswith(q, F.lit(opening))
        out = F.when(hit, name).otherwise(out)
    return out


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """Name-based UUID (version 5)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substr(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def drop_page_numbers(c: Column) -> Column:
    """Without lines that hold only a page number; three line breaks or more become two."""
    for pattern in (r"(?m)^\s*[-—–]\s*\d+\s*[-—–]\s*$", r"(?m)^\s*\d+\s*$", r"(?m)^\s*(?i:page)\s+\d+\s*$"):
        c = F.regexp_replace(c, pattern, "")
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def date_from_name(c: Column) -> Column:
    """A YYMMDD in a file name as 20YY-MM-DD; null if there is none."""
    part = F.regexp_extract(c, r"\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])", 0)
    return F.when(part != "", F.concat(F.lit("20"), F.substring(part, 1, 2), F.lit("-"), F.substring(part, 3, 2), F.lit("-"), F.substring(part, 5, 2)))


def stem_key(c: Column) -> Column:
    """A file name for matching: no extension, blanks or ``_-[]()+``, lower-cased."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"\.[A-Za-z0-9]{1,5}$", ""), r"[\s_\-\[\]()+]", ""))


def acronyms(c: Column) -> Column:
    """All matches of the acronym shapes between characters that are not ASCII letters or digits."""
    found = [F.regexp_extract_all(c, F.lit(rf"(?<![A-Za-z0-9])({p})(?![A-Za-z0-9])"), F.lit(1)) for p in ACRONYM_PATTERNS]
    clean = F.transform(F.flatten(F.array(*found)), lambda t: F.regexp_replace(t, r"\s+", " "))
    return F.filter(clean, lambda t: (F.length(t) >= 2) & ~t.isin(*ACRONYM_STOPLIST))


def strip_fences(c: Column) -> Column:
    """The inside of a fenced code block, else the text."""
    inside = F.regexp_extract(c, r"(?s)```[a-zA-Z]*\s*(.*?)```", 1)
    return strip(F.when(inside != "", inside).otherwise(c))


def strip_thinking(c: Column) -> Column:
    """Without <think> parts and <|...|> marks."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"<\|[^|>]*\|>", ""))


def first_json(c: Column) -> Column:
    """The JSON object from the first { to the last }, else null."""
    body = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(body != "", F.try_parse_json(body))


def reply_score(c: Column) -> Column:
    """The score 1-5 of a judge's reply: its JSON, else a number after a key word, else a lone digit."""
    number = F.try_variant_get(first_json(strip_fences(c)), "$.score", "double")
    named = F.regexp_extract(c, r"(?i)(?:score|점수)\D{0,5}([1-5])", 1).try_cast("double")
    lone = F.when(F.regexp_count(c, F.lit(r"(?<!\d)[1-5](?!\d)")) == 1, F.regexp_extract(c, r"(?<!\d)([1-5])(?!\d)", 1)).try_cast("double")
    return F.coalesce(F.when(number.between(1, 5), number), named, lone)


def difficulty(c: Column) -> Column:
    return F.when(F.length(c) < 50, "easy").when(F.length(c) < 200, "medium").otherwise("hard")


def middle_cut(c: Column, size: int = 8000) -> Column:
    """Head and tail of a long text with a mark between them."""
    half = size // 2
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, half), F.lit("\n...\n"), F.right(c, F.lit(half)))).otherwise(c)
