"""Nouns of a language that writes particles behind them, cut from the corpus itself.

A word is cut behind the prefix that holds together best inside and is
followed by the most different things: cohesion is the share of the words
with the prefix's first character that have all of it, as a mean of one
character; branching is the entropy of what follows, the end included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Longest prefix that is tried.
LONGEST = 8


def word_counts(rows: DataFrame, text: str, pattern: str = r"\p{L}+") -> DataFrame:
    """(word, n) of the lower-cased runs of letters."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    return rows.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def prefix_scores(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(prefix, score) of the prefixes of two characters or more of (word, n)."""
    size = F.least(F.length("word"), F.lit(longest))
    each = words.select("word", "n", F.explode(F.sequence(F.lit(1), size)).alias("k"))
    parts = each.select(F.substr("word", F.lit(1), F.col("k")).alias("prefix"), F.substr("word", F.col("k") + 1, F.lit(1)).alias("next"), "n")
    follows = parts.groupBy("prefix", "next").agg(F.sum("n").alias("n"))
    totals = follows.groupBy("prefix").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.ln("n")).alias("spread"))
    first = totals.where(F.length("prefix") == 1).select(F.col("prefix").alias("head"), F.col("total").alias("head_total"))
    # one row for each character that a word can open with
    joined = totals.where(F.length("prefix") > 1).withColumn("head", F.substring("prefix", 1, 1)).join(first, "head")
    cohesion = (F.col("total") / F.col("head_total")) ** (1 / (F.length("prefix") - 1))
    branching = F.ln("total") - F.col("spread") / F.col("total")
    return joined.select("prefix", F.round(cohesion * F.greatest(branching, F.lit(0.0)), 9).alias("score"))


def noun_counts(rows: DataFrame, text: str, least: int = 2, most: int = 100, stops: tuple[str, ...] = (), pattern: str = r"\p{L}+", longest: int = LONGEST) -> DataFrame:
    """(noun, n, place): the ``most`` frequent heads of the words of ``text``, of two characters and ``least`` uses or more.

    Ties go to the first by spelling.  Words of one character have no noun;
    of equal scores the longest prefix counts, so a word that is never
    followed by anything is a noun as it is.
    """
    words = word_counts(rows, text, pattern)
    tried = words.where(F.length("word") > 1).select("word", "n", F.explode(F.transform(F.sequence(F.lit(2), F.least(F.length("word"), F.lit(longest))), lambda k: F.substr("word", F.lit(1), k))).alias("prefix"))
    scored = tried.join(prefix_scores(words, longest), "prefix")
    best = scored.groupBy("word", "n").agg(F.max(F.struct("score", F.length("prefix"), "prefix"))["prefix"].alias("noun"))
    counts = best.groupBy("noun").agg(F.sum("n").alias("n")).where((F.col("n") >= least) & ~_in(F.col("noun"), stops))
    top = counts.orderBy(F.desc("n"), "noun").limit(most)
    # at most ``most`` rows are numbered
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "noun")).cast("long"))


def _in(c: Column, words: tuple[str, ...]) -> Column:
    return c.isin(*words) if words else F.lit(False)
