"""Question-answer rows: building, rule checks, statistics and training formats."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import REJECT_PATTERNS, bigram_overlap, bigrams, question_type, strip
from .products import largest

#: Turns that one conversation may have before its places meet the next one's.
TURNS = 1 << 32

#: Characters of the texts that a tokenizer gets at once.
ENCODED_CHARS = 1 << 18


def qa_pairs(turns: DataFrame) -> DataFrame:
    """(pos, source_doc, question, answer): each user turn with the assistant turn right after it."""
    own = W.partitionBy("conv_id").orderBy("turn")
    seen = turns.withColumns({"next_role": F.lead("role").over(own), "answer": F.lead("text").over(own)})
    pairs = seen.where("role = 'user' and next_role = 'assistant'")
    return pairs.select((F.col("conv_id").cast("long") * TURNS + F.col("turn")).alias("pos"), F.col("conv_id").cast("string").alias("source_doc"), F.col("text").alias("question"), "answer")


def validate(pairs: DataFrame, least: int = 20, most: int = 2000, patterns: tuple[str, ...] = REJECT_PATTERNS) -> DataFrame:
    """Add ``reasons`` and ``accepted``.  An empty row has that one reason and hides no later copy of itself."""
    q, a = strip(F.coalesce("question", F.lit(""))), strip(F.coalesce("answer", F.lit("")))
    rows = pairs.withColumns({"q": q, "a": a}).withColumn("blank", (F.col("q") == "") | (F.col("a") == ""))
    rows = rows.withColumn("same", F.xxhash64(F.lower("q"), F.lower("a")))
    first = F.row_number().over(W.partitionBy(F.when(F.col("blank"), F.col("pos")), "same", F.lower("q"), F.lower("a")).orderBy("pos"))
    rows = rows.withColumn("copy", (first > 1) & ~F.col("blank"))
    size = F.length("a")
    reasons = [F.when(size < least, "answer_too_short"), F.when(size > most, "answer_too_long")]
    reasons += [F.when(F.regexp_like("answer", F.lit(p)), F.lit(f"reject_pattern:{k}")) for k, p in enumerate(patterns)]
    reasons += [F.when(F.col("copy"), "duplicate")]
    found = F.when(F.col("blank"), F.array(F.lit("empty_question_or_answer"))).otherwise(F.array_compact(F.array(*reasons)))
    return rows.withColumn("reasons", found).withColumn("accepted", F.size("reasons") == 0).drop("q", "a", "blank", "same", "copy")


def rejection_histogram(validated: DataFrame) -> DataFrame:
    """(reason, n) without the details after a colon or bracket."""
    each = validated.select(F.explode("reasons").alias("reason"))
    return each.groupBy(F.regexp_replace("reason", r"[:(].*$", "").alias("reason")).agg(F.count("*").alias("n"))


def paraphrase_filter(variants: DataFrame, least: float = 0.3, keep: int = 2) -> DataFrame:
    """Variants (question, variant, place) that share enough bigrams with their question, the first ``keep`` of each."""
    good = variants.withColumn("overlap", bigram_overlap(F.col("question"), F.col("variant"))).where(F.col("overlap") >= least)
    return good.withColumn("nth", F.row_number().over(W.partitionBy("question").orderBy("place"))).where(F.col("nth") <= keep).drop("nth")


def augmented(pairs: DataFrame, variants: DataFrame) -> DataFrame:
    """All ``pairs`` and, for each that is no augmentation itself, its ``variants`` (pos, variant) as pairs of their own.

    A new pair keeps everything of its pair but the question and the
    instruction, which are the variant, and ``is_augmented``.  Null
    ``is_augmented`` counts as false; variants of unknown pairs, null
    variants and variants of a null ``pos`` add nothing.
    """
    new = {"question": F.col("variant"), "instruction": F.col("variant"), "is_augmented": F.lit(True)}
    own = pairs.where(~F.coalesce("is_augmented", F.lit(False))).join(variants.where("variant is not null").select("pos", "variant"), "pos")
    return pairs.unionByName(own.select(*(new.get(c, F.col(c)).alias(c) for c in pairs.columns)))


def length_stats(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row of min, max, mean, median and sample deviation for each named text column."""
    parts = []
    for name, column in columns.items():
        size = F.length(column)
        parts.append(
            rows.agg(
                F.lit(name).alias("metric"), F.min(size).cast("long").alias("min"), F.max(size).cast("long").alias("max"), F.round(F.avg(size), 6).alias("mean"),
                F.percentile(size, F.lit(0.5)).alias("median"), F.round(F.coalesce(F.stddev_samp(size), F.lit(0.0)), 6).alias("stdev"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distribution(rows: DataFrame, column: str, blank: str) -> DataFrame:
    value = F.when(strip(F.coalesce(column, F.lit(""))) == "", blank).otherwise(F.col(column))
    return rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))


def diversity(rows: DataFrame, question: str = "question") -> DataFrame:
    """One row: distinct over all bigrams, and how many of the eight question types are found."""
    grams = rows.select(F.explode(bigrams(F.col(question))).alias("g")).groupBy("g").agg(F.count("*").alias("c"))
    counts = grams.agg(F.count("*").alias("d"), F.coalesce(F.sum("c"), F.lit(0)).alias("t"))
    types = rows.agg(F.count_distinct(question_type(F.col(question))).alias("types"))
    return counts.crossJoin(types).select((F.col("d") / F.greatest("t", F.lit(1))).alias("unique_bigram_ratio"), (F.col("types") / 8.0).alias("question_type_coverage"), F.col("types").alias("unique_question_types"))


def quality_warnings(pairs: DataFrame, category: str) -> DataFrame:
    """One row of the warnings that a dataset deserves, as flags."""
    per = pairs.groupBy("source_doc").agg(F.count("*").alias("n")).agg(F.max("n").alias("hi"), F.min("n").alias("lo"))
    size = F.length("answer")
    whole = pairs.agg(F.count("*").alias("n"), F.count_distinct(category).alias("categories"), F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias("sd"), F.avg(size).alias("mean"))
    out = per.crossJoin(whole).crossJoin(diversity(pairs))
    return out.select(
        (F.col("hi") > 5 * F.col("lo")).alias("sources_uneven"), (F.col("categories") == 1).alias("one_category"), (F.col("sd") > 1.5 * F.col("mean")).alias("lengths_uneven"),
        (F.col("n") < 50).alias("few_pairs"), (F.col("unique_bigram_ratio") < 0.3).alias("low_diversity"), (F.col("unique_question_types") <= 2).alias("few_types"),
    )


def compare_datasets(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(value, n_a, n_b, delta) over all values of either dataset."""
    left, right = (distribution(x, column, "uncategorized").withColumnRenamed("n", n) for x, n in ((a, "n_a"), (b, "n_b")))
    both = left.join(right, "value", "full_outer").na.fill(0, ["n_a", "n_b"])
    return both.withColumn("delta", F.col("n_b") - F.col("n_a"))


def chat_messages(pairs: DataFrame, system: str | None = None) -> DataFrame:
    """(pos, messages): the JSON of a chat with an optional system turn."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    turns = [turn("system", F.lit(system))] * bool(system) + [turn("user", F.col("question")), turn("assistant", F.col("answer"))]
    return pairs.select("pos", F.to_json(F.array(*turns)).alias("messages"))


def by_size(texts: list[str], most: int) -> Iterator[list[str]]:
    """``texts`` in order, in lists of at most ``most`` characters unless one text has more."""
    held: list[str] = []
    size = 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def token_count(text: Column, vocabulary: str) -> Column:
    """How many ids a tokenizer file gives a text, marks of its own included; null texts have none.

    ``vocabulary`` is the file's content, a few megabytes whatever the data
    are; every Python worker reads it once, texts come in Arrow batches.
    """

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # tasks are what runs side by side; threads of a tokenizer would each keep memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(vocabulary)
        for texts in batches:
            counts: list[int] = []
            # what the tokenizer returns takes many times a text, so only some of a batch is held at once
            for some in by_size(texts.fillna("").tolist(), ENCODED_CHARS):
                counts += [len(e.ids) for e in own.encode_batch_fast(some)]
            yield pd.Series(counts, dtype="int64")

    return run(text)


def fitting(rows: DataFrame, text: str, vocabulary: str, most: int) -> DataFrame:
    """Rows whose ``text`` has at most ``most`` tokens, with ``n_tokens``; null and longer texts are left out, none is cut."""
    counted = rows.where(F.col(text).isNotNull()).withColumn("n_tokens", token_count(F.col(text), vocabulary))
    return counted.where(F.col("n_tokens") <= most)


def in_batches(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Add ``batch``, from 0: every ``size`` rows of a group in ``order``."""
    place = F.row_number().over(W.partitionBy(group).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(place / size).cast("long"))


def split_prompt(rows: DataFrame, text: str, marker: str) -> DataFrame:
    """Add prompt and completion: what ends with the last marker, and what follows; all is completion without one."""
    has = F.contains(F.col(text), F.lit(marker))
    tail = F.substring_index(text, marker, -1)
    return rows.withColumns({"completion": F.when(has, tail).otherwise(F.col(text)), "prompt": F.when(has, F.substr(F.col(text), F.lit(1), F.length(text) - F.length(tail))).otherwise("")})


def hash_split(rows: DataFrame, key: str, percent: int = 90, seed: str = "42") -> DataFrame:
    """Add ``part``: train or eval by a hash of ``key``, the same in every run."""
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))), 1, 7), 16, 10).cast("long") % 100
    return rows.withColumn("part", F.when(bucket < percent, "train").otherwise("eval"))


def grounded(pairs: DataFrame, sources: DataFrame, least: float = 0.3) -> DataFrame:
    """Add ``similarity``, the best over the source's windows, and ``kept``; rows of unknown sources are kept.

    ``pairs`` is (pos, source_doc, vector), ``sources`` (source_doc, vector);
    vectors are of unit length.
    """
    best = pairs.select("pos", "source_doc").distinct().join(largest(pairs, sources), ["pos", "source_doc"], "left")
    return best.withColumn("kept", F.col("similarity").isNull() | (F.col("similarity") >= least))
