"""From raw documents to packed training sequences, stage by stage.

Every stage but the last returns the columns of ``documents``; each is
written as Parquet and read again before the next.

Null and empty texts are documents like others: the classifier scores them,
they have no lines to lose and no near copies, count no tokens and become
sequences of a single end mark.  A row without a doc_id is scored, cut, mixed
and packed by itself and is never dropped as a near copy; repeated rows of
one doc_id are scored and cut each, and go together or stay together as near
copies.  Rows of a source that has no words at all have no weight in the mix
and are left out there.  Extra columns travel along up to the packing, and
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import jaccard, lines, mixing, packing, quality
from loomery.llm.queries import MIX_BLOCK, MIX_ENTROPY, MIX_REPETITION, byte_bpe
from loomery.llm.shared import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    seen = docs.select(F.struct(*docs.columns).alias("row"), *quality.view_columns(docs))
    return quality.classify_quality(seen, table(spark, sf_dir, "labels")).where("kept").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; a text that loses lines gets a new length."""
    cut = lines.dedup_lines(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "n_chars"), min_docs=10)
    new = {"text": F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return cut.select("row", *(e.alias(f"new_{c}") for c, e in new.items())).select(*(F.col(f"new_{c}" if c in new else f"row.{c}").alias(c) for c in docs.columns))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.keep_one(docs, words=5, percent=75)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is used once or more often, as its source's weight asks; rows are in the mix's order."""
    counted = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", mixing.count_words(F.col("text")).alias("n_tokens"))
    mixed = mixing.mix(counted, MIX_ENTROPY, MIX_REPETITION, block_tokens=MIX_BLOCK)
    return mixing.in_order(mixed).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, byte_bpe(), 2048)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Fitted models and tokenizers have no SQL form; the tests hold each stage against a plain version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents`` in turn."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
