"""Writing pairs, training files, corpora and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_pairs(pairs: DataFrame, path: str) -> None:
    """One JSON object a line with all columns of ``pairs``; nulls stay as such."""
    pairs.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def alpaca_rows(pairs: DataFrame) -> DataFrame:
    """instruction, input (empty), output, source_doc and category of pairs."""
    return pairs.select(F.coalesce("instruction", "question").alias("instruction"), F.lit("").alias("input"), F.col("answer").alias("output"), "source_doc", "category")


def write_alpaca(pairs: DataFrame, path: str) -> None:
    alpaca_rows(pairs).write.mode("overwrite").json(path)


def write_training(rows: DataFrame, column: str, path: str) -> int:
    """Write the JSON texts of ``column``, one a line, and say how many; an empty table is an error and writes nothing."""
    rows = rows.where(F.col(column).isNotNull())
    if rows.isEmpty():
        raise ValueError("there are no rows to train on")
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
    return rows.count()


def write_corpus(chunks: DataFrame, qa: DataFrame, folder: str) -> None:
    """corpus.parquet and qa.parquet below ``folder``."""
    chunks.write.mode("overwrite").parquet(f"{folder}/corpus.parquet")
    qa.write.mode("overwrite").parquet(f"{folder}/qa.parquet")


def write_report(row: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file."""
    row.coalesce(1).write.mode("overwrite").json(path)
