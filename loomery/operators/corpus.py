"""Chunk tables: identifiers, neighbours and lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import uuid5
from .ranks import numbered

#: Fixed value: the namespace of chunk ids.
CHUNK_NAMESPACE = uuid.UUID("b7e23f8a-4c19-4d7b-9a31-0f8e6d2c5a47")


def with_lineage(chunks: DataFrame) -> DataFrame:
    """Add chunk_id, prev_id, next_id and total_chunks to (doc_id, chunk_index, ...)."""
    own = W.partitionBy("doc_id").orderBy("chunk_index")
    chunk_id = uuid5(CHUNK_NAMESPACE, F.concat_ws("::", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
    out = chunks.withColumn("chunk_id", chunk_id)
    return out.withColumns(
        {"prev_id": F.lag("chunk_id").over(own), "next_id": F.lead("chunk_id").over(own), "total_chunks": F.count("*").over(W.partitionBy("doc_id"))}
    )


def coverage_sample(rows: DataFrame, n: int, group: str, order: str) -> DataFrame:
    """At most ``n`` rows: the first of every group, then the second ones, and so on."""
    turn = F.row_number().over(W.partitionBy(group).orderBy(order))
    # the bound on a group's turns lets each task drop the rest before rows are exchanged; a later turn could not be among the n
    return rows.withColumn("turn", turn).where(F.col("turn") <= n).withColumn("turn", F.col("turn").cast("long")).orderBy("turn", order, group).limit(n)


def every_nth(rows: DataFrame, n: int, order: str) -> DataFrame:
    """A stratified sample of ``n`` rows, len // n apart.

    Positions come from counts of ranges of ``order``, so no task sees the
    whole table.
    """
    total = rows.count()
    step = max(1, total // n)
    return numbered(rows, F.col(order)).where((F.col("place") % step == 0) & (F.col("place") < step * n))
