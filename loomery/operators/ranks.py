"""Places in a whole table's order, and broadcasts of counted size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import written

#: Most rows of a side that a join may broadcast.
BROADCAST_ROWS = 20_000


def bounded(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with a broadcast hint if there are at most ``most`` of them, else as they are."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def in_blocks(rows: DataFrame, most: int = BROADCAST_ROWS) -> list[DataFrame]:
    """``rows`` dealt by hash into broadcast blocks of about ``most`` rows: a stated set meets a table block by block, never as a product of two shuffles."""
    blocks = max(1, -(-rows.count() // most))
    if blocks == 1:
        return [F.broadcast(rows)]
    return [F.broadcast(rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(blocks)) == i)) for i in range(blocks)]


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Add ``place``, from 0, in ``order``: ranges are numbered each by itself and moved by the counts of those before.

    No task sees the whole table; the counts have a row for each range.  The
    ranges are written once, since two plans over one table may cut it
    differently.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    placed = ranged.withColumn("place", own).join(F.broadcast(before), "part")
    return placed.withColumn("place", (F.col("place") + F.col("before")).cast("long")).drop("part", "before")
