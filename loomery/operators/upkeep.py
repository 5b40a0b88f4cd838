"""Keeping derived data up to date: change detection, keyed merges, versions, content duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def diff_manifests(current: DataFrame, saved: DataFrame) -> DataFrame:
    """(name, change) for every name of either manifest (name, sha256): new, modified, deleted or same."""
    now, then = current.select("name", F.col("sha256").alias("now")), saved.select("name", F.col("sha256").alias("before"))
    change = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("before"), "modified").otherwise("same")
    return now.join(then, "name", "full_outer").select("name", change.alias("change"))


def merge_rows(new: DataFrame, old: DataFrame, keys: list[str], mode: str = "append", deleted: DataFrame | None = None) -> DataFrame:
    """First-wins merge on ``keys``, new rows ahead of old; ``replace`` takes only the new.

    ``pos`` orders each side.  Rows whose source is in ``deleted`` (source_doc)
    go as well if it is given; by default they stay.
    """
    rows = new.withColumn("side", F.lit(0))
    if mode == "append":
        rows = rows.unionByName(old.withColumn("side", F.lit(1)))
    if deleted is not None:
        rows = rows.join(deleted.select("source_doc").distinct(), "source_doc", "left_anti")
    first = F.row_number().over(W.partitionBy(*keys).orderBy("side", "pos"))
    return rows.withColumn("nth", first).where("nth = 1").drop("nth")


def distinct_contents(rows: DataFrame, content: str, name: str) -> DataFrame:
    """(digest, first, copies): each content once, under its least name."""
    return rows.groupBy(F.md5(F.coalesce(F.col(content), F.lit("")).cast("binary")).alias("digest")).agg(F.min(name).alias("first"), F.count("*").alias("copies"))


def name_versions(runs: DataFrame) -> DataFrame:
    """Add ``version``: vYYYYMMDD, with -2, -3 and so on for later runs of a day."""
    day = F.date_format("created", "yyyyMMdd")
    nth = F.row_number().over(W.partitionBy(day).orderBy("created", "run_id"))
    return runs.withColumn("nth", nth).withColumn("version", F.concat(F.lit("v"), day, F.when(F.col("nth") > 1, F.concat(F.lit("-"), F.col("nth").cast("string"))).otherwise(""))).drop("nth")


def retained_versions(versions: DataFrame, keep: int = 3) -> DataFrame:
    """Versions that stay: the last ``keep`` promoted, the current one, and the others only while the promoted are within ``keep``.

    ``versions`` has run_id (unique), promoted and current.  Only counts and
    the ``keep`` latest promoted runs are brought together.
    """
    latest = versions.where("promoted").orderBy(F.desc("run_id")).limit(keep).agg(F.min("run_id").alias("least"))
    total = versions.agg(F.count_if("promoted").alias("n_promoted")).crossJoin(latest)
    stays = F.col("current") | (F.col("n_promoted") <= keep) | (F.col("promoted") & (F.col("run_id") >= F.col("least")))
    # one row
    return versions.crossJoin(F.broadcast(total)).where(stays).drop("least", "n_promoted")
