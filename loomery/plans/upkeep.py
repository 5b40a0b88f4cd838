"""Queries that keep derived data up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import upkeep as U
from .curation import PAIRS, pairs
from .registry import query, table

NEW = "new AS (SELECT pos, source_doc, question, answer || ' (new)' AS answer FROM pairs WHERE CAST(source_doc AS BIGINT) % 2 = 1 AND pos % 4294967296 < 4)"


@query("""WITH now AS (SELECT CAST(doc_id AS VARCHAR) AS name, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 9 <> 0),
old AS (SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 5 = 0 THEN 'altered' ELSE sha256(coalesce(text, '')) END AS h FROM documents WHERE doc_id % 7 <> 0)
SELECT name, CASE WHEN old.h IS NULL THEN 'new' WHEN now.h IS NULL THEN 'deleted' WHEN now.h <> old.h THEN 'modified' ELSE 'same' END AS change FROM now FULL JOIN old USING (name)""")
def hash_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    saved = docs.where("doc_id % 7 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 5 == 0, "altered").otherwise(F.col("sha256")))
    return U.diff_manifests(docs.where("doc_id % 9 <> 0"), saved)


def newer(rows: DataFrame) -> DataFrame:
    return rows.where("cast(source_doc as bigint) % 2 = 1 and pos % 4294967296 < 4").withColumn("answer", F.concat("answer", F.lit(" (new)")))


@query(f"""WITH {PAIRS}, {NEW}, a AS (SELECT *, 0 AS side FROM new UNION ALL SELECT *, 1 FROM pairs)
SELECT source_doc, question, answer, pos FROM (SELECT *, row_number() OVER (PARTITION BY question, source_doc ORDER BY side, pos) AS nth FROM a) WHERE nth = 1""")
def merge_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir)
    return U.merge_rows(newer(rows), rows, ["question", "source_doc"]).select("source_doc", "question", "answer", "pos")


@query(f"""WITH {PAIRS}, {NEW} SELECT source_doc, question, answer, pos FROM (SELECT *, row_number() OVER (PARTITION BY question, source_doc ORDER BY pos) AS nth FROM new) WHERE nth = 1""")
def merge_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir)
    return U.merge_rows(newer(rows), rows, ["question", "source_doc"], "replace").select("source_doc", "question", "answer", "pos")


@query("SELECT md5(coalesce(text, '')) AS digest, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.distinct_contents(table(spark, sf_dir, "documents"), "text", "doc_id")


VERSIONS = """v AS (SELECT o_orderkey AS run_id, o_orderkey % 3 = 0 AS promoted, o_orderkey = (SELECT min(o_orderkey) FROM orders) AS current,
  'v' || strftime(CAST(o_orderdate AS TIMESTAMP), '%Y%m%d') || CASE WHEN row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderdate, o_orderkey) > 1
  THEN '-' || row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderdate, o_orderkey) ELSE '' END AS version FROM orders)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version history made up from the orders."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created"), (F.col("o_orderkey") % 3 == 0).alias("promoted"))
    first = orders.agg(F.min("run_id").alias("current_id"))
    return U.name_versions(orders).crossJoin(F.broadcast(first)).withColumn("current", F.col("run_id") == F.col("current_id")).select("run_id", "promoted", "current", "version")


@query(f"WITH {VERSIONS} SELECT run_id, version FROM v")
def version_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).select("run_id", "version")


@query(f"""WITH {VERSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY promoted ORDER BY run_id DESC) AS nth, (SELECT count(*) FROM v WHERE promoted) AS n FROM v)
SELECT run_id, version FROM r WHERE current OR n <= 3 OR (promoted AND nth <= 3)""")
def version_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.retained_versions(versions(spark, sf_dir), 3).select("run_id", "version")
