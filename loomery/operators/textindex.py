"""A BM25 index in files: built once, read by many searches.

A term's postings lie in blocks by falling weight, each with the largest
weight in it, in a bucket of the term.  A search reads the buckets of its
words, learns from the first blocks what its k-th result reaches at least,
and leaves out every block none of whose documents can reach that.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..sources.store import commit, latest, written
from .search import EPSILON, K1, B, ranked

#: Postings of a block, postings of a term that one task orders, and what rounding may change in a score.
BLOCK, SPREAD, MARGIN = 128, 1 << 20, 1e-8


class TextIndex:
    """The index in ``folder``, of the last :meth:`build` there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def build(self, docs: DataFrame, id_col: str, text: str, buckets: int = 32) -> TextIndex:
        """Index the words of ``text``; documents are split into words once.

        The postings of a frequent term are dealt by id before they are
        ordered, so no task has all of them.
        """
        # dealt by id, a document's words are counted where they are split
        words = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).repartition("id").select("id", tokens(F.col("text")).alias("words"))
        each = words.select("id", F.size("words").alias("dl"), F.explode("words").alias("term"))
        postings = written(each.groupBy("id", "dl", "term").agg(F.count("*").cast("int").alias("tf")), "postings")
        n_docs, n_tokens = docs.count(), postings.agg(F.sum("tf")).first()[0] or 0
        average = n_tokens / n_docs if n_tokens else 1.0
        raw = F.ln((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        terms = postings.groupBy("term").agg(F.count("*").alias("df")).withColumn("raw", raw)
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        terms = terms.withColumn("bucket", bucket)
        terms.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/terms")
        terms = self.spark.read.schema(terms.schema).parquet(f"{path}/terms")
        floor = terms.agg(F.avg("raw") * EPSILON).first()[0] or 0.0

        part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))
        weighed = postings.join(terms.select("term", "df", "bucket"), "term").withColumns({"weight": part, "share": F.pmod(F.xxhash64("id"), F.ceil(F.col("df") / SPREAD))})
        place = F.row_number().over(W.partitionBy("term", "share").orderBy(F.desc("weight"), "id")) - 1
        rows = weighed.withColumn("block", F.floor(place / BLOCK).cast("int"))
        blocks = rows.groupBy("bucket", "term", "share", "block").agg(F.max("weight").alias("most"), F.collect_list(F.struct("id", "weight")).alias("postings"))
        blocks.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/blocks")
        commit(self.spark, self.folder, latest(self.spark, self.folder)[0] + 1, {"path": path, "buckets": buckets, "floor": floor, "schemas": {"terms": terms.schema.json(), "blocks": blocks.schema.json()}})
        return self

    def _asked(self, queries: DataFrame, query_id: str, text: str) -> DataFrame:
        """(query_id, bucket, term, factor): the words of each query that documents have, and what a posting's weight is multiplied by."""
        state = latest(self.spark, self.folder)[1]
        asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        asked = asked.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(state["buckets"])).cast("int"))
        idf = F.when(F.col("raw") < 0, F.lit(state["floor"])).otherwise(F.col("raw"))
        return asked.join(self._read("terms").select("term", "bucket", "raw"), ["bucket", "term"]).select("query_id", "bucket", "term", (F.col("qtf") * idf).alias("factor"))

    def _read(self, name: str) -> DataFrame:
        state = latest(self.spark, self.folder)[1]
        return self.spark.read.schema(T.StructType.fromJson(json.loads(state["schemas"][name]))).parquet(f"{state['path']}/{name}")

    def needed(self, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, factor, bucket, term, share, block) of the blocks that can hold one of the ``k`` best of a query.

        A posting adds at most its block's bound, all other words together at
        most the sum of their own bounds; the k-th best by the first blocks
        alone bounds the k-th best from below.  Where a word weighs nothing
        or less that is not so, and all blocks count.
        """
        key, own = ["bucket", "term"], W.partitionBy("query_id")
        blocks = self._read("blocks").select(*key, "share", "block", "most").join(asked, key).withColumn("bound", F.col("factor") * F.col("most"))
        top = blocks.where("block = 0").groupBy("query_id", "term").agg(F.max("bound").alias("top"))
        top = top.withColumns({"rest": F.sum("top").over(own) - F.col("top"), "least": F.min("top").over(own)})
        first = scores(self._read("blocks").where("block = 0").join(asked, key))
        bar = first.withColumn("place", F.row_number().over(own.orderBy(F.desc("score")))).where(F.col("place") == k).select("query_id", F.col("score").alias("bar"))
        seen = blocks.join(top, ["query_id", "term"]).join(bar, "query_id", "left")
        can = F.col("bar").isNull() | (F.col("least") <= 0) | (F.col("bound") + F.col("rest") >= F.col("bar") - MARGIN)
        return seen.where(can).select("query_id", "factor", *key, "share", "block")

    def topk(self, queries: DataFrame, k: int, query_id: str = "item_id", text: str = "text") -> DataFrame:
        """(query_id, rank, id, score) of the ``k`` best documents of each query; a list ends where scores are no longer positive."""
        asked = written(self._asked(queries, query_id, text), "asked")
        hits = self._read("blocks").join(self.needed(asked, k), ["bucket", "term", "share", "block"])
        return ranked(scores(hits).where("score > 0"), k)


def scores(blocks: DataFrame) -> DataFrame:
    """(query_id, id, score) of blocks with their ``factor``."""
    each = blocks.select("query_id", "factor", F.explode("postings").alias("p"))
    return each.groupBy("query_id", F.col("p.id").alias("id")).agg(F.sum(F.col("factor") * F.col("p.weight")).alias("score"))
