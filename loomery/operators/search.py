"""Retrieval: BM25, vectors, TF-IDF, rank fusion and what follows a ranked list.

Ranked lists are tables (query_id, rank, id, score); ties always go to the
smaller id, on scores rounded to nine digits so that summing order is no matter.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import BLANKS, char_ngrams, tokens
from .products import ROWS, nearest
from .ranks import BROADCAST_ROWS, bounded, in_blocks
from .scan import scan_topk

#: BM25 parameters and the share of the mean idf that replaces a negative one.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60


def postings(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(term, id, tf, dl) of every document."""
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text)).alias("words"))
    each = words.select("id", F.size("words").cast("long").alias("dl"), F.explode("words").alias("term"))
    return each.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def bm25_stats(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row: documents, total and average length."""
    size = F.size(tokens(F.col(text))).cast("long")
    return docs.agg(F.count("*").alias("n_docs"), F.sum(size).alias("n_tokens"), F.avg(size).alias("avgdl"))


def ranked(scored: DataFrame, k: int, score: str = "score", query: str = "query_id", item: str = "id") -> DataFrame:
    """The best ``k`` of each query with their rank from 1."""
    order = W.partitionBy(query).orderBy(F.round(score, 9).desc(), item)
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def bm25_scores(docs: DataFrame, queries: DataFrame, id_col: str, text: str, query_id: str, query_text: str) -> DataFrame:
    """(query_id, id, score) of every document that shares a term with a query.

    Query terms count as often as they are asked.  Only words that a query
    asks for become postings; the other words are counted by document
    frequency alone, which the floor of the idf needs.
    """
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text)).alias("words"))
    stats = words.agg(F.count("*").alias("n_docs"), F.avg(F.size("words")).alias("avgdl"))
    df = words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))
    df = df.withColumn("raw", F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    floor = df.agg((F.avg("raw") * EPSILON).alias("floor"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    wanted = asked.select("term").distinct()
    terms = df.join(bounded(wanted), "term", "left_semi").crossJoin(F.broadcast(floor)).select("term", "avgdl", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    each = words.select("id", F.size("words").cast("long").alias("dl"), F.explode("words").alias("term")).join(bounded(wanted), "term", "left_semi")
    hits = each.groupBy("term", "id", "dl").agg(F.count("*").alias("tf")).join(asked.join(terms, "term"), "term")
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "id").agg(F.sum(F.col("qtf") * F.col("idf") * part).alias("score"))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_id, rank, id, score) by one pass over the documents; a list ends where scores are no longer positive."""
    return ranked(scan_topk(docs, queries, k, id_col, text, query_id, query_text, K1, B, EPSILON), k)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", block: int = ROWS) -> DataFrame:
    """Exact cosine top-k of a set of queries, ``block`` of them at a time at most; blocks of either side meet in tasks."""
    side = lambda rows: rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    return ranked(nearest(side(vectors), side(queries), k, block), k)


def tfidf_cosine(docs: DataFrame, queries: DataFrame, id_col: str, text: str, query_id: str, query_text: str, n: int = 3) -> DataFrame:
    """(query_id, id, score): cosine of character n-gram TF-IDF; each query is one more document of its own corpus."""
    grams = lambda rows, i, t, name: rows.select(F.col(i).alias(name), F.explode(char_ngrams(F.lower(F.col(t)), n)).alias("gram")).groupBy(name, "gram").agg(F.count("*").alias("c"))
    d, q = grams(docs, id_col, text, "id"), grams(queries, query_id, query_text, "query_id")
    total = docs.agg((F.count("*") + 1).alias("n"))
    share = lambda rows, name: rows.withColumn("tf", F.col("c") / F.sum("c").over(W.partitionBy(name)))
    d, q = share(d, "id"), share(q, "query_id")
    df = d.groupBy("gram").agg(F.count("*").alias("df"))
    # a gram of the query is in one more document
    weighted = q.join(df, "gram", "left").crossJoin(F.broadcast(total)).withColumn("idf", F.ln(F.col("n") / (F.coalesce("df", F.lit(0)) + 1)))
    q_norm = weighted.groupBy("query_id").agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)).alias("qn"))
    plain = d.join(df, "gram").crossJoin(F.broadcast(total)).withColumn("w", F.col("tf") * F.ln(F.col("n") / F.col("df")))
    d_norm = plain.groupBy("id").agg(F.sum(F.col("w") ** 2).alias("dn2"))
    both = weighted.select("query_id", "gram", "idf", F.col("tf").alias("qtf")).join(plain.select("gram", "id", "tf", "w"), "gram")
    # shared grams weigh less in the document too, as the query adds to their df
    pair = both.groupBy("query_id", "id").agg(F.sum(F.col("qtf") * F.col("tf") * F.col("idf") ** 2).alias("top"), F.sum((F.col("tf") * F.col("idf")) ** 2 - F.col("w") ** 2).alias("less"))
    out = pair.join(q_norm, "query_id").join(d_norm, "id")
    norm = F.col("qn") * F.sqrt(F.greatest(F.col("dn2") + F.col("less"), F.lit(0.0)))
    return out.select("query_id", "id", F.when(norm > 1e-12, F.col("top") / norm).otherwise(0.0).alias("score"))


def holding(docs: DataFrame, items: DataFrame, block: int = BROADCAST_ROWS) -> DataFrame:
    """(query_id, id): which of ``docs`` (id, text) hold the whole text of which of ``items`` (query_id, item), as it is.

    A word with white space on both sides in an item is a word of every text
    that holds the item; the longest one leads to the texts that can.  Only
    items without such a word, of two words at most, are looked for in every text.
    """
    inner = F.split("item", BLANKS)
    inner = F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    items = items.withColumn("word", longest)
    words = docs.select("id", "text", F.explode(F.array_distinct(F.split("text", BLANKS))).alias("word"))
    held = [words.join(some, "word").where(F.contains("text", F.col("item"))) for some in in_blocks(items.where("word is not null"), block)]
    held += [docs.join(some, F.contains("text", F.col("item"))) for some in in_blocks(items.where("word is null"), block)]
    return reduce(DataFrame.unionByName, [h.select("query_id", "id") for h in held])


def rrf(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, first_seen, scores): reciprocal-rank fusion; an id twice in a list counts twice.

    ``first_seen`` is the place (list, rank) of the first appearance and
    ``scores`` has the id's own best score in each list, null where it is not.
    """
    rows = None
    for at, one in enumerate(lists):
        part = one.select("query_id", "id", "rank", F.lit(at).alias("list"), F.col("score").alias("own"))
        rows = part if rows is None else rows.unionByName(part)
    own = [F.max(F.when(F.col("list") == at, F.col("own"))) for at in range(len(lists))]
    return rows.groupBy("query_id", "id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first_seen"), F.array(*own).alias("scores"))


def fused_topk(*lists: DataFrame, k: int = 5) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "first_seen", "id")
    return rrf(*lists).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def soft_minimum(results: DataFrame, least: float) -> DataFrame:
    """Rows of at least the score; all rows of a query where none has it."""
    good = F.col("score") >= least
    count = F.sum(good.cast("long")).over(W.partitionBy("query_id"))
    return results.withColumn("passing", count).where(good | (F.col("passing") == 0)).drop("passing")


def lost_in_middle(results: DataFrame) -> DataFrame:
    """Add ``place``: the best first and last, the weakest in the middle; lists under three stay."""
    own = W.partitionBy("query_id")
    i, n = F.col("rank") - 1, F.count("*").over(own)
    place = F.when(n < 3, i).when(i % 2 == 0, F.floor(i / 2)).otherwise(n - 1 - F.floor((i - 1) / 2))
    return results.withColumn("place", place.cast("long"))


def pack_context(results: DataFrame, body: str, name: str) -> DataFrame:
    """(query_id, n_sources, context): bodies in order, one for each first 100 characters, under a label."""
    once = F.row_number().over(W.partitionBy("query_id", F.substring(body, 1, 100)).orderBy("place", "id"))
    kept = results.withColumn("seen", once).where("seen = 1")
    n = F.row_number().over(W.partitionBy("query_id").orderBy("place", "id"))
    part = F.concat(F.lit("[doc "), F.col("n").cast("string"), F.lit(" | doc:"), F.col(name).cast("string"), F.lit("]\n"), F.col(body))
    parts = kept.withColumn("n", n).select("query_id", "n", part.alias("part"))
    listed = F.array_sort(F.collect_list(F.struct("n", "part")))
    return parts.groupBy("query_id").agg(F.count("*").alias("n_sources"), F.array_join(F.transform(listed, lambda x: x["part"]), "\n\n").alias("context"))


def best_per_source(results: DataFrame, source: str) -> DataFrame:
    """One row for each query and source: its best score at the place of its first appearance."""
    return results.groupBy("query_id", source).agg(F.max("score").alias("score"), F.min("rank").alias("first_rank"))


def hybrid_ground_truth(bm25: DataFrame, tfidf: DataFrame, owned: DataFrame | None = None, least: float = 0.05, k: int = 3) -> DataFrame:
    """Top chunks of each question: 0.4 BM25 over its maximum plus 0.6 cosine; at least the best one.

    Both inputs are (query_id, id, score); ``owned`` (query_id, id) limits
    the candidates to the chunks of each question's own document.
    """
    if owned is not None:
        tfidf, bm25 = (x.join(owned, ["query_id", "id"], "left_semi") for x in (tfidf, bm25))
    both = tfidf.select("query_id", "id", F.col("score").alias("cosine")).join(bm25.select("query_id", "id", F.col("score").alias("bm25")), ["query_id", "id"], "left")
    both = both.withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    top = F.max("bm25").over(W.partitionBy("query_id"))
    both = both.withColumn("score", 0.4 * F.when(top > 0, F.col("bm25") / top).otherwise(F.col("bm25")) + 0.6 * F.col("cosine"))
    return ranked(both, k).where((F.col("score") > least) | (F.col("rank") == 1))


def rerank(pool: DataFrame, texts: DataFrame, asked: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], k: int = 5) -> DataFrame:
    """(query_id, rank, id, rerank_score, score): a fused pool in the order of a scorer of (question, text) pairs.

    ``pool`` (query_id, id, score) is the union of several searches before any
    of them was cut to ``k``; ``texts`` is (id, body), ``asked`` (query_id,
    question).  The scorer gets batches of pairs; a pair without a question or
    a text has score 0.  Equal scores go by falling text, then by falling id.
    """
    scored = F.pandas_udf(scorer, "double")
    pairs = pool.select("query_id", "id", "score").join(texts.select("id", "body"), "id").join(asked.select("query_id", "question"), "query_id", "left")
    whole = F.col("question").isNotNull() & F.col("body").isNotNull()
    judged = pairs.withColumn("rerank_score", F.when(whole, scored(F.coalesce("question", F.lit("")), F.coalesce("body", F.lit("")))).otherwise(0.0))
    order = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("body"), F.desc("id"))
    return judged.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "id", "rerank_score", "score")


def term_overlap(question: pd.Series, body: pd.Series) -> pd.Series:
    """The share of the question's distinct words that a text has, in hundredths."""
    shares = []
    for q, t in zip(question, body, strict=True):
        words = set(q.lower().split())
        shares.append(round(len(words & set(t.lower().split())) * 100 / len(words)) / 100 if words else 0.0)
    return pd.Series(shares, dtype="float64")
