"""Registered queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

from . import cover, jaccard, lexical, lines, mixing, negatives, neighbours, packing, quality, repetition, substrings, toxicity, warc
from .shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


MIX_ENTROPY, MIX_REPETITION, MIX_BLOCK = 0.9, 4.0, 1 << 20


@query
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents mixed to nine tenths of the largest entropy, no document more than four times."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.count_words(F.col("text")).alias("n_tokens"))
    return mixing.with_positions(mixing.mix(docs, MIX_ENTROPY, MIX_REPETITION, block_tokens=MIX_BLOCK))


ORACLES["op1_source_mixing"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents
),
s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY source HAVING sum(n_tokens) > 0),
p AS (SELECT source, tokens, tokens / (SELECT CAST(sum(tokens) AS DOUBLE) FROM s) AS p, {MIX_ENTROPY} * ln((SELECT count(*) FROM s)) AS goal FROM s),
b AS (
  SELECT 0 AS k, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN met THEN lo ELSE mid END, CASE WHEN met THEN mid ELSE hi END
  FROM (
    SELECT k, lo, hi, mid, ln(sum(pow(p, mid))) - mid * sum(pow(p, mid) * ln(p)) / sum(pow(p, mid)) <= max(goal)
           AND max(pow(p, mid) / p) / min(pow(p, mid) / p) <= {MIX_REPETITION} AS met
    FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE k < 40), p GROUP BY k, lo, hi, mid
  )
),
a AS (SELECT hi AS a FROM b WHERE k = 40),
q AS (
  SELECT source, tokens, CAST(floor(w / z * (z / least) * (1 + 1e-9)) AS BIGINT) AS quota
  FROM (SELECT source, tokens, pow(p, a) AS w FROM p, a),
       (SELECT sum(pow(p, a)) AS z, min(pow(p, a) / tokens) AS least FROM p, a)
),
e AS (
  SELECT d.doc_id, d.source, d.n_tokens, q.tokens, q.quota, epoch, md5(d.doc_id || ':' || epoch || ':0') AS key,
         CAST(greatest(1, ceil((SELECT sum(quota) FROM q) / {MIX_BLOCK})) AS BIGINT) AS blocks
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source, unnest(range(0, quota // tokens + 1)) AS u(epoch)
),
c AS (
  SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY key, n_tokens ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM e
),
m AS (
  SELECT doc_id, source, n_tokens, CAST(epoch AS BIGINT) AS epoch,
         CAST(least(floor(CAST(epoch * tokens + upto - n_tokens AS DOUBLE) * blocks / quota), blocks - 1) AS BIGINT) AS block
  FROM c WHERE epoch < quota // tokens OR upto <= quota % tokens
)
SELECT *, row_number() OVER (PARTITION BY block ORDER BY md5(doc_id || ':' || epoch || ':0:block'), n_tokens) AS position FROM m
"""


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more leave every document."""
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op2_line_dedup"] = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, pos, ls[pos] AS line,
         translate(trim(ls[pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM t, unnest(range(1, len(ls) + 1)) AS u(pos)
),
f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f USING (k)
GROUP BY doc_id
"""


@query
def op3_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector, by inner product."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 2048 tokens; documents and attention cost bound only by that."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), byte_bpe(), 2048)


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document, from a model fitted on at most 30,000 labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.grade_toxicity(docs, table(spark, sf_dir, "labels"))


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies: five-word shingles, similarity of 0.75 or more."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=5, percent=75)


ORACLES["op6_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, list_aggregate(ws[i : i + 4], 'string_agg', ' ') AS sh
  FROM w, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS u(i)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))
),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) m USING (doc_id)
"""


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, from views fitted on at most 8,000 labelled and 8,000 other ones."""
    out = quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "text_score", "metadata_score", "quality_score", "kept")


@query
def op8_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures of every document and whether it is kept."""
    return repetition.repetition_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through an archive and back."""
    index = warc.archive_pages(table(spark, sf_dir, "pages"), min_bytes=1000)
    return warc.read_records(index, with_payload=False)


ORACLES["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM w
"""


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in strings of 400 bytes that are found twice or more leave every document."""
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 400)
    # what is left as text: a cut inside a character leaves a replacement mark
    kept = F.make_valid_utf8(F.col("kept").cast("string"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("changed"), kept.alias("kept_text"))


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    out = lexical.rank_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), items, k=10)
    return out.select("item_id", "rank", "doc_id", "score")


ORACLES["op11_lexical_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
a AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
p AS (SELECT r, doc_id, n, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, a GROUP BY t, n_docs),
s AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN p USING (t), a GROUP BY item_id, r, doc_id
),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""


@query
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in sequences of 35 that are found twice or more leave every document."""
    out = cover.remove_repeated_words(table(spark, sf_dir, "documents").select("doc_id", "text"), 35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("changed"), F.col("kept").alias("kept_text"))


ORACLES["op12_substring_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, i, list_aggregate(ws[i : i + 34], 'string_agg', ' ') AS win FROM t, unnest(range(1, len(ws) - 33)) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n FROM v) WHERE n > 1),
k AS (
  SELECT t.doc_id, t.j, t.word, max(r.i) OVER (PARTITION BY t.doc_id ORDER BY t.j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM t) t LEFT JOIN r ON r.doc_id = t.doc_id AND r.i = t.j
)
SELECT t.doc_id, CAST(len(t.ws) AS BIGINT) AS n_words, count(*) FILTER (k.gone) AS n_removed,
       sha256(coalesce(string_agg(k.word, ' ' ORDER BY k.j) FILTER (NOT k.gone), '')) AS kept_sha256,
       count(*) FILTER (k.gone) > 0 AS changed, coalesce(string_agg(k.word, ' ' ORDER BY k.j) FILTER (NOT k.gone), '') AS kept_text
FROM t LEFT JOIN k USING (doc_id) GROUP BY t.doc_id, t.ws
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives just below each of the five positives of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    rows = negatives.scaled(vectors)
    return negatives.hard_negatives(rows, rows.where("id % 100 = 0"))


ORACLES["op13_hard_negatives"] = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5
),
n AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
