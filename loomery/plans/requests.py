"""Queries of routing, gates, citations and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import routing as R
from ..operators import sessions as S
from .registry import query, table
from .retrieval import BM25, texts

ROUTED = r"""r AS (SELECT conv_id, turn, text, list_filter(['vs', 'versus', 'pros', 'cons'], lambda k: contains(lower(text), k)) AS found,
  regexp_matches(text, '(?i)^\s*((hi|hello|hey|yo|howdy)(\s+(there|guys|all|everyone|folks))?|good\s*(morning|afternoon|evening|night|day)|how\s*are\s*you|thanks?|thank\s*you|thx|cheers|sorry|bye|goodbye|see\s*(you|ya)|ok(ay)?|alright|sure|nope?|yep|yeah|who\s*are\s*you|what\s*can\s*you\s*do)[\s.!?,~]*$') AS chats,
  length(text) - length(replace(replace(text, '?', ''), '？', '')) AS marks FROM conversations WHERE role = 'user'),
m AS (SELECT conv_id, turn, CASE WHEN len(found) > 0 THEN 'agent' WHEN chats THEN 'chitchat' WHEN marks >= 2 THEN 'agent' ELSE 'simple' END AS mode,
  CAST(CASE WHEN len(found) > 0 THEN 0.8 WHEN chats THEN 0.0 WHEN marks >= 2 THEN 0.7 ELSE 0.1 END AS DOUBLE) AS complexity, found[1] AS matched_keyword FROM r)"""


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", R.route(F.col("text")).alias("r")).select("conv_id", "turn", "r.*")


@query(f"WITH {ROUTED} SELECT * FROM m")
def route_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir)


@query(f"""WITH {ROUTED}, c AS (SELECT *, (turn * 37 + conv_id * 11) % 100 / 100.0 AS confidence FROM m)
SELECT conv_id, turn, CASE WHEN confidence >= CASE WHEN mode = 'agent' THEN 0.85 ELSE 0.7 END THEN 'general' ELSE mode END AS mode, confidence < 0.95 AND confidence >= 0.55 AS overridden FROM c""")
def route_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route after a classifier with made-up confidences, and whether the corpus overrides it."""
    rows = routed(spark, sf_dir).withColumn("confidence", (F.col("turn") * 37 + F.col("conv_id") * 11) % 100 / 100.0)
    over = R.corpus_override(F.col("confidence"), F.when(F.col("confidence") < 0.95, F.col("confidence")).otherwise(0.0), F.lit(False))
    return rows.select("conv_id", "turn", R.merge_route(F.col("mode"), F.lit("general"), F.col("confidence")).alias("mode"), over.alias("overridden"))


@query(f"""WITH {BM25}, p AS (SELECT query_id, count(*) AS n, max(score) AS best, sum(score) AS total FROM bmr WHERE rank <= 5 AND query_id % 3 <> 0 GROUP BY query_id)
SELECT b.item_id AS query_id, coalesce(n, 0) AS n_sources, round(best, 6) AS best, round(CASE WHEN n >= 2 THEN (total - best) / (n - 1) END, 6) AS rest_mean,
  coalesce(n, 0) = 0 OR best < 12.0 AS below_floor, coalesce(n >= 2 AND total - best > 0 AND best < (total - best) / (n - 1) * 1.1, false) AS below_rest
FROM benchmark b LEFT JOIN p ON p.query_id = b.item_id""")
def refusal_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates on the text search; every third item is left without results."""
    found = texts(spark, sf_dir, 5).where("query_id % 3 <> 0")
    return R.refusal_gates(found, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")), 12.0, 0.1)


@query("""WITH a AS (SELECT doc_id AS answer_id, source, doc_id % 10 AS m FROM documents)
SELECT answer_id, CAST(0 AS BIGINT) AS place, 'made-up ' || answer_id || '.pdf' AS cited FROM a WHERE m IN (0, 3) UNION ALL SELECT answer_id, 2, 'x' FROM a""")
def citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations without a source, in answers made up from the documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), "source")
    name = F.when((F.col("answer_id") % 10).isin(0, 3), F.concat(F.lit("made-up "), F.col("answer_id").cast("string"), F.lit(".pdf"))).otherwise(F.concat("source", F.lit("-file.pdf")))
    answers = docs.select("answer_id", F.concat(F.lit("See [doc:"), name, F.lit("] and [doc:"), "source", F.lit("-file::p5] but not [doc:x].")).alias("answer"))
    return R.audit_citations(answers, docs.select("answer_id", F.concat(F.upper("source"), F.lit("-file.pdf#chunk_3")).alias("source")))


@query(r"""WITH s AS (SELECT * FROM (VALUES ('length', 'regex:.{300,}', 5), ('the', 'the', 9), ('and', 'and', 9), ('digits', 'regex:\d', 7), ('never', 'zzzz', 10)) AS v(skill, trigger, priority)),
h AS (SELECT doc_id AS query_id, skill, priority FROM documents, s WHERE CASE WHEN starts_with(trigger, 'regex:') THEN regexp_matches(text, trigger[7:]) ELSE contains(lower(text), trigger) END),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, skill) AS place FROM h)
SELECT query_id, skill, place FROM r WHERE place <= 3""")
def skill_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("length", "regex:.{300,}", 5), ("the", "the", 9), ("and", "and", 9), ("digits", r"regex:\d", 7), ("never", "zzzz", 10)]
    skills = spark.createDataFrame(rules, "skill string, trigger string, priority int")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return R.match_skills(docs, skills)


@query("""WITH l AS (SELECT 0 AS source, doc_id AS place, upper(source) AS keyword FROM documents UNION ALL SELECT 1, doc_id, lang FROM documents UNION ALL SELECT 2, doc_id, source FROM documents),
f AS (SELECT keyword, source, place, row_number() OVER (PARTITION BY lower(keyword) ORDER BY source, place) AS nth FROM l)
SELECT keyword, row_number() OVER (ORDER BY source, place, lower(keyword)) AS place FROM f WHERE nth = 1 ORDER BY place LIMIT 60""")
def keyword_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = lambda i, c: docs.select(F.lit(i).alias("source"), F.col("doc_id").alias("place"), c.alias("keyword"))
    return R.merge_keywords(part(0, F.upper("source")).unionByName(part(1, F.col("lang"))).unionByName(part(2, F.col("source"))))


@query("""WITH g AS (SELECT *, coalesce(CAST(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 AS INT), 0) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)
SELECT user_id, session, count(*) AS n_events, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS micros FROM s GROUP BY user_id, session""")
def session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after an hour without an event."""
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return S.session_table(table(spark, sf_dir, "events")).select("user_id", "session", "n_events", (at("end") - at("start")).alias("micros"))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 4")
def history_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.capped_history(table(spark, sf_dir, "conversations"), 4).select("conv_id", "turn")


LABEL = "CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'System' END || ': ' || coalesce(text, '')"


@query(f"SELECT conv_id, count(*) AS n_turns, string_agg({LABEL}, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def history_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.transcript(table(spark, sf_dir, "conversations"))


@query(f"""WITH c AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, turn, role, text FROM c WHERE n <= 6 OR back <= 3 UNION ALL
SELECT conv_id, -1, 'system', substr(string_agg({LABEL}, chr(10) ORDER BY turn), 1, 500) FROM c WHERE n > 6 AND back > 3 GROUP BY conv_id""")
def compress_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.compressed(table(spark, sf_dir, "conversations"), 3)


@query("SELECT user_id, nth FROM (SELECT user_id, row_number() OVER (ORDER BY max(ts) DESC, user_id) AS nth FROM events GROUP BY user_id) WHERE nth > 100")
def lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.evicted(table(spark, sf_dir, "events"), 100).select("user_id", "nth")


@query("""SELECT user_id, count(*) FILTER (event_type = 'view') AS n_tokens, count(*) FILTER (event_type = 'purchase') AS n_done,
  (min(CASE WHEN event_type = 'view' THEN epoch_us(ts) END) - min(epoch_us(ts))) / 1e6 AS first_token_s, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS total_s FROM events GROUP BY user_id""")
def token_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.token_metrics(table(spark, sf_dir, "events"))
