"""Queries that measure retrieval and answers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import difficulty, tokens
from ..operators import evaluate as E
from ..operators import search as S
from .curation import PAIRS, pairs
from .registry import query, table
from .retrieval import BM25, VEC, texts, vectors

METRICS = """per AS (SELECT q.query_id, q.relevant, min(h.rank) AS first, count(DISTINCT h.id) AS found FROM (SELECT query_id, count(*) AS relevant FROM truth GROUP BY query_id) q
  LEFT JOIN (SELECT r.* FROM results r JOIN truth USING (query_id, id)) h ON h.query_id = q.query_id GROUP BY ALL)
SELECT count(*) AS n_queries, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_1, round(avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hit_at_k,
  round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr, round(avg(found / relevant), 6) AS recall_at_k FROM per"""


@query(f"""WITH {VEC}, results AS (SELECT query_id, rank, id FROM vr WHERE rank <= 10),
truth AS (SELECT q.vec_id AS query_id, v.vec_id AS id FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0), {METRICS}""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the same label are relevant."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return E.label_metrics(vectors(spark, sf_dir, 10), rows, rows.where("id % 100 = 0"), 10)


@query(f"""WITH {BM25}, chunk AS (SELECT query_id, source AS doc, min(rank) AS r FROM bmr JOIN documents d ON d.doc_id = id WHERE rank <= 10 GROUP BY ALL),
results AS (SELECT query_id, doc AS id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r, doc) AS rank FROM chunk) WHERE rank <= 5),
truth AS (SELECT DISTINCT b.item_id AS query_id, d.source AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), {METRICS}""")
def doc_level_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of documents that hold an item's text are relevant."""
    docs = table(spark, sf_dir, "documents")
    found = texts(spark, sf_dir, 10).join(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("doc")), "id")
    truth = S.holding(docs.select(F.col("source").alias("id"), "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item")))
    return E.document_metrics(found, truth, 5)


ROUGE = r"""w AS (SELECT pos, list_filter(regexp_split_to_array(lower(answer), '\s+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(question), '\s+'), lambda x: x <> '') AS b FROM pairs),
ga AS (SELECT pos, list_aggregate(a[i : i + N - 1], 'string_agg', ' ') AS g, count(*) AS c FROM w, unnest(range(1, greatest(len(a) - N + 2, 1))) AS u(i) GROUP BY ALL),
gb AS (SELECT pos, list_aggregate(b[i : i + N - 1], 'string_agg', ' ') AS g, count(*) AS c FROM w, unnest(range(1, greatest(len(b) - N + 2, 1))) AS u(i) GROUP BY ALL),
sh AS (SELECT pos, sum(least(ga.c, gb.c)) AS s FROM ga JOIN gb USING (pos, g) GROUP BY pos)
SELECT pos, round(CASE WHEN len(a) < N OR len(b) < N THEN 0.0 ELSE 2.0 * coalesce(s, 0) / (len(a) + len(b) - 2 * N + 2) END, 6) AS rouge FROM w LEFT JOIN sh USING (pos)"""


def rouge_sql(n: int) -> str:
    return re.sub(r"\bN\b", str(n), ROUGE)


@query(f"WITH {PAIRS}, {rouge_sql(1)}")
def rouge_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rouge_n(pairs(spark, sf_dir), "pos", "answer", "question", 1).withColumn("rouge", F.round("rouge", 6))


@query(f"WITH {PAIRS}, {rouge_sql(2)}")
def rouge_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rouge_n(pairs(spark, sf_dir), "pos", "answer", "question", 2).withColumn("rouge", F.round("rouge", 6))


WORDS = rf"""{PAIRS}, w AS (SELECT pos, list_filter(regexp_split_to_array(lower(answer), '\s+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(question), '\s+'), lambda x: x <> '') AS b FROM pairs)"""


@query(f"""WITH RECURSIVE {WORDS},
r AS (SELECT pos, a, b, CAST(0 AS BIGINT) AS i, list_transform(range(0, len(b) + 1), lambda x: CAST(0 AS BIGINT)) AS l FROM w WHERE len(a) > 0 AND len(b) > 0
  UNION ALL SELECT pos, a, b, i + 1, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) AS l
  FROM (SELECT pos, a, b, i, list_prepend(CAST(0 AS BIGINT), list_transform(range(1, len(b) + 1), lambda j: CASE WHEN b[j] = a[i + 1] THEN l[j] + 1 ELSE l[j + 1] END)) AS c FROM r WHERE i < len(a)))
SELECT pos, round(coalesce(2.0 * list_max(l) / (len(w.a) + len(w.b)), 0.0), 4) AS rouge FROM w LEFT JOIN (SELECT pos, l FROM r WHERE i = len(a)) r USING (pos)""")
def rouge_l_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-L of the answers and questions of all conversations."""
    words = pairs(spark, sf_dir).select("pos", tokens(F.col("answer")).alias("a"), tokens(F.col("question")).alias("b"))
    return words.select("pos", F.round(E.rouge_l(F.col("a"), F.col("b")), 4).alias("rouge"))


@query(f"""WITH {WORDS.replace(", w AS (", ", w0 AS (")}, w AS (SELECT pos, a AS b, list_transform(list_filter(range(1, len(a) + 1), lambda i: i % 9 <> 5), lambda i: a[i]) AS a FROM w0), n AS (SELECT unnest([1, 2, 3, 4]) AS n),
ga AS (SELECT pos, n, list_aggregate(a[i : i + n - 1], 'string_agg', ' ') AS g, count(*) AS c FROM (SELECT pos, a, n, unnest(range(1, greatest(len(a) - n + 2, 1))) AS i FROM w, n) GROUP BY ALL),
gb AS (SELECT pos, n, list_aggregate(b[i : i + n - 1], 'string_agg', ' ') AS g, count(*) AS c FROM (SELECT pos, b, n, unnest(range(1, greatest(len(b) - n + 2, 1))) AS i FROM w, n) GROUP BY ALL),
p AS (SELECT pos, n, sum(least(ga.c, coalesce(gb.c, 0))) / sum(ga.c) AS p FROM ga LEFT JOIN gb USING (pos, n, g) GROUP BY pos, n),
m AS (SELECT pos, min(p) AS low, count(*) AS have, sum(CASE WHEN p > 0 THEN ln(p) ELSE 0 END) / 4 AS log FROM p GROUP BY pos)
SELECT pos, round(CASE WHEN low > 0 AND have = 4 THEN exp(log + least(0.0, 1 - len(b) / len(a))) ELSE 0.0 END, 4) AS bleu FROM w LEFT JOIN m USING (pos)""")
def bleu_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU of the answers of all conversations without every ninth word against the whole ones."""
    whole = pairs(spark, sf_dir).select("pos", tokens(F.col("answer")).alias("b"))
    words = whole.select("pos", "b", F.filter("b", lambda x, i: i % 9 != 4).alias("a"))
    return E.bleu(words, "pos", "a", "b").withColumn("bleu", F.round("bleu", 4))


SCORES = "s AS (SELECT 'quality' AS metric, CAST(quality AS DOUBLE) AS score FROM labels UNION ALL SELECT 'toxic', CAST(toxic AS DOUBLE) FROM labels)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.expr("stack(2, 'quality', double(quality), 'toxic', double(toxic)) as (metric, score)"))


@query(f"""WITH {SCORES}, t AS (SELECT * FROM (VALUES ('quality', 0.5), ('toxic', 0.5), ('rougeL', 0.2)) AS v(metric, threshold))
SELECT t.metric, CAST(threshold AS DOUBLE) AS threshold, round(coalesce(avg(score), 0.0), 6) AS mean, coalesce(avg(score), 0.0) >= threshold AS passed FROM t LEFT JOIN s USING (metric) GROUP BY t.metric, threshold""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gate(scores(spark, sf_dir), {"quality": 0.5, "toxic": 0.5, "rougeL": 0.2})


@query("""WITH r AS (SELECT event_type AS metric, avg(value) AS b, avg(value + event_id % 3) AS t FROM events GROUP BY 1)
SELECT metric, round(b, 6) AS base, round(t, 6) AS tuned, round(CASE WHEN b > 0 THEN (t - b) / b * 100 WHEN t > 0 THEN 100.0 ELSE 0.0 END, 6) AS percent FROM r""")
def improvement_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.col("value").alias("base"), (F.col("value") + F.col("event_id") % 3).alias("tuned"))
    return E.improvement(rows)


RUNS = """r AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'read timeout' WHEN event_id % 13 = 0 THEN 'status 500' END AS error, CASE WHEN event_id % 7 = 0 THEN 'which?' END AS clarification,
  CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 17 = 0 THEN '관련 정보를 찾을 수 없습니다.' ELSE event_type || ' is the answer' END AS answer,
  CASE WHEN event_id % 3 = 0 THEN 'FAIL' WHEN event_id % 3 = 1 THEN 'PASS' ELSE 'PARTIAL' END AS verdict, CASE WHEN event_id % 19 = 0 THEN 'uncited' END AS warning, event_id % 2 = 0 AS expected_found FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, kind = F.col("event_id"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(i % 11 == 0, "read timeout").when(i % 13 == 0, "status 500").alias("error"), F.when(i % 7 == 0, "which?").alias("clarification"),
        F.when(i % 5 == 0, "").when(i % 17 == 0, "관련 정보를 찾을 수 없습니다.").otherwise(F.concat(kind, F.lit(" is the answer"))).alias("answer"),
        F.when(i % 3 == 0, "FAIL").when(i % 3 == 1, "PASS").otherwise("PARTIAL").alias("verdict"), F.when(i % 19 == 0, "uncited").alias("warning"), (i % 2 == 0).alias("expected_found"),
    )


@query(f"""WITH {RUNS} SELECT CASE WHEN contains(error, 'timeout') THEN 'timeout' WHEN error IS NOT NULL THEN 'http_error' WHEN clarification IS NOT NULL AND length(answer) = 0 THEN 'clarification_loop'
  WHEN length(answer) < 10 THEN 'empty_answer' WHEN verdict = 'FAIL' THEN 'verifier_fail' WHEN warning IS NOT NULL THEN 'citation_miss'
  WHEN contains(answer, '관련 정보를 찾을 수 없') AND expected_found THEN 'wrongful_refusal' ELSE 'none' END AS failure, count(*) AS n FROM r GROUP BY 1""")
def failure_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure kinds of runs made up from the events."""
    return E.failure(runs(spark, sf_dir)).groupBy("failure").agg(F.count("*").alias("n"))


@query(f"""WITH {RUNS}, v AS (SELECT verdict FROM r WHERE event_id % 4 <> 0)
SELECT count(*) AS n, round(count(*) FILTER (verdict = 'PASS') * 100.0 / count(*), 6) AS pass_rate, round(count(*) FILTER (verdict = 'PARTIAL') * 100.0 / count(*), 6) AS partial_rate,
  round(count(*) FILTER (verdict = 'FAIL') * 100.0 / count(*), 6) AS fail_rate FROM v""")
def judge_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 4 == 0, "control-ambiguous").otherwise("query")
    return E.judge_rates(runs(spark, sf_dir).withColumn("kind", kind))


@query(f"WITH {PAIRS} SELECT CASE WHEN length(answer) < 50 THEN 'easy' WHEN length(answer) < 200 THEN 'medium' ELSE 'hard' END AS difficulty, count(*) AS n FROM pairs GROUP BY 1")
def difficulty_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy(difficulty(F.col("answer")).alias("difficulty")).agg(F.count("*").alias("n"))


FAILURES = """CASE WHEN contains(error, 'timeout') THEN 'timeout' WHEN error IS NOT NULL THEN 'http_error' WHEN clarification IS NOT NULL AND length(answer) = 0 THEN 'clarification_loop'
  WHEN length(answer) < 10 THEN 'empty_answer' WHEN verdict = 'FAIL' THEN 'verifier_fail' WHEN warning IS NOT NULL THEN 'citation_miss' WHEN contains(answer, '관련 정보를 찾을 수 없') AND expected_found THEN 'wrongful_refusal' ELSE 'none' END"""


@query(f"""WITH {RUNS}, t AS (SELECT event_id, event_type AS label, CASE WHEN event_id % 11 <> 0 THEN (event_id % 8) / 4 END AS first_token, (event_id % 64) / 4 AS total FROM events)
SELECT label, count(*) AS n_runs, count(*) FILTER ({FAILURES} <> 'none') AS n_failures, count(*) FILTER (expected_found) AS n_expected,
  round(avg(coalesce(first_token, 0.0)), 3) AS avg_first_token, round(avg(total), 3) AS avg_total FROM r JOIN t USING (event_id) GROUP BY label""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the events, labelled by their kind; those that time out have no first token."""
    i = F.col("event_id")
    times = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("label"), F.when(i % 11 != 0, i % 8 / 4).alias("first_token"), (i % 64 / 4).alias("total"))
    return E.run_summary(E.failure(runs(spark, sf_dir)).join(times, "event_id"))


@query("""WITH e AS (SELECT event_id // 25 AS request, event_id % 25 AS seq, event_type, CASE event_id % 25 WHEN 22 THEN 'done' WHEN 0 THEN 'route' ELSE CASE WHEN (event_id // 25) % 7 = 0 THEN 'action' ELSE 'token' END END AS type FROM events),
t AS (SELECT request, min(seq / 8) FILTER (type = 'token') AS f, max(seq / 8) AS z, coalesce(sum(length(event_type)) FILTER (type = 'token'), 0) AS n FROM e WHERE seq <= 22 GROUP BY request)
SELECT count(*) AS n, round(avg(coalesce(f, 0.0)), 3) AS avg_first_token, round(avg(z), 3) AS avg_total, round(avg(coalesce(round(n / greatest(z - f, 0.001), 1), 0.0)), 1) AS avg_chars_per_sec FROM t""")
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event streams of 25 events each, of which those after ``done`` do not count; every seventh has no token."""
    request, seq = F.floor(F.col("event_id") / 25), F.col("event_id") % 25
    kind = F.when(seq == 22, "done").when(seq == 0, "route").when(request % 7 == 0, "action").otherwise("token")
    rows = table(spark, sf_dir, "events").select(request.alias("request"), seq.alias("seq"), (seq / 8).alias("seconds"), kind.alias("type"), F.col("event_type").alias("content"))
    return E.stream_summary(E.request_trace(rows))


@query(f"""WITH {PAIRS}, d AS (SELECT *, CASE pos % 5 WHEN 0 THEN 'Finance' WHEN 1 THEN 'public sector' WHEN 2 THEN 'Law & Order' WHEN 3 THEN 'commerce' END AS domain FROM pairs)
SELECT 'bench_' || regexp_replace(lower(domain), '[^a-z0-9]+', '', 'g') || '_' || printf('%03d', row_number() OVER (PARTITION BY domain ORDER BY pos)) AS id, 'qa' AS intent, question AS query, answer AS expected,
  source_doc AS expected_doc, domain, CASE WHEN length(coalesce(answer, '')) < 50 THEN 'easy' WHEN length(coalesce(answer, '')) < 200 THEN 'medium' ELSE 'hard' END AS difficulty
FROM d WHERE domain IN ('Finance', 'public sector', 'Law & Order')""")
def evaluation_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs, dealt to four domains and none, of which three are wanted."""
    part = F.col("pos") % 5
    named = F.when(part == 0, "Finance").when(part == 1, "public sector").when(part == 2, "Law & Order").when(part == 3, "commerce")
    return E.evaluation_set(pairs(spark, sf_dir).withColumn("domain", named), ("Finance", "public sector", "Law & Order"), "bench")
