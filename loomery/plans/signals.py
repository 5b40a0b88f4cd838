"""Queries of request signals, tables, traces and measures, on texts made from the events and on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking as C
from ..functions import replies as R
from ..functions import signals as S
from ..functions.text import tokens
from ..operators import evaluate as E
from ..operators import routing
from .curation import PAIRS, pairs
from .registry import query, table
from .replies import reply_query

words = lambda *x: F.array(*map(F.lit, x))

reply_query(
    "keyword_in_query",
    [("the SLA가 {v}", (True,)), ("slack {v}", (False,)), ("통신망 {v}", (True,)), ("a 4x4-mimo", (True,)), ("nothing {v}", (False,)), ("c++ here", (True,)), ("x", (False,))],
    {"found": "BOOLEAN"},
    lambda c: S.has_keyword(c, words("SLA", "통신", "4x4-MIMO", "C++", "x")),
)
reply_query(
    "route_cases",
    [
        *((f"{{v}} {k} {{v}}", ("agent", 0.8, k)) for k in routing.COMPLEX_KEYWORDS if k not in ("versus", "다른점", "장점과 단점")),
        ("A VERSUS B", ("agent", 0.8, "versus")),
        ("다른점은", ("agent", 0.8, "다른점")),
        ("장점과 단점", ("agent", 0.8, "장점과 단점")),
        *((t, ("chitchat", 0.0, None)) for t in ("안녕하세요!", "  hello everyone ~", "네", "こんにちは。", "谢谢", "xin chào", "what's up??", "How are you", "니 이름은 뭐야?", "thx")),
        ("{v}? {v}?", ("agent", 0.7, None)),
        ("{v}？ {v}?", ("agent", 0.7, None)),
        ("사과 와 바나나를 {v}", ("agent", 0.75, None)),
        ("hello {v}", ("simple", 0.1, None)),
        ("{v}?", ("simple", 0.1, None)),
    ],
    {"mode": "VARCHAR", "complexity": "DOUBLE", "matched_keyword": "VARCHAR"},
    routing.route,
)
reply_query(
    "route_override",
    [("0.9,0.6,f", (True,)), ("0.9,0.5,t", (True,)), ("0.9,0.5,f", (False,)), ("0.97,0.6,f", (False,)), ("0.97,0.65,f", (True,)), ("0.97,0.6,t", (True,)), ("0.97,0.5,t", (False,))],
    {"overridden": "BOOLEAN"},
    lambda c: routing.corpus_override(F.split_part(c, F.lit(","), F.lit(1)).cast("double"), F.split_part(c, F.lit(","), F.lit(2)).cast("double"), F.split_part(c, F.lit(","), F.lit(3)) == "t"),
)
reply_query(
    "in_domain_gate",
    [("말해줘 {v} RFP", (0.5, ["RFP"])), ("세 가지 항목을 요약해줘", (0.5, [])), ("세 가지 API 항목을 요약해줘", (0.9, [])), ("weather {v}", (0.9, [])), ("rfp 통신 nms bis", (0.5, ["RFP", "통신", "NMS"]))],
    {"confidence": "DOUBLE", "matched": "VARCHAR[]"},
    lambda c: S.in_domain_gate(c, F.lit("general"), F.lit(0.9), words("RFP", "통신", "이것", "z", "NMS", "BIS")),
)
reply_query(
    "persona_composition",
    [
        ('{"i": "comparative", "c": 0.9, "q": "why {v}"}', ("comparator", "analyst")),
        ('{"i": "comparative", "c": 0.9, "q": "{v}"}', ("comparator", None)),
        ('{"i": "comparative", "c": 0.2, "q": "{v}"}', ("comparator", "analyst")),
        ('{"i": "exploratory", "q": "{v} 표로"}', ("analyst", "comparator")),
        ('{"i": "factual", "c": 0.1, "q": "why"}', ("researcher", None)),
        ('{"i": "general", "c": 0.1, "q": "why"}', (None, None)),
    ],
    {"persona": "VARCHAR", "second": "VARCHAR"},
    lambda c: S.composed_persona(F.get_json_object(c, "$.i"), F.get_json_object(c, "$.c").cast("double"), F.get_json_object(c, "$.q"), F.lit(None).cast("string")),
)
reply_query(
    "question_flags",
    [("A vs. B {v}", (True, False)), ("Why {v}?", (False, True)), ("표로 원인 분석", (True, True)), ("plain {v}", (False, False)), ("a TABLE of {v}", (True, False))],
    {"tabular": "BOOLEAN", "analytical": "BOOLEAN"},
    lambda c: F.struct(S.asks_for_table(c).alias("tabular"), S.asks_for_reasons(c).alias("analytical")),
)
reply_query(
    "name_keywords",
    [("소프트웨어 및 RFP, (입찰) {v}", (["NMS", "rfp", "소프트웨어", "입찰", "{v}"],)), ("", (["NMS", "rfp"],)), ("a-b nms·망관리", (["NMS", "rfp", "망관리"],))],
    {"merged": "VARCHAR[]"},
    lambda c: S.merged_keywords(words("NMS", "rfp", "Rfp", ""), c),
)
reply_query(
    "benchmark_intent",
    [("A와 B의 차이는 어떻게", ("compare",)), ("신청 방법은 무엇", ("howto",)), ("누구 {v}", ("lookup",)), ("{v} 설명", ("explain",))],
    {"intent": "VARCHAR"},
    S.benchmark_intent,
)
reply_query(
    "markdown_table",
    [
        ('[["a", "b"], ["1"], ["2", "{v}", "cut"]]', ("| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | {v} |",)),
        ('[["only {v}"]]', ("| only {v} |\n| --- |",)),
        ("[]", ("",)),
        ('[[], ["x"]]', ("",)),
    ],
    {"md": "VARCHAR"},
    lambda c: S.markdown_table(F.from_json(c, "array<array<string>>")),
)
reply_query("part_labels", [("1", ([],)), ("3", (["Part 1/3", "Part 2/3", "Part 3/3"],))], {"labels": "VARCHAR[]"}, lambda c: S.part_labels(c.cast("int")))
reply_query(
    "merge_tables",
    [("[]", ("body purchase",)), ('["| t |", "| u |"]', ("body purchase\n\n| t |\n\n| u |",))],
    {"content": "VARCHAR"},
    lambda c: S.with_tables(F.lit("body purchase"), F.from_json(c, "array<string>")),
)
reply_query(
    "message_text",
    [("just {v}", ("just {v}",)), ('[{"type": "text", "text": "a {v}"}, {"type": "image", "url": "x"}, {"type": "text", "text": "b"}]', ("a {v}b",)), ("[]", ("",))],
    {"text": "VARCHAR"},
    S.message_text,
)
reply_query("profile_override", [(" new {v} ", ("new {v}",)), ("  ", ("old",)), ("", ("old",))], {"name": "VARCHAR"}, lambda c: S.override_profile(F.lit("old"), c))
reply_query(
    "context_prefix",
    [("", ("body",)), ("about {v}", ("[Context] about {v}\n\nbody",)), ("x" * 310, ("[Context] " + "x" * 300 + "…\n\nbody",))],
    {"text": "VARCHAR"},
    lambda c: S.context_prefix(c, F.lit("body")),
)


@query("""WITH t AS (SELECT doc_id, repeat('a', CAST(300 + doc_id % 200 AS INT)) || chr(10) || chr(10) || repeat('b', CAST(200 + doc_id % 50 AS INT)) AS t, 300 + doc_id % 200 AS cut FROM documents),
s AS (SELECT *, length(t) AS n FROM t)
SELECT doc_id, CAST(0 AS BIGINT) AS chunk_index, CAST(0 AS BIGINT) AS start, CASE WHEN n <= 512 THEN n ELSE cut END AS size FROM s UNION ALL
SELECT doc_id, 1, cut - 102, n - cut + 102 FROM s WHERE n > 512""")
def chunk_at_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that end at the blank line of their second half, on texts made with one."""
    i = F.col("doc_id")
    made = F.concat(F.repeat(F.lit("a"), (300 + i % 200).cast("int")), F.lit("\n\n"), F.repeat(F.lit("b"), (200 + i % 50).cast("int")))
    rows = C.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", made.alias("text")))
    return rows.select("doc_id", "chunk_index", "start", F.length("contents").cast("long").alias("size"))


@query("""WITH t AS (SELECT doc_id, 150 + doc_id % 100 AS a, 500 + doc_id % 100 AS b, 900 AS c FROM documents)
SELECT doc_id, CAST(0 AS BIGINT) AS chunk_index, 7 + a + 2 + 8 + b AS size, '1. One' AS title FROM t UNION ALL SELECT doc_id, 1, 9 + c, '3. Three' FROM t""")
def section_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections under three headings: the small first one waits for the second, the third stands alone."""
    i = F.col("doc_id")
    body = lambda c, n: F.repeat(F.lit(c), n.cast("int"))
    made = F.concat(F.lit("1. One\n"), body("x", 150 + i % 100), F.lit("\n\n2. Two \n"), body("y", 500 + i % 100), F.lit("\n\n3. Three\n"), body("z", F.lit(900)))
    rows = C.chunk_sections(table(spark, sf_dir, "documents").select("doc_id", made.alias("text")), 1000)
    return rows.select("doc_id", "chunk_index", F.length("contents").cast("long").alias("size"), "title")


SCORES = "s AS (SELECT event_type AS metric, value AS score FROM events UNION ALL SELECT 'base_' || event_type, value FROM events UNION ALL SELECT 'finetuned_' || event_type, value + 1 FROM events WHERE event_type <> 'view' UNION ALL SELECT 'base_zero', 0.0 UNION ALL SELECT 'finetuned_zero', 1.0)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "value")
    named = lambda prefix, add, df: df.select(F.concat(F.lit(prefix), "event_type").alias("metric"), (F.col("value") + add).alias("score"))
    fixed = spark.createDataFrame([("base_zero", 0.0), ("finetuned_zero", 1.0)], "metric string, score double")
    return named("", 0, rows).unionByName(named("base_", 0, rows)).unionByName(named("finetuned_", 1, rows.where("event_type <> 'view'"))).unionByName(fixed)


@query(f"WITH {SCORES} SELECT metric, round(avg(score), 6) AS mean, min(score) AS least, max(score) AS most FROM s GROUP BY metric")
def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.metric_table(scores(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {SCORES}, b AS (SELECT metric[6:] AS metric, avg(score) AS base FROM s WHERE starts_with(metric, 'base_') GROUP BY 1), t AS (SELECT metric[11:] AS metric, avg(score) AS tuned FROM s WHERE starts_with(metric, 'finetuned_') GROUP BY 1)
SELECT metric, round(base, 6) AS base, round(tuned, 6) AS tuned, CASE WHEN base > 0 THEN printf('%+.1f%%', (tuned - base) / base * 100) ELSE 'N/A' END AS improvement FROM b JOIN t USING (metric)""")
def comparison_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.comparison_summary(scores(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("base", "tuned")})


@query("SELECT count(*) FILTER (event_id % 4 = 0) AS approved, count(*) FILTER (event_id % 4 = 1) AS rejected, count(*) FILTER (event_id % 4 > 1) AS pending FROM events")
def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 4
    return E.review_counts(table(spark, sf_dir, "events").select(F.when(kind == 0, "approved").when(kind == 1, "rejected").when(kind == 2, "odd").alias("status")), "status")


@query(f"WITH {PAIRS} SELECT count(*) AS pairs, count(*) FILTER (pos % 3 <> 0) AS originals, count(*) FILTER (pos % 3 = 0) AS augmented FROM pairs")
def pair_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pair_totals(pairs(spark, sf_dir).select((F.col("pos") % 3 == 0).alias("augmented")), "augmented")


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) SELECT event_id, event_type || '_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS id FROM r""")
def domain_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.domain_ids(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id").select("event_id", "id")


@query("SELECT event_id FROM events WHERE CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value / 100 END < 0.5")
def weak_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("event_id") % 3 > 0, F.create_map(F.lit("llm_judge"), F.col("value") / 100)).otherwise(F.create_map(F.lit("bleu"), F.lit(1.0)))
    return R.weak_rows(table(spark, sf_dir, "events").select("event_id", score.alias("scores")), "scores").select("event_id")


@query("SELECT user_id, count(*) AS n, CASE WHEN count(*) < 100 THEN 3 WHEN count(*) < 500 THEN 2 ELSE 1 END AS epochs, CASE WHEN count(*) < 100 THEN 0.00005 WHEN count(*) < 500 THEN 0.0001 ELSE 0.0002 END::DOUBLE AS learning_rate FROM events GROUP BY user_id")
def training_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", "n", S.epochs(F.col("n")).alias("epochs"), S.learning_rate(F.col("n")).alias("learning_rate"))


@query("SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"))


TRACE = """e AS (SELECT event_id // 25 AS request, event_id % 25 AS seq, (event_id % 25) / 10.0 AS seconds,
  CASE event_id % 25 WHEN 0 THEN 'route' WHEN 3 THEN 'action' WHEN 9 THEN 'route' WHEN 20 THEN 'verification' WHEN 22 THEN 'done' ELSE 'token' END AS type, event_type AS content FROM events)"""


@query(f"""WITH {TRACE}, r AS (SELECT * FROM e WHERE seq <= 22)
SELECT request, CAST(min(seconds) FILTER (type = 'token') AS DOUBLE) AS first_token, CAST(max(seconds) AS DOUBLE) AS total, string_agg(content, '' ORDER BY seq) FILTER (type = 'token') AS answer,
  max_by(content, seq) FILTER (type = 'route') AS route, max_by(content, seq) FILTER (type = 'verification') AS verification, string_agg(content, '|' ORDER BY seq) FILTER (type = 'action') AS actions, max_by(type, seq) AS last_event FROM r GROUP BY request""")
def request_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event streams of 25 events each, of which those after ``done`` do not count."""
    seq = F.col("event_id") % 25
    kind = F.when(seq.isin(0, 9), "route").when(seq == 3, "action").when(seq == 20, "verification").when(seq == 22, "done").otherwise("token")
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 25).alias("request"), seq.alias("seq"), (seq / 10).alias("seconds"), kind.alias("type"), F.col("event_type").alias("content"))
    return E.request_trace(rows).select("request", "first_token", "total", "answer", "route", "verification", F.array_join("actions", "|").alias("actions"), "last_event")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 0.0 ELSE round(2.0 * CASE doc_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 4 END / CASE doc_id % 4 WHEN 0 THEN 8 WHEN 1 THEN 6 ELSE 8 END, 6) END AS rouge FROM documents""")
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest common subsequences of word lists that are known."""
    kind = F.col("doc_id") % 4
    a = F.when(kind == 0, "a b c d").when(kind == 1, "x y z").when(kind == 2, "p q r s").otherwise("")
    b = F.when(kind == 0, "a c x d").when(kind == 1, "z x y").when(kind == 2, "p q r s").otherwise("k")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(E.rouge_l(tokens(a), tokens(b)), 6).alias("rouge"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN round(exp((ln(5 / 6.0) + ln(3 / 5.0) + ln(2 / 4.0) + ln(1 / 3.0)) / 4), 6) ELSE 0.0 END AS bleu FROM documents""")
def bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU of sentences whose n-gram matches are known."""
    kind = F.col("doc_id") % 3
    a = F.when(kind == 0, "the cat sat on it").when(kind == 1, "a b c d X f").otherwise("no match")
    b = F.when(kind == 0, "the cat sat on it").when(kind == 1, "a b c d e f").otherwise("other words")
    rows = table(spark, sf_dir, "documents").select("doc_id", tokens(a).alias("c"), tokens(b).alias("r"))
    return E.bleu(rows, "doc_id", "c", "r").withColumn("bleu", F.round("bleu", 6))


@query("""WITH k AS (SELECT * FROM (VALUES (0, 'report ' || '1.pdf', 0, 'report 1'), (1, 'Re-port_2.docx', 1, 're port 2'), (2, 'annualplan', 2, 'the annual plan'), (3, 'x', NULL, NULL)) AS v(k, asked, how, stem)) SELECT DISTINCT asked, how, stem FROM k JOIN documents ON doc_id % 4 = k WHERE how IS NOT NULL""")
def file_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of an evaluation set matched to a corpus by falling priority."""
    known = spark.createDataFrame([("report 1.md",), ("re port 2.txt",), ("the annual plan.pdf",), ("an unrelated name.pdf",)], "known string")
    kind = F.col("doc_id") % 4
    asked = table(spark, sf_dir, "documents").select(F.when(kind == 0, "report 1.pdf").when(kind == 1, "Re-port_2.docx").when(kind == 2, "annualplan").otherwise("x").alias("asked"))
    return E.match_files(asked, known)
