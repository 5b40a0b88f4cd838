"""Queries of the texts that models and readers get, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..operators import evaluate as E
from .curation import PAIRS, pairs
from .registry import query, table
from .retrieval import BM25, texts

NL = "chr(10)"
BLANK = "' ' || chr(9) || chr(10) || chr(13)"


@query(f"""WITH d AS (SELECT source, doc_id, trim(coalesce(text, ''), {BLANK}) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
SELECT source, string_agg('[청크 ' || n || ']' || {NL} || CASE WHEN length(t) > 800 THEN substr(t, 1, 800) || '...' ELSE t END, {NL} || {NL} ORDER BY n) AS samples FROM d WHERE n <= 5 GROUP BY source""")
def profile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five texts of each source, as a profile's prompt has them."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    first = docs.withColumn("n", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).where("n <= 5")
    per = first.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("l"))
    return per.select("source", B.sample_block(F.transform("l", lambda x: x["text"])).alias("samples"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, sources): the five results of each item."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).otherwise(" ").alias("name"))
    rows = texts(spark, sf_dir, 5).join(docs, "id").select("query_id", F.struct("rank", F.col("id").cast("string").alias("doc_id"), "name", "score", "content").alias("s"))
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list("s")).alias("sources"))


HITS = f"""{BM25}, h AS (SELECT query_id, rank, id, score, coalesce(text, '') AS content, CASE WHEN doc_id % 3 <> 0 THEN source ELSE CAST(id AS VARCHAR) END AS name FROM bmr JOIN documents ON doc_id = id WHERE rank <= 5),
p AS (SELECT *, replace(trim(content, {BLANK}), {NL}, ' ') AS preview FROM h)"""


@query(f"""WITH {HITS} SELECT query_id,
  {NL} || {NL} || '---' || {NL} || '**📚 참고 문서**' || {NL} || {NL} || string_agg(rank || '. `' || id || '` · score ' || printf('%.2f', score) || ' — ' || CASE WHEN length(preview) > 160 THEN substr(preview, 1, 160) || '…' ELSE preview END, {NL} ORDER BY rank) AS footer,
  string_agg('[문서 ' || rank || ' | doc:' || name || '] (유사도: ' || printf('%.2f', score) || ')' || {NL} || substr(content, 1, 500), {NL} || {NL} ORDER BY rank) AS found,
  '[이전 대화 참조 문서]' || {NL} || {NL} || string_agg('[이전 문서 ' || rank || '] (ID: ' || id || ')' || {NL} || substr(content, 1, 300), {NL} || {NL} ORDER BY rank) FILTER (rank <= 3) AS prior FROM p GROUP BY query_id""")
def source_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of each item as a footer, as an agent reads them, and as the next turn's prompt has them."""
    s = F.col("sources")
    return sources(spark, sf_dir).select("query_id", B.source_footer(s).alias("footer"), B.found_block(s).alias("found"), B.prior_block(s).alias("prior"))


@query(f"""WITH d AS (SELECT doc_id, substr(coalesce(text, ''), 1, 80) AS t, row_number() OVER (ORDER BY doc_id) AS n FROM documents QUALIFY n <= 100)
SELECT '총 ' || count(*) || '개 문서:' || {NL} || string_agg('- ' || doc_id || ': ' || t || '...', {NL} ORDER BY n) FILTER (n <= 50) || CASE WHEN count(*) > 50 THEN {NL} || '  ... 외 ' || (count(*) - 50) || '개' ELSE '' END AS listing FROM d""")
def document_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listing tool answers: the first hundred documents are looked at, fifty shown."""
    some = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")).orderBy("doc_id").limit(100)
    listed = some.agg(F.array_sort(F.collect_list(F.struct("doc_id", "content"))).alias("l"))
    return listed.select(B.listing(F.transform("l", lambda x: F.struct(x["doc_id"].cast("string").alias("doc_id"), x["content"].alias("content")))).alias("listing"))


@query(f"""WITH s AS (SELECT n_regionkey, n_nationkey, n_name, CASE WHEN n_nationkey % 4 = 0 THEN '  ' ELSE ' adds ' || n_name || {NL} END AS addon FROM nation)
SELECT n_regionkey AS region, '[도메인 스킬]' || coalesce(string_agg({NL} || '## ' || n_name || {NL} || trim(addon, {BLANK}), '' ORDER BY n_nationkey) FILTER (trim(addon, {BLANK}) <> ''), '') AS addons FROM s GROUP BY 1""")
def skill_addons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt texts of the nations of each region, as skills; every fourth has none."""
    rows = table(spark, sf_dir, "nation").withColumn("addon", F.when(F.col("n_nationkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" adds "), "n_name", F.lit("\n"))))
    per = rows.groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("name"), "addon"))).alias("skills"))
    return per.select("region", B.addon_block(F.col("skills")).alias("addons"))


@query("""WITH e AS (SELECT event_id, floor(value) / 100 AS score, event_id % 5 <> 0 AS shown, event_id % 2 = 0 AS word FROM events WHERE value IS NOT NULL)
SELECT event_id, CAST(0 AS BIGINT) AS seq, 'thought' AS type, '의도 보정: ' || CASE WHEN word THEN 'corpus 키워드 매칭(유사도 ' || printf('%.2f', score) || ')' ELSE 'corpus 유사도 ' || printf('%.2f', score) || ' ≥ 임계 0.35' END || ' — router 분류 무시하고 단순 RAG로 정정' AS content FROM e WHERE shown
UNION ALL SELECT event_id, CASE WHEN shown THEN 1 ELSE 0 END, 'route', 'simple' FROM e""")
def override_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of corrected routes, one correction for each row of events."""
    i = F.col("event_id")
    made = B.override_events(F.floor("value") / 100, F.lit(0.35), F.when(i % 2 == 0, "keyword").otherwise("vector"), "router", i % 5 != 0)
    each = table(spark, sf_dir, "events").where("value is not null").select("event_id", F.posexplode(made).alias("seq", "e"))
    return each.select("event_id", F.col("seq").cast("long").alias("seq"), "e.type", "e.content")


@query("""WITH t AS (SELECT user_id, list(DISTINCT event_type) FILTER (value < 30) AS a, list(DISTINCT event_type) FILTER (value > 60) AS b FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN user_id % 7 <> 0 AND user_id % 11 <> 0 THEN list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) END AS tools FROM t""")
def persona_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tools of two personas together; some allow all."""
    kinds = lambda when: F.collect_set(F.when(when, F.col("event_type")))
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(kinds(F.col("value") < 30).alias("a"), kinds(F.col("value") > 60).alias("b"))
    own = lambda c, n: F.when(F.col("user_id") % n != 0, F.col(c))
    return per.select("user_id", B.union_tools(own("a", 7), own("b", 11)).alias("tools"))


@query("SELECT CASE event_type WHEN 'view' THEN 'auto' WHEN 'purchase' THEN 'agent' WHEN 'click' THEN 'rag' ELSE 'auto' END AS stream, count(*) AS n FROM events GROUP BY 1")
def model_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many requests each stream gets by the model they name."""
    stream = B.chosen_stream(F.col("event_type"), {"view": "auto", "purchase": "agent", "click": "rag"})
    return table(spark, sf_dir, "events").groupBy(stream.alias("stream")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_custkey, CASE WHEN o_custkey % 5 <> 0 THEN max(o_orderkey) END AS version FROM orders GROUP BY o_custkey)
SELECT c.o_custkey AS owner, c.version, o_orderpriority AS model FROM c LEFT JOIN orders o ON o.o_custkey = c.o_custkey AND o.o_orderkey = c.version""")
def current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of each owner's current version; null where none is current."""
    versions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("model"))
    current = versions.groupBy("owner").agg(F.max("version").alias("version")).withColumn("version", F.when(F.col("owner") % 5 != 0, F.col("version")))
    return current.join(versions, ["owner", "version"], "left").select("owner", "version", "model")


#: Fixed questions that every text is asked.
ASKED = ("What is this about?", "Which facts does it give?", "Whom does it concern?")


@query(f"""SELECT doc_id, CAST(q.place AS BIGINT) AS place, q.question, length(text) AS chars FROM documents, (VALUES {", ".join(f"({i}, '{a}')" for i, a in enumerate(ASKED))}) AS q(place, question)""")
def fixed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with each of the fixed questions."""
    asked = F.posexplode(F.array(*map(F.lit, ASKED))).alias("place", "question")
    return table(spark, sf_dir, "documents").select("doc_id", asked, F.length("text").cast("long").alias("chars")).withColumn("place", F.col("place").cast("long"))


@query("""WITH r AS (SELECT event_id, event_id % 40 AS query_id, CASE WHEN event_id % 11 = 0 THEN 'read timeout' END AS error, CASE WHEN event_id % 6 = 0 THEN '' ELSE event_type || ' is the answer' END AS answer,
  CASE WHEN event_id % 5 = 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, [event_id % 7, user_id % 7] AS sources, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 10 END AS first_s FROM events),
j AS (SELECT r.*, list_contains(sources, b.item_id % 7) AS expected_found, CASE WHEN contains(error, 'timeout') THEN 'timeout' WHEN length(answer) < 10 THEN 'empty_answer' WHEN verdict = 'FAIL' THEN 'verifier_fail' ELSE 'none' END AS failure FROM r LEFT JOIN benchmark b ON b.item_id = r.query_id)
SELECT failure, count(*) AS n, count(*) FILTER (expected_found) AS expected, round(avg(coalesce(first_s, 0.0)), 6) AS first_s FROM j GROUP BY failure""")
def reclassified_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with the definitions of their queries: failures anew, expected sources found, mean time to the first token."""
    i = F.col("event_id")
    none = F.lit(None).cast("string")
    runs = table(spark, sf_dir, "events").select(
        "event_id", (i % 40).alias("query_id"), F.when(i % 11 == 0, "read timeout").alias("error"), none.alias("clarification"), none.alias("warning"), F.when(i % 6 == 0, "").otherwise(F.concat("event_type", F.lit(" is the answer"))).alias("answer"),
        F.when(i % 5 == 0, "FAIL").otherwise("PASS").alias("verdict"), F.array(i % 7, F.col("user_id") % 7).alias("sources"), F.when(i % 3 != 0, F.col("value") / 10).alias("first_s"),
    )
    known = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 7).alias("expected"))
    told = runs.join(known, "query_id", "left").withColumn("expected_found", F.array_contains("sources", F.col("expected")))
    return E.failure(told).groupBy("failure").agg(F.count("*").alias("n"), F.count_if("expected_found").alias("expected"), F.round(F.avg(F.coalesce("first_s", F.lit(0.0))), 6).alias("first_s"))


@query(f"""WITH {PAIRS}, s AS (SELECT CAST(conv_id AS VARCHAR) AS source_doc, text AS source FROM conversations WHERE turn = (SELECT min(turn) FROM conversations)),
a AS (SELECT pos, source_doc, question, answer, false AS augmented FROM pairs UNION ALL SELECT pos, source_doc, question || '?', answer, true FROM pairs WHERE pos % 3 = 0)
SELECT pos, augmented, question, length(coalesce(source, '')) AS source_chars FROM a LEFT JOIN s USING (source_doc)""")
def pairs_with_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original and augmented pairs, each with the text of its own source for scoring."""
    own = pairs(spark, sf_dir).select("pos", "source_doc", "question", F.lit(False).alias("augmented"))
    every = own.unionByName(own.where("pos % 3 = 0").withColumns({"question": F.concat("question", F.lit("?")), "augmented": F.lit(True)}))
    turns = table(spark, sf_dir, "conversations")
    first = turns.agg(F.min("turn").alias("turn"))
    source = turns.join(F.broadcast(first), "turn").select(F.col("conv_id").cast("string").alias("source_doc"), F.col("text").alias("source"))
    return every.join(source, "source_doc", "left").select("pos", "augmented", "question", F.length(F.coalesce("source", F.lit(""))).cast("long").alias("source_chars"))


@query(f"""SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\\n{{3,}}', {NL} || {NL}, 'g') || {NL} || CASE doc_id % 4 WHEN 0 THEN '주요현황끝' WHEN 1 THEN '2,476 명' WHEN 2 THEN '漢字 text' ELSE '계획' END, {BLANK})) AS digest FROM documents""")
def artefact_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with what is left of a binary file's marks at their end, cleaned."""
    i = F.col("doc_id") % 4
    tail = F.when(i == 0, "주요현황艰\nȃ\n끝").when(i == 1, "2,476浵ࡦ 명").when(i == 2, "漢字 text").otherwise("계획艰")
    made = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), tail)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(B.without_artefacts(made).cast("binary")).alias("digest"))
