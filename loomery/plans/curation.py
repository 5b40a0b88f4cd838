"""Queries over question-answer rows, which are the turns of ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bigram_overlap, question_type
from ..operators import curate as Q
from .registry import query, table

PAIRS = """pairs AS (SELECT conv_id * 4294967296 + turn AS pos, CAST(conv_id AS VARCHAR) AS source_doc, text AS question, answer FROM (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"""
BIGRAMS = "(SELECT question, substr(t, i, 2) AS g FROM (SELECT question, lower(replace(question, ' ', '')) AS t FROM pairs), unnest(range(1, length(t))) AS u(i))"
TYPES = """CASE WHEN q LIKE 'what %' THEN 'what' WHEN q LIKE 'how %' THEN 'how' WHEN q LIKE 'why %' THEN 'why' WHEN q LIKE 'when %' THEN 'when' WHEN q LIKE 'where %' THEN 'where'
  WHEN q LIKE 'who %' THEN 'who' WHEN q LIKE '%is it%' OR q LIKE '%does it%' OR q LIKE '%can %' THEN 'yes-no' ELSE 'other' END"""
RULES = rf"""{PAIRS}, r AS (SELECT *, trim(coalesce(question, ''), ' ' || chr(9) || chr(10) || chr(13)) AS q, trim(coalesce(answer, ''), ' ' || chr(9) || chr(10) || chr(13)) AS a FROM pairs),
d AS (SELECT *, row_number() OVER (PARTITION BY q = '' OR a = '', lower(q), lower(a) ORDER BY pos) AS nth FROM r),
v AS (SELECT pos, CASE WHEN q = '' OR a = '' THEN ['empty_question_or_answer'] ELSE list_filter([
  CASE WHEN length(a) < 20 THEN 'answer_too_short' END, CASE WHEN length(a) > 2000 THEN 'answer_too_long' END,
  CASE WHEN regexp_matches(answer, '(?i)i don''t know') THEN 'reject_pattern:0' END, CASE WHEN regexp_matches(answer, '(?i)not (available|provided|mentioned|found)') THEN 'reject_pattern:1' END,
  CASE WHEN regexp_matches(answer, '(?i)the document does not contain') THEN 'reject_pattern:2' END, CASE WHEN regexp_matches(answer, '(?:알|확인할|파악할|판단할) 수 없') THEN 'reject_pattern:3' END, CASE WHEN regexp_matches(answer, '정보.{{0,8}}(?:없|부족|찾을 수 없)') THEN 'reject_pattern:4' END,
  CASE WHEN regexp_matches(answer, '(?:문서|자료|내용)에서?.{{0,12}}(?:찾을 수 없|포함되어 있지 않|언급되지 않|다루고 있지 않)') THEN 'reject_pattern:5' END, CASE WHEN nth > 1 THEN 'duplicate' END], lambda x: x IS NOT NULL) END AS reasons FROM d)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.qa_pairs(table(spark, sf_dir, "conversations"))


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)


@query(f"WITH {RULES} SELECT pos, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS accepted FROM v")
def rule_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, pattern and copy rules with their reasons."""
    return Q.validate(pairs(spark, sf_dir)).select("pos", F.array_join("reasons", ",").alias("reasons"), "accepted")


#: Answers that break each rule in turn; both languages read the same text.
SPOILT = """CASE pos % 10 WHEN 0 THEN '   ' WHEN 1 THEN 'too short' WHEN 2 THEN 'Sorry, the document does not contain this.' WHEN 3 THEN 'This is not mentioned in the whole text.' WHEN 4 THEN 'the same answer to all of these questions'
  WHEN 5 THEN repeat('long ', 500) WHEN 6 THEN '이 값은 확인할 수 없습니다. 다른 자료를 보세요.' WHEN 7 THEN '정보가 부족합니다. 문서에서 해당 항목을 찾을 수 없습니다.' ELSE answer END"""
ASKED = "CASE WHEN pos % 10 = 4 THEN 'The Question' ELSE question END"
SPOILT_RULES = RULES.replace("pairs AS (", "whole AS (", 1).replace(", r AS (", f", pairs AS (SELECT pos, source_doc, {ASKED} AS question, {SPOILT} AS answer FROM whole), r AS (", 1)


def spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.validate(pairs(spark, sf_dir).select("pos", "source_doc", F.expr(ASKED).alias("question"), F.expr(SPOILT).alias("answer")))


@query(f"WITH {SPOILT_RULES} SELECT pos, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS accepted FROM v")
def rule_validate_spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on answers of which four fifths break one or more."""
    return spoilt(spark, sf_dir).select("pos", F.array_join("reasons", ",").alias("reasons"), "accepted")


@query(f"WITH {SPOILT_RULES} SELECT regexp_replace(reason, '[:(].*$', '') AS reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM v) GROUP BY 1")
def rejection_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.rejection_histogram(spoilt(spark, sf_dir))


@query(f"""WITH {PAIRS}, a AS (SELECT DISTINCT pos, substr(t, i, 2) AS g FROM (SELECT pos, lower(replace(question, ' ', '')) AS t FROM pairs), unnest(range(1, length(t))) AS u(i)),
b AS (SELECT DISTINCT pos, substr(t, i, 2) AS g FROM (SELECT pos, lower(replace(answer, ' ', '')) AS t FROM pairs), unnest(range(1, length(t))) AS u(i)),
na AS (SELECT pos, count(*) AS n FROM a GROUP BY pos), nb AS (SELECT pos, count(*) AS n FROM b GROUP BY pos), c AS (SELECT pos, count(*) AS n FROM a JOIN b USING (pos, g) GROUP BY pos)
SELECT p.pos, round(coalesce(c.n, 0) / greatest(na.n, nb.n), 6) AS overlap FROM pairs p LEFT JOIN na USING (pos) LEFT JOIN nb USING (pos) LEFT JOIN c USING (pos)""")
def bigram_overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("pos", F.round(bigram_overlap(F.col("question"), F.col("answer")), 6).alias("overlap"))


@query(f"""WITH {PAIRS}, s AS (SELECT 'question' AS metric, length(question) AS n FROM pairs UNION ALL SELECT 'answer', length(answer) FROM pairs)
SELECT metric, min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean, CAST(median(n) AS DOUBLE) AS median, round(stddev_samp(n), 6) AS stdev FROM s GROUP BY metric""")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.length_stats(pairs(spark, sf_dir), {"question": "question", "answer": "answer"})


@query("SELECT coalesce(nullif(trim(source), ''), 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1")
def source_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.distribution(table(spark, sf_dir, "documents"), "source", "unknown")


@query(f"WITH {PAIRS} SELECT {TYPES} AS type, count(*) AS n FROM (SELECT lower(trim(question)) AS q FROM pairs) GROUP BY 1")
def question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy(question_type(F.col("question")).alias("type")).agg(F.count("*").alias("n"))


@query(f"""WITH {PAIRS}, g AS {BIGRAMS}, t AS (SELECT count(DISTINCT {TYPES}) AS types FROM (SELECT lower(trim(question)) AS q FROM pairs))
SELECT round(count(DISTINCT g) / greatest(count(*), 1), 6) AS unique_bigram_ratio, max(types) / 8.0 AS question_type_coverage, max(types) AS unique_question_types FROM g, t""")
def bigram_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.diversity(pairs(spark, sf_dir)).withColumn("unique_bigram_ratio", F.round("unique_bigram_ratio", 6))


@query(f"""WITH {PAIRS}, per AS (SELECT count(*) AS n FROM pairs GROUP BY source_doc), g AS {BIGRAMS}, t AS (SELECT count(DISTINCT {TYPES}) AS types FROM (SELECT lower(trim(question)) AS q FROM pairs)),
w AS (SELECT count(*) AS n, stddev_samp(length(answer)) AS sd, avg(length(answer)) AS mean, count(DISTINCT source_doc) AS categories FROM pairs)
SELECT (SELECT max(n) > 5 * min(n) FROM per) AS sources_uneven, categories = 1 AS one_category, sd > 1.5 * mean AS lengths_uneven, n < 50 AS few_pairs,
  (SELECT count(DISTINCT g) / count(*) < 0.3 FROM g) AS low_diversity, (SELECT types <= 2 FROM t) AS few_types FROM w""")
def quality_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.quality_warnings(pairs(spark, sf_dir), "source_doc")


@query(f"""WITH {PAIRS}, a AS (SELECT source_doc AS value, count(*) AS n FROM pairs WHERE pos % 2 = 0 GROUP BY 1), b AS (SELECT source_doc AS value, count(*) AS n FROM pairs WHERE pos % 3 = 0 GROUP BY 1)
SELECT value, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b USING (value)""")
def dataset_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir)
    return Q.compare_datasets(rows.where("pos % 2 = 0"), rows.where("pos % 3 = 0"), "source_doc")


@query(f"""WITH {PAIRS} SELECT pos, CAST(json_array_length(m) AS BIGINT) AS n, m ->> '$[0].role' AS first_role, m ->> '$[2].content' AS reply
FROM (SELECT pos, to_json([{{'role': 'system', 'content': 'Answer briefly.'}}, {{'role': 'user', 'content': question}}, {{'role': 'assistant', 'content': answer}}]) AS m FROM pairs)""")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Q.chat_messages(pairs(spark, sf_dir), "Answer briefly.")
    return m.select("pos", F.json_array_length("messages").cast("long").alias("n"), F.get_json_object("messages", "$[0].role").alias("first_role"), F.get_json_object("messages", "$[2].content").alias("reply"))


@query(f"""WITH {PAIRS}, t AS (SELECT pos, '<user>' || question || '<assistant>' || answer AS t FROM pairs)
SELECT pos, list_last(string_split(t, '<assistant>')) AS completion, CAST(length(t) - length(list_last(string_split(t, '<assistant>'))) AS BIGINT) AS prompt_length FROM t""")
def prompt_completion_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).select("pos", F.concat(F.lit("<user>"), "question", F.lit("<assistant>"), "answer").alias("t"))
    return Q.split_prompt(rows, "t", "<assistant>").select("pos", "completion", F.length("prompt").cast("long").alias("prompt_length"))


@query("""SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('42:' || doc_id), 1, 7) AS BIGINT) % 100 < 90 THEN 'train' ELSE 'eval' END AS part FROM documents""")
def train_eval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.hash_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("""WITH p AS (SELECT vec_id AS pos, CASE WHEN vec_id % 7 = 0 THEN 99 ELSE label END AS source_doc, embedding AS e FROM embeddings WHERE vec_id % 2 = 0), s AS (SELECT label AS source_doc, embedding AS e FROM embeddings WHERE vec_id % 2 = 1),
m AS (SELECT pos, p.source_doc, max(list_inner_product(CAST(p.e AS DOUBLE[]), CAST(s.e AS DOUBLE[]))) AS similarity FROM p LEFT JOIN s USING (source_doc) GROUP BY ALL)
SELECT pos, CAST(source_doc AS BIGINT) AS source_doc, round(similarity, 6) AS similarity, similarity IS NULL OR similarity >= 0.3 AS kept FROM m""")
def groundedness_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best similarity to a source's windows; every seventh row names an unknown source."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 2 = 0").select(F.col("vec_id").alias("pos"), F.when(F.col("vec_id") % 7 == 0, 99).otherwise(F.col("label")).cast("long").alias("source_doc"), F.col("embedding").alias("vector"))
    sources = rows.where("vec_id % 2 = 1").select(F.col("label").cast("long").alias("source_doc"), F.col("embedding").alias("vector"))
    return Q.grounded(asked, sources).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {PAIRS}, v AS (SELECT pos, question, 0 AS place, 'Say: ' || question AS variant FROM pairs UNION ALL SELECT pos, question, 1, reverse(question) FROM pairs
  UNION ALL SELECT pos, question, 2, substr(question, 1, length(question) // 2) FROM pairs UNION ALL SELECT pos, question, 3, question || '?' FROM pairs),
g AS (SELECT question, place, variant, lower(replace(question, ' ', '')) AS q, lower(replace(variant, ' ', '')) AS t FROM (SELECT DISTINCT question, place, variant FROM v)),
o AS (SELECT *, list_distinct(list_transform(range(1, length(q)), lambda i: substr(q, i, 2))) AS x, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) AS y FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY place) AS nth FROM o WHERE len(x) > 0 AND len(y) > 0 AND len(list_intersect(x, y)) / greatest(len(x), len(y)) >= 0.3)
SELECT question, place, variant FROM k WHERE nth <= 2""")
def paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four variants of each question the first two that share three tenths of its bigrams."""
    q = F.col("question")
    made = F.array(F.concat(F.lit("Say: "), q), F.reverse(q), F.substr(q, F.lit(1), F.floor(F.length(q) / 2).cast("int")), F.concat(q, F.lit("?")))
    variants = pairs(spark, sf_dir).where("question is not null").select("question", F.posexplode(made).alias("place", "variant")).distinct()
    return Q.paraphrase_filter(variants).select("question", F.col("place").cast("long").alias("place"), "variant")


@query(f"""WITH {PAIRS}, p AS (SELECT *, question AS instruction, pos % 5 = 0 AS is_augmented FROM pairs),
v AS (SELECT pos, 'Say: ' || question AS variant FROM pairs UNION ALL SELECT pos, question || '?' FROM pairs WHERE pos % 3 = 0)
SELECT pos, source_doc, question, answer, instruction, is_augmented FROM p
UNION ALL SELECT pos, source_doc, variant, answer, variant, true FROM p JOIN v USING (pos) WHERE NOT is_augmented AND variant IS NOT NULL""")
def augmented_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with one or two variants; each fifth is an augmentation already and gets none."""
    rows = pairs(spark, sf_dir).select("pos", "source_doc", "question", "answer", F.col("question").alias("instruction"), (F.col("pos") % 5 == 0).alias("is_augmented"))
    told = rows.select("pos", F.concat(F.lit("Say: "), "question").alias("variant"))
    asked = rows.where("pos % 3 = 0").select("pos", F.concat("question", F.lit("?")).alias("variant"))
    return Q.augmented(rows, told.unionByName(asked))
