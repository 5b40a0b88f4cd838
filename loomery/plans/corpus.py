"""Queries over texts and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking as C
from ..functions import nouns as N
from ..functions import text as X
from ..operators import corpus as O
from ..sources import readers
from .registry import query, table

CHUNKS = """chunks AS (
  SELECT doc_id, k AS chunk_index, k * 410 AS start, substr(text, k * 410 + 1, 512) AS contents
  FROM documents, unnest(range(0, CASE WHEN length(text) <= 512 THEN 1 ELSE CAST(ceil((length(text) - 512) / 410.0) AS BIGINT) + 1 END)) AS u(k)
  WHERE regexp_matches(text, '[^ \\t\\n\\r\\f\\v]')
)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_documents(table(spark, sf_dir, "documents"), 512, 102)


@query(f"WITH {CHUNKS} SELECT * FROM chunks")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 512 characters that overlap by 102."""
    return chunks(spark, sf_dir)


@query(rf"""WITH {CHUNKS}, h AS (
  SELECT doc_id, chunk_index, sha1(unhex('{O.CHUNK_NAMESPACE.hex}') || encode(doc_id || '::' || chunk_index)) AS h FROM chunks
), i AS (
  SELECT doc_id, chunk_index, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
         substr('89ab', CAST((instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id
  FROM h
)
SELECT doc_id, chunk_index, chunk_id, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id, count(*) OVER (PARTITION BY doc_id) AS total_chunks
FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)""")
def chunk_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk ids, neighbours and counts."""
    return O.with_lineage(chunks(spark, sf_dir).select("doc_id", "chunk_index"))


@query()
def section_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks along headings."""
    return C.chunk_sections(table(spark, sf_dir, "documents"), 2000)


@query("""SELECT doc_id, CAST(len(range(0, length(text), 448)) AS BIGINT) AS n_windows,
  CAST(length(substr(text, (len(range(0, length(text), 448)) - 1) * 448 + 1, 512)) AS BIGINT) AS last_length FROM documents""")
def groundedness_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 512 characters at steps of 448."""
    w = C.windows(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n_windows"), F.length(F.element_at(w, -1)).cast("long").alias("last_length"))


@query("""WITH p AS (SELECT doc_id, length(text) AS n, list_filter(string_split(text, chr(10) || chr(10)), lambda x: length(trim(x, ' ' || chr(9) || chr(10) || chr(13))) > 20) AS ps FROM documents),
m AS (SELECT doc_id, n, CASE WHEN len(ps) > 0 THEN list_sum(list_transform(ps, lambda x: length(x))) / len(ps) ELSE 350.0 END AS mean FROM p)
SELECT doc_id, CAST(CASE WHEN n <= 10000 THEN 10000 ELSE greatest(2000, least(floor(n / greatest(3, ceil(sqrt(n / 2000))) * greatest(0.7, least(1.3, mean / 350))), 10000)) END AS BIGINT) AS chunk_size FROM m""")
def auto_chunk_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.auto_chunk_size(F.col("text")).alias("chunk_size"))


@query(r"""WITH n AS (
  SELECT doc_id, length(text) / 1200 AS base, len(regexp_extract_all(text, '\d{4}[년.]|\d+[%원건명개호조억만대]|\d+[.,]\d+')) AS numbers,
         len(regexp_extract_all(text, '(?m)^\s*[-•·◦▪]\s|^\s*\d+[.)]\s|^\s*[가-힣][.)]\s|^\s*[oO]\s|^\s*\(\d+\)')) AS items FROM documents)
SELECT doc_id, CAST(greatest(3, least(round_even(base + least(numbers * 0.3, 3.0) + least(items * 0.2, 2.0), 0), 15)) AS BIGINT) AS questions FROM n""")
def auto_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.auto_questions(F.col("text")).alias("questions"))


@query(r"""WITH t AS (SELECT unnest(regexp_extract_all(regexp_replace(text, '[^A-Za-z0-9]+', '  ', 'g'), '(?:^| )([A-Z]{2,6}|[A-Z][a-z]{1,3}[A-Z][a-z]?|\d+G|FR\d+)(?: |$)', 1)) AS token FROM documents)
SELECT token, count(*) AS n FROM t
WHERE token NOT IN ('TV','USB','PDF','HTML','XML','JSON','CSV','URL','URI','OK','OR','AND','NOT','IF','IS','AT','IN','ON','BY','TO','AM','PM','DC','AC','OS','PC','NO','YES','EU','UN','US','UK','KR','JP','CN','ID','IP','IT','AAA','AA','BBB','BB','CCC','CC','DDD','DD')
GROUP BY token HAVING count(*) >= 2 ORDER BY n DESC, token LIMIT 20""")
def acronym_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most frequent acronyms found twice or more."""
    each = table(spark, sf_dir, "documents").select(F.explode(X.acronyms(F.col("text"))).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "token").limit(20)


@query(r"""SELECT page_id, nullif(CASE WHEN regexp_extract(url, '\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])') = '' THEN '' ELSE
  '20' || regexp_extract(url, '(\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])', 1) || '-' || regexp_extract(url, '(\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])', 2) || '-' || regexp_extract(url, '(\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])', 3) END, '') AS date,
  lower(regexp_replace(regexp_replace(url, '\.[A-Za-z0-9]{1,5}$', ''), '[\s_\-\[\]()+]', '', 'g')) AS stem,
  trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title FROM pages""")
def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in page addresses, their stems for matching, and titles."""
    url = F.col("url")
    title = F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    return table(spark, sf_dir, "pages").select("page_id", X.date_from_name(url).alias("date"), X.stem_key(url).alias("stem"), title.alias("title"))


@query(r"""SELECT doc_id, CAST(length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^\s*[-—–]\s*\d+\s*[-—–]\s*$', '', 'g'), '(?m)^\s*\d+\s*$', '', 'g'), '(?mi)^\s*page\s+\d+\s*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), 'x', 'x')) AS BIGINT) AS n
FROM (SELECT doc_id, text || chr(10) || '- ' || doc_id || ' -' || chr(10) || 'Page ' || doc_id || chr(10) || doc_id || chr(10) || 'end' AS t FROM documents)""")
def page_number_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-number lines removed, shown on texts that got some."""
    i = F.col("doc_id").cast("string")
    t = F.concat(F.col("text"), F.lit("\n- "), i, F.lit(" -\nPage "), i, F.lit("\n"), i, F.lit("\nend"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(X.drop_page_numbers(t)).cast("long").alias("n"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the JSON found in a fenced reply."""
    reply = F.concat(F.lit("Here you are:\n```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(X.first_json(X.strip_fences(reply)), "$.k", "bigint").alias("k"))


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents)
SELECT doc_id, lang, turn FROM r ORDER BY turn, doc_id, lang LIMIT 30""")
def coverage_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty documents, round robin over languages."""
    return O.coverage_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), 30, "lang", "doc_id")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, greatest(1, (SELECT count(*) FROM documents) // 16) AS step FROM documents)
SELECT doc_id, place FROM r WHERE place % step = 0 AND place < step * 16""")
def profile_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen documents at even distances."""
    return O.every_nth(table(spark, sf_dir, "documents").select("doc_id"), 16, "doc_id").select("doc_id", "place")


@query(r"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) AS word FROM documents) GROUP BY word),
f AS (SELECT word[1:k] AS prefix, word[k + 1:k + 1] AS next, sum(n) AS n FROM w, unnest(range(1, least(length(word), 8) + 1)) AS u(k) GROUP BY 1, 2),
t AS (SELECT prefix, CAST(sum(n) AS DOUBLE) AS total, sum(n * ln(n)) AS spread FROM f GROUP BY prefix),
s AS (SELECT t.prefix, round(pow(t.total / h.total, 1.0 / (length(t.prefix) - 1)) * greatest(ln(t.total) - t.spread / t.total, 0.0), 9) AS score FROM t JOIN t h ON h.prefix = t.prefix[1:1] WHERE length(t.prefix) > 1),
b AS (SELECT word, n, row_number() OVER (PARTITION BY word ORDER BY score DESC, length(prefix) DESC) AS r, prefix FROM (SELECT word, n, word[1:k] AS prefix FROM w, unnest(range(2, least(length(word), 8) + 1)) AS u(k)) JOIN s USING (prefix)),
c AS (SELECT prefix AS noun, CAST(sum(n) AS BIGINT) AS n FROM b WHERE r = 1 GROUP BY prefix HAVING sum(n) >= 2 AND prefix NOT IN ('the', 'and'))
SELECT noun, n, row_number() OVER (ORDER BY n DESC, noun) AS place FROM c QUALIFY place <= 100""")
def noun_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most frequent heads of words, cut by how they hold together and what follows them."""
    return N.noun_counts(table(spark, sf_dir, "documents"), "text", stops=("the", "and"))


@query("""SELECT 'doc-' || doc_id || '.txt' AS name, 'txt' AS format, CASE WHEN doc_id % 10 <> 3 THEN length(coalesce(text, '')) END AS size, CASE WHEN doc_id % 10 <> 3 THEN 'doc-' || doc_id END AS title, CAST(NULL AS BIGINT) AS n_rows,
  CASE WHEN doc_id % 10 = 3 THEN 'ValueError' END AS error FROM documents
UNION ALL SELECT 'event-' || event_id || '.json', 'json', CASE WHEN event_id % 10 <> 4 THEN length(props) END, CASE WHEN event_id % 10 <> 4 THEN 'event-' || event_id END, NULL, CASE WHEN event_id % 10 = 4 THEN 'JSONDecodeError' END FROM events
UNION ALL SELECT 'order-' || o_orderkey || '.csv', 'csv', CASE WHEN o_orderkey % 5 <> 2 THEN length('key,price' || chr(10) || o_orderkey || ',' || o_orderpriority || chr(10)) END, CASE WHEN o_orderkey % 5 <> 2 THEN 'order-' || o_orderkey END, CASE WHEN o_orderkey % 5 <> 2 THEN 2 END,
  CASE WHEN o_orderkey % 5 = 2 THEN 'ValueError' END FROM orders
UNION ALL SELECT 'page-' || page_id || '.pdf', 'pdf', NULL, NULL, NULL, 'LookupError' FROM pages""")
def parsed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of four formats, some of each broken and those of one without a reader: every file gives a row."""
    d, e, o, p = (table(spark, sf_dir, t) for t in ("documents", "events", "orders", "pages"))
    name = lambda kind, key, ext: F.concat(F.lit(f"{kind}-"), F.col(key).cast("string"), F.lit(f".{ext}"))
    file = lambda rows, kind, key, ext, body: rows.select(name(kind, key, ext).alias("name"), F.lit(ext).alias("format"), body.cast("binary").alias("content"))
    text = F.when(F.col("doc_id") % 10 == 3, F.concat(F.unhex(F.lit("FF30FF")), F.coalesce("text", F.lit("")).cast("binary"))).otherwise(F.coalesce("text", F.lit("")).cast("binary"))
    props = F.when(F.col("event_id") % 10 == 4, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    row = F.concat(F.lit("key,price\n"), F.col("o_orderkey").cast("string"), F.lit(","), "o_orderpriority", F.when(F.col("o_orderkey") % 5 == 2, ",more").otherwise(""), F.lit("\n"))
    files = file(d, "doc", "doc_id", "txt", text).unionByName(file(e, "event", "event_id", "json", props)).unionByName(file(o, "order", "o_orderkey", "csv", row)).unionByName(file(p, "page", "page_id", "pdf", F.col("html")))
    rows = F.when(F.size("tables") > 0, F.size(F.col("tables")[0])).cast("long")
    return readers.read_files(files).select("name", "format", F.length("content").cast("long").alias("size"), "title", rows.alias("n_rows"), F.split_part("error", F.lit(":"), F.lit(1)).alias("error"))
