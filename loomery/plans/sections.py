"""Queries of sections and tables, over whole texts that get headings and tables of every kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking as C
from ..functions import signals as S
from .registry import query, table

#: Marks of three sections and of two inner ones, a row for each heading shape.
MARKS = (
    ("Ⅰ. ", "Ⅱ. ", "Ⅲ. ", "1. ", "2. "), ("1. ", "2. ", "3. ", "Ⅰ. ", "Ⅱ. "), ("(1) ", "(2) ", "(3) ", "Ⅰ. ", "Ⅱ. "),
    ("가. ", "나. ", "다. ", "Ⅰ. ", "Ⅱ. "), ("□ ", "○ ", "● ", "Ⅰ. ", "Ⅱ. "),
)
#: One line of text for both languages; pieces by place and size.
LINE = r"trim(regexp_replace({text}, '[\x09-\x0D\x20]+', ' '{all}))"
NL = "chr(10)"


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, t): every document's whole text as one line."""
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"[\x09-\x0D\x20]+", " "), F.lit(C.SPACES)).alias("t"))


def cut(a: int, n: int | None = None) -> Column:
    return F.rtrim(F.substr("t", F.lit(a)) if n is None else F.substr("t", F.lit(a), F.lit(n)), F.lit(C.SPACES))


def mark(which: int) -> Column:
    i = F.col("doc_id") % len(MARKS)
    out = F.lit(MARKS[-1][which])
    for k, row in enumerate(MARKS[:-1]):
        out = F.when(i == k, row[which]).otherwise(out)
    return out


MARK_SQL = ", ".join(f"CASE doc_id % {len(MARKS)} " + " ".join(f"WHEN {k} THEN '{row[w]}'" for k, row in enumerate(MARKS)) + f" END AS {name}" for w, name in enumerate(("h1", "h2", "h3", "s1", "s2")))
LINE_SQL = "d AS (SELECT doc_id, " + LINE.format(text="text", all=", 'g'") + " AS t FROM documents)"
#: Plain pieces of (doc_id, ..., c): of 2,000 characters at every 1,600th.
PIECES = "CAST(unnest(range(0, CASE WHEN length(c) <= 2000 THEN 1 ELSE CAST(ceil((length(c) - 2000) / 1600.0) AS BIGINT) + 1 END)) AS BIGINT)"


@query(f"""WITH {LINE_SQL}, m AS (SELECT *, {MARK_SQL} FROM d WHERE length(t) >= 3000),
q AS (SELECT *, h1 || 'One' || {NL} || '· ' || rtrim(substr(t, 1, 300)) || {NL} || {NL} || h2 || 'Two' || {NL} || '· ' || rtrim(substr(t, 301, 1500)) AS a,
  s1 || 'Sub a' || {NL} || '· ' || rtrim(substr(t, 1801, 1000)) AS p1, s2 || 'Sub b' || {NL} || '· ' || rtrim(substr(t, 2801)) AS p2 FROM m),
r AS (SELECT *, h3 || 'Three' || {NL} || p1 || {NL} || p2 AS three FROM q),
x AS (SELECT doc_id, 0 AS o, a AS c, true AS whole FROM r UNION ALL
  SELECT doc_id, 1, three, true FROM r WHERE length(three) <= 2000 UNION ALL
  SELECT doc_id, 1, p1 || {NL} || {NL} || p2, true FROM r WHERE length(three) > 2000 AND length(p1) + length(p2) + 2 <= 2000 UNION ALL
  SELECT doc_id, 1, p1, true FROM r WHERE length(three) > 2000 AND length(p1) + length(p2) + 2 > 2000 UNION ALL
  SELECT doc_id, 2, p2, length(p2) <= 2000 FROM r WHERE length(three) > 2000 AND length(p1) + length(p2) + 2 > 2000 UNION ALL
  SELECT doc_id, 3, t, false FROM d WHERE length(t) BETWEEN 1 AND 2999),
y AS (SELECT doc_id, o, k, CASE WHEN whole THEN c ELSE substr(c, k * 1600 + 1, 2000) END AS contents FROM (SELECT *, CASE WHEN whole THEN 0 ELSE NULL END AS z, {PIECES} AS k FROM x) WHERE NOT whole OR k = 0),
f AS (SELECT * FROM y WHERE o = 3 OR length(trim(contents)) >= 200)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o, k) - 1 AS chunk_index, length(contents) AS size, md5(contents) AS digest,
  CASE WHEN o < 3 AND k = 0 THEN string_split(contents, {NL})[1] END AS title FROM f""")
def section_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts under headings of each shape: small sections wait for the next, large ones are cut along inner headings or plainly; texts under 3,000 characters have none."""
    body = lambda m, name, a, n=None: F.concat(mark(m), F.lit(f"{name}\n· "), cut(a, n))
    made = F.concat_ws("\n", body(0, "One", 1, 300), body(1, "Two", 301, 1500), F.concat(mark(2), F.lit("Three")), body(3, "Sub a", 1801, 1000), body(4, "Sub b", 2801))
    rows = line(spark, sf_dir).select("doc_id", F.when(F.length("t") >= 3000, made).otherwise(F.col("t")).alias("text"))
    return C.chunk_sections(rows, 2000).select("doc_id", "chunk_index", F.length("contents").cast("long").alias("size"), F.md5(F.col("contents").cast("binary")).alias("digest"), "title")


@query(f"""WITH {LINE_SQL}, m AS (SELECT * FROM d WHERE length(t) >= 3000 AND doc_id % 7 <> 0),
s AS (SELECT doc_id, 0 AS sec, '' AS major, 'Preface ' || rtrim(substr(t, 1, 250)) AS section FROM m UNION ALL
  SELECT doc_id, 1, 'Ⅰ. First', 'Ⅰ. First' || {NL} || '· ' || rtrim(substr(t, 251, 300)) FROM m UNION ALL
  SELECT doc_id, 2, 'Ⅱ. Second', 'Ⅱ. Second' || {NL} || '1. Sub one' || {NL} || '· ' || rtrim(substr(t, 551, 1500)) || {NL} || '2. Sub two' || {NL} || '· ' || rtrim(substr(t, 2051, 800)) FROM m UNION ALL
  SELECT doc_id, 3, 'Ⅲ. Third', 'Ⅲ. Third' || {NL} || '· ' || rtrim(substr(t, 2851)) FROM m),
x AS (SELECT doc_id, sec, 0 AS i, CASE WHEN sec = 0 THEN '' ELSE '[' || major || ']' END AS context, section AS parent, section AS c, sec = 3 AS cut FROM s WHERE sec <> 2 UNION ALL
  SELECT doc_id, sec, 0, '[Ⅱ. Second > 1. Sub one]', section, split_part(split_part(section, 'Ⅱ. Second' || {NL}, 2), {NL} || '2. Sub two', 1), false FROM s WHERE sec = 2 UNION ALL
  SELECT doc_id, sec, 1, '[Ⅱ. Second > 2. Sub two]', section, '2. Sub two' || split_part(section, {NL} || '2. Sub two', 2), false FROM s WHERE sec = 2),
y AS (SELECT doc_id, sec, i + k AS i, context, parent, CASE WHEN cut THEN substr(c, k * 1600 + 1, 2000) ELSE c END AS contents FROM (SELECT *, {PIECES} AS k FROM x) WHERE cut OR k = 0),
u AS (SELECT doc_id, sec, i, 'section_' || sec || '_chunk_' || i AS chunk_id, context, parent[1:12000] AS parent, contents FROM y WHERE length(trim(contents)) >= 200 UNION ALL
  SELECT doc_id, 9, 0, 'chunk_0', '', c, c FROM (SELECT doc_id, 'Ⅰ. A' || {NL} || {NL} || 'Ⅱ. B' || {NL} || {NL} || 'Ⅲ. C' AS c FROM d WHERE length(t) >= 3000 AND doc_id % 7 = 0) UNION ALL
  SELECT doc_id, 9, k, 'chunk_' || k, '', piece, piece FROM (SELECT doc_id, k, substr(c, k * 1600 + 1, 2000) AS piece FROM (SELECT doc_id, t AS c, {PIECES.replace("c)", "t)")} AS k FROM d WHERE length(t) BETWEEN 1 AND 2999)))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec, i) - 1 AS chunk_index, chunk_id, context, length(contents) AS size, length(parent) AS parent_size, md5(contents) AS digest, md5(parent) AS parent_digest FROM u""")
def context_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts under two levels of headings, with the sections that their chunks come from; texts under 3,000 characters have none, every seventh long one only empty ones."""
    made = F.concat(
        F.lit("Preface "), cut(1, 250), F.lit("\nⅠ. First\n· "), cut(251, 300), F.lit("\nⅡ. Second\n1. Sub one\n· "), cut(551, 1500), F.lit("\n2. Sub two\n· "), cut(2051, 800), F.lit("\nⅢ. Third\n· "), cut(2851),
    )
    text = F.when(F.length("t") < 3000, F.col("t")).when(F.col("doc_id") % 7 == 0, "Ⅰ. A\n\nⅡ. B\n\nⅢ. C").otherwise(made)
    out = C.chunk_with_context(line(spark, sf_dir).select("doc_id", text.alias("text")), 2000)
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    return out.select("doc_id", "chunk_index", "chunk_id", "context", F.length("contents").cast("long").alias("size"), F.length("parent").cast("long").alias("parent_size"), digest("contents").alias("digest"), digest("parent").alias("parent_digest"))


#: Tables by the kind of document: a whole one and one without a rule, a broken one, none.
TABLED = f"""coalesce(text, '') || {NL} || CASE doc_id % 3 WHEN 0 THEN '  | id | lang |' || {NL} || '|---|:--|  ' || {NL} || '| ' || doc_id || ' | ' || lang || ' |' || {NL} || '| a |  |' || {NL} || 'between' || {NL} || '|x|' || {NL} || '|' || source || '|'
  WHEN 1 THEN '| id | open' || {NL} || '|---|' || {NL} || 'no bar |' || {NL} || '| ' || doc_id || ' |' ELSE 'none' END"""


@query(rf"""WITH d AS (SELECT doc_id, {TABLED} AS t FROM documents),
l AS (SELECT doc_id, i, trim(ls[i], ' ' || chr(9) || chr(13)) AS line FROM (SELECT doc_id, string_split(t, {NL}) AS ls FROM d), unnest(range(1, len(ls) + 1)) AS u(i)),
b AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM l WHERE line LIKE '|%' AND line LIKE '%|'),
g AS (SELECT doc_id, run, string_agg(line, {NL} ORDER BY i) AS block, list(line ORDER BY i) AS ls FROM b GROUP BY doc_id, run),
p AS (SELECT *, coalesce(regexp_matches(ls[2], '^\|(\s*:?-+:?\s*\|)+$'), false) AS ruled FROM g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS place, block, CASE WHEN ruled THEN list_transform(string_split(ls[1][2:-2], '|'), lambda x: trim(x)) END AS head,
  CAST(len(ls) - CASE WHEN ruled THEN 2 ELSE 0 END AS BIGINT) AS n_rows, list_transform(string_split(ls[-1][2:-2], '|'), lambda x: trim(x)) AS last_row FROM p""")
def text_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown tables at the end of whole texts: two, a broken one, or none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    i = F.col("doc_id").cast("string")
    two = F.concat(F.lit("  | id | lang |\n|---|:--|  \n| "), i, F.lit(" | "), "lang", F.lit(" |\n| a |  |\nbetween\n|x|\n|"), "source", F.lit("|"))
    broken = F.concat(F.lit("| id | open\n|---|\nno bar |\n| "), i, F.lit(" |"))
    made = F.when(F.col("doc_id") % 3 == 0, two).when(F.col("doc_id") % 3 == 1, broken).otherwise("none")
    blocks = docs.select("doc_id", F.posexplode(S.table_blocks(F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), made))).alias("place", "block"))
    parts = blocks.select("doc_id", F.col("place").cast("long").alias("place"), "block", S.table_parts(F.col("block")).alias("p"))
    return parts.select("doc_id", "place", "block", "p.head", F.size("p.rows").cast("long").alias("n_rows"), F.element_at("p.rows", -1).alias("last_row"))
