"""Queries of prompts, of decisions put in words, of hooks and of token limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..operators import curate as Q
from ..operators.hooks import POST_SEARCH, POST_SYNTHESIS, PRE_QUERY, Hooks, on_column, on_values
from .curation import PAIRS, pairs
from .registry import query, table

NL = "chr(10)"
BLANK = "' ' || chr(9) || chr(10) || chr(13)"
#: Pairs that one prompt has scored, and the tokens that a training row may have.
BATCH, MOST_TOKENS = 5, 512


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def named(names: dict[str, str], column: str, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in names.items()) + f" ELSE {other} END"


@query(f"""WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents)
SELECT doc_id, md5({quoted(P.SYSTEM)} || coalesce(lang, '') || {NL} || {quoted(P.DOCUMENT)} || coalesce(source, '') || CASE WHEN doc_id % 4 = 0 THEN ' (Part ' || doc_id || ')' ELSE '' END || {NL}
  || substr(t, 1, {P.CONTENT_CHARS}) || CASE WHEN length(t) > {P.CONTENT_CHARS} THEN {quoted(P.CUT)} ELSE '' END
  || CASE WHEN doc_id % 3 = 0 THEN {NL} || {quoted(P.TABLES)} || '| ' || doc_id || ' |' || {NL} || {NL} || '|-|' ELSE '' END
  || CASE WHEN doc_id % 5 <> 0 THEN {NL} || {quoted(P.QUESTION)} || substr(t, 1, 40) ELSE '' END || {NL} || {quoted(chr(10).join(P.ANSWER_LINES))}) AS digest FROM d""")
def question_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt that asks for an answer out of each document, by its digest."""
    doc_id = F.col("doc_id").cast("string")
    part = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Part "), doc_id))
    tables = F.when(F.col("doc_id") % 3 == 0, F.array(F.concat(F.lit("| "), doc_id, F.lit(" |")), F.lit("|-|")))
    asked = F.when(F.col("doc_id") % 5 != 0, F.substring(F.coalesce("text", F.lit("")), 1, 40))
    prompt = P.question_prompt(F.col("source"), F.col("text"), asked, F.col("lang"), tables, part)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(prompt.cast("binary")).alias("digest"))


@query(f"""WITH {PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY source_doc ORDER BY pos) - 1 AS k FROM pairs)
SELECT source_doc, k // {BATCH} AS batch, count(*) AS n_pairs, string_agg('[' || (k % {BATCH}) || '] 질문: ' || coalesce(question, '') || {NL} || '    답변: ' || coalesce(answer, '') || {NL}, '' ORDER BY k) AS listed,
  {quoted(P.EXCERPT)} || substr(min(source_doc || ': ' || answer), 1, {P.SOURCE_CHARS}) || {NL} || {NL} AS excerpt FROM n GROUP BY 1, 2""")
def scoring_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a conversation in batches that one prompt has scored."""
    own = Q.in_batches(pairs(spark, sf_dir), "source_doc", "pos", BATCH)
    per = own.groupBy("source_doc", "batch").agg(F.count("*").alias("n_pairs"), F.array_sort(F.collect_list(F.struct("pos", "question", "answer"))).alias("l"), F.min(F.concat("source_doc", F.lit(": "), "answer")).alias("s"))
    return per.select("source_doc", "batch", "n_pairs", P.numbered_pairs(F.col("l")).alias("listed"), P.excerpt(F.col("s")).alias("excerpt"))


@query(f"""WITH d AS (SELECT doc_id, coalesce(source, '?') AS p, coalesce(text, '') AS t FROM documents)
SELECT doc_id, md5(CASE WHEN t = '' THEN p ELSE p || {NL} || CASE WHEN length(t) > {P.STEP_CHARS} THEN {quoted(P.STEPS_CUT)} || right(t, {P.STEP_CHARS}) ELSE t END END) AS steps,
  md5(CASE WHEN t = '' THEN {quoted(P.NOTHING_GATHERED)} ELSE right(t, {P.GATHERED_CHARS}) END) AS gathered FROM d""")
def step_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request with the end of what was found so far, the texts standing for that."""
    prompt, steps = F.coalesce("source", F.lit("?")), F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(P.last_steps(prompt, steps).cast("binary")).alias("steps"), F.md5(P.gathered(steps).cast("binary")).alias("gathered"))


SAID = "SELECT event_id, ['fact', 'compare', 'explain', 'howto', 'ambiguous', event_type, NULL][event_id % 7 + 1] AS intent, ['agent', 'chitchat', 'general', event_type, NULL][event_id % 5 + 1] AS mode, ['', NULL, ' ' || props || ' '][event_id % 3 + 1] AS reason, event_type, props FROM events"


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, nothing, at = F.col("event_type"), F.lit(None).cast("string"), F.col("event_id")
    pick = lambda values, n: F.element_at(F.array(*values), (at % n + 1).cast("int"))
    intent, mode = pick([*map(F.lit, P.INTENTS), kind, nothing], 7), pick([*map(F.lit, P.PATHS), kind, nothing], 5)
    return table(spark, sf_dir, "events").select("event_id", intent.alias("intent"), mode.alias("mode"), pick([F.lit(""), nothing, F.concat(F.lit(" "), "props", F.lit(" "))], 3).alias("reason"), "event_type", "props")


@query(f"""WITH s AS ({SAID})
SELECT event_id, CASE WHEN intent IS NULL THEN {quoted(P.ROUTED)} ELSE trim({quoted(P.MEANT)} || {named(P.INTENTS, 'intent', 'intent')}) END || ' → ' || {named(P.PATHS, "coalesce(mode, 'agent')", quoted(P.OTHER_PATH))}
  || CASE WHEN trim(coalesce(reason, '')) <> '' THEN ' (' || trim(reason) || ')' ELSE '' END AS line FROM s""")
def intent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir).select("event_id", P.intent_line(F.col("intent"), F.col("mode"), F.col("reason")).alias("line"))


@query(f"""WITH s AS ({SAID})
SELECT event_id, 'Persona: ' || coalesce(nullif(intent, ''), 'default') || CASE WHEN mode IS NULL THEN ' (composition skip: ' || coalesce(nullif(reason, ''), 'n/a')
  ELSE '+' || mode || ' (composition, trigger=' || CASE event_id % 3 WHEN 0 THEN event_type || ', ' || props WHEN 1 THEN event_type ELSE 'n/a' END END || ', conf=' || printf('%.2f', event_id % 100 / 100.0) || ')' AS line FROM s""")
def persona_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    triggers = F.when(F.col("event_id") % 3 == 0, F.array("event_type", "props")).when(F.col("event_id") % 3 == 1, F.array("event_type"))
    line = P.persona_line(F.col("intent"), F.col("mode"), triggers, F.col("reason"), F.col("event_id") % 100 / 100.0)
    return said(spark, sf_dir).select("event_id", line.alias("line"))


TEMPLATES = f"""d AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN source || ' {{history}} ' || lang WHEN 2 THEN source WHEN 3 THEN '{{history}}' END AS first,
  CASE doc_id % 3 WHEN 0 THEN source || {NL} || '규칙:' || {NL} || text WHEN 1 THEN lang || ' {{x}}' || {NL} || {NL} || '답변 구조 (' || source || '):' || {NL} || '- {{' || lang || '}}' || {NL} || '## ' || text ELSE text END AS second FROM documents)"""


@query(f"""WITH {TEMPLATES}, m AS (SELECT *, coalesce(second, '') AS t, regexp_extract(coalesce(second, ''), '(?m){P.RULES_HEAD}') AS head FROM d),
l AS (SELECT *, list_filter(list_transform(string_split(CASE WHEN head <> '' THEN substr(t, instr(t, head) + length(head)) ELSE t END, {NL}), lambda x: trim(x, {BLANK})), lambda x: x <> '') AS lines FROM m),
e AS (SELECT *, coalesce(nullif(list_position(list_transform(lines, lambda x: regexp_matches(x, '{P.RULES_END}')), true), 0), len(lines) + 1) - 1 AS n FROM l),
r AS (SELECT *, replace(replace(coalesce(array_to_string(lines[1:least(n, {P.RULE_LINES})], {NL}), ''), '{{', '{{{{'), '}}', '}}}}') AS rules FROM e)
SELECT doc_id, md5(rules) AS rules, md5(CASE WHEN first IS NULL OR rules = '' THEN first WHEN contains(first, '{{history}}') THEN substr(first, 1, instr(first, '{{history}}') - 1) || {quoted(P.RULES_TITLE)} || rules || {NL} || substr(first, instr(first, '{{history}}'))
  ELSE {quoted(P.RULES_TITLE)} || rules || {NL} || first END) AS joined FROM r""")
def persona_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rules of one prompt put into another; texts stand for the rules."""
    docs, lang, source, nl = table(spark, sf_dir, "documents"), F.col("lang"), F.col("source"), F.lit("\n")
    first = F.when(F.col("doc_id") % 4 == 1, F.concat(source, F.lit(" {history} "), lang)).when(F.col("doc_id") % 4 == 2, source).when(F.col("doc_id") % 4 == 3, "{history}")
    structure = F.concat(lang, F.lit(" {x}\n\n답변 구조 ("), source, F.lit("):\n- {"), lang, F.lit("}\n## "), F.col("text"))
    second = F.when(F.col("doc_id") % 3 == 0, F.concat(source, nl, F.lit("규칙:\n"), F.col("text"))).when(F.col("doc_id") % 3 == 1, structure).otherwise(F.col("text"))
    return docs.select("doc_id", F.md5(P.core_rules(second).cast("binary")).alias("rules"), F.md5(P.joined_prompt(first, second).cast("binary")).alias("joined"))


def broken(rows: DataFrame) -> DataFrame:
    return rows.withColumn("query", F.col("no_such_column"))


@query(rf"SELECT conv_id, turn, lower(regexp_replace(trim(text, {BLANK}), '\s+', ' ', 'g')) AS query FROM conversations WHERE role = 'user'")
def hooked_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests through the hooks ahead of a search, one of which cannot be planned."""
    hooks = Hooks(("squash_query",))
    hooks.add(PRE_QUERY, broken)
    hooks.add(PRE_QUERY, on_column("query", F.lower))
    return hooks.run(PRE_QUERY, table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query")))


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_linenumber) AS nth FROM lineitem)
SELECT l_orderkey, string_agg(l_linenumber || ':' || l_suppkey % 3, ' ' ORDER BY l_linenumber, l_suppkey % 3) AS sources FROM f WHERE nth = 1 GROUP BY 1""")
def hooked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search found, here the lines of each order, once for each document, here a third of the suppliers."""
    line = F.struct(F.col("l_linenumber").alias("rank"), (F.col("l_suppkey") % 3).alias("doc_id"))
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("sources"))
    kept = Hooks(("distinct_sources", "no_such_hook")).run(POST_SEARCH, found)
    return kept.select("l_orderkey", F.array_join(F.transform("sources", lambda s: F.concat(s["rank"].cast("string"), F.lit(":"), s["doc_id"].cast("string"))), " ").alias("sources"))


def signed(answer: str) -> str:
    if "&" in answer:
        raise ValueError(answer)
    return f"{answer} --"


@query("""WITH p AS (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS t FROM pages) SELECT page_id, md5(CASE WHEN contains(t, '&') THEN t ELSE t || ' --' END) AS digest FROM p""")
def hooked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, here pages, without tags; then a Python hook that fails on some of them."""
    hooks = Hooks(("plain_answer",))
    hooks.add(POST_SYNTHESIS, on_values("answer", signed))
    answers = hooks.run(POST_SYNTHESIS, table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("answer")))
    return answers.select("page_id", F.md5(F.col("answer").cast("binary")).alias("digest"))


def vocabulary() -> str:
    """The content of a public tokenizer's file, read where the query is planned."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@query()
def token_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows that are not too long for a model; a tokenizer has no SQL form."""
    chats = Q.chat_messages(pairs(spark, sf_dir), "Answer briefly.")
    return Q.fitting(chats, "messages", vocabulary(), MOST_TOKENS).select("pos", "n_tokens")
