"""Sessions and conversations: expiry, caps, transcripts, eviction, token measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import numbered


def with_sessions(events: DataFrame, ttl: int = 3600, key: str = "user_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Add ``session``, counted from 0: a gap of more than ``ttl`` seconds starts the next."""
    own = W.partitionBy(key).orderBy(ts, order)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(own)
    return events.withColumn("new", F.coalesce((gap > ttl * 1_000_000).cast("long"), F.lit(0))).withColumn("session", F.sum("new").over(own)).drop("new")


def session_table(events: DataFrame, ttl: int = 3600, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, session, n_events, start, end)."""
    rows = with_sessions(events, ttl, key, ts)
    return rows.groupBy(key, "session").agg(F.count("*").alias("n_events"), F.min(ts).alias("start"), F.max(ts).alias("end"))


def capped_history(turns: DataFrame, most: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``most`` turns of each conversation."""
    back = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return turns.withColumn("back", back).where(F.col("back") <= most).drop("back")


def transcript(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, n_turns, transcript): labelled turns in order."""
    label = F.when(F.col("role") == "user", "User").when(F.col("role") == "assistant", "Assistant").otherwise("System")
    line = F.concat(label, F.lit(": "), F.coalesce("text", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return turns.groupBy(key).agg(F.count("*").alias("n_turns"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))


def compressed(turns: DataFrame, after: int, target: int = 500, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Conversations of more than 2 * ``after`` turns: one summary turn and the last ``after`` ones.

    The summary is the head of the transcript, where a model would write one.
    """
    own = W.partitionBy(key)
    back = F.row_number().over(own.orderBy(F.desc(order)))
    seen = turns.withColumns({"n": F.count("*").over(own), "back": back})
    long = F.col("n") > 2 * after
    kept = seen.where(~long | (F.col("back") <= after)).select(key, order, "role", "text")
    # turns that begin beyond the summary's length are left out before a transcript is gathered; a label and its colon count as one
    size = F.length(F.coalesce("text", F.lit(""))) + 1
    begins = F.coalesce(F.sum(size).over(own.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    old = transcript(seen.withColumn("begins", begins).where(long & (F.col("back") > after) & (F.col("begins") < target)), key, order)
    return kept.unionByName(old.select(key, F.lit(-1).cast("long").alias(order), F.lit("system").alias("role"), F.substring("transcript", 1, target).alias("text")))


def evicted(events: DataFrame, most: int, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, last_access, nth) of the keys that go when only the ``most`` latest stay."""
    last = events.groupBy(key).agg(F.max(ts).alias("last_access"))
    # one row for each key is ranked, not each event
    ranked = numbered(last, F.desc("last_access"), F.col(key))
    return ranked.withColumn("nth", F.col("place") + 1).where(F.col("nth") > most).drop("place")


def token_metrics(events: DataFrame, key: str = "user_id", ts: str = "ts", token: str = "view", done: str = "purchase") -> DataFrame:
    """(key, n_tokens, first_token_s, total_s): time to the first token and to the last event of the stream."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    kind = F.col("event_type")
    per = events.groupBy(key).agg(F.count_if(kind == token).alias("n_tokens"), F.count_if(kind == done).alias("n_done"), F.min(micros).alias("a"), F.min(F.when(kind == token, micros)).alias("t"), F.max(micros).alias("z"))
    return per.select(key, "n_tokens", "n_done", ((F.col("t") - F.col("a")) / 1e6).alias("first_token_s"), ((F.col("z") - F.col("a")) / 1e6).alias("total_s"))
