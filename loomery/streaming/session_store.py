"""Conversations kept in a keyed store: messages merged exactly once, expiry, eviction, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.sessions import evicted
from ..sources.store import KeyedStore

MESSAGE = "struct<seq:long,role:string,content:string,ts:timestamp>"
SCHEMA = f"session_id string, messages array<{MESSAGE}>, last_sources array<string>, last_access timestamp"

#: Words of a history that a model reads.
HISTORY, USER, ASSISTANT, SUMMARY = "[이전 대화]", "사용자: ", "어시스턴트: ", "[이전 대화 요약] "


def open_store(spark: SparkSession, folder: str, buckets: int = 16) -> KeyedStore:
    return KeyedStore(spark, folder, "session_id", SCHEMA, buckets)


def _tail(messages: Column, most: int) -> Column:
    return F.when(F.size(messages) > most, F.slice(messages, F.size(messages) - most + 1, F.lit(most))).otherwise(messages)


def add_messages(store: KeyedStore, batch: DataFrame, number: int, max_turns: int = 10) -> bool:
    """Append the messages of one batch (session_id, seq, role, content, ts, sources); False for a batch that is in already.

    A session keeps its last 2 * ``max_turns`` messages by ``seq``, the
    sources of its last message that has some, and the time of its last one.
    Only that many messages of a session leave the batch's window, so a long
    session in a batch is no large group.
    """
    most = 2 * max_turns
    back = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("seq")))
    message = F.struct(F.col("seq").cast("long").alias("seq"), "role", "content", F.col("ts").cast("timestamp").alias("ts"))
    per = batch.groupBy("session_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last_access"), F.max_by("sources", F.when(F.col("sources").isNotNull(), F.col("seq"))).alias("last_sources"))
    kept = batch.withColumn("back", back).where(F.col("back") <= most).groupBy("session_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))

    def merged(old: DataFrame, new: DataFrame) -> DataFrame:
        o, n = old.alias("o"), new.alias("n")
        none = F.array().cast(f"array<{MESSAGE}>")
        both = F.array_sort(F.concat(F.coalesce(F.col("o.messages"), none), F.coalesce(F.col("n.messages"), none)))
        pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
        return o.join(n, F.col("o.session_id") == F.col("n.session_id"), "full_outer").select(pick("session_id"), _tail(both, most).alias("messages"), pick("last_sources"), F.greatest(F.col("o.last_access"), F.col("n.last_access")).alias("last_access"))

    return store.upsert(per.join(kept, "session_id"), F.col("last_access"), number, merged)


def keep_sessions(store: KeyedStore, messages: DataFrame, checkpoint: str, max_turns: int = 10) -> None:
    """Merge a stream of messages into the store, each batch once even if it is replayed."""
    flow = messages.writeStream.foreachBatch(lambda batch, number: add_messages(store, batch, number, max_turns) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    flow.awaitTermination()


def expire(store: KeyedStore, now: Column, ttl: int = 3600) -> None:
    """Take out sessions whose last message is more than ``ttl`` seconds before ``now``."""
    age = F.unix_micros(now) - F.unix_micros("last_access")
    store.remove(store.read().where(age > ttl * 1_000_000).select("session_id"))


def evict(store: KeyedStore, most: int) -> None:
    """Keep the ``most`` sessions of the latest access."""
    store.remove(evicted(store.read().select("session_id", "last_access"), most, "session_id", "last_access").select("session_id"))


def compress(store: KeyedStore, summaries: DataFrame, keep: int) -> None:
    """Of the sessions of ``summaries`` (session_id, summary), put the summary in place of all but the last ``keep`` messages."""

    def shorter(old: DataFrame, new: DataFrame) -> DataFrame:
        said = old.join(new, "session_id", "left")
        last = F.element_at("messages", F.size("messages") - F.lit(keep))
        note = F.struct(last["seq"].alias("seq"), F.lit("assistant").alias("role"), F.concat(F.lit(SUMMARY), F.col("summary")).alias("content"), last["ts"].alias("ts"))
        long = F.col("summary").isNotNull() & (F.size("messages") > keep)
        return said.withColumn("messages", F.when(long, F.concat(F.array(note), _tail(F.col("messages"), keep))).otherwise(F.col("messages")))

    store.upsert(summaries, F.lit(1), combine=shorter)


def history(messages: Column) -> Column:
    """What a model reads of a session: user and assistant turns under a title; empty without messages."""
    lines = F.filter(F.transform(messages, lambda m: F.when(m["role"] == "user", F.concat(F.lit(USER), m["content"])).when(m["role"] == "assistant", F.concat(F.lit(ASSISTANT), m["content"]))), lambda x: x.isNotNull())
    return F.when(F.size(messages) > 0, F.array_join(F.concat(F.array(F.lit(HISTORY)), lines, F.array(F.lit(""))), "\n")).otherwise("")
