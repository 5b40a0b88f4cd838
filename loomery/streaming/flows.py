"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squash
from ..operators.upkeep import diff_manifests
from ..sources.files import scan_folder
from ..sources.store import commit, folders, latest


def sessions(events: DataFrame, gap: str = "60 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n_events) of a stream of events (user_id, ts): a gap of more than ``gap`` ends a session.

    In append mode state is kept for each user's open session only, and a
    session comes out once nothing can join it; complete mode keeps and gives
    all of them.  Events more than ``late`` behind the newest are dropped.
    ``end`` is the last event's time.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n_events")).drop("session_window")


def first_requests(requests: DataFrame, keep: str = "300 seconds") -> DataFrame:
    """Requests (query, ts) of a stream whose query, but for case and blanks, was not asked within ``keep`` before."""
    rows = requests.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("norm", F.lower(squash(F.col("query"))))
    return rows.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["norm"])


#: The state store that operators with their own state need.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = "spark.sql.shuffle.partitions"


def run_once(stream: DataFrame, folder: str, mode: str = "append", run: str | None = None, stateful: bool = False) -> DataFrame:
    """Process all that is there now and return what the stream has given so far, as written tables below ``folder``.

    A later call with the same ``run`` goes on where the last one ended.
    Every batch has a folder of its own, which a replay of it replaces.
    ``stateful``: the stream has operators with their own state; it has two
    tasks a core at most, as opening and saving a store takes each its time.
    """
    spark, run = stream.sparkSession, run or uuid.uuid4().hex
    out = f"{folder}/out-{run}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number:012d}")

    own = {STATE_STORE: ROCKS, PARTITIONS: str(min(int(spark.conf.get(PARTITIONS)), 2 * spark.sparkContext.defaultParallelism))} if stateful else {}
    usual = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        flow = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state-{run}").trigger(availableNow=True).start()
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    flow.awaitTermination()
    parts = [f"{out}/{n}" for n in folders(spark, out)]
    if mode == "complete":
        parts = parts[-1:]
    return spark.read.schema(stream.schema).parquet(*parts) if parts else spark.createDataFrame([], stream.schema)


def process_changes(spark: SparkSession, folder: str, state: str, process: Callable[[DataFrame], None]) -> None:
    """Give new and modified files of ``folder`` to ``process``; their hashes count only after it has returned.

    What is listed is written once, names, hashes and bytes of one moment,
    below ``state``: ``process`` reads that, and the next call compares with
    its hashes.  A file that changes meanwhile is seen the next time.  A call
    that stops leaves the hashes of the last that did not.
    """
    number, content = latest(spark, state)
    path = f"{state}/snapshots/{uuid.uuid4().hex}"
    found = scan_folder(spark, folder)
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    saved = spark.read.schema(found.schema).parquet(content["snapshot"]) if content else spark.createDataFrame([], found.schema)
    changed = diff_manifests(found, saved.select("name", "sha256")).where("change in ('new', 'modified')").select("name")
    process(found.join(changed, "name", "left_semi"))
    commit(spark, state, number + 1, {"snapshot": path})
