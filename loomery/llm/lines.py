"""Line-level deduplication with levelled sorted runs of line hashes.

Only DataFrame functions are used: every step runs in the JVM.

A run is a table (h1, h2, n_docs) of 128-bit line hashes, bucketed and
sorted by hash, that says in how many documents of some batches a line was
found.  A new batch counts its own lines, leaves out what the runs already
know to be frequent (a merge anti-join on the shared buckets) and adds the
rest as a run of level 0.  When a level holds ``fanout`` runs they are merged
into one run of the next level, so a hash is rewritten once per level.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import delete_folder, fresh_path, materialize, small_side

_BLANKS = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; texts of ASCII only take the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h1, h2, n_docs) of the distinct line keys of each row of ``docs``."""
    lines = docs.select(F.explode(F.array_distinct(F.transform(split_lines(lower_ascii(F.col("text"))), line_key))).alias("key"))
    return lines.where(F.char_length("key") >= min_chars).select(*hashes(F.col("key"))).groupBy(*HASH).agg(F.count("*").alias("n_docs"))


class LineRuns:
    """Levelled runs of line hashes; lines in ``min_docs`` documents or more are frequent."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_chars: int = 1, fanout: int = 2):
        self.spark, self.min_docs, self.min_chars, self.fanout = spark, min_docs, min_chars, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = fresh_path(self.spark, "line-run")
        run.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", self.paths[name]).saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        # a merge join of the sorted buckets; a union of bucketed scans is not zipped bucket by bucket
        out = self.spark.table(names[0])
        for name in names[1:]:
            own, other = F.coalesce("n_docs", F.lit(0)), F.coalesce("n_more", F.lit(0))
            out = out.join(self.spark.table(name).withColumnRenamed("n_docs", "n_more"), HASH, "full_outer").select(*HASH, (own + other).alias("n_docs"))
        return out

    def add(self, batch: DataFrame) -> None:
        """Take in the documents of one batch; null and empty texts add nothing."""
        own = line_counts(batch, self.min_chars)
        for name in (n for level in self.levels for n in level):
            own = own.join(self.spark.table(name).where(F.col("n_docs") >= self.min_docs), HASH, "left_anti")
        self.levels[0].append(self._write(own))
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(self._merged(level)))
                for name in level:
                    self._drop(name)
                level.clear()

    def _drop(self, name: str) -> None:
        """Forget a run and delete its files, which an external table would leave behind."""
        self.spark.sql(f"DROP TABLE {name}")
        delete_folder(self.spark, self.paths.pop(name))

    def close(self) -> None:
        """Drop all runs; what :meth:`frequent` gave must have been written out before."""
        for name in [n for level in self.levels for n in level]:
            self._drop(name)
        self.levels = [[]]

    def frequent(self) -> DataFrame:
        """(h1, h2) of the lines that reach ``min_docs`` over all runs."""
        names = [n for level in self.levels for n in level]
        run = self.spark.table(names[0]) if len(names) == 1 else self._merged(names)
        return run.where(F.col("n_docs") >= self.min_docs).select(*HASH)


def _row_key() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(1), "doc_id", text).alias("k2")]


def drop_frequent(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text, where lines of ``frequent``, a written table, are gone."""
    keyed = docs.select(*_row_key(), F.posexplode(split_lines(lower_ascii(F.col("text")))).alias("pos", "line"))
    keyed = keyed.withColumn("key", line_key(F.col("line"))).where(F.col("key") != "").select("k1", "k2", "pos", *hashes(F.col("key")))
    hits = keyed.join(small_side(frequent), HASH, "left_semi")
    gone = materialize(hits.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "dropped-lines")

    # one character for each line, 1 where it goes, so a text is put together in one pass
    step = F.transform("gone", lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.when(i > 0, F.col("gone")[i - 1] + 1).otherwise(0)), F.lit("1")))
    flags = F.split(F.rpad(F.array_join(step, ""), F.size("lines"), "0"), "")
    pairs = F.arrays_zip(F.col("lines").alias("line"), flags.alias("flag"))
    kept = F.filter(pairs, lambda z: z["line"].isNotNull() & (z["flag"] == "0"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"), *_row_key()).join(small_side(gone), ["k1", "k2"], "left")
    whole = whole.withColumn("lines", split_lines(F.col("text")))
    added = {
        "n_lines": F.size("lines").cast("long"),
        "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
        "kept_text": F.when(F.col("gone").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda z: z["line"]), "\n")),
    }
    whole = whole.select("row", *(e.alias(c) for c, e in added.items()))
    return whole.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in added), *added)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 3, fanout: int = 2) -> DataFrame:
    """Drop every line whose key is found in at least ``min_docs`` rows of ``docs``.

    A key is the line without blanks (space, \\t to \\r) at its ends and with
    A-Z lower-cased; keys under ``min_chars`` code points are never dropped.
    Adds n_lines, n_dropped and kept_text.  A null or empty text is one empty
    line and its kept_text is empty; a repeated row counts as a document of
    its own; a null doc_id is kept; all columns of ``docs`` stay, but for
    those named as an added one.  An empty table gives an empty result.
    """
    runs = LineRuns(docs.sparkSession, min_docs, min_chars, fanout)
    batch = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(batches))
    for k in range(batches):
        runs.add(docs.where(batch == k))
    frequent = materialize(runs.frequent(), "frequent-lines")
    runs.close()
    return drop_frequent(docs, frequent)
