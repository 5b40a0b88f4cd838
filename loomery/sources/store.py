"""Tables in a shared folder: written once, numbered generations, and rows that are replaced by key.

A folder's state is the last of its generations, small JSON files that are
never changed once they are there.  A writer puts its data into files of its
own and then adds the next generation, which names the files that count: a
run that stops in between leaves files that nothing reads, and of two writers
of one generation the second fails.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession) -> str:
    """A folder for what a query writes: the shared one of a cluster, or one of its own on a local master."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomery-")
        sc.setCheckpointDir(found)
    return f"{found.rstrip('/')}/loomery-flows"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once below the shared folder and read back: every later read has the same rows in the same files."""
    path = f"{scratch(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what is right below ``path``; none if it is not there."""
    where, fs = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def moved(spark: SparkSession, path: str, to: str) -> None:
    """Give a folder another name; an error if that is taken."""
    where, fs = _files(spark, path)
    final, _ = _files(spark, to)
    fs.mkdirs(final.getParent())
    if fs.exists(final) or not fs.rename(where, final):
        raise FileExistsError(f"{path} could not become {to}")


def latest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """(number, content) of the last generation of ``folder``; (0, {}) before the first."""
    names = [n for n in folders(spark, f"{folder}/generations") if n.endswith(".json")]
    if not names:
        return 0, {}
    where, fs = _files(spark, f"{folder}/generations/{names[-1]}")
    source = fs.open(where)
    try:
        return int(names[-1].removesuffix(".json")), json.loads(bytes(source.readAllBytes()).decode())
    finally:
        source.close()


def commit(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    """Add generation ``number``; an error if another writer has been first."""
    final, fs = _files(spark, f"{folder}/generations/{number:012d}.json")
    draft, _ = _files(spark, f"{folder}/drafts/{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(content, ensure_ascii=False).encode()))
    out.close()
    fs.mkdirs(final.getParent())
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise FileExistsError(f"generation {number} of {folder} is there already")


Combine = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedStore:
    """Rows by a unique key, in ``buckets`` files' worth of folders that are replaced one by one.

    The number of buckets is that of the first write; choose it so that the
    rows of a bucket fit a task.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: T.StructType | str, buckets: int = 16):
        self.spark, self.folder, self.key = spark, folder, key
        self.schema = spark.createDataFrame([], schema).schema
        self.buckets = latest(spark, folder)[1].get("buckets", buckets)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _table(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def files(self) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        return self._files_of(latest(self.spark, self.folder))

    def _files_of(self, seen: tuple[int, dict]) -> dict[int, str]:
        return {int(b): p for b, p in seen[1].get("files", {}).items()}

    def read(self) -> DataFrame:
        return self._table(list(self.files().values()))

    def _replace(self, seen: tuple[int, dict], touched: list[int], rows: DataFrame, token: int | None) -> None:
        """Put ``rows``, made of generation ``seen``, in place of the buckets ``touched``; an error if that is no longer the last."""
        number, content = seen
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names, self._bucket().alias("in_bucket")).repartition(max(1, len(touched)), "in_bucket").write.partitionBy("in_bucket").parquet(path)
        there = set(folders(self.spark, path))
        files = content.get("files", {}) | {str(b): f"{path}/in_bucket={b}" for b in touched}
        files = {b: p for b, p in files.items() if int(b) not in touched or f"in_bucket={b}" in there}
        commit(self.spark, self.folder, number + 1, {"buckets": self.buckets, "files": files, "token": content.get("token") if token is None else token})

    def upsert(self, rows: DataFrame, order: Column, token: int | None = None, combine: Combine | None = None) -> bool:
        """Put ``rows`` into the store; False if their ``token`` is not above that of the last write, which had them.

        Of several rows of a key the one with the largest ``order`` counts.
        They replace the rows of their keys, or become what ``combine`` makes
        of (rows of the buckets touched, new rows): one row for each key of
        either.  Rows without a key are left out.  Other buckets are not read.
        """
        seen = latest(self.spark, self.folder)
        if token is not None and seen[1].get("token") is not None and token <= seen[1]["token"]:
            return False
        names = [c for c in rows.columns if c != self.key]
        new = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*names), order).alias("row")).select(self.key, "row.*")
        new = written(new, "upsert")
        # at most a number for each bucket
        touched = sorted(r.b for r in new.select(self._bucket().alias("b")).distinct().collect())
        files = self._files_of(seen)
        old = self._table([files[b] for b in touched if b in files])
        if combine is None:
            combine = lambda old, new: old.join(new, self.key, "left_anti").unionByName(new.select(*self.schema.names))
        self._replace(seen, touched, combine(old, new), token)
        return True

    def remove(self, gone: DataFrame) -> None:
        """Take the keys of ``gone`` out; only their buckets are written anew."""
        seen = latest(self.spark, self.folder)
        gone = written(gone.select(self.key).distinct(), "removed")
        files = self._files_of(seen)
        touched = sorted(r.b for r in gone.select(self._bucket().alias("b")).distinct().collect() if r.b in files)
        if touched:
            self._replace(seen, touched, self._table([files[b] for b in touched]).join(gone, self.key, "left_anti"), None)
