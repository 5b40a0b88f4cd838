"""Session helpers that the operators of this subpackage share.

Intermediate tables are written as Parquet below the folder named by
``spark.checkpoint.dir``, which driver and executors share.  Only a local
master may leave the setting out; a folder is then chosen here.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest table, in bytes of its rows in memory, that a join may broadcast; above it the join shuffles.
BROADCAST_BYTES = 32 << 20

#: Rows of one Arrow batch while a table is written: batches of long texts are copied several times outside the heap.
ARROW_ROWS = 1000
_ARROW_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Bytes of the rows of each table made by :func:`materialize`, by the name of its folder.
_row_bytes: dict[str, int] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from the session's own setting."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomery-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/loomery/{label}-{uuid.uuid4().hex}"


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes of one value in memory, about."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return 8 + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, T.ArrayType):
        inner = sum(8 for _ in kind.elementType.fields) + 16 if isinstance(kind.elementType, T.StructType) else 8
        return 24 + inner * F.coalesce(F.size(value), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a durable cut of the lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    seen = Observation()
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(24))
    usual = spark.conf.get(_ARROW_ROWS_KEY)
    spark.conf.set(_ARROW_ROWS_KEY, str(min(int(usual), ARROW_ROWS) if int(usual) > 0 else ARROW_ROWS))
    try:
        df.observe(seen, F.sum(width.cast("long")).alias("bytes")).write.parquet(path)
    finally:
        spark.conf.set(_ARROW_ROWS_KEY, usual)
    _row_bytes[path.rsplit("/", 1)[1]] = seen.get["bytes"] or 0
    return spark.read.schema(df.schema).parquet(path)


def _folders(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_materialized(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`materialize` that nothing reads any more."""
    for df in tables:
        for folder in _folders(df):
            if "/loomery/" in folder:
                delete_folder(df.sparkSession, folder)
                _row_bytes.pop(folder.rsplit("/", 1)[1], None)


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, of tables made by :func:`materialize`, with a broadcast hint if the rows of these are within ``limit`` bytes."""
    return F.broadcast(df) if sum(_row_bytes[f.rsplit("/", 1)[1]] for f in _folders(df)) <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
