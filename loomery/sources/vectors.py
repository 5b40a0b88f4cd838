"""Points of a vector index: an id, a vector and a payload, in a keyed store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import KeyedStore

#: Characters of a parent text that a payload keeps.
PARENT_CHARS = 10_000


def open_points(spark: SparkSession, folder: str, buckets: int = 64) -> KeyedStore:
    return KeyedStore(spark, folder, "id", "id long, vector array<float>, norm double, payload string", buckets)


def payload(document: Column, doc_id: Column, metadata: dict[str, Column], parent: Column | None = None) -> Column:
    """A JSON object of the text, its id and the metadata that is not null; of a parent text its head, if it has any."""
    fields = [document.alias("document"), doc_id.alias("doc_id"), *(c.alias(name) for name, c in metadata.items())]
    if parent is not None:
        fields.append(F.when(parent != "", F.substring(parent, 1, PARENT_CHARS)).alias("parent_content"))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})


def upsert_points(store: KeyedStore, points: DataFrame, order: Column, token: int | None = None) -> bool:
    """Put (id, vector, payload) into the store; the last by ``order`` of an id replaces what is there."""
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return store.upsert(points.withColumn("norm", F.sqrt(square)), order, token)
