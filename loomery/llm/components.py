"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_materialized, materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (u, v): the label is the least node it can reach.

    Large-star and small-star steps in turn, until a turn changes nothing;
    each turn is written out.  The number of turns grows with the logarithm
    of the longest path.  Hubs are met by joins that Spark can split.
    Links with a null end or from a node to itself are left out.
    """
    edges = materialize(links.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u <> v").distinct().select("u", "v"), "links")
    last = None
    while True:
        # every neighbour above u is tied to the least of u and its neighbours
        both = _both_ways(edges)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # u and every neighbour below it are tied to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        step = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = step.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        drop_materialized(edges)
        edges = step
        if tuple(now) == last:
            break
        last = tuple(now)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
