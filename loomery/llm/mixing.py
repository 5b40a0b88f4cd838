"""Mixing sources to target weights by temperature, and laying the mix out in blocks.

Source shares p are raised to an exponent a in [0, 1] and normalised; a = 1
keeps the natural mix, a = 0 makes all sources equal.  The exponent is found
by bisection.  Each source is then read in whole permutations of its
documents, the last one cut at the source's budget, and the streams of all
sources advance together through blocks, each permuted in itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Bisection steps in all, and those that one pass over the source table settles.
STEPS, STEPS_A_PASS = 40, 5
#: Rows of one source and epoch that are summed up in order by one task, at most about.
BUCKET_ROWS = 1024


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key without nulls: rows of no source are one source of their own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def solve_exponent(sources: DataFrame, entropy: float, max_repetition: float, budget: float | None) -> float:
    """The least exponent at which the mix has at most the target entropy and keeps the repetition limit.

    ``sources`` has a ``tokens`` column.  ``entropy`` is a share of ln(number
    of sources).  If even a = 1 is above the entropy target it is taken.
    Without ``budget`` the mix is as long as it takes to use every document
    once.  The table is read once for every five halvings, so the number of
    sources is not bounded by the driver.
    """
    total, n = sources.agg(F.sum("tokens"), F.count("*")).first()
    if budget is not None and budget > max_repetition * total:
        raise ValueError("the budget cannot be met within the repetition limit")
    target = entropy * math.log(n) if n > 1 else 0.0
    share = sources.select((F.col("tokens") / F.lit(float(total))).alias("p"))

    def met(points: list[float]) -> dict[float, bool]:
        grid = share.select("p", F.explode(F.array(*map(F.lit, points))).alias("a"))
        power = F.pow("p", F.col("a"))
        rows = grid.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.ln("p")).alias("y"), F.max(power / F.col("p")).alias("most"), F.min(power / F.col("p")).alias("least")).collect()
        out = {}
        for r in rows:
            h = math.log(r.z) - r.a * r.y / r.z
            repeats = r.most / r.least if budget is None else budget / total * r.most / r.z
            out[r.a] = h <= target and repeats <= max_repetition
        return out

    lo, hi = 0.0, 1.0
    if met([0.0])[0.0]:
        return 0.0
    for _ in range(STEPS // STEPS_A_PASS):
        cells = 1 << STEPS_A_PASS
        points = [lo + (hi - lo) * k / cells for k in range(1, cells)]
        known = met(points)
        for _ in range(STEPS_A_PASS):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if known[mid] else (mid, hi)
    return hi


def mix_weights(docs: DataFrame, entropy: float = 0.9, max_repetition: float = 4.0, budget: int | None = None) -> DataFrame:
    """One row per source: key, tokens, weight and quota (its tokens in the mix).

    ``docs`` has ``source`` and ``n_tokens``.  A source without any token has
    no share and is left out.
    """
    sources = docs.groupBy(source_key(F.col("source")).alias("sid")).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    sources = materialize(sources, "sources")
    if sources.isEmpty():
        return sources.select("sid", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"))
    a = solve_exponent(sources, entropy, max_repetition, budget)
    total = float(sources.agg(F.sum("tokens")).first()[0])
    power = F.pow(F.col("tokens") / F.lit(total), F.lit(a))
    z, least = sources.agg(F.sum(power), F.min(power / F.col("tokens"))).first()
    whole = z / least if budget is None else float(budget)
    weight = power / F.lit(z)
    # a part in 10**9 is added so that rounding does not take the last document of a source
    return sources.select("sid", "tokens", weight.alias("weight"), F.floor(weight * F.lit(whole) * F.lit(1 + 1e-9)).cast("long").alias("quota"))


def hex_key(seed: str, name: Column | None = None) -> Column:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")) if name is None else name
    return F.md5(F.concat_ws(":", name, F.col("epoch").cast("string"), F.lit(seed)).cast("binary"))


def row_name(docs: DataFrame) -> Column:
    """The doc_id, or for a row without one a hash of its other columns, so that such rows do not share a place."""
    rest = [c.name for c in docs.schema.fields if not isinstance(c.dataType, T.MapType | T.VariantType)]
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.xxhash64(*rest).cast("string")))


def mix(docs: DataFrame, entropy: float = 0.9, max_repetition: float = 4.0, budget: int | None = None, block_tokens: int = 1 << 20, seed: str = "0") -> DataFrame:
    """``docs`` (doc_id, source, n_tokens and any others) as a mix: adds epoch and block.

    Epoch e of a source is its e-th permutation by hash; a document is in the
    last, cut epoch if it ends within the quota.  ``block`` says which of the
    mix's blocks of about ``block_tokens`` a row falls in; every block holds
    each source in proportion to its weight.  Empty documents count no
    tokens and travel with their source; a source of only empty documents
    has no weight and is left out; a null source is a source; rows that are
    equal in all columns are placed each on its own; columns of ``docs`` named
    epoch or block are replaced; an empty table gives an empty result.
    """
    weights = mix_weights(docs, entropy, max_repetition, budget)
    quota_sum, rows = weights.agg(F.sum("quota")).first()[0] or 0, docs.count()
    blocks = max(1, -(-quota_sum // block_tokens))
    digits = max(0, math.ceil(math.log(max(rows, 1) / BUCKET_ROWS, 16)))
    whole, rest = F.floor(F.col("quota") / F.col("tokens")), F.col("quota") % F.col("tokens")

    def spread(rows: DataFrame) -> DataFrame:
        """A row for each epoch that its source reaches into, with its place in the permutation."""
        rows = rows.withColumn("sid", source_key(F.col("source"))).join(weights.select("sid", "tokens", "quota"), "sid")
        rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), whole))).withColumn("key", hex_key(seed, F.col("name")))
        return rows.withColumn("bucket", F.substring("key", 1, digits))

    place = ["sid", "epoch", "bucket"]
    sums = spread(docs.select(row_name(docs).alias("name"), "source", "n_tokens")).groupBy(*place).agg(F.sum("n_tokens").alias("own"))
    before = F.sum("own").over(W.partitionBy("sid", "epoch").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*place, F.coalesce(before, F.lit(0)).alias("before"))
    upto = F.sum("n_tokens").over(W.partitionBy(*place).orderBy("key", "n_tokens").rowsBetween(W.unboundedPreceding, 0))
    own = spread(docs.select(F.struct(*docs.columns).alias("row"), row_name(docs).alias("name"), "source", "n_tokens"))
    placed = own.withColumn("upto", upto).join(sums, place).withColumn("upto", F.col("upto") + F.col("before"))
    placed = placed.where((F.col("epoch") < whole) | (F.col("upto") <= rest))
    at = F.col("epoch") * F.col("tokens") + F.col("upto") - F.col("n_tokens")
    block = F.least(F.floor(at.cast("double") * F.lit(float(blocks)) / F.col("quota").cast("double")), F.lit(blocks - 1)).cast("long")
    placed = placed.select("row", "epoch", block.alias("block"))
    return placed.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in ("epoch", "block")), "epoch", "block")


def with_positions(mixed: DataFrame, seed: str = "0") -> DataFrame:
    """Add ``position``, a permutation of each block; blocks have bounded size."""
    order = W.partitionBy("block").orderBy(hex_key(seed + ":block"), "n_tokens")
    return mixed.withColumn("position", F.row_number().over(order).cast("long"))


def in_order(mixed: DataFrame, seed: str = "0") -> DataFrame:
    """``mixed`` by block and, in each block, by :func:`with_positions`' order: written, its files follow each other so."""
    order = [F.col("block"), hex_key(seed + ":block"), F.col("n_tokens")]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)
