"""Jaccard self-join of word shingles with adaptive multi-match prefixes.

Shingles are ordered by hash.  Two sets that reach the threshold share at
least l shingles of their l-prefixes, which are l - 1 longer than the usual
prefix.  All documents start with l = 1.  A shingle of more than ``HOT``
documents is hot: it costs too many candidates and makes none.

* A document whose prefix holds no hot shingle keeps l = 1; of what it shares
  with any partner nothing is hot.
* A document with k hot shingles in its prefix is crowded; its prefix is
  lengthened by 2 k, and l with it.  If h < l shingles of the longer prefix
  are hot it is settled: a crowded partner with l or more shares at least
  l - h shingles with it that are not hot, and only pairs with as many are
  verified.
* The few crowded documents that are mostly hot take part with their whole
  sets.  Among themselves their shingles are ordered anew, rare ones first,
  each takes the l with the least estimated candidates, and the places of a
  shared shingle must allow for the overlap that the two sizes ask for: a
  copy with too many changes of its own meets nobody.  So must bitmaps of
  what each set shares: two copies that differ from one text in different
  places have too many bits that the other has not.

Documents of equal sets are one node.  First every node is verified against
the node it shares most prefix shingles with, among the least and the largest
of each shingle's nodes; what this links needs no more verification among
itself, so a large group of near copies takes about as many comparisons as it
has members.  All remaining candidates are pairs of different components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared
from .components import connected_components
from .kernels import shingle_sets
from .shared import drop_materialized, materialize

#: Largest side of a join that is broadcast here: the operator has over a dozen such joins, which together must fit a small driver.
SIDE_BYTES = 8 << 20

#: Documents above which a shingle is hot, and shingles under which a crowded set is taken whole.
HOT, FEW = 24, 16

#: Meetings of a token that the verification of one candidate is worth.
VERIFY = 8
#: Largest l - 1 of a set whose tokens are ordered by their documents.
MORE = 4
#: Bitmaps, of 64 bits each, of the tokens that such a set shares with others.
MAPS = ("m0", "m1", "m2", "m3")


def small_side(df: DataFrame) -> DataFrame:
    return shared.small_side(df, SIDE_BYTES)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Of n shingles, how many to take so that similar sets share one."""
    return n - -(-percent * n // 100) + 1


def index_length(n: np.ndarray, percent: int) -> np.ndarray:
    """The same for the smaller set of a pair."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def set_sizes(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, f1, f2): the number of shingles and a 128-bit hash of the set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, sets, bounds in shingle_sets(batch.column("text"), words):
                data = memoryview(sets.view(np.uint8))
                marks = [xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                pairs = np.frombuffer(b"".join(marks), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(marks)), pa.array(np.diff(bounds)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["doc_id", "n", "f1", "f2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long")


def most_extra(n, percent: int, whole: bool):
    """The largest l - 1 of a set of n: half of it, or what makes its prefix the whole set."""
    return -(-percent * n // 100) - 1 if whole else n // 2


def prefix_rows(docs: DataFrame, words: int, percent: int, whole: bool = False) -> DataFrame:
    """(token, node, small) of the prefixes of ``docs`` (doc_id, text, extra).

    ``extra`` is l - 1, cut to :func:`most_extra`; ``small`` marks shingles
    in the prefix that the smaller set of a pair needs.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, more = batch.column("doc_id").to_numpy(), batch.column("extra").to_numpy()
            for first, sets, bounds in shingle_sets(batch.column("text"), words):
                n = np.diff(bounds)
                extra = np.maximum(np.minimum(more[first : first + len(n)], most_extra(n, percent, whole)), 0)
                take = np.where(n > 0, np.minimum(n, prefix_length(n, percent) + extra), 0)
                row = np.repeat(np.arange(len(n)), take)
                place = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
                token = sets[bounds[:-1][row] + place].view(np.int64)
                small = place < (index_length(n, percent) + extra)[row]
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(ids[first + row]), pa.array(small)], names=["token", "node", "small"])

    return docs.select("doc_id", "text", "extra").mapInArrow(run, "token long, node long, small boolean")


def shared_tokens(rows: DataFrame) -> DataFrame:
    """``rows``, a table that is read twice, of tokens of two nodes or more, with their number and the least and largest node.

    Tokens are counted by partial aggregation, so one that a third of all
    documents hold sends one row from each task, and are then joined back;
    its rows are those of a skewed join, which Spark splits.
    """
    counted = rows.groupBy("token").agg(F.count("*").alias("df"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    return rows.join(counted, "token")


def verify(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose texts reach the threshold; ``pairs`` is a written table."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    left = text.join(small_side(pairs.select(F.col("v").alias("doc_id"), "u")), "doc_id")
    left = left.select("u", F.col("doc_id").alias("v"), F.col("text").alias("text_v"))
    hubs = materialize(pairs.select(F.col("u").alias("doc_id")).distinct(), "hubs")
    right = text.join(small_side(hubs), "doc_id").select(F.col("doc_id").alias("u"), F.col("text").alias("text_u"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[str, np.ndarray] = ("", np.zeros(0, dtype=np.uint64))
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for first, sets, bounds in shingle_sets(batch.column("text_v"), words):
                for i in range(len(bounds) - 1):
                    hub = batch.column("text_u")[first + i].as_py()
                    if kept[0] != hub:
                        kept = (hub, next(shingle_sets(pa.array([hub]), words))[1])
                    a, b = kept[1], sets[bounds[i] : bounds[i + 1]]
                    if len(a) and len(b):
                        at = np.searchsorted(a, b)
                        common = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                        good[first + i] = 100 * common >= percent * (len(a) + len(b) - common)
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("u", "v")], names=["u", "v"])

    both = left.join(right, "u").select("u", "v", "text_u", "text_v")
    return both.mapInArrow(run, "u long, v long")


def leaders(groups: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(u, v): for each node v the two nodes it shares most tokens with, of the least and of the largest ones.

    Only those that share four tenths of v's prefix or more: this is a quick
    first look, and what it misses is among the candidates.
    """
    n = F.col("n")
    prefix = n - F.ceil(n * percent / F.lit(100)) + 1
    votes = None
    for end in ("lo", "hi"):
        count = groups.where(F.col(end) != F.col("node")).groupBy("node", end).agg(F.count("*").alias("c"))
        best = count.groupBy("node").agg(F.max(F.struct("c", end)).alias("best")).select("node", F.col(f"best.{end}").alias("other"), "best.c")
        votes = best if votes is None else votes.unionByName(best)
    good = votes.join(sizes, "node").where(10 * F.col("c") >= 4 * prefix)
    return good.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()


def rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """(token, node, place, l, shared, MAPS): prefixes of whole ``sets`` (token, node, n), rare tokens first.

    The tokens of an l-prefix meet sum(df - 1) others, and a candidate shares
    l of them, so there are at most sum(df - 1) / l candidates, each worth
    VERIFY such meetings.  Each set takes the l with the least cost of both
    (the smaller l of equal ones): a set whose tokens are rare keeps l = 1,
    and the more hot tokens its usual prefix holds, the longer it gets and
    the more of it a partner must share; past 1 + MORE the tokens added are
    the hottest of the set.  Tokens of one set only keep their place but make
    no row.  ``shared`` counts the others, the bitmaps say where their hashes
    lie: a bit that one set has and another has not is a token not in common.
    """
    counted = sets.join(sets.groupBy("token").agg(F.count("*").alias("df")), "token")
    order = W.partitionBy("node").orderBy("df", "token")
    placed = counted.withColumns({"place": F.row_number().over(order) - 1, "cost": F.sum(F.col("df") - 1).over(order.rowsBetween(W.unboundedPreceding, 0))})
    share = F.ceil(F.col("n") * percent / F.lit(100))
    usual = F.col("n") - share + 1
    l_here = F.col("place") - usual + 2
    estimate = F.when((l_here >= 1) & (l_here <= F.least(share, F.lit(1 + MORE))), F.struct((F.col("cost") * (1 + VERIFY / l_here)).alias("cost"), l_here.alias("l")))
    best = F.min(estimate).over(W.partitionBy("node"))["l"]
    both = F.col("df") > 1
    spot = F.pmod(F.xxhash64("token"), F.lit(64 * len(MAPS))).cast("int")
    bit = lambda j: F.when(both & (F.floor(spot / 64) == j), F.expr("shiftleft(1L, spot % 64)"))
    own = W.partitionBy("node")
    near = placed.withColumn("spot", spot).withColumns({"l": best.cast("long"), "shared": F.count_if(both).over(own)} | {m: F.coalesce(F.bit_or(bit(j)).over(own), F.lit(0).cast("long")) for j, m in enumerate(MAPS)})
    return near.where(both & (F.col("place") < usual + F.col("l") - 1)).select("token", "node", "place", "l", "shared", *MAPS)


def in_common(a: dict, b: dict) -> Column:
    """At most so many tokens of ``a`` are in ``b``: those that it shares, less the bits that ``b`` has not."""
    out = a["shared"]
    for m in MAPS:
        out = out - F.bit_count(a[m].bitwiseAND(F.bitwise_not(b[m])))
    return out


def special_candidates(plain: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(u, v) of a settled and a mostly hot node: ``plain`` (token, node, small, n, need) and ``sets`` (token, node, n).

    ``plain`` has all tokens of settled prefixes that are not hot and in any of
    ``sets``; at most HOT settled nodes share one.
    """
    label = lambda x: labels.select(F.col("node").alias(f"node_{x}"), F.col("label").alias(f"label_{x}"))
    a = plain.select("token", "small", "need", F.col("node").alias("node_a"), F.col("n").alias("n_a")).join(label("a"), "node_a", "left")
    b = sets.select("token", F.col("node").alias("node_b"), F.col("n").alias("n_b")).join(label("b"), "node_b", "left")
    fits = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a")) & (F.col("small") | (F.col("n_a") >= F.col("n_b")))
    apart = F.coalesce("label_a", "node_a") != F.coalesce("label_b", "node_b")
    found = a.join(b, "token").where(fits & apart).groupBy("node_a", "node_b").agg(F.count("*").alias("c"), F.max("need").alias("need"))
    return found.where("c >= need").select(F.least("node_a", "node_b").alias("u"), F.greatest("node_a", "node_b").alias("v"))


def cross_candidates(rows: DataFrame, labels: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(u, v) of nodes of different components that share enough prefix tokens and could reach the threshold.

    ``rows`` is (part, token, node, small, special, l, h, place, shared,
    MAPS): part 0 for prefixes of l = 1, where crowded nodes are special and
    do not meet each other; part 1 for settled crowded nodes; part 2 for
    mostly hot nodes with rare tokens first, which alone have bitmaps.
    """
    # the rows are read three times: written once, they are not put together anew for each
    rows = materialize(rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(sizes, "node"), "candidate-rows")
    key = ["part", "token"]
    counts = rows.groupBy(*key, "label").agg(F.count("*").alias("c"))
    mixed = counts.groupBy(*key).agg(F.count("*").alias("labels"), F.max(F.struct("c", "label")).alias("most")).where("labels > 1").select(*key, F.col("most.label").alias("major"))
    rows = rows.join(small_side(materialize(mixed, "mixed-tokens")), key)
    # of each token's nodes, those outside its largest component meet all others
    names = ("node", "label", "small", "special", "l", "h", "place", "n", "shared", *MAPS)
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in names]
    pairs = rows.where("label <> major").select(*key, *side("a")).join(rows.select(*key, "major", *side("b")), key)
    a, b = ({c: F.col(f"{c}_{x}") for c in names} for x in "ab")
    once = (b["label"] == F.col("major")) | (a["node"] < b["node"])
    fits = (100 * a["n"] >= percent * b["n"]) & (100 * b["n"] >= percent * a["n"])
    small = F.when(a["n"] < b["n"], a["small"]).when(b["n"] < a["n"], b["small"]).otherwise(a["small"] | b["small"])
    plain_a, plain_b = a["l"] - a["h"], b["l"] - b["h"]
    settled = F.when(a["l"] < b["l"], plain_a).when(b["l"] < a["l"], plain_b).otherwise(F.greatest(plain_a, plain_b))
    # t tokens in common: the l-th of them has t - l after it in either order; of fewer than l all are in the prefix
    t = F.ceil(percent * (a["n"] + b["n"]) / F.lit(100 + percent))
    need = F.when(F.col("part") == 0, 1).when(F.col("part") == 1, settled).otherwise(F.least(a["l"], b["l"], t))
    within = (a["place"] <= a["n"] - t + need - 1) & (b["place"] <= b["n"] - t + need - 1)
    room = (in_common(a, b) >= t) & (in_common(b, a) >= t)
    meets = F.when(F.col("part") == 0, ~(a["special"] & b["special"])).when(F.col("part") == 2, within & room).otherwise(True)
    found = pairs.where((a["label"] != b["label"]) & once & fits & small & meets)
    found = found.groupBy("part", F.least(a["node"], b["node"]).alias("u"), F.greatest(a["node"], b["node"]).alias("v")).agg(F.count("*").alias("c"), F.max(need).alias("need"))
    return found.where("c >= need").select("u", "v")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Two documents are linked if their sets of ``words``-word shingles have
    at least ``percent`` hundredths of their union in common; a component's
    id is its least doc_id.  A text with fewer words is one shingle; one
    without words, or null, has none and is linked with nothing.  Repeated
    rows and equal texts are one node; rows that share a doc_id are one
    document.  A row with a null doc_id gets the component of an equal set,
    else null.  Other columns are left out; an empty table gives an empty
    result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    facts = materialize(set_sizes(docs, words), "set-sizes")
    mark = ["f1", "f2", "n"]
    copies = materialize(facts.where("n > 0").groupBy(*mark).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "copies")
    members = materialize(facts.join(small_side(copies), mark, "left").select("doc_id", "n", F.coalesce("first", "doc_id").alias("node")), "members")
    others = materialize(members.where("doc_id <> node").select("doc_id").distinct(), "copied")
    twice = materialize(members.where("doc_id = node").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    texts = docs.where(F.col("doc_id").isNotNull()).join(small_side(others), "doc_id", "left_anti")
    if not twice.isEmpty():
        again = texts.join(small_side(twice), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        texts = texts.join(small_side(twice), "doc_id", "left_anti").unionByName(again)
    sizes = materialize(members.where("doc_id = node").groupBy("node").agg(F.max("n").alias("n")), "sizes")

    every = materialize(prefix_rows(texts.withColumn("extra", F.lit(0).cast("long")), words, percent), "prefixes")
    first = materialize(shared_tokens(every), "shared-tokens")
    drop_materialized(every)
    crowded = materialize(first.where(F.col("df") > HOT).groupBy("node").agg(F.count("*").alias("k")), "crowded")

    tried = materialize(leaders(first, sizes, percent), "leaders")
    links = materialize(verify(texts, tried, words, percent), "first-links")
    labels = materialize(connected_components(links), "first-labels")

    shape = ["part", "token", "node", "small", "special", "l", "h", "place", "shared", *MAPS]
    no = F.lit(0).cast("long")
    blank = {"place": no, "shared": no} | dict.fromkeys(MAPS, no)
    one = {"part": F.lit(0), "special": F.col("k").isNotNull(), "l": F.lit(1).cast("long"), "h": no} | blank
    rows = first.where(F.col("df") <= HOT).join(small_side(crowded), "node", "left").withColumns(one).select(*shape)
    if not crowded.isEmpty():
        named = texts.withColumnRenamed("doc_id", "node")
        longer = lambda state: named.join(small_side(state), "node").withColumnRenamed("node", "doc_id")
        every = materialize(prefix_rows(longer(crowded.select("node", (2 * F.col("k")).alias("extra"))), words, percent), "longer-prefixes")
        second = materialize(shared_tokens(every), "longer-tokens")
        drop_materialized(every)
        hot = second.where(F.col("df") > HOT).groupBy("node").agg(F.count("*").alias("h"))
        state = crowded.join(sizes, "node").join(hot, "node", "left").select("node", "n", (1 + F.least(2 * F.col("k"), F.floor(F.col("n") / 2))).alias("l"), F.coalesce("h", F.lit(0).cast("long")).alias("h"))
        state = materialize(state.withColumn("special", (F.col("h") >= F.col("l")) | (F.col("n") < FEW)), "settled")
        whole = materialize(state.where("special").select("node", F.col("n").alias("extra")), "whole")
        plain = second.where(F.col("df") <= HOT).join(small_side(state), "node").where("not special")
        rows = rows.unionByName(plain.withColumns({"part": F.lit(1)} | blank).select(*shape))
        sets = materialize(prefix_rows(longer(whole), words, percent, whole=True).join(small_side(whole), "node").select("token", "node", F.col("extra").alias("n")), "whole-sets")
        rare = rare_first(sets, percent).withColumns({"part": F.lit(2), "small": F.lit(True), "special": F.lit(True), "h": no, "place": F.col("place").cast("long")})
        rows = rows.unionByName(rare.select(*shape))
    found = materialize(cross_candidates(rows, labels, sizes, percent), "cross-candidates")
    if not crowded.isEmpty():
        # of the settled prefixes also what no other prefix holds: a whole set may have it past its own prefix
        wanted = materialize(sets.select("token").distinct(), "whole-tokens")
        hot_tokens = materialize(second.where(F.col("df") > HOT).select("token").distinct(), "hot-tokens")
        settled = materialize(state.where("not special").join(crowded, "node").select("node", "n", (F.col("l") - F.col("h")).alias("need"), (2 * F.col("k")).alias("extra")), "settled-nodes")
        inside = prefix_rows(longer(settled.select("node", "extra")), words, percent).join(small_side(wanted), "token", "left_semi").join(small_side(hot_tokens), "token", "left_anti")
        found = found.unionByName(special_candidates(inside.join(small_side(settled.drop("extra")), "node"), sets, labels, percent))
    rest = found.distinct().join(tried, ["u", "v"], "left_anti")
    more = verify(texts, materialize(rest, "candidates"), words, percent)
    labels = materialize(connected_components(links.unionByName(materialize(more, "more-links"))), "labels")
    out = members.join(labels, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "node").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """One row of each component stays, that of the least doc_id; rows that link to nothing all stay."""
    found = jaccard_components(docs, words, percent)
    gone = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return docs.join(small_side(gone), "doc_id", "left_anti")
