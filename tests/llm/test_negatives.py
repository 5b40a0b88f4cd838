import math
import random

import numpy as np
import pytest
from loomery.llm import negatives


def brute(rows, step, low=80, high=100):
    good = [(i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i in sorted({i for i, _, _ in good if i % step == 0}):
        label, v = min((l, v) for j, l, v in good if j == i)
        peers = [(j, l, dot(v, w)) for j, l, w in good if len(w) == len(v)]
        best = sorted((-s, j) for j, l, s in peers if l == label and j != i)[:5]
        for s, j in best:
            rest = sorted((-t, k) for k, l, t in peers if l != label and low * -s <= 100 * t <= high * -s)[:5]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(rest, 1)]
    return sorted(out)


def vectors(n, dim, spread, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = rng.randrange(4)
        rows.append((i, [rng.gauss(0.2 if d == label else 0.0, spread) for d in range(dim)], label))
    rows += [(n + i, rows[3][1], rows[3][2]) for i in range(8)] + [(n + 10 + i, rows[3][1], (rows[3][2] + 1) % 4) for i in range(8)]
    rows += [rows[20], rows[20], (10, rows[11][1], 3), (None, rows[2][1], 1), (n + 30, None, 1), (n + 31, rows[2][1], None), (n + 32, [], 1), (n + 33, [1.0, float("nan")], 1), (n + 34, [1.0, None], 1), (n + 35, [float("inf"), 1.0], 0)]
    rows += [(n + 40 + i, [0.3 * i, -0.2], i % 2) for i in range(6)] + [(1000, [0.0] * dim, 1), (1010, [0.0] * dim, 2)]
    return rows


@pytest.mark.parametrize("block_rows", [50, 8192])
@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_negatives_match_brute_force(spark, block_rows, spread):
    rows = vectors(230, 9, spread, 4)
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, tops int").repartition(3)
    part = negatives.scaled(table)
    got = negatives.hard_negatives(part, part.where("id % 10 = 0"), block_rows=block_rows)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10)
    assert len(brute(rows, 10)) > 100


def test_bounds_hold_every_score():
    rng = np.random.default_rng(3)
    v = rng.integers(-4000, 4000, (500, 7))
    block = negatives.Approximations(np.arange(500), rng.integers(0, 5, 500), v)
    q = rng.integers(-300, 300, 7)
    low, high = block.bounds(q, 0, 500)
    score = block.vectors @ q
    assert (low <= score).all() and (score <= high).all() and (high - low).mean() < 0.05 * (score.max() - score.min())


def test_empty_and_lonely_rows(spark):
    kind = "id long, label long, v array<long>"
    none = spark.createDataFrame([], kind)
    one = spark.createDataFrame([(1, 1, [5])], kind)
    assert negatives.hard_negatives(none, none).count() == 0
    assert negatives.hard_negatives(one, one).count() == 0
    assert negatives.hard_negatives(one, none).count() == 0
