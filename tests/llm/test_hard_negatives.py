"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from findrift.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, id long, score string, block int, codes string, anchor boolean, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, c, 1, "s", 2, "c", None, 3) for i, v, c in rows], SCHEMA)


def brute(rows, is_anchor, n_pos=5, n_neg=10):
    kept = {(i, c, tuple(math.floor(256 * x) for x in v)) for i, v, c in rows
            if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
            and math.hypot(*(256 * x for x in v)) < 1 << 31}
    out = []
    for i, c, x in kept:
        if not is_anchor(i):
            continue
        others = sorted((-sum(a * b for a, b in zip(x, y)), j, d == c) for j, d, y in kept if j != i and len(y) == len(x))
        for s, j, same in [o for o in others if o[2]][:n_pos]:
            inside = [o for o in others if not o[2] and 30 * -s <= 100 * -o[0] <= 90 * -s][:n_neg]
            out += [(i, j, r, k, -s, -t) for r, (t, k, _) in enumerate(inside, 1)]
    return sorted(out)


def awkward(seed, n, dim=12, labels=4):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0.2, 0.3) for _ in range(dim)], r.randrange(labels)) for i in range(n)]
    hot = [0.25] * dim
    rows += [(n + i, hot, i % 2) for i in range(n // 3)]  # one vector under many ids
    rows += [rows[0], rows[0], (5, [0.5] * dim, 1), (100, rows[20][1], 2)]  # repeated rows, one id with several vectors
    rows += [(None, hot, 1), (700, None, 1), (701, hot, None), (702, [None] * dim, 1), (703, [math.nan] * dim, 1), (704, [math.inf] * dim, 1),
             (800, [], 1), (801, [], 1), (802, [], 2), (900, [1.0, 2.0], 1), (901, [1.0, 2.0], 1), (902, [0.5, 1.0], 3),
             (1000, [0.0] * dim, 1), (1001, [1e9] * dim, 1), (1002, [1e300] * dim, 1), (1100, [-0.3] * dim, 1), (1200, [4000.0] * dim, 2)]
    return rows


@pytest.mark.parametrize("shape", [{}, {"row_block": 20, "anchor_block": 3, "run": 2}])
def test_equals_brute_force_for_any_tile_shape(spark, shape):
    rows = awkward(1, 240)
    got = hn.mine(table(spark, rows), F.col("vec_id") % 20 == 0, **shape)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 20 == 0)


def test_no_rows_no_anchors_and_one_label(spark):
    t = table(spark, awkward(2, 30))
    for df in (t.where("false"), t.where("vec_id is null"), t.where("label = 1 and vec_id < 30")):
        assert hn.mine(df, F.col("vec_id") % 5 == 0).count() == 0
    assert hn.mine(t, F.lit(False)).count() == 0


def test_scan_prunes_and_keeps_what_it_must():
    r = np.random.default_rng(3)
    x = r.integers(-100, 100, (400, 32))
    block = hn.Block({"dim": 32, "n": 400, "ids": np.arange(400).tobytes(), "labels": np.zeros(400, np.int64).tobytes(), "width": 2,
                      "codes": np.ascontiguousarray(x.T).astype("<i2").tobytes()})
    a = np.array([10_000, *r.integers(-3, 3, 31)])  # one great component decides
    seen = []
    best = hn.Best(5)
    at, score = hn.scan(a, block, np.ones(400, bool), lambda low, high: seen.append(len(low)) or (high >= hn.kth(low, 5)))
    best.add(block.ids[at], score)
    product = x @ a
    want = sorted(range(400), key=lambda i: (-product[i], i))[:5]
    assert best.ids.tolist() == want and best.scores.tolist() == [product[i] for i in want]
    assert seen[0] == 400 and seen[1] < 60 and (score == product[at]).all()
    assert hn.scan(a, block, np.zeros(400, bool), lambda low, high: high >= low)[0].size == 0


def test_windows_are_exact_at_their_ends():
    for s in range(-50, 200):
        a, z = hn.window(s, 30, 90)
        assert [t for t in range(-300, 300) if 30 * s <= 100 * t <= 90 * s] == list(range(a, z + 1))
