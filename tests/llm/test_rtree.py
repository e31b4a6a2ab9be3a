"""Hard negatives and the R-tree against brute force."""

from collections import defaultdict
from math import floor, isfinite

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from plumbline.llm import rtree

SCHEMA = "vec_id long, embedding array<double>, label int, score string, id int, `a.b` int"


def plain(rows, k=5):
    """{(anchor, positive): negatives} in plain integers; rows are (id, vector, label)."""
    valid = {(i, tuple(floor(256 * x) for x in v), l) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and isfinite(x) for x in v)}
    out = []
    for anchor, a, label in valid:
        if anchor % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a, v)), i, l) for i, v, l in valid if i != anchor and len(v) == len(a)]
        for p, i, _ in sorted(s for s in scored if s[2] == label)[:k]:
            found = sorted(s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p)[:k]
            out += [(anchor, i, rank, n[1], -p, -n[0]) for rank, n in enumerate(found, 1)]
    return sorted(out)


def found(spark, rows, **more):
    table = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in rtree.hard_negatives(table, F.col("vec_id") % 100 == 0, **more).collect())


def groups(size, dim, spread, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(5, dim))
    return [(i, (centres[i % 5] + spread * draw.normal(size=dim)).tolist(), int(draw.integers(0, 3)) if i % 3 else i % 5) for i in range(size)]


@pytest.mark.parametrize("dim, spread", [(1, 1.0), (3, 0.02), (16, 0.3)])
def test_small_shards_and_leaves(spark, monkeypatch, dim, spread):
    for name, value in (("SHARD", 64), ("LEAF", 8), ("FAN", 3), ("BOXES", 4), ("ASKING", 3)):
        monkeypatch.setattr(rtree, name, value)
    rows = groups(900, dim, spread, dim)
    # hundreds of copies with one label, ties between labels, and repeated rows
    rows += [(2_000 + i, rows[0][1], 1) for i in range(300)] + [(3_000 + i, rows[5][1], i % 4) for i in range(40)] + rows[:30]
    assert found(spark, rows) == plain(rows)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [0.9, 0.9], 2), (3, [1.0, 0.9], 3), (4, [0.95, 0.9], 0), (5, [1.0, None], 2), (6, [nan, 1.0], 2), (7, [inf, 1.0], 2),
        (8, None, 2), (9, [1.0, 0.9], None), (None, [1.0, 0.9], 2), (10, [1.0], 2), (100, [1.0], 3), (200, [], 1), (201, [], 1), (202, [], 2), (300, [-1.0, -1.0], 1),
        (400, [0.0, 0.0], 4), (401, [0.5, 0.0], 4), (1, [0.2, 0.2], 2), (0, [1.0, 1.0], 2), (500, None, 1),
    ]
    got = found(spark, rows)
    assert got == plain(rows)
    assert {r[0] for r in got} >= {0, 200, 400} and all(r[0] != r[3] for r in got)
    assert found(spark, [*rows, (11, [1e9, 1.0], 2), (12, [1e300, 0.0], 1)]) == got
    assert found(spark, rows[:1]) == [] == found(spark, [(i, v, 7) for i, v, _ in rows[:4]]) == found(spark, [(8, None, 2)])


def test_scores_beyond_double(spark):
    rows = [(i, [90_000.0 + i / 256, 80_000.0 - i, float(i % 5)], i % 3) for i in range(0, 120)]
    assert found(spark, rows) == plain(rows) != []


def test_negative_scores(spark):
    """Windows of a negative positive are empty, unless one bound is all they are."""
    rows = [(0, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 2), (3, [-0.9], 2)]
    assert found(spark, rows) == []
    assert found(spark, rows, low=100) == [(0, 1, 1, 2, -256 * 256, -256 * 256)]


@settings(max_examples=80, deadline=None)
@given(seed=st.integers(0, 10_000), dim=st.integers(1, 5), size=st.integers(1, 120), k=st.integers(1, 4), reach=st.integers(0, 60))
def test_best_first_search(seed, dim, size, k, reach):
    draw = np.random.default_rng(seed)
    points, asking = draw.integers(-9, 9, (size, dim)), draw.integers(-9, 9, dim)
    rtree.LEAF, rtree.FAN, kept = 4, 2, (rtree.LEAF, rtree.FAN)
    try:
        order = rtree.tiles(points, rtree.LEAF, list(range(min(dim, 3))))
        assert sorted(order.tolist()) == list(range(size))
        tree, windows = rtree.Tree(order, points[order]), [(-(2**62), 2**62), (reach - 30, reach), (reach, reach + 5)]
        got = tree.search(0, asking, windows, k)
    finally:
        rtree.LEAF, rtree.FAN = kept
    scores = points @ asking
    for (low, high), hits in zip(windows, got):
        assert hits == sorted((-int(s), i) for i, s in enumerate(scores) if low <= s <= high and i != 0)[:k]


@settings(max_examples=80, deadline=None)
@given(seed=st.integers(0, 10_000), dim=st.integers(1, 4))
def test_intervals_hold_all_scores(seed, dim):
    draw = np.random.default_rng(seed)
    points, asking = draw.integers(-9, 9, (30, dim)), draw.integers(-9, 9, (4, dim))
    low, high = rtree.boxes(points, 7)
    least, most = rtree.intervals(asking, low, high)
    inside = defaultdict(list)
    for i, s in enumerate((points @ asking.T).tolist()):
        inside[i // 7].append(s)
    for b, own in inside.items():
        assert (np.min(own, 0) >= least[:, b]).all() and (np.max(own, 0) <= most[:, b]).all()
