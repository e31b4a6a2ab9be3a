"""Attributions and importances of large tables take the same rows as those of small ones."""

import random

from plumbline.operators import explain


def test_repeats_alone_find_what_repeats_together_find(spark):
    draw = random.Random(3)
    rows = [(i, i % 3, draw.gauss(0, 1), draw.gauss(0, 2), draw.gauss(0, 1)) for i in range(500)]
    data = spark.createDataFrame([(*r, 3 * r[2] - r[3] + 0.1 * r[4]) for r in rows], "id long, part int, a double, b double, c double, y double").repartition(3)
    predict = explain.linear_predictor(0.0, {"a": 3.0, "b": -1.0, "c": 0.1})
    found = [
        {r.feature: (round(r.importance, 9), round(r.std, 9), r["rank"]) for r in explain.permutation_importance(data, predict, ["a", "b", "c"], "y", ["id", "part"], False, 4, task_rows=n).collect()}
        for n in (1000, 50)
    ]
    assert found[0] == found[1] and len(found[0]) == 3
