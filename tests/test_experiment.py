"""An experiment ends with an explanation of its winner."""

import random

from pyspark.sql import functions as F

from plumbline.operators import train


def rows(n=300):
    draw = random.Random(5)
    out = []
    for i in range(n):
        a, b, c = draw.gauss(0, 1), draw.gauss(0, 1), draw.gauss(0, 1)
        out.append((i, a, b, c, 5 * a - 2 * b + 0.01 * c, 7.0 if 3 * a - b > 0 else 3.0))
    return out


SCHEMA = "id long, a double, b double, c double, y double, kind double"


def test_the_winner_is_explained(spark):
    data = spark.createDataFrame(rows(), SCHEMA)
    found = train.run_experiment(data, "y", ["a", "b", "c"], ["id"], models=["ridge"], method="none", k=2, explained=True)
    assert found.best == "ridge" and found.data.is_cached
    report = found.explanation
    assert {"permutation", "coefficients", "shapley", "local", "consensus", "partial_dependence"} <= set(report)
    assert [r.feature for r in report["consensus"].orderBy("consensus_rank").collect()] == ["a", "b", "c"]
    assert {r.feature: round(r.coefficient) for r in report["coefficients"].collect()} == {"a": 5, "b": -2, "c": 0}
    assert report["partial_dependence"].select("feature").distinct().count() == 3
    found.release()
    assert not found.data.is_cached


def test_a_winning_classifier_is_explained(spark):
    data = spark.createDataFrame(rows(), SCHEMA)
    found = train.run_experiment(data, "kind", ["a", "b", "c"], ["id"], models=["logistic"], method="none", k=2)
    report = train.explain_best(found, ["id"], repeats=2, top=1)
    assert found.labels == [3.0, 7.0] and report["consensus"].orderBy("consensus_rank").first().feature == "a"
    assert report["partial_dependence"].select("feature").distinct().count() == 1
    assert report["permutation"].where(F.col("feature") == "a").count() == 1
    found.release()
