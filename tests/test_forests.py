"""Forests grown from cells against Spark's own forests of the same rows."""

import gc

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from plumbline.operators import forests


def rows(spark, n=3000):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 50, n).astype(float), rng.normal(0, 1, n)
    y = a * 10 + np.sin(3 * b) * 40 + rng.normal(0, 5, n)
    data = spark.createDataFrame([(i, float(p), float(q), float(v), float(v > 250)) for i, (p, q, v) in enumerate(zip(a, b, y))], "id long, a double, b double, label double, kind double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(data).cache()


@pytest.fixture
def cells(monkeypatch):
    monkeypatch.setattr(forests, "LEAST_ROWS", 100)


def test_regression_as_good_as_from_rows(spark, cells):
    data = rows(spark)
    judge = RegressionEvaluator(metricName="r2")
    options = {"numTrees": 30, "maxDepth": 6, "seed": 1, "featureSubsetStrategy": "all"}
    mine, own = forests.ForestRegressor(**options).fit(data), RandomForestRegressor(**options).fit(data)
    assert mine.getNumTrees == 30 and mine.getOrDefault("maxDepth") == 6 and max(t.depth for t in mine.trees) <= 6
    assert judge.evaluate(mine.transform(data)) == pytest.approx(judge.evaluate(own.transform(data)), abs=0.005)
    assert mine.featureImportances.toArray() == pytest.approx(own.featureImportances.toArray(), abs=0.03)
    # Every tree holds about as many draws as there are rows, and its root predicts about their mean.
    counts = [t._call_java("rootNode").impurityStats().rawCount() for t in mine.trees]
    assert np.mean(counts) == pytest.approx(3000, rel=0.02) and np.std(counts) == pytest.approx(3000**0.5, rel=0.5)


def test_classes_as_good_as_from_rows(spark, cells):
    data = rows(spark).drop("label").withColumnRenamed("kind", "label")
    judge = BinaryClassificationEvaluator()
    options = {"numTrees": 20, "maxDepth": 5, "seed": 1}
    mine, own = forests.ForestClassifier(**options).fit(data), forests.RandomForestClassifier(**options).fit(data)
    assert mine.numClasses == 2 and judge.evaluate(mine.transform(data)) == pytest.approx(judge.evaluate(own.transform(data)), abs=0.01)


def test_the_way_is_chosen_by_size(spark, monkeypatch):
    """Few rows and too many cells are left to Spark; many rows of few cells are not handed to it."""
    data = rows(spark, 400)
    given = []
    plain = RandomForestRegressor._fit
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda self, d: given.append(d.count()) or plain(self, d))
    forest = forests.ForestRegressor(numTrees=3, maxDepth=3, seed=1)
    forest.fit(data)
    monkeypatch.setattr(forests, "LEAST_ROWS", 100)
    forest.fit(data)
    monkeypatch.setattr(forests, "HELD_SUMS", 500)
    forest.fit(data)
    assert given[0] == given[2] == 400 and given[1] < 20


def test_one_value_and_least_rows(spark, cells):
    data = rows(spark, 300).withColumn("label", F.lit(2.0))
    model = forests.ForestRegressor(numTrees=3, maxDepth=30, seed=1).fit(data)
    assert {t.numNodes for t in model.trees} == {1} and model.transform(data).agg({"prediction": "max"}).first()[0] == 2.0
    least = forests.ForestRegressor(numTrees=3, maxDepth=30, minInstancesPerNode=60, seed=1).fit(rows(spark, 300))
    assert max(t.numNodes for t in least.trees) <= 2 * 5


def test_rows_look_up_what_the_trees_say(spark, cells):
    """Scores by cells are those of the trees, at the borders of cells and beyond all rows too."""
    data = rows(spark)
    more = spark.createDataFrame([(-1, -1e9, 1e9), (-2, 1e9, -1e9), (-3, 24.5, 0.0), (-4, 0.5, 0.1)], "id long, a double, b double")
    asked = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(data.select("id", "a", "b").unionAll(more))
    for forest, label in ((forests.ForestRegressor, "label"), (forests.ForestClassifier, "kind")):
        model = forest(numTrees=10, maxDepth=8, seed=1, labelCol=label).fit(data)
        gc.collect()
        assert sum(model.featureImportances.toArray()) == pytest.approx(1)
        trees = type(model).__mro__[2](model._java_obj).transform(asked)
        seen, said = ({r["id"]: (r["prediction"], r["probability"] if "probability" in r else None) for r in found.collect()} for found in (model.transform(asked), trees))
        assert len(seen) == 3004 and seen == said
