"""A preparation learns from training rows only, and any column name will do."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import explain, features, models, select
from plumbline.operators.evaluate import TEST_SHARE, split
from plumbline.operators.preparation import FeaturePlan, fit_preparation
from plumbline.plans.segments import quoted


def rows(n=400):
    draw = random.Random(8)
    cities = ["St. Louis", "New York", "x`y", "Rome"]
    out = []
    for i in range(n):
        a, b, city = draw.gauss(0, 1), draw.random() * 9, draw.choice(cities)
        out.append((i, None if i % 11 == 0 else a, b, city if i % 13 else None, f"shop {i % 40}", 3 * a - b + cities.index(city) + draw.gauss(0, 0.1)))
    return out


SCHEMA = "id long, `a.x` double, b double, c string, shop string, y double"
TYPES = {"c": "categorical", "shop": "categorical"}
PLANS = {
    "one_hot": FeaturePlan(scaling="standard", lasso=0.001),
    "target": FeaturePlan(encoding="target", scaling="minmax", target_correlation=0.01),
    "components": FeaturePlan(pca=0.99),
    "aggregates": FeaturePlan(aggregate_columns=["a.x", "b"], aggregate_group="c", scaling="standard", encoding_columns=["c"], encoding="ordinal", vif=1e9, drop_correlated=0.999999),
}


@pytest.mark.parametrize("name", PLANS)
def test_test_rows_change_nothing_that_is_learned(spark, name):
    data = spark.createDataFrame(rows(), SCHEMA)
    test = split(data, ["id"], TEST_SHARE).where("split = 'test'").select("id").withColumn("out", F.lit(True))
    changed = data.join(test, "id", "left").select(
        "id", F.when(F.col("out"), 1e6).otherwise(F.col("`a.x`")).alias("a.x"), F.when(F.col("out"), -5.0).otherwise(F.col("b")).alias("b"),
        F.when(F.col("out"), "elsewhere").otherwise(F.col("c")).alias("c"), "shop", F.when(F.col("out"), -1e6).otherwise(F.col("y")).alias("y"),
    )
    predictors = ["a.x", "b", "c", "shop"] if name != "aggregates" else ["a.x", "b", "c"]
    found = [models.fit_model(d, "y", predictors, ["id"], TYPES, "multiple", PLANS[name]) for d in (data, changed)]
    learned = [
        sorted((r.step, r.column, r.name, str(r.text), round(r.value or 0.0, 8) + 0.0) for r in report["preparation"].parameters(data).collect()) for _, report in found
    ]
    assert learned[0] == learned[1] != []
    assert list(found[0][0].coefficients) == list(found[1][0].coefficients)
    assert found[0][0].coefficients == pytest.approx(found[1][0].coefficients) and found[0][0].intercept == pytest.approx(found[1][0].intercept)
    assert found[0][0].rows.count() == 400 and found[0][0].rows.where("prediction is null").count() == 0
    assert found[0][0].extra["holdout"].first()["n"] == test.count()


def test_unseen_values_and_gaps(spark):
    data = spark.createDataFrame(rows(), SCHEMA)
    fitted = fit_preparation(data, "y", ["a.x", "b", "c", "shop"], TYPES, FeaturePlan(scaling="standard"))
    odd = spark.createDataFrame([(1, None, None, "nowhere", "no shop", 1.0), (2, 1.0, 2.0, None, None, 1.0), (3, 1.0, 2.0, None, None, None)], SCHEMA)
    out = fitted.apply(odd)
    assert out.count() == 2 and all(out.where(quoted(p).isNull()).isEmpty() for p in fitted.predictors)
    assert "c_St. Louis" in out.columns


def test_names_with_dots(spark):
    data = features.one_hot(spark.createDataFrame(rows(), SCHEMA), ["c"])
    names = [c for c in data.columns if c.startswith("c_")]
    assert "c_St. Louis" in names
    scaled = features.scale(data, [*names, "a.x"])
    assert abs(scaled.agg(F.avg("`c_St. Louis`")).first()[0]) < 1e-9
    back = features.unscale(scaled, ["a.x"], features.scale_parameters(data, ["a.x"]))
    assert back.agg(F.avg("`a.x`")).first()[0] == pytest.approx(data.agg(F.avg("`a.x`")).first()[0])
    assert {r["column"] for r in select.lasso_selection(data, [*names, "b"], "y").collect()} == {*names, "b"}
    assert {r["column"] for r in select.importance_selection(data, [*names, "b"], "y").collect()} == {*names, "b"}
    made, shares = select.principal_components(data, [*names, "b"], 2)
    assert {"PC1", "PC2"} <= set(made.columns) and len(shares) == 2
    forest = models.random_forest(data, "y", [*names, "b"], ["id"], trees=3, depth=3)
    assert explain.predictor(forest.model, [*names, "b"])(data).where("prediction is null").count() == 0
