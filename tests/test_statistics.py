"""Small reference fixtures, closed forms and edge rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import distributions as dist
from plumbline.operators import (
    clean, dedup, describe, evaluate, explain, features, impute, infer, models, outliers, profile, select, train,
)
from plumbline.plans import order, quantiles


def one(df):
    return df.first().asDict()


def numbers(table, values, name="x"):
    return table(f"id long, {name} double", [(i, None if v is None else float(v)) for i, v in enumerate(values)])


# ---- descriptive ---------------------------------------------------------------------------------

def test_summary_of_one_to_ten(table):
    row = one(describe.describe(numbers(table, range(1, 11)), ["x"]))
    assert (row["count"], row["mean"], row["median"], row["min"], row["max"]) == (10, 5.5, 5.5, 1.0, 10.0)
    assert abs(row["skewness"]) < 1e-9 and row["outlier_count"] == 0


def test_summary_counts_missing(table):
    row = one(describe.describe(numbers(table, [1, None, 3]), ["x"]))
    assert (row["count"], row["null_count"]) == (2, 1) and row["skewness"] == 0.0


def test_summary_of_one_value_and_of_none(table):
    row = one(describe.describe(numbers(table, [4]), ["x"]))
    assert (row["std"], row["variance"], row["iqr"], row["mode"]) == (0.0, 0.0, 0.0, 4.0)
    row = one(describe.describe(numbers(table, [None, None]), ["x"]))
    assert row["count"] == 0 and row["mean"] is None and row["outlier_count"] == 0


def test_summary_of_constant(table):
    row = one(describe.describe(numbers(table, [5.1] * 20), ["x"]))
    assert row["std"] == pytest.approx(0.0, abs=1e-12) and row["range"] == 0.0


def test_mode_takes_smallest_on_ties(table):
    assert one(describe.describe(numbers(table, [3, 1, 3, 1, 2]), ["x"]))["mode"] == 1.0


@pytest.mark.parametrize("partitions", [1, 16])
@pytest.mark.parametrize("bound", [10**6, 0])
def test_summary_does_not_depend_on_layout(table, partitions, bound):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), float(rng.randint(0, 30)) if rng.random() > 0.1 else None) for _ in range(400)]
    found = describe.describe(table("g string, x double", rows, partitions), ["x"], ["g"], bound)
    for row in found.collect():
        values = np.array([v for g, v in rows if g == row["g"] and v is not None])
        assert row["median"] == pytest.approx(np.median(values)) and row["q3"] == pytest.approx(np.percentile(values, 75))
        assert row["mean"] == pytest.approx(values.mean()) and row["variance"] == pytest.approx(values.var(ddof=1))
        counts = {v: (values == v).sum() for v in set(values)}
        assert row["mode"] == min(v for v in counts if counts[v] == max(counts.values()))


def test_outlier_report(table):
    row = one(outliers.outlier_report(numbers(table, [*range(1, 10), 100]), ["x"]))
    assert row["outlier_count"] == 1 and row["lower"] < row["upper"] < 100
    row = one(outliers.outlier_report(numbers(table, [1, 2, 3]), ["x"]))
    assert row["outlier_count"] == 0 and row["lower"] is None


def test_outlier_actions_keep_missing_values(table):
    data = numbers(table, [*range(1, 10), 100, None])
    assert outliers.treat_outliers(data, ["x"], action="remove").count() == 10
    clipped = [r["x"] for r in outliers.treat_outliers(data, ["x"], action="clip").collect()]
    assert None in clipped and max(v for v in clipped if v is not None) < 100
    assert outliers.treat_outliers(numbers(table, [-5, 1, 2, 3, 4, 900]), ["x"], action="log").agg(F.min("x")).first()[0] == pytest.approx(math.log1p(1))


# ---- order ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("task_rows", [10**6, 0])
def test_positions_ranks_and_carry(table, task_rows):
    rng = random.Random(7)
    # One segment holds most rows.
    rows = [("big" if rng.random() < 0.8 else rng.choice("xyz"), i, float(rng.randint(0, 5)) if rng.random() > 0.4 else None) for i in range(500)]
    data = table("g string, i long, v double", rows, 7)
    placed = order.positions(data, ["i"], ["g"], task_rows=task_rows).collect()
    for g in {r["g"] for r in placed}:
        assert [r["position"] for r in sorted((r for r in placed if r["g"] == g), key=lambda r: r["i"])] == list(range(sum(x[0] == g for x in rows)))
    for forward in (True, False):
        got = {r["i"]: r["v"] for r in order.carry(data, ["v"], ["i"], ["g"], forward, task_rows).collect()}
        last, expected = {}, {}
        for g, i, v in rows if forward else reversed(rows):
            last[g] = v if v is not None else last.get(g)
            expected[i] = last[g]
        assert got == expected
    ranks = {(r["g"], r["v"]): r["rank"] for r in order.average_ranks(data, "v", ["g"], task_rows=task_rows).collect()}
    for (g, v), rank in ranks.items():
        values = [x for h, _, x in rows if h == g and x is not None]
        assert rank == sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2


def test_spread_percentiles_match(table):
    values = [random.Random(3).gauss(0, 1) for _ in range(301)]
    found = quantiles.percentiles(numbers(table, values), ["x"], [0.1, 0.5, 0.99], bound=0, task_rows=0)
    assert found.first()["percentiles"] == pytest.approx(list(np.percentile(values, [10, 50, 99])))


# ---- inference -----------------------------------------------------------------------------------

def test_tail_probabilities():
    assert dist.t_two_sided([2.1], [18])[0] == pytest.approx(0.05009, abs=1e-4)
    assert dist.chi2_upper([3.84], [1])[0] == pytest.approx(0.05004, abs=1e-4)
    assert dist.f_upper([3.35], [2], [27])[0] == pytest.approx(0.05017, abs=2e-4)
    assert dist.normal_two_sided([1.959964])[0] == pytest.approx(0.05, abs=1e-6)
    assert dist.chi2_upper([0.0], [4])[0] == 1.0 and dist.t_two_sided([0.0], [5])[0] == pytest.approx(1.0)


def test_tail_probabilities_against_the_jvm(spark):
    jvm = spark.sparkContext._jvm.org.apache.commons.math3.distribution
    for t, dof in ((0.3, 3.0), (1.7, 12.5), (5.0, 200.0)):
        assert dist.t_two_sided([t], [dof])[0] == pytest.approx(2 * jvm.TDistribution(dof).cumulativeProbability(-t), rel=1e-9)
    for x, dof in ((0.5, 2.0), (9.0, 7.0), (260.0, 200.0), (2800.0, 2640.0)):
        assert dist.chi2_upper([x], [dof])[0] == pytest.approx(1 - jvm.ChiSquaredDistribution(dof).cumulativeProbability(x), rel=1e-7)
    for f, a, b in ((0.7, 1.0, 9.0), (2.5, 4.0, 30.0), (1.1, 40.0, 900.0)):
        assert dist.f_upper([f], [a], [b])[0] == pytest.approx(1 - jvm.FDistribution(a, b).cumulativeProbability(f), rel=1e-8)


SMOKE = [
    ("Alice", 25, 88, 1, "F"), ("Bob", 30, 92, 1, "M"), ("Cara", 22, 75, 0, "F"), ("Dan", 35, 85, 1, "M"), ("Eve", 28, 95, 1, "F"),
    ("Finn", 40, 70, 0, "M"), ("Gia", 33, 90, 1, "F"), ("Hal", 27, 65, 0, "M"), ("Ida", 45, 80, 1, "F"), ("Jon", 31, 78, 0, "M"),
]


def test_small_table_end_to_end(table):
    data = table("name string, age long, score long, passed long, gender string", SMOKE)
    age, score = np.array([r[1] for r in SMOKE], float), np.array([r[2] for r in SMOKE], float)
    # Ten distinct values are few, so ranks are used.
    found = one(infer.correlations(data, [("age", "score")]))
    rank = lambda v: np.argsort(np.argsort(v)).astype(float)
    assert found["method"] == "spearman" and found["r"] == pytest.approx(np.corrcoef(rank(age), rank(score))[0, 1])
    test = one(infer.welch_t_test(data, "score", "gender"))
    f, m = (np.array([r[2] for r in SMOKE if r[4] == g], float) for g in "FM")
    assert test["statistic"] == pytest.approx((f.mean() - m.mean()) / math.sqrt(f.var(ddof=1) / 5 + m.var(ddof=1) / 5))
    fit = one(infer.regression(data, "score", ["age"]))
    assert fit["coefficients"][0] == pytest.approx(np.polyfit(age, score, 1)[0])


def test_constant_columns_have_no_correlation(table):
    data = table("a double, b double", [(5.1, float(i)) for i in range(40)], 4)
    assert infer.correlations(data, [("a", "b")]).count() == 0
    assert infer.pearson(data, [("a", "b")]).first()["r"] is None


def test_many_pairs_agree_with_few(table, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [tuple(None if rng.random() < 0.1 else float(v) for v in rng.normal(1e6, 1, 5)) for _ in range(200)]
    data = table("a double, b double, c double, d double, e double", rows, 3)
    pairs = [(x, y) for x in "abcde" for y in "abcde" if x < y]
    plain = {(r["column_a"], r["column_b"]): (r["n"], r["r"]) for r in infer.pearson(data, pairs).collect()}
    monkeypatch.setattr(infer, "MANY_PAIRS", 0)
    for r in infer.pearson(data, pairs).collect():
        n, value = plain[r["column_a"], r["column_b"]]
        assert r["n"] == n and r["r"] == pytest.approx(value, abs=1e-8)


def test_welch_needs_two_groups(table):
    data = table("v double, g string", [(1.0, "a"), (2.0, "b"), (3.0, "c"), (4.0, "a"), (5.0, "b"), (1.0, "c")])
    assert infer.welch_t_test(data, "v", "g").count() == 0


def test_yates_correction(table):
    rows = [("a", "x")] * 12 + [("a", "y")] * 5 + [("b", "x")] * 3 + [("b", "y")] * 9
    n, o = 29, {("a", "x"): 12, ("a", "y"): 5, ("b", "x"): 3, ("b", "y"): 9}
    r, c = {"a": 17, "b": 12}, {"x": 15, "y": 14}
    expected = sum((abs(o[k] - r[k[0]] * c[k[1]] / n) - 0.5) ** 2 / (r[k[0]] * c[k[1]] / n) for k in o)
    assert one(infer.chi_square_test(table("a string, b string", rows), "a", "b"))["statistic"] == pytest.approx(expected)


# ---- regression ----------------------------------------------------------------------------------

def test_exact_line(table):
    data = table("x long, y long", [(x, 3 * x + 7) for x in range(50)])
    row = one(models.linear_model(data, "y", models.linear_terms(["x"])))
    assert row["coefficients"][0] == pytest.approx(3) and row["intercept"] == pytest.approx(7) and row["r2"] > 0.99


def test_two_predictors_against_numpy(table):
    rng = np.random.default_rng(11)
    x1, x2 = np.arange(1, 101.0), rng.random(100) * 50
    y = 2 * x1 - 0.5 * x2 + rng.normal(0, 3, 100)
    data = table("a double, b double, y double", [tuple(map(float, v)) for v in zip(x1, x2, y)])
    row = one(models.linear_model(data, "y", models.linear_terms(["a", "b"])))
    beta = np.linalg.lstsq(np.column_stack([np.ones(100), x1, x2]), y, rcond=None)[0]
    assert [row["intercept"], *row["coefficients"]] == pytest.approx(list(beta))
    fitted = infer.predict_terms(data, models.linear_model(data, "y", models.linear_terms(["a", "b"])), F.col("y"), models.linear_terms(["a", "b"]))
    assert fitted.where("prediction is not null").count() == 100
    assert fitted.agg(F.sum("residual")).first()[0] == pytest.approx(0, abs=1e-6)


def test_too_few_rows_give_no_fit(table):
    data = table("x double, y double", [(float(i), float(i)) for i in range(9)])
    assert models.linear_model(data, "y", models.linear_terms(["x"])).count() == 0


def test_vif(table):
    rng = random.Random(2)
    data = table("a double, b double", [(float(i), 2.0 * i + rng.random()) for i in range(50)])
    factors = {r["column"]: r["vif"] for r in select.variance_inflation(data, ["a", "b"]).collect()}
    assert factors["a"] == pytest.approx(factors["b"]) and factors["a"] > 10
    assert select.variance_inflation(data, ["a"]).first()["vif"] == 1.0


def test_ridge_matches_closed_form(table):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 2, (80, 2))
    y = x @ [1.5, -2.0] + 4 + rng.normal(0, 0.5, 80)
    data = table("id long, a double, b double, y double", [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))])
    matrix, names = train.model_matrix(data, "y", ["a", "b"], ["id"])
    model = train.estimator("ridge", "regression", train.Shape(80, 2, target_std=float(y.std())), {"alpha": 10.0}).fit(matrix)
    xc, yc = x - x.mean(0), y - y.mean()
    assert list(model.coefficients) == pytest.approx(list(np.linalg.solve(xc.T @ xc + 10 * np.eye(2), xc.T @ yc)), rel=1e-3)


def test_logistic_gradient_vanishes(table):
    rng = np.random.default_rng(4)
    rows = [(i, float(v), int(rng.random() < 1 / (1 + math.exp(-v)))) for i, v in enumerate(rng.normal(0, 2, 300))]
    fitted = models.logistic_regression(table("id long, x double, y long", rows), "y", ["x"], ["id"])
    data = fitted.rows.where("split = 'train'")
    assert abs(data.agg(F.avg(F.col("label") - F.col("score"))).first()[0]) < 1e-4


# ---- preprocessing -------------------------------------------------------------------------------

def test_exact_split_sizes(table):
    data = numbers(table, range(10))
    sizes = {r["split"]: r["count"] for r in evaluate.split(data, ["id"], 0.3, exact=True).groupBy("split").count().collect()}
    assert sizes == {"train": 7, "test": 3}
    assert evaluate.split(data.limit(0), ["id"], 0.3).count() == 0


def test_folds_reach_all_training_rows(table):
    parted = evaluate.split(numbers(table, range(400)), ["id"], 0.2, 0.15).where("split = 'train'")
    assert evaluate.folds(parted, ["id"], 3).select("fold").distinct().count() == 3


def test_scaling_centres(table):
    data = numbers(table, range(1, 6))
    scaled = features.scale(data, ["x"])
    assert scaled.agg(F.avg("x")).first()[0] == pytest.approx(0) and scaled.agg(F.stddev_pop("x")).first()[0] == pytest.approx(1)


def test_one_hot_drops_first(table):
    data = features.one_hot(table("color string", [("red",), ("blue",), ("green",), ("red",), (None,)]), ["color"])
    assert data.columns == ["color_green", "color_red"]
    assert data.agg(F.sum("color_red"), F.sum("color_green")).first()[:] == (2, 1)


def test_earlier_column_of_a_correlated_pair_goes(table):
    data = table("a double, b double, c double", [(float(i), 2.0 * i, float(i * i % 7)) for i in range(30)])
    assert select.correlated_features(data, ["a", "b", "c"]) == (["b", "c"], {"a": "b"})


def test_components_of_two_columns(table):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, 200)
    y = 0.8 * x + rng.normal(0, 0.5, 200)
    data = table("a double, b double", [(float(u), float(v)) for u, v in zip(x, y)])
    made, shares = select.principal_components(data, ["a", "b"], 2)
    rho = np.corrcoef(x, y)[0, 1]
    assert shares == pytest.approx([(1 + rho) / 2, (1 - rho) / 2]) and made.columns == ["PC1", "PC2"]


def test_title_case(table):
    row = clean.standardise_text(table("s string", [("  o'neil   abc-DEF ",)]), ["s"]).first()
    assert row["s"] == "O'neil Abc-Def".title()


def test_states(table):
    rows = [("ny",), (" new york",), ("Californa",), ("TX",), ("atlantis ",), (None,)]
    found = [r[0] for r in clean.standardise_states(table("s string", rows), ["s"]).collect()]
    assert sorted(map(str, found)) == ["California", "New York", "New York", "None", "Texas", "atlantis"]


def test_dates_both_ways(table):
    data = table("d string", [("03/04/2021",), ("2021-05-06",), ("nope",)])
    assert clean.parse_dates(data).agg(F.min("d")).first()[0].month == 3
    assert clean.parse_dates(data, dayfirst=True).agg(F.min("d")).first()[0].month == 4


def test_type_hints(table):
    rows = [(1 + i % 2, 1 + i % 3, i % 11, 1 + i % 5, 20 + i, 50.0 + i) for i in range(60)]
    data = table("sex long, marital long, pain_level long, q1 long, age long, score double", rows)
    found = {r["column"]: (r["type"], r["coded"], r["code_uncertain"]) for r in profile.profile(data).collect()}
    assert found["sex"] == ("binary", True, False)
    assert found["marital"][1] is True and found["pain_level"][:2] == ("ordinal", True)
    assert found["q1"] == ("ordinal", None, True)
    assert found["age"] == ("continuous", False, False) and found["score"] == ("continuous", False, False)


def test_gappy_bits_are_binary_without_counting_missing(table):
    data = table("f long", [(i % 2 if i % 5 else None,) for i in range(40)])
    assert profile.profile(data).first()["type"] == "ordinal"
    assert profile.profile(data, count_null=False).first()["type"] == "binary"


def test_keep_rules(table):
    data = table("id long, a string", [(1, "x"), (2, None), (3, "x"), (4, None), (5, "y")])
    kept = {k: sorted(r["id"] for r in dedup.drop_duplicates(data, ["id"], ["a"], k).collect()) for k in ("first", "last", "none")}
    assert kept == {"first": [1, 2, 5], "last": [3, 4, 5], "none": [5]}


def test_iterative_fill_recovers_a_line(table):
    data = table("a double, b double", [(float(i), 2.0 * i + 1 if i % 7 else None) for i in range(70)])
    filled = impute.fill_iterative(data, ["a", "b"])
    assert filled.agg(F.max(F.abs(F.col("b") - 2 * F.col("a") - 1))).first()[0] < 0.5


# ---- explanation ---------------------------------------------------------------------------------

def _linear(table, n=120):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (n, 2))
    return table("id long, a double, b double, y double", [(i, float(r[0]), float(r[1]), float(3 * r[0] + r[1])) for i, r in enumerate(x)])


def test_sampled_attributions_approach_linear_ones(table):
    data = _linear(table)
    exact = {r["feature"]: r["share"] for r in explain.shapley_linear(data, {"a": 3.0, "b": 1.0}).collect()}
    sampled = explain.shapley_sampled(data, explain.linear_predictor(0.0, {"a": 3.0, "b": 1.0}), ["a", "b"], ["id"], orders=20)
    found = {r["feature"]: r["share"] for r in sampled.collect()}
    assert found["a"] == pytest.approx(exact["a"], abs=8)


def test_local_surrogate_of_a_linear_model(table):
    data = _linear(table)
    found = explain.local_surrogate(data, explain.linear_predictor(1.0, {"a": 3.0, "b": 1.0}), ["a", "b"], ["id"], data.where("id < 3"), samples=100)
    spread = data.agg(F.stddev_pop("a"), F.stddev_pop("b")).first()
    for r in found.collect():
        assert r["contribution"] == pytest.approx(3 * spread[0] if r["feature"] == "a" else spread[1], rel=1e-6)


@pytest.mark.parametrize("task_rows", [10**6])
def test_permutation_importance_orders_features(table, task_rows):
    found = explain.permutation_importance(_linear(table), explain.linear_predictor(0.0, {"a": 3.0, "b": 1.0}), ["a", "b"], "y", ["id"], False, 4)
    ranks = {r["feature"]: (r["rank"], r["importance"]) for r in found.collect()}
    # Shuffling a column of a linear model costs about twice its share of the variance.
    assert ranks["a"][0] == 1 and ranks["a"][1] == pytest.approx(2 * 9 / 10, rel=0.3) and ranks["b"][1] > 0


def test_dependence_in_closed_form_and_by_scoring(table):
    data = _linear(table)
    weights = {"a": 3.0, "b": 1.0}
    closed = {(r["feature"], round(r["value"], 9)): r["average"] for r in explain.partial_dependence_linear(data, 1.0, weights, points=10).collect()}
    scored = explain.partial_dependence(data, explain.linear_predictor(1.0, weights), ["a", "b"], points=10).collect()
    assert len(scored) == len(closed) == 20
    for r in scored:
        assert r["average"] == pytest.approx(closed[r["feature"], round(r["value"], 9)])


def test_every_value_of_a_categorical_column_is_listed(spark):
    data = spark.range(6_000).selectExpr("concat('w', id % 60) AS word", "id % 80 AS region_code", "concat('n', id) AS name", "date_add(DATE'2020-01-01', CAST(id % 900 AS int)) AS day")
    found = {r["column"]: r for r in profile.profile(data).collect()}
    assert found["word"]["unique_values"] == sorted(f"w{i}" for i in range(60))
    assert found["region_code"]["type"] == "categorical" and found["region_code"]["unique_values"] == [str(i) for i in range(80)]
    assert {c: r["distinct_count"] for c, r in found.items()} == {"word": 60, "region_code": 80, "name": 6_000, "day": 900}
    assert len(found["name"]["unique_values"]) == 6_000 and found["day"]["unique_values"] is None
