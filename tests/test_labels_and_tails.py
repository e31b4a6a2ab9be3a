"""Class codes of any kind, tails at any degrees of freedom, and attributions over all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import distributions as dist
from plumbline.operators import charts, explain, models, select, train


@pytest.mark.parametrize("dof", [1.0, 30.0, 999.0, 1001.0, 1e5, 1e8, 1e10, 1e12])
def test_f_of_one_with_equal_dof_is_a_half(dof):
    assert dist.f_upper([1.0], [dof], [dof])[0] == pytest.approx(0.5, rel=1e-8)


@pytest.mark.parametrize("t", [0.01, 0.5, 1.96, 6.0, 20.0])
def test_t_tends_to_the_normal(t):
    assert dist.t_two_sided([t], [1e12])[0] == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-8)


def test_chi_square_of_two_and_of_many():
    assert dist.chi2_upper([5.0], [2])[0] == pytest.approx(math.exp(-2.5), rel=1e-12)
    for dof in (1e4, 1e8, 1e12):
        # leading term of the tail at its mean
        assert dist.chi2_upper([dof], [dof])[0] == pytest.approx(0.5 - 1 / (3 * math.sqrt(math.pi * dof)), rel=1e-6)


def test_f_tends_to_chi_square():
    for dof1 in (1.0, 7.0, 400.0):
        expected = dist.chi2_upper([dof1 * 1.3], [dof1])[0]
        assert dist.f_upper([1.3], [dof1], [1e12])[0] == pytest.approx(expected, rel=1e-8)


@pytest.mark.parametrize("dof1", [1.0, 3.0, 50.0, 900.0])
@pytest.mark.parametrize("f", [1e-3, 0.4, 0.97, 1.0, 1.1, 2.5, 30.0])
def test_series_and_integral_agree(f, dof1):
    f, dof1, dof2 = np.array([f]), np.array([dof1]), np.array([900.0])
    series = dist.f_upper(f, dof1, dof2)
    assert dist._f_integral(f, dof1, dof2) == pytest.approx(series, rel=1e-9, abs=1e-250)
    chi = dist.chi2_upper(f * dof1, dof1)
    assert dist._chi2_integral(f * dof1, dof1) == pytest.approx(chi, rel=1e-9, abs=1e-250)


def test_tails_at_the_ends():
    assert dist.f_upper([0.0, np.inf], [3, 3], [1e9, 1e9]).tolist() == [1.0, 0.0]
    assert dist.chi2_upper([0.0, np.inf], [1e9, 4]).tolist() == [1.0, 0.0]
    assert dist.t_two_sided([0.0], [1e9])[0] == 1.0


def _two_classes(table, low, high):
    rng = random.Random(4)
    rows = [(i, rng.gauss(2.0 * (i % 2), 1.0), float(high if i % 2 else low)) for i in range(300)]
    return table("id long, x double, y double", rows)


@pytest.mark.parametrize("codes", [(1, 2), (-1, 1)])
def test_recoded_classes_change_nothing(table, codes):
    found = [
        train.run_experiment(_two_classes(table, *c), "y", ["x"], ["id"], models=["logistic"], problem="classification", method="none", k=2)
        for c in ((0, 1), codes)
    ]
    plain, coded = [{(r["model"], r["split"], r["metric"]): r["value"] for r in f.metrics.collect()} for f in found]
    assert coded == pytest.approx(plain) and coded["logistic", "test", "auc"] > 0.8
    assert found[1].cross_validation["logistic"]["mean"] == pytest.approx(found[0].cross_validation["logistic"]["mean"])
    assert found[1].labels == [float(c) for c in codes]
    scored = found[1].as_given(found[1].models["logistic"].transform(found[1].data))
    assert {r["prediction"] for r in scored.select("prediction").distinct().collect()} == {float(c) for c in codes}


@pytest.mark.parametrize("codes", [(100, 200), (-5, 300)])
def test_importance_of_any_codes(table, codes):
    found = select.importance_selection(_two_classes(table, *codes), ["x"], "y").first()
    plain = select.importance_selection(_two_classes(table, 0, 1), ["x"], "y").first()
    assert found == plain and found["selected"]


def test_attributions_cover_all_rows(table):
    """Of an additive model the mean size of the attributions is that of w (x - background), exact for two equal halves."""
    rows = [(i, float(i % 2), float(i // 250)) for i in range(500)]
    data = table("id long, a double, b double", rows)
    predict = lambda df: df.withColumn("prediction", 3 * F.col("a") + 100 * F.col("b"))
    found = {r["feature"]: r for r in explain.shapley_sampled(data, predict, ["a", "b"], ["id"]).collect()}
    assert found["b"]["rank"] == 1 and found["b"]["mean_abs"] == pytest.approx(50, rel=0.1)
    assert found["a"]["mean_abs"] == pytest.approx(1.5, rel=0.1)


def test_names_with_dots_and_text_as_numbers(table):
    rows = [(i, float(i), float(i % 3), "n/a" if i % 5 == 0 else str(i)) for i in range(60)]
    data = table("id long, `St. Louis` double, `x``y` double, t string", rows)
    assert models.assemble(data, ["St. Louis", "x`y"], "t", ["id"]).count() == 48


def test_dependence_lines_follow_the_ranking(table):
    lines = table("feature string, value double, average double", [(f, 1.0, 2.0) for f in "abcdef"])
    ranking = table("feature string, rank int", [(f, i + 1) for i, f in enumerate("fedcba")])
    assert charts.dependence_lines(lines).count() == 6
    assert {r["feature"] for r in charts.dependence_lines(lines, ranking, 2).collect()} == {"f", "e"}
