"""Rows behind the plots."""

from pyspark.sql import functions as F

from plumbline.operators import charts as c, evaluate as e, explain as x, models as m, train as t

from . import models as workload_models
from .common import r, rounded, table

WEIGHTS = workload_models.WEIGHTS


def _lineitem(spark, folder):
    return workload_models._lineitem(spark, folder)


def histogram(spark, folder):
    return rounded(c.histogram(_lineitem(spark, folder), ["quantity_gaps", "l_extendedprice"], ["l_returnflag"]), 4)


def residual_histogram(spark, folder):
    return rounded(c.residual_histogram(_lineitem(spark, folder), "l_extendedprice", "estimate", ["l_linestatus"]), 4, density=10)


def box_plot(spark, folder):
    return rounded(c.box_plot(table(spark, folder, "events"), ["value"], ["event_type"]), 4)


def bar_counts(spark, folder):
    return rounded(c.bar_counts(table(spark, folder, "part"), ["p_type", "p_brand"], top=5))


def scatter_points(spark, folder):
    points = c.scatter(table(spark, folder, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"])
    return rounded(points, 2)


def scatter_points_spread(spark, folder):
    points = c.scatter(table(spark, folder, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"], task_rows=0)
    return rounded(points, 2)


def predicted_against_actual(spark, folder):
    orders = table(spark, folder, "orders").withColumn("estimate", F.expr("o_custkey * 2.0"))
    return rounded(c.predicted_against_actual(orders, "o_totalprice", "estimate", ["o_orderkey"]), 2)


def heatmap(spark, folder):
    return rounded(c.heatmap(_lineitem(spark, folder), ["l_quantity", "l_extendedprice", "l_tax"]), 5)


def importance_bars(spark, folder):
    return rounded(c.importance_bars(x.consensus(workload_models._ranks(spark, folder))), 4)


def forecast_band(spark, folder):
    trend = m.time_trend(workload_models._daily(spark, folder), "total", ["day"], ["o_orderstatus"])
    return rounded(c.forecast_band(m.forecast(trend, ["o_orderstatus"]), ["o_orderstatus"]), 2)


def dependence_lines(spark, folder):
    """The lines of the two leading features."""
    lineitem = _lineitem(spark, folder)
    return rounded(c.dependence_lines(x.partial_dependence_linear(lineitem, 5.0, WEIGHTS), x.shapley_linear(lineitem, WEIGHTS), 2), 3)


def attribution_bars(spark, folder):
    return rounded(c.attribution_bars(x.shapley_linear(_lineitem(spark, folder), WEIGHTS)), 4)


def model_comparison(spark, folder):
    """Two fixed rules on the train and test parts of the line items, side by side."""
    data = e.split(_lineitem(spark, folder), ["l_orderkey", "l_linenumber"])
    parts = None
    for name, rule in (("fair", 1500), ("large", 2000)):
        scored = data.withColumn("estimate", F.col("l_quantity") * rule)
        found = e.long_metrics(e.regression_metrics(scored, "l_extendedprice", "estimate", ["split"]), ["split"])
        found = found.withColumn("model", F.lit(name))
        parts = found if parts is None else parts.unionByName(found)
    return rounded(t.comparison(parts).select("model", "test_r2", "test_rmse", "train_r2"), 4)


QUERIES = {
    q.__name__: q
    for q in (
        histogram, residual_histogram, box_plot, bar_counts, scatter_points, scatter_points_spread, predicted_against_actual,
        heatmap, importance_bars, forecast_band, dependence_lines, attribution_bars, model_comparison,
    )
}

LINEITEM = workload_models.LINEITEM


def _scatter(x_, y_, a, b):
    return f"""SELECT o_orderkey, {r(x_, 2)} AS {a}, {r(y_, 2)} AS {b} FROM orders
      QUALIFY (row_number() OVER (ORDER BY o_orderkey) - 1) % greatest(1, count(*) OVER () // 500) = 0"""


ORACLES = {
    "histogram": " UNION ALL ".join(
        f"""SELECT l_returnflag, '{n}' AS "column", bin, {r('any_value(lo + (bin - 1) * (hi - lo) / 10)', 4)} AS lower,
        {r('any_value(lo + bin * (hi - lo) / 10)', 4)} AS upper, count(*) AS "count"
        FROM (SELECT *, least(CAST(floor(({n} - lo) / (hi - lo) * 10) AS BIGINT) + 1, 10) AS bin
          FROM (SELECT l_returnflag, {n}, min({n}) OVER w AS lo, max({n}) OVER w AS hi FROM {LINEITEM} WHERE {n} IS NOT NULL
            WINDOW w AS (PARTITION BY l_returnflag))) GROUP BY l_returnflag, bin"""
        for n in ("quantity_gaps", "l_extendedprice")
    ),
    "residual_histogram": f"""SELECT l_linestatus, bin, {r('any_value(lo + (bin - 0.5) * w)', 4)} AS midpoint, count(*) AS "count",
      {r('count(*) / any_value(n * w)', 10)} AS density, {r('any_value(m)', 4)} AS mean, {r('any_value(s)', 4)} AS std,
      {r('any_value(lo)', 4)} AS min, {r('any_value(hi)', 4)} AS max
      FROM (SELECT *, (hi - lo) / b AS w, least(CAST(floor((e - lo) / (hi - lo) * b) AS BIGINT) + 1, b) AS bin
        FROM (SELECT l.l_linestatus, l_extendedprice - estimate AS e, n, m, s, lo, hi, CAST(least(greatest(floor(sqrt(n)), 5), 20) AS BIGINT) AS b
          FROM {LINEITEM} l JOIN (SELECT l_linestatus, count(*) AS n, avg(l_extendedprice - estimate) AS m,
            stddev_samp(l_extendedprice - estimate) AS s, min(l_extendedprice - estimate) AS lo, max(l_extendedprice - estimate) AS hi
            FROM {LINEITEM} GROUP BY 1) f ON l.l_linestatus = f.l_linestatus)) GROUP BY l_linestatus, bin""",
    "box_plot": f"""SELECT event_type, 'value' AS "column", {r('min(value)', 4)} AS min, {r('quantile_cont(value, 0.25)', 4)} AS q1,
      {r('median(value)', 4)} AS median, {r('quantile_cont(value, 0.75)', 4)} AS q3, {r('max(value)', 4)} AS max FROM events GROUP BY 1""",
    "bar_counts": " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", value, "count", {r('"count" / total')} AS share FROM (SELECT {n} AS value, count(*) AS "count",
        CAST(sum(count(*)) OVER () AS DOUBLE) AS total, row_number() OVER (ORDER BY count(*) DESC, {n}) AS place FROM part GROUP BY 1) WHERE place <= 5"""
        for n in ("p_type", "p_brand")
    ),
    "scatter_points": _scatter("o_custkey", "o_totalprice", "x", "y"),
    "scatter_points_spread": _scatter("o_custkey", "o_totalprice", "x", "y"),
    "predicted_against_actual": _scatter("o_totalprice", "o_custkey * 2.0", "actual", "predicted"),
    "heatmap": " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r(f'corr({a}, {b})' if a != b else 'max(1)', 5)} AS r FROM lineitem"
        for a in ("l_quantity", "l_extendedprice", "l_tax") for b in ("l_quantity", "l_extendedprice", "l_tax")
    ),
    "importance_bars": f"""SELECT feature, {r('importance', 4)} AS importance, {r('importance / max(importance) OVER ()', 4)} AS relative,
      consensus_rank AS rank, methods FROM (SELECT *, round(1 / average_rank, 4) AS importance FROM ({workload_models.ORACLES['consensus_ranking']}))""",
    "forecast_band": f"""SELECT o_orderstatus, 'Period ' || period AS name, predicted, lower, upper FROM ({workload_models.ORACLES['forecast']})""",
    "dependence_lines": f"""SELECT feature, {r('value', 3)} AS x, {r('average', 3)} AS y FROM ({workload_models.ORACLES['linear_dependence']})
      WHERE feature IN (SELECT feature FROM {workload_models._attributions()} WHERE rank <= 2)""",
    "attribution_bars": f"SELECT feature, {r('mean_abs', 4)} AS mean_abs, {r('share', 4)} AS share, rank FROM {workload_models._attributions()}",
    "model_comparison": " UNION ALL ".join(
        f"""SELECT '{n}' AS model, {r('max(r2) FILTER (WHERE test)', 4)} AS test_r2, {r('max(rmse) FILTER (WHERE test)', 4)} AS test_rmse,
        {r('max(r2) FILTER (WHERE NOT test)', 4)} AS train_r2 FROM (SELECT {workload_models._TEST} AS test,
          1 - avg(pow(l_extendedprice - l_quantity * {k}, 2)) / var_pop(l_extendedprice) AS r2,
          sqrt(avg(pow(l_extendedprice - l_quantity * {k}, 2))) AS rmse FROM lineitem GROUP BY 1)"""
        for n, k in (("fair", 1500), ("large", 2000))
    ),
}
