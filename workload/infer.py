"""Correlations, tests and least squares."""

from pyspark.sql import functions as F

from plumbline.operators import infer as i

from .common import chi2_tail, f_tail, r, rounded, t_tail, table

GAPS = "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END"


def _lineitem(spark, folder):
    return table(spark, folder, "lineitem").withColumn("quantity_gaps", F.expr(GAPS))


def pearson_correlations(spark, folder):
    pairs = [("l_quantity", "l_extendedprice"), ("quantity_gaps", "l_extendedprice")]
    return rounded(i.correlations(_lineitem(spark, folder), pairs), 4)


def pearson_by_segment(spark, folder):
    pairs = [("l_quantity", "l_extendedprice")]
    return rounded(i.correlations(_lineitem(spark, folder), pairs, ["l_returnflag", "l_linestatus"]), 4)


def spearman_correlations(spark, folder):
    pairs = [("l_discount", "l_extendedprice"), ("l_linenumber", "quantity_gaps"), ("l_quantity", "l_extendedprice")]
    types = {"l_quantity": "ordinal"}
    return rounded(i.correlations(_lineitem(spark, folder), pairs, types=types), 4)


def spearman_by_segment(spark, folder):
    found = i.spearman(table(spark, folder, "events"), [("event_id", "value")], ["event_type"])
    return rounded(found, 6)


def spearman_spread(spark, folder):
    """Ranks through running totals over ranges, as for very many distinct values."""
    found = i.spearman(_lineitem(spark, folder), [("l_quantity", "l_extendedprice")], task_rows=0)
    return rounded(found, 6)


def point_biserial(spark, folder):
    found = i.point_biserial(_lineitem(spark, folder), "l_linestatus", "l_extendedprice")
    return rounded(found, 4)


def all_correlations(spark, folder):
    found = i.all_correlations(_lineitem(spark, folder), ["l_quantity", "l_extendedprice", "l_partkey", "l_suppkey"])
    return rounded(found.select("column_a", "column_b", "method", "n", "r", "label"), 4)


def correlation_matrix(spark, folder):
    found = i.correlation_matrix(
        _lineitem(spark, folder), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag"]
    )
    return rounded(found, 6)


def welch_t_test(spark, folder):
    return rounded(i.welch_t_test(_lineitem(spark, folder), "l_extendedprice", "l_linestatus"), 4)


def welch_t_test_by_segment(spark, folder):
    return rounded(i.welch_t_test(_lineitem(spark, folder), "l_quantity", "l_linestatus", ["l_returnflag"]), 4)


def one_sample_t_test(spark, folder):
    return rounded(i.one_sample_t_test(table(spark, folder, "events"), "value", 10.0, ["event_type"]), 4)


def chi_square_test(spark, folder):
    return rounded(i.chi_square_test(table(spark, folder, "orders"), "o_orderstatus", "o_orderpriority"), 4)


def chi_square_yates(spark, folder):
    return rounded(i.chi_square_test(table(spark, folder, "labels"), "quality", "toxic"), 4)


def chi_square_sparse(spark, folder):
    """Many empty cells: balances in bands against nations."""
    customers = table(spark, folder, "customer").withColumn("band", F.floor(F.col("c_acctbal") / 100))
    return rounded(i.chi_square_test(customers, "band", "c_nationkey").select("test", "statistic", "dof1"), 4)


def anova_test(spark, folder):
    return rounded(i.anova(table(spark, folder, "events"), "value", "event_type"), 4)


def anova_by_segment(spark, folder):
    return rounded(i.anova(table(spark, folder, "orders"), "o_totalprice", "o_orderpriority", ["o_orderstatus"]), 4)


def least_squares_fit(spark, folder):
    fit = i.regression(_lineitem(spark, folder), "l_extendedprice", ["quantity_gaps", "l_discount"])
    return rounded(
        fit.select(
            "n", "intercept", F.col("coefficients")[0].alias("b_quantity"), F.col("coefficients")[1].alias("b_discount"),
            "r2", "adjusted_r2", "mse", "rmse",
        ),
        4,
    )


def least_squares_residuals(spark, folder):
    lineitem = _lineitem(spark, folder)
    fit = i.regression(lineitem, "l_extendedprice", ["l_quantity"], ["l_returnflag"])
    rows = i.with_predictions(lineitem, fit, "l_extendedprice", ["l_quantity"], ["l_returnflag"])
    return rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "prediction", "residual"), 3)


def inferential_tests(spark, folder):
    report = i.inferential_report(
        _lineitem(spark, folder),
        tests=[
            {"type": "t-test", "columns": ["l_extendedprice", "l_linestatus"]},
            {"type": "anova", "columns": ["l_quantity", "l_returnflag"]},
            {"type": "chi-square", "columns": ["l_returnflag", "l_linestatus"]},
        ],
    )
    tests = report["tests"].withColumn("columns", F.concat_ws(",", "columns"))
    return rounded(tests.select("test", "columns", "statistic", "dof1", "dof2", "significant"), 4)


QUERIES = {
    f.__name__: f
    for f in (
        pearson_correlations, pearson_by_segment, spearman_correlations, spearman_by_segment, spearman_spread,
        point_biserial, all_correlations, correlation_matrix, welch_t_test, welch_t_test_by_segment,
        one_sample_t_test, chi_square_test, chi_square_yates, chi_square_sparse, anova_test, anova_by_segment,
        least_squares_fit, least_squares_residuals, inferential_tests,
    )
}

LINEITEM = f"(SELECT *, {GAPS} AS quantity_gaps FROM lineitem)"
LABEL = """CASE WHEN abs(r) >= 0.7 THEN 'strong' || sgn WHEN abs(r) >= 0.4 THEN 'moderate' || sgn ELSE 'weak' END"""


def _judged(source, keys="", method=None, p=True):
    p_value = f"{r(t_tail('r * sqrt((n - 2) / (1 - r * r))', '(n - 2)'), 4)} AS p_value," if p else ""
    return f"""SELECT {keys} column_a, column_b, {method or 'method'} AS method, n, {r('r', 4)} AS r, {LABEL} AS label,
      {p_value} {r('tanh(atanh(r) - 1.96 / sqrt(n - 3))', 4)} AS ci_lower,
      {r('tanh(atanh(r) + 1.96 / sqrt(n - 3))', 4)} AS ci_upper
      FROM (SELECT *, CASE WHEN r > 0 THEN ' positive' ELSE ' negative' END AS sgn FROM ({source}))"""


def _pearson(a, b, source, by=""):
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys} '{a}' AS column_a, '{b}' AS column_b, 'pearson' AS method,
      count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r
      FROM {source} {f'GROUP BY {by}' if by else ''}"""


def _spearman(a, b, source, by=""):
    keys, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return f"""SELECT {keys} '{a}' AS column_a, '{b}' AS column_b, 'spearman' AS method, count(*) AS n, corr(ra, rb) AS r
      FROM (SELECT {keys} rank() OVER ({part} ORDER BY {a}) + (count(*) OVER (PARTITION BY {keys} {a}) - 1) / 2.0 AS ra,
        rank() OVER ({part} ORDER BY {b}) + (count(*) OVER (PARTITION BY {keys} {b}) - 1) / 2.0 AS rb
        FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) {f'GROUP BY {by}' if by else ''}"""


def _plain(source, keys="", digits=6):
    return f"SELECT {keys} column_a, column_b, n, {r('r', digits)} AS r FROM ({source})"


_BITS = "(SELECT *, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS code FROM lineitem)"
_MATRIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_ALL = ["l_quantity", "l_extendedprice", "l_partkey", "l_suppkey"]


def _welch(value, group, source, by=""):
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys} (m1 - m2) / sqrt(s1 / n1 + s2 / n2) AS statistic,
        pow(s1 / n1 + s2 / n2, 2) / (pow(s1 / n1, 2) / (n1 - 1) + pow(s2 / n2, 2) / (n2 - 1)) AS dof1
      FROM (SELECT {keys} max(n) FILTER (WHERE k = 1) AS n1, max(m) FILTER (WHERE k = 1) AS m1,
          max(s) FILTER (WHERE k = 1) AS s1, max(n) FILTER (WHERE k = 2) AS n2, max(m) FILTER (WHERE k = 2) AS m2,
          max(s) FILTER (WHERE k = 2) AS s2
        FROM (SELECT {keys} count(*) AS n, avg({value}) AS m, var_samp({value}) AS s,
            row_number() OVER ({f'PARTITION BY {by}' if by else ''} ORDER BY {group}) AS k
          FROM {source} WHERE {value} IS NOT NULL AND {group} IS NOT NULL GROUP BY {keys} {group})
        {f'GROUP BY {by}' if by else ''})"""


def _verdict(source, test, p, keys="", extra=""):
    return f"""SELECT {keys} '{test}' AS test, {r('statistic', 4)} AS statistic, {r('dof1', 4)} AS dof1,
      {r('dof2', 4)} AS dof2, {r('p', 4)} AS p_value, p < 0.05 AS significant {extra}
      FROM (SELECT *, {p} AS p FROM ({source}))"""


def _chi2(a, b, source):
    """Over the full grid of categories, empty cells included."""
    return f"""SELECT CASE WHEN any_value((nr - 1) * (nc - 1)) = 1
        THEN sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) ELSE sum(pow(o - e, 2) / e) END AS statistic,
        any_value((nr - 1) * (nc - 1)) AS dof1, CAST(NULL AS DOUBLE) AS dof2
      FROM (SELECT coalesce(x.o, 0) AS o, r.r * c.c / CAST(sum(coalesce(x.o, 0)) OVER () AS DOUBLE) AS e,
          (SELECT count(DISTINCT {a}) FROM {source}) AS nr, (SELECT count(DISTINCT {b}) FROM {source}) AS nc
        FROM (SELECT {a} AS a, count(*) AS r FROM {source} GROUP BY 1) r
        CROSS JOIN (SELECT {b} AS b, count(*) AS c FROM {source} GROUP BY 1) c
        LEFT JOIN (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {source} GROUP BY 1, 2) x ON x.a = r.a AND x.b = c.b)"""


def _anova(value, group, source, by=""):
    keys = f"{by}, " if by else ""
    match = f"g.{by} = t.{by}" if by else "true"
    return f"""SELECT {f'g.{by},' if by else ''}
        (sum(n * pow(m - grand, 2)) / (count(*) - 1)) / (sum((n - 1) * s) / (sum(n) - count(*))) AS statistic,
        count(*) - 1 AS dof1, sum(n) - count(*) AS dof2
      FROM (SELECT {keys} {group} AS grp, count(*) AS n, avg({value}) AS m, var_samp({value}) AS s FROM {source}
        GROUP BY {keys} {group} HAVING count(*) >= 2) g
      JOIN (SELECT {keys} avg({value}) AS grand FROM {source} {f'GROUP BY {by}' if by else ''}) t ON {match}
      {f'GROUP BY g.{by}' if by else ''}"""


_OLS2 = f"""SELECT n, my - b1 * m1 - b2 * m2 AS intercept, b1, b2, syy - b1 * s1y - b2 * s2y AS mse,
    1 - (syy - b1 * s1y - b2 * s2y) / syy AS r2
  FROM (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
      (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2
    FROM (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS s11, var_pop(x2) AS s22,
        covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y, var_pop(y) AS syy
      FROM (SELECT l_extendedprice AS y, quantity_gaps AS x1, l_discount AS x2 FROM {LINEITEM}
        WHERE quantity_gaps IS NOT NULL)))"""

_NO_DOF2 = "CAST(NULL AS DOUBLE) AS dof2"
ORACLES = {
    "pearson_correlations": " UNION ALL ".join(
        _judged(_pearson(a, b, LINEITEM))
        for a, b in [("l_quantity", "l_extendedprice"), ("quantity_gaps", "l_extendedprice")]
    ),
    "pearson_by_segment": _judged(
        _pearson("l_quantity", "l_extendedprice", LINEITEM, "l_returnflag, l_linestatus"), "l_returnflag, l_linestatus, "
    ),
    "spearman_correlations": " UNION ALL ".join(
        _judged(_spearman(a, b, LINEITEM))
        for a, b in [
            ("l_discount", "l_extendedprice"), ("l_linenumber", "quantity_gaps"), ("l_quantity", "l_extendedprice")
        ]
    ),
    "spearman_by_segment": _plain(_spearman("event_id", "value", "events", "event_type"), "event_type, "),
    "spearman_spread": _plain(_spearman("l_quantity", "l_extendedprice", "lineitem")),
    "point_biserial": _judged(
        f"SELECT 'l_linestatus' AS column_a, 'l_extendedprice' AS column_b, n, r FROM ({_pearson('code', 'l_extendedprice', _BITS)})",
        method="'point-biserial'",
    ),
    "all_correlations": " UNION ALL ".join(
        f"""SELECT column_a, column_b, method, n, r, label FROM ({_judged(source(a, b, 'lineitem'), p=False)})
        WHERE {wanted} (SELECT count(DISTINCT {a}) > 15 AND count(DISTINCT {b}) > 15 FROM lineitem)"""
        for k, a in enumerate(_ALL) for b in _ALL[k + 1:] for source, wanted in ((_pearson, ""), (_spearman, "NOT"))
    ),
    "correlation_matrix": " UNION ALL ".join(
        f"""SELECT l_returnflag, '{a}' AS column_a, '{b}' AS column_b, {r(f'corr({a}, {b})' if a != b else '1')} AS r
        FROM lineitem GROUP BY l_returnflag"""
        for a in _MATRIX for b in _MATRIX
    ),
    "welch_t_test": _verdict(
        f"SELECT *, {_NO_DOF2} FROM ({_welch('l_extendedprice', 'l_linestatus', 'lineitem')})", "t-test",
        t_tail("statistic", "dof1"),
    ),
    "welch_t_test_by_segment": _verdict(
        f"SELECT *, {_NO_DOF2} FROM ({_welch('l_quantity', 'l_linestatus', 'lineitem', 'l_returnflag')})", "t-test",
        t_tail("statistic", "dof1"), "l_returnflag, ",
    ),
    "one_sample_t_test": _verdict(
        f"""SELECT event_type, (avg(value) - 10.0) / (stddev_samp(value) / sqrt(count(*))) AS statistic,
        count(*) - 1 AS dof1, {_NO_DOF2} FROM events GROUP BY event_type""",
        "one-sample t-test", t_tail("statistic", "dof1"), "event_type, ",
    ),
    "chi_square_test": _verdict(
        _chi2("o_orderstatus", "o_orderpriority", "orders"), "chi-square", chi2_tail("statistic", "dof1")
    ),
    "chi_square_yates": _verdict(_chi2("quality", "toxic", "labels"), "chi-square", chi2_tail("statistic", "dof1")),
    "chi_square_sparse": f"""SELECT 'chi-square' AS test, {r('statistic', 4)} AS statistic, {r('dof1', 4)} AS dof1 FROM (
      {_chi2('band', 'c_nationkey', '(SELECT floor(c_acctbal / 100) AS band, c_nationkey FROM customer)')})""",
    "anova_test": _verdict(_anova("value", "event_type", "events"), "anova", f_tail("statistic", "dof1", "dof2")),
    "anova_by_segment": _verdict(
        _anova("o_totalprice", "o_orderpriority", "orders", "o_orderstatus"), "anova",
        f_tail("statistic", "dof1", "dof2"), "o_orderstatus, ",
    ),
    "least_squares_fit": f"""SELECT n, {r('intercept', 4)} AS intercept, {r('b1', 4)} AS b_quantity,
      {r('b2', 4)} AS b_discount, {r('r2', 4)} AS r2, {r('1 - (1 - r2) * (n - 1) / (n - 3)', 4)} AS adjusted_r2,
      {r('mse', 4)} AS mse, {r('sqrt(mse)', 4)} AS rmse FROM ({_OLS2})""",
    "least_squares_residuals": f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
      {r('a + b * l_quantity', 3)} AS prediction, {r('l_extendedprice - (a + b * l_quantity)', 3)} AS residual
      FROM lineitem l JOIN (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS b,
        regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem GROUP BY l_returnflag) f
      ON l.l_returnflag = f.l_returnflag""",
    "inferential_tests": " UNION ALL ".join(
        f"SELECT test, '{cols}' AS columns, statistic, dof1, dof2, significant FROM ({_verdict(sql, test, p)})"
        for test, cols, sql, p in (
            ("t-test", "l_extendedprice,l_linestatus",
             f"SELECT *, {_NO_DOF2} FROM ({_welch('l_extendedprice', 'l_linestatus', 'lineitem')})", t_tail("statistic", "dof1")),
            ("anova", "l_quantity,l_returnflag", _anova("l_quantity", "l_returnflag", "lineitem"),
             f_tail("statistic", "dof1", "dof2")),
            ("chi-square", "l_returnflag,l_linestatus", _chi2("l_returnflag", "l_linestatus", "lineitem"),
             chi2_tail("statistic", "dof1")),
        )
    ),
}
