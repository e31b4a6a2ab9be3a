"""Descriptive statistics and outliers."""

from pyspark.sql import functions as F

from plumbline.operators import describe as d, outliers as o

from .common import r, rounded, stacked, table

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DIRTY = "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END"
WILD = "CASE WHEN l_orderkey % 1000 = 0 THEN l_extendedprice * 100 ELSE l_extendedprice END"


def _lineitem(spark, folder):
    return table(spark, folder, "lineitem").withColumns(
        {"quantity_gaps": F.expr(DIRTY), "price_wild": F.expr(WILD)}
    )


LINEITEM_SQL = f"SELECT *, {DIRTY} AS quantity_gaps, {WILD} AS price_wild FROM lineitem"


def _summary_sql(columns, by="", source=LINEITEM_SQL):
    """Moments are written out: skewness and kurtosis are the population forms."""
    keys = f"{by}, " if by else ""
    match = f"s.{by} = m.{by} AND " if by else ""
    group = f"GROUP BY {by}" if by else ""
    group_m = f"GROUP BY {', '.join('m.' + k for k in [by] if k)}" if by else ""
    select = f"""
      SELECT {'m.' + by + ',' if by else ''} '{{c}}' AS "column",
        any_value(m.n) AS "count", any_value(m.total - m.n) AS null_count,
        {r('any_value(m.mean)')} AS mean, {r('any_value(m.q[2])')} AS median, {r('any_value(m.mode)')} AS mode,
        {r('any_value(m.sd)')} AS std, {r('any_value(m.var)', 4)} AS variance,
        {r('any_value(m.lo)')} AS min, {r('any_value(m.hi)')} AS max, {r('any_value(m.hi - m.lo)')} AS range,
        {r('any_value(m.q[1])')} AS q1, {r('any_value(m.q[3])')} AS q3, {r('any_value(m.q[3] - m.q[1])')} AS iqr,
        {r('avg(pow(s.{c} - m.mean, 3)) / pow(avg(pow(s.{c} - m.mean, 2)), 1.5)')} AS skewness,
        {r('avg(pow(s.{c} - m.mean, 4)) / pow(avg(pow(s.{c} - m.mean, 2)), 2) - 3')} AS kurtosis,
        count(*) FILTER (WHERE s.{{c}} < m.q[1] - 1.5 * (m.q[3] - m.q[1]) OR s.{{c}} > m.q[3] + 1.5 * (m.q[3] - m.q[1]))
          AS outlier_count
      FROM ({source}) s JOIN (
        SELECT {keys} count({{c}}) AS n, count(*) AS total, avg({{c}}) AS mean, stddev_samp({{c}}) AS sd,
          var_samp({{c}}) AS var, min({{c}}) AS lo, max({{c}}) AS hi,
          quantile_cont({{c}}, [0.25, 0.5, 0.75]) AS q,
          (SELECT min(v) FROM (SELECT f.{{c}} AS v, count(*) AS k FROM ({source}) f
             WHERE f.{{c}} IS NOT NULL {f'AND f.{by} = t.{by}' if by else ''} GROUP BY 1 QUALIFY k = max(k) OVER ())) AS mode
        FROM ({source}) t {group}) m ON {match} true {group_m}"""
    return stacked(columns, select)


def numeric_summary(spark, folder):
    summary = d.describe(_lineitem(spark, folder), [*MEASURES, "quantity_gaps"])
    return rounded(summary, 6, variance=4)


def numeric_summary_by_flag(spark, folder):
    summary = d.describe(_lineitem(spark, folder), ["l_quantity", "l_discount"], ["l_returnflag"])
    return rounded(summary, 6, variance=4)


def numeric_summary_spread(spark, folder):
    """The same summary through counted values and running totals, as for very many distinct values."""
    summary = d.describe(_lineitem(spark, folder), [*MEASURES, "quantity_gaps"], bound=0)
    return rounded(summary, 6, variance=4)


def frequency_table(spark, folder):
    return rounded(d.frequencies(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"]))


def frequency_by_segment(spark, folder):
    events = table(spark, folder, "events").withColumn("hour", F.hour("ts"))
    return rounded(d.frequencies(events, ["event_type"], ["hour"]))


def text_summary(spark, folder):
    orders = table(spark, folder, "orders").withColumn(
        "priority", F.expr("CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END")
    )
    return d.text_summary(orders, ["o_orderstatus", "priority"])


def column_percentiles(spark, folder):
    probs = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    return rounded(d.column_percentiles(_lineitem(spark, folder), ["l_extendedprice", "l_quantity"], probs))


def percentiles_by_segment(spark, folder):
    events = table(spark, folder, "events")
    return rounded(d.column_percentiles(events, ["value"], [0.1, 0.5, 0.9], ["event_type"]))


def date_range(spark, folder):
    found = d.date_range(table(spark, folder, "orders"), ["o_orderdate"], ["o_orderstatus"])
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("min", "max")})


def describe_by_type(spark, folder):
    """Type dispatch: the numeric table that the profile of the customers asks for."""
    from plumbline.operators.profile import profile

    customers = table(spark, folder, "customer")
    parts = d.describe_by_type(customers, profile(customers), ["c_acctbal", "c_mktsegment"])
    numeric = parts["numeric"].select("column", "count", F.round("mean", 6).alias("mean"), F.lit(None).cast("string").alias("mode"))
    text = parts["text"].select("column", "count", F.lit(None).cast("double").alias("mean"), "mode")
    return numeric.unionByName(text)


def skewness_labels(spark, folder):
    summary = d.describe(_lineitem(spark, folder), ["l_quantity", "price_wild"])
    return rounded(d.with_skewness_label(summary).select("column", "skewness", "skewness_label"), 4)


def outliers_iqr(spark, folder):
    return rounded(o.outlier_report(_lineitem(spark, folder), ["price_wild", "quantity_gaps"]), 4)


def outliers_iqr_by_flag(spark, folder):
    return rounded(o.outlier_report(_lineitem(spark, folder), ["price_wild"], ["l_returnflag"]), 4)


def outliers_zscore(spark, folder):
    return rounded(o.outlier_report(table(spark, folder, "events"), ["value"], ["event_type"], "zscore"), 4)


def outlier_rows(spark, folder):
    found = o.outlier_rows(table(spark, folder, "events"), "value", ["event_type"], "zscore")
    return found.select("event_id", "event_type", F.round("value", 4).alias("value"))


def outliers_removed(spark, folder):
    kept = o.treat_outliers(_lineitem(spark, folder), ["price_wild", "quantity_gaps"], action="remove")
    return kept.groupBy("l_returnflag").agg(
        F.count("*").alias("kept"), F.round(F.sum("price_wild"), 2).alias("total"), F.count("quantity_gaps").alias("known")
    )


def outliers_clipped(spark, folder):
    clipped = o.treat_outliers(_lineitem(spark, folder), ["price_wild", "quantity_gaps"], ["l_returnflag"])
    return rounded(clipped.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price_wild", "quantity_gaps"), 4)


def outliers_logged(spark, folder):
    customers = table(spark, folder, "customer").withColumn(
        "c_acctbal", F.expr("CASE WHEN c_custkey % 50 = 0 THEN c_acctbal * 100 ELSE c_acctbal END")
    )
    logged = o.treat_outliers(customers, ["c_acctbal"], action="log")
    return rounded(logged.select("c_custkey", "c_acctbal"))


def outliers_rooted(spark, folder):
    customers = table(spark, folder, "customer").withColumn(
        "c_acctbal", F.expr("CASE WHEN c_custkey % 50 = 0 THEN c_acctbal * 100 ELSE c_acctbal END")
    )
    rooted = o.treat_outliers(customers, ["c_acctbal"], action="sqrt")
    return rounded(rooted.select("c_custkey", "c_acctbal"))


QUERIES = {
    f.__name__: f
    for f in (
        numeric_summary, numeric_summary_by_flag, numeric_summary_spread, frequency_table, frequency_by_segment,
        text_summary, column_percentiles, percentiles_by_segment, date_range, describe_by_type, skewness_labels,
        outliers_iqr, outliers_iqr_by_flag, outliers_zscore, outlier_rows, outliers_removed, outliers_clipped,
        outliers_logged, outliers_rooted,
    )
}

_FREQ = """SELECT {keys} '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS "count",
  (round(count(*) / sum(count(*)) OVER ({part}), 6) + 0.0) AS share FROM {source} GROUP BY {group}"""


def _percentile_sql(source, columns, probs, by=""):
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"""SELECT {keys} '{c}' AS "column", CAST({p} AS DOUBLE) AS prob, {r(f'quantile_cont({c}, {p})')} AS value
        FROM {source} {group}"""
        for c in columns for p in probs
    )


def _iqr_sql(columns, by=""):
    keys = f"s.{by}, " if by else ""
    inner = f"{by}, " if by else ""
    select = f"""SELECT {keys} '{{c}}' AS "column", any_value(round(q[1] - 1.5 * (q[2] - q[1]), 4) + 0.0) AS lower,
        any_value(round(q[2] + 1.5 * (q[2] - q[1]), 4) + 0.0) AS upper,
        count(*) FILTER (WHERE {{c}} < q[1] - 1.5 * (q[2] - q[1]) OR {{c}} > q[2] + 1.5 * (q[2] - q[1])) AS outlier_count
      FROM ({LINEITEM_SQL}) s JOIN (SELECT {inner} quantile_cont({{c}}, [0.25, 0.75]) AS q FROM ({LINEITEM_SQL})
        {f'GROUP BY {by}' if by else ''}) b ON {f's.{by} = b.{by}' if by else 'true'} {f'GROUP BY s.{by}' if by else ''}"""
    return stacked(columns, select)


_Z = "SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY event_type"
_BOUNDS = f"""SELECT quantile_cont(price_wild, [0.25, 0.75]) AS p, quantile_cont(quantity_gaps, [0.25, 0.75]) AS g
  {{keys}} FROM ({LINEITEM_SQL}) {{group}}"""
_WILD_CUSTOMERS = (
    "SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN c_acctbal * 100 ELSE c_acctbal END AS c_acctbal FROM customer"
)

ORACLES = {
    "numeric_summary": _summary_sql([*MEASURES, "quantity_gaps"]),
    "numeric_summary_spread": _summary_sql([*MEASURES, "quantity_gaps"]),
    "numeric_summary_by_flag": _summary_sql(["l_quantity", "l_discount"], "l_returnflag"),
    "frequency_table": " UNION ALL ".join(
        _FREQ.replace("{keys}", "").replace("{part}", "").replace("{source}", "orders")
        .replace("{group}", c).replace("{c}", c)
        for c in ("o_orderstatus", "o_orderpriority")
    ),
    "frequency_by_segment": _FREQ.replace("{keys}", "hour,").replace("{part}", "PARTITION BY hour")
    .replace("{source}", "(SELECT *, hour(ts) AS hour FROM events)").replace("{group}", "hour, event_type")
    .replace("{c}", "event_type"),
    "text_summary": " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", count({e}) AS "count", count(*) - count({e}) AS null_count,
        count(DISTINCT {e}) AS distinct_count,
        (SELECT min(v) FROM (SELECT {e} AS v, count(*) AS k FROM orders WHERE {e} IS NOT NULL GROUP BY 1
          QUALIFY k = max(k) OVER ())) AS mode FROM orders"""
        for n, e in (
            ("o_orderstatus", "o_orderstatus"),
            ("priority", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END"),
        )
    ),
    "column_percentiles": _percentile_sql(
        "lineitem", ["l_extendedprice", "l_quantity"], [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    ),
    "percentiles_by_segment": _percentile_sql("events", ["value"], [0.1, 0.5, 0.9], "event_type"),
    "date_range": """SELECT o_orderstatus, 'o_orderdate' AS "column", count(o_orderdate) AS "count",
      count(*) - count(o_orderdate) AS null_count, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min,
      strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max FROM orders GROUP BY o_orderstatus""",
    "describe_by_type": """SELECT 'c_acctbal' AS "column", count(c_acctbal) AS "count",
        round(avg(c_acctbal), 6) AS mean, CAST(NULL AS VARCHAR) AS mode FROM customer
      UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), NULL, (SELECT min(v) FROM (SELECT c_mktsegment AS v,
        count(*) AS k FROM customer GROUP BY 1 QUALIFY k = max(k) OVER ())) FROM customer""",
    "skewness_labels": f"""SELECT "column", skewness, CASE WHEN abs(skewness) < 0.5 THEN 'symmetric'
      WHEN abs(skewness) < 1 THEN 'moderate' ELSE 'skewed' END AS skewness_label FROM ({stacked(
        ['l_quantity', 'price_wild'],
        f'''SELECT '{{c}}' AS "column", {r('avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5)', 4)} AS skewness
        FROM ({LINEITEM_SQL}), (SELECT avg({{c}}) AS m FROM ({LINEITEM_SQL}))''')})""",
    "outliers_iqr": _iqr_sql(["price_wild", "quantity_gaps"]),
    "outliers_iqr_by_flag": _iqr_sql(["price_wild"], "l_returnflag"),
    "outliers_zscore": f"""SELECT e.event_type, 'value' AS "column", any_value({r('m - 3 * s', 4)}) AS lower,
      any_value({r('m + 3 * s', 4)}) AS upper, count(*) FILTER (WHERE abs(value - m) / s > 3) AS outlier_count
      FROM events e JOIN ({_Z}) z ON e.event_type = z.event_type GROUP BY e.event_type""",
    "outlier_rows": f"""SELECT event_id, e.event_type, round(value, 4) AS value FROM events e JOIN ({_Z}) z
      ON e.event_type = z.event_type WHERE abs(value - m) / s > 3""",
    "outliers_removed": f"""SELECT l_returnflag, count(*) AS kept, round(sum(price_wild), 2) AS total,
      count(quantity_gaps) AS known FROM ({LINEITEM_SQL}),
      ({_BOUNDS.replace('{keys}', '').replace('{group}', '')})
      WHERE price_wild BETWEEN p[1] - 1.5 * (p[2] - p[1]) AND p[2] + 1.5 * (p[2] - p[1])
        AND (quantity_gaps IS NULL OR quantity_gaps BETWEEN g[1] - 1.5 * (g[2] - g[1]) AND g[2] + 1.5 * (g[2] - g[1]))
      GROUP BY l_returnflag""",
    "outliers_clipped": f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
      {r('least(greatest(price_wild, p[1] - 1.5 * (p[2] - p[1])), p[2] + 1.5 * (p[2] - p[1]))', 4)} AS price_wild,
      {r('CASE WHEN quantity_gaps IS NOT NULL THEN least(greatest(quantity_gaps, g[1] - 1.5 * (g[2] - g[1])), g[2] + 1.5 * (g[2] - g[1])) END', 4)}
        AS quantity_gaps
      FROM ({LINEITEM_SQL}) s JOIN ({_BOUNDS.replace('{keys}', ', l_returnflag').replace('{group}', 'GROUP BY l_returnflag')}) b
      ON s.l_returnflag = b.l_returnflag""",
    "outliers_logged": f"""SELECT c_custkey, {r('ln(1 + greatest(c_acctbal, (SELECT min(c_acctbal) FROM (' + _WILD_CUSTOMERS + ') WHERE c_acctbal > 0)))')}
      AS c_acctbal FROM ({_WILD_CUSTOMERS})""",
    "outliers_rooted": f"SELECT c_custkey, {r('sqrt(greatest(c_acctbal, 0))')} AS c_acctbal FROM ({_WILD_CUSTOMERS})",
}
