"""Feature creation, encoding, scaling and selection."""

from pyspark.sql import functions as F

from plumbline.operators import features as f, select as s

from .common import r, rounded, table

PRIORITY = "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END"
QUANTITY = "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _lineitem(spark, folder):
    return table(spark, folder, "lineitem").withColumn("quantity_gaps", F.expr(QUANTITY))


def date_parts(spark, folder):
    orders = f.date_parts(table(spark, folder, "orders"), ["o_orderdate"], [*f.DATE_PARTS, "week_of_year"])
    return rounded(orders.drop("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))


def event_hours(spark, folder):
    events = f.date_parts(table(spark, folder, "events"), ["ts"])
    return rounded(events.groupBy("ts_hour", "ts_day_of_week", "ts_is_weekend").agg(F.count("*").alias("n")))


def ratio_features(spark, folder):
    made = f.ratios(_lineitem(spark, folder), [("l_extendedprice", "l_quantity"), ("quantity_gaps", "l_discount")])
    return rounded(made.select(*KEYS, "l_extendedprice_div_l_quantity", "quantity_gaps_div_l_discount"), 8)


def interaction_features(spark, folder):
    made = f.interactions(_lineitem(spark, folder), [("quantity_gaps", "l_discount")])
    return rounded(made.select(*KEYS, "quantity_gaps_x_l_discount", "quantity_gaps_minus_l_discount"), 4)


def row_aggregates(spark, folder):
    made = f.row_aggregates(_lineitem(spark, folder), ["quantity_gaps", "l_discount", "l_tax"])
    return rounded(made.select(*KEYS, *[c for c in made.columns if c.startswith("_row")]), 5)


def group_means(spark, folder):
    made = f.row_aggregates(_lineitem(spark, folder), ["quantity_gaps", "l_tax"], "l_suppkey")
    return rounded(made.select(*KEYS, "quantity_gaps_group_mean", "l_tax_group_mean"))


def one_hot_columns(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.expr(PRIORITY).alias("priority"), "o_orderstatus")
    made = f.one_hot(orders, ["priority", "o_orderstatus"])
    renamed = made.withColumnsRenamed({c: c.replace("-", "_").replace(" ", "_").lower() for c in made.columns})
    return rounded(renamed)


def target_encoding(spark, folder):
    customers = table(spark, folder, "customer").select(
        "c_custkey", "c_acctbal", F.expr("CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_nationkey END").alias("nation")
    )
    return rounded(f.target_encode(customers, ["nation"], "c_acctbal"))


def target_encoding_fitted(spark, folder):
    """Codes come from other rows than the ones encoded."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    made = f.target_encode(customers, ["c_nationkey"], "c_acctbal", fit_on=customers.where("c_acctbal > 0 and c_nationkey <> 3"))
    return rounded(made)


def ordinal_encoding(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.expr(PRIORITY).alias("priority"), "o_orderstatus")
    return rounded(f.ordinal_encode(orders, ["priority", "o_orderstatus"], {"o_orderstatus": ["P", "O"]}))


def automatic_encoding(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    made = f.auto_encode(customers, ["c_nationkey", "c_mktsegment"], "c_acctbal")
    return rounded(made.withColumnsRenamed({c: c.lower() for c in made.columns}))


def automatic_encoding_without_target(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    return rounded(f.auto_encode(customers, ["nation"]))


def z_scores(spark, folder):
    made = f.scale(_lineitem(spark, folder).withColumn("same", F.lit(3.0)), ["quantity_gaps", "l_extendedprice", "same"])
    return rounded(made.select(*KEYS, "quantity_gaps", "l_extendedprice", "same"), 5)


def z_scores_by_segment(spark, folder):
    made = f.scale(_lineitem(spark, folder), ["l_extendedprice"], by=["l_returnflag"])
    return rounded(made.select(*KEYS, "l_extendedprice"), 5)


def unit_range(spark, folder):
    made = f.scale(table(spark, folder, "events"), ["value"], "minmax", ["event_type"])
    return rounded(made.select("event_id", "value"))


def scaled_and_back(spark, folder):
    events = table(spark, folder, "events")
    parameters = f.scale_parameters(events, ["value"])
    back = f.unscale(f.scale(events, ["value"], parameters=parameters), ["value"], parameters)
    return rounded(back.select("event_id", "value"))


def correlated_features(spark, folder):
    lineitem = _lineitem(spark, folder).withColumn("double_quantity", F.expr("l_quantity * 2 + l_tax"))
    kept, dropped = s.correlated_features(lineitem, ["l_quantity", "l_discount", "double_quantity"])
    facts = lineitem.groupBy().agg(F.count("*").alias("n"))
    listed = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(dropped.get(c)).alias("replaced_by")) for c in [*kept, *dropped]])
    return facts.select("n", F.explode(listed).alias("x")).select("n", "x.*")


def target_correlations(spark, folder):
    found = s.target_correlations(_lineitem(spark, folder), ["quantity_gaps", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice")
    return rounded(found, 4)


def variance_inflation(spark, folder):
    lineitem = _lineitem(spark, folder).withColumn("mix", F.expr("l_quantity + 100 * l_discount"))
    return rounded(s.variance_inflation(lineitem, ["l_extendedprice", "l_quantity", "mix"]), 4)


def variance_inflation_by_segment(spark, folder):
    return rounded(s.variance_inflation(_lineitem(spark, folder), ["l_extendedprice", "l_quantity"], ["l_returnflag"]), 4)


def vif_filter(spark, folder):
    lineitem = _lineitem(spark, folder).withColumn("double_quantity", F.expr("l_quantity * 2 + l_tax"))
    kept, history = s.vif_filter(lineitem, ["l_quantity", "l_discount", "double_quantity"])
    facts = lineitem.groupBy().agg(F.count("*").alias("n"))
    return facts.select("n", F.explode(F.array(*[F.lit(c) for c in kept])).alias("column"), F.lit(len(history)).cast("bigint").alias("rounds"))


def principal_components(spark, folder):
    lineitem = _lineitem(spark, folder).select(*KEYS, "quantity_gaps", "l_extendedprice")
    made, shares = s.principal_components(lineitem, ["quantity_gaps", "l_extendedprice"], n_components=2)
    return rounded(made.select(*KEYS, F.col("PC1").alias("pc1"), F.lit(shares[0]).alias("share1"), F.lit(shares[1]).alias("share2")), 4)


def lasso_selection(spark, folder):
    found = s.lasso_selection(_lineitem(spark, folder), ["quantity_gaps"], "l_extendedprice", 50.0)
    return rounded(found, 3)


def lasso_of_many(spark, folder):
    found = s.lasso_selection(_lineitem(spark, folder), ["quantity_gaps", "l_discount", "l_tax"], "l_extendedprice", 100.0)
    return rounded(found, 3)


def forest_selection(spark, folder):
    events = table(spark, folder, "events").withColumn("hour", F.hour("ts"))
    found = s.importance_selection(events, ["user_id", "hour", "event_id"], "value", top_k=2)
    return rounded(found, 4)


QUERIES = {
    x.__name__: x
    for x in (
        date_parts, event_hours, ratio_features, interaction_features, row_aggregates, group_means, one_hot_columns,
        target_encoding, target_encoding_fitted, ordinal_encoding, automatic_encoding, automatic_encoding_without_target,
        z_scores, z_scores_by_segment, unit_range, scaled_and_back, correlated_features, target_correlations,
        variance_inflation, variance_inflation_by_segment, vif_filter, principal_components, lasso_selection,
        lasso_of_many, forest_selection,
    )
}

LINEITEM = f"(SELECT *, {QUANTITY} AS quantity_gaps FROM lineitem)"
_KEYS = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey"
_ROW = "list_filter([quantity_gaps, l_discount, l_tax], lambda x: x IS NOT NULL)"


def _parts(c, *extra):
    parts = {
        "year": f"year({c})", "month": f"month({c})", "day": f"day({c})", "day_of_week": f"isodow({c}) - 1",
        "is_weekend": f"CASE WHEN isodow({c}) >= 6 THEN 1 ELSE 0 END", "quarter": f"quarter({c})", "week_of_year": f"weekofyear({c})",
    }
    return ", ".join(f"CAST({e} AS BIGINT) AS {c}_{n}" for n, e in parts.items())


def _codes(column, source):
    return f"""(SELECT {column} AS k, (count(c_acctbal) * avg(c_acctbal) + 10 * (SELECT avg(c_acctbal) FROM {source}))
      / (count(c_acctbal) + 10) AS code FROM {source} WHERE {column} IS NOT NULL GROUP BY 1)"""


_C9 = "(SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_nationkey END AS nation FROM customer)"
_FIT = "(SELECT * FROM customer WHERE c_acctbal > 0 AND c_nationkey <> 3)"
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_MIX = "(SELECT l_extendedprice AS a, l_quantity AS b, l_quantity + 100 * l_discount AS c FROM lineitem)"
_DET = "(1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc)"

ORACLES = {
    "date_parts": f"SELECT o_orderkey, {_parts('o_orderdate')} FROM orders",
    "event_hours": """SELECT hour(ts) AS ts_hour, isodow(ts) - 1 AS ts_day_of_week,
      CAST(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS ts_is_weekend, count(*) AS n FROM events GROUP BY 1, 2, 3""",
    "ratio_features": f"""SELECT {_KEYS}, {r('l_extendedprice / nullif(l_quantity, 0)', 8)} AS l_extendedprice_div_l_quantity,
      {r('quantity_gaps / nullif(l_discount, 0)', 8)} AS quantity_gaps_div_l_discount FROM {LINEITEM}""",
    "interaction_features": f"""SELECT {_KEYS}, {r('quantity_gaps * l_discount', 4)} AS quantity_gaps_x_l_discount,
      {r('quantity_gaps - l_discount', 4)} AS quantity_gaps_minus_l_discount FROM {LINEITEM}""",
    "row_aggregates": f"""SELECT {_KEYS}, {r(f'list_avg({_ROW})', 5)} AS _row_mean, {r(f'list_stddev_samp({_ROW})', 5)} AS _row_std,
      {r(f'list_max({_ROW})', 5)} AS _row_max, {r(f'list_min({_ROW})', 5)} AS _row_min,
      {r(f'list_max({_ROW}) - list_min({_ROW})', 5)} AS _row_range FROM {LINEITEM}""",
    "group_means": f"""SELECT {_KEYS}, {r('avg(quantity_gaps) OVER (PARTITION BY l_suppkey)')} AS quantity_gaps_group_mean,
      {r('avg(l_tax) OVER (PARTITION BY l_suppkey)')} AS l_tax_group_mean FROM {LINEITEM}""",
    "one_hot_columns": f"""SELECT o_orderkey, {', '.join(
        f"CAST(coalesce(CASE WHEN p = '{v}' THEN 1 ELSE 0 END, 0) AS BIGINT) AS priority_{v.replace('-', '_').replace(' ', '_').lower()}"
        for v in _PRIORITIES[1:])}, CAST(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS BIGINT) AS o_orderstatus_o,
      CAST(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS BIGINT) AS o_orderstatus_p
      FROM (SELECT *, {PRIORITY} AS p FROM orders)""",
    "target_encoding": f"""SELECT c_custkey, {r('c_acctbal')} AS c_acctbal,
      {r(f'coalesce(code, (SELECT avg(c_acctbal) FROM {_C9}))')} AS nation_target_encoded
      FROM {_C9} LEFT JOIN {_codes('nation', _C9)} ON k = nation""",
    "target_encoding_fitted": f"""SELECT c_custkey, {r('c_acctbal')} AS c_acctbal,
      {r(f'coalesce(code, (SELECT avg(c_acctbal) FROM {_FIT}))')} AS c_nationkey_target_encoded
      FROM customer LEFT JOIN {_codes('c_nationkey', _FIT)} ON k = c_nationkey""",
    "ordinal_encoding": f"""SELECT o_orderkey, (SELECT count(DISTINCT o_orderpriority) FROM orders x WHERE
        x.o_orderkey % 11 <> 0 AND x.o_orderpriority < p) + CASE WHEN p IS NULL THEN NULL ELSE 0 END AS priority,
      CAST(CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 END AS BIGINT) AS o_orderstatus
      FROM (SELECT *, {PRIORITY} AS p FROM orders)""",
    "automatic_encoding": f"""SELECT c_custkey, {r('c_acctbal')} AS c_acctbal, {r('code')} AS c_nationkey_target_encoded,
      {', '.join(f"CAST(CASE WHEN c_mktsegment = '{v}' THEN 1 ELSE 0 END AS BIGINT) AS c_mktsegment_{v.lower()}" for v in _SEGMENTS[1:])}
      FROM customer JOIN {_codes('c_nationkey', 'customer')} ON k = c_nationkey""",
    "automatic_encoding_without_target": """SELECT c_custkey, dense_rank() OVER (ORDER BY CAST(c_nationkey AS VARCHAR)) - 1 AS nation
      FROM customer""",
    "z_scores": f"""SELECT {_KEYS}, {r('(quantity_gaps - avg(quantity_gaps) OVER ()) / stddev_pop(quantity_gaps) OVER ()', 5)} AS quantity_gaps,
      {r('(l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER ()', 5)} AS l_extendedprice,
      CAST(3 AS DOUBLE) AS same FROM {LINEITEM}""",
    "z_scores_by_segment": f"""SELECT {_KEYS}, {r('(l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag)) / stddev_pop(l_extendedprice) OVER (PARTITION BY l_returnflag)', 5)}
      AS l_extendedprice FROM lineitem""",
    "unit_range": f"""SELECT event_id, {r('(value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w)')} AS value
      FROM events WINDOW w AS (PARTITION BY event_type)""",
    "scaled_and_back": f"SELECT event_id, {r('value')} AS value FROM events",
    "correlated_features": """SELECT n, "column", CASE WHEN "column" = 'l_quantity' AND abs(x) > 0.95 THEN 'double_quantity' END AS replaced_by
      FROM (SELECT count(*) AS n, corr(l_quantity, l_quantity * 2 + l_tax) AS x FROM lineitem),
        (SELECT unnest(['l_quantity', 'l_discount', 'double_quantity']) AS "column")""",
    "target_correlations": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {r(f'corr({c}, l_extendedprice)', 4)} AS r,
        abs(round(corr({c}, l_extendedprice), 4)) >= 0.05 AS selected FROM {LINEITEM}"""
        for c in ("quantity_gaps", "l_discount", "l_tax", "l_linenumber")
    ),
    "variance_inflation": " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", {r(f'(1 - {x} * {x}) / {_DET}', 4)} AS vif
        FROM (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM {_MIX})"""
        for n, x in (("l_extendedprice", "bc"), ("l_quantity", "ac"), ("mix", "ab"))
    ),
    "variance_inflation_by_segment": " UNION ALL ".join(
        f"""SELECT l_returnflag, '{c}' AS "column", {r('1 / (1 - pow(corr(l_extendedprice, l_quantity), 2))', 4)} AS vif
        FROM lineitem GROUP BY l_returnflag"""
        for c in ("l_extendedprice", "l_quantity")
    ),
    "vif_filter": """SELECT n, "column", 2 AS rounds FROM (SELECT count(*) AS n FROM lineitem),
      (SELECT unnest(['l_discount', 'double_quantity']) AS "column")""",
    "principal_components": f"""SELECT {_KEYS}, {r('(z1 + sign(rho) * z2) / sqrt(2)', 4)} AS pc1, {r('(1 + abs(rho)) / 2', 4)} AS share1, {r('(1 - abs(rho)) / 2', 4)} AS share2
      FROM (SELECT l.*, (quantity_gaps - m1) / s1 AS z1, (l_extendedprice - m2) / s2 AS z2, rho FROM {LINEITEM} l,
        (SELECT avg(quantity_gaps) AS m1, stddev_pop(quantity_gaps) AS s1, avg(l_extendedprice) AS m2,
          stddev_pop(l_extendedprice) AS s2, corr(quantity_gaps, l_extendedprice) AS rho FROM {LINEITEM}
          WHERE quantity_gaps IS NOT NULL))""",
    "lasso_selection": f"""SELECT 'quantity_gaps' AS "column", {r('sign(c) * greatest(abs(c) - 50.0, 0)', 3)} AS coefficient, abs(c) > 50 AS selected
      FROM (SELECT covar_pop(quantity_gaps, l_extendedprice) / stddev_pop(quantity_gaps) AS c FROM {LINEITEM} WHERE quantity_gaps IS NOT NULL)""",
}
