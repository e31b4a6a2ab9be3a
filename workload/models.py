"""Models, splits, metrics, training and explanation."""

from pyspark.sql import functions as F

from plumbline.operators import evaluate as e, explain as x, infer as i, models as m, train as t

from .common import r, rounded, table

QUANTITY = "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END"
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def _lineitem(spark, folder):
    return table(spark, folder, "lineitem").withColumns({
        "quantity_gaps": F.expr(QUANTITY),
        "returned": F.expr("CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"),
        "guess": F.expr("CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END"),
        "chance": F.expr("l_quantity / 50"),
        "estimate": F.expr("l_quantity * 1500"),
        "class3": F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"),
        "guess3": F.expr("l_linenumber % 4"),
    })


def _fit_columns(fit, names, by=()):
    return fit.select(
        *by, "n", "intercept", *[F.col("coefficients")[k].alias(f"b_{n}") for k, n in enumerate(names)], "r2", "adjusted_r2", "rmse"
    )


# ---- least squares and trend ---------------------------------------------------------------------

def simple_regression(spark, folder):
    fit = m.linear_model(_lineitem(spark, folder), "l_extendedprice", m.linear_terms(["quantity_gaps"]), ["l_returnflag"])
    return rounded(_fit_columns(fit, ["quantity"], ["l_returnflag"]), 4)


def regression_holdout(spark, folder):
    found = m.holdout(_lineitem(spark, folder), "l_extendedprice", m.linear_terms(["l_quantity"]), ["l_orderkey", "l_linenumber"])
    return rounded(found.select("n", "r2", "rmse", "mae"), 4)


def multiple_regression(spark, folder):
    fit = m.linear_model(_lineitem(spark, folder), "l_extendedprice", m.linear_terms(["l_quantity", "l_discount"]), ["l_linestatus"])
    return rounded(_fit_columns(fit, ["quantity", "discount"], ["l_linestatus"]), 4)


def ridge_fallback(spark, folder):
    """Two predictors of which one is twice the other."""
    lineitem = _lineitem(spark, folder).withColumn("twice", F.expr("l_quantity * 2"))
    fit = m.linear_model(lineitem, "l_extendedprice", m.linear_terms(["l_quantity", "twice"]))
    slope = F.col("coefficients")[0] + 2 * F.col("coefficients")[1]
    return rounded(fit.select("n", slope.alias("slope"), "r2", "ridge"), 3)


def polynomial_regression(spark, folder):
    events = table(spark, folder, "events").withColumn("hour", F.hour("ts"))
    fit = m.linear_model(events, "value", m.polynomial_terms("hour"), ["event_type"])
    return rounded(_fit_columns(fit, ["hour", "hour2"], ["event_type"]).drop("adjusted_r2"), 4)


def model_choice(spark, folder):
    lineitem = _lineitem(spark, folder).withColumn("bend", F.expr("(l_quantity - 25) * (l_quantity - 25)"))
    picks = {
        "binary": m.choose_model(lineitem, "returned", ["l_quantity"], {"returned": "binary"}),
        "several": m.choose_model(lineitem, "l_extendedprice", ["l_quantity", "l_tax"], {}),
        "dated": m.choose_model(lineitem, "l_extendedprice", ["l_shipdate"], {"l_shipdate": "datetime"}),
        "line": m.choose_model(lineitem, "l_extendedprice", ["l_quantity"], {}),
        "curve": m.choose_model(lineitem, "bend", ["l_quantity"], {}),
    }
    listed = F.array(*[F.struct(F.lit(k).alias("case"), F.lit(v).alias("model")) for k, v in picks.items()])
    return lineitem.groupBy().agg(F.count("*").alias("n")).select("n", F.explode(listed).alias("p")).select("n", "p.*")


def _daily(spark, folder):
    return table(spark, folder, "orders").groupBy("o_orderstatus", F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("total"))


def time_trend(spark, folder):
    return rounded(m.time_trend(_daily(spark, folder), "total", ["day"], ["o_orderstatus"]), 3)


def time_trend_of_events(spark, folder):
    """All events in time order, placed over ranges instead of in one partition."""
    return rounded(m.time_trend(table(spark, folder, "events"), "value", ["ts", "event_id"], task_rows=0), 6)


def forecast(spark, folder):
    trend = m.time_trend(_daily(spark, folder), "total", ["day"], ["o_orderstatus"])
    return rounded(m.forecast(trend, ["o_orderstatus"]), 2)


def trend_positions(spark, folder):
    return m.trend_rows(table(spark, folder, "events"), "value", ["ts", "event_id"], ["user_id"]).select("event_id", "position")


def linear_scores(spark, folder):
    scored = m.score_linear(_lineitem(spark, folder), 10.5, {"quantity_gaps": 2.0, "l_discount": -3.5})
    return rounded(scored.select("l_orderkey", "l_linenumber", "l_partkey", "prediction"), 4)


def stride_sample(spark, folder):
    return rounded(m.stride_sample(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"]), 2)


def typical_row(spark, folder):
    found = m.typical_row(table(spark, folder, "customer"), ["c_acctbal", "c_nationkey"], ["c_custkey"])
    return rounded(found.select("c_custkey", "c_acctbal", "c_nationkey"), 2)


def largest_classes(spark, folder):
    coded = m.binary_target(_lineitem(spark, folder), "class3")
    return rounded(coded.groupBy("l_returnflag", "label").agg(F.count("*").alias("n")))


# ---- splits and metrics --------------------------------------------------------------------------

def hash_split(spark, folder):
    parted = e.split(table(spark, folder, "orders"), ["o_orderkey"], validation=0.15)
    return parted.select("o_orderkey", "split")


def exact_split(spark, folder):
    return e.split(table(spark, folder, "orders"), ["o_orderkey"], exact=True).select("o_orderkey", "split")


def stratified_split(spark, folder):
    parted = e.split(table(spark, folder, "orders"), ["o_orderkey"], validation=0.15, stratify="o_orderstatus")
    return parted.select("o_orderkey", "split")


def stratified_folds(spark, folder):
    return rounded(e.folds(table(spark, folder, "orders"), ["o_orderkey"], 5, "o_orderpriority").select("o_orderkey", "fold"))


def plain_folds(spark, folder):
    return rounded(e.folds(table(spark, folder, "orders"), ["o_orderkey"], 5).select("o_orderkey", "fold"))


def problem_types(spark, folder):
    lineitem = _lineitem(spark, folder)
    parts = [
        e.problem_type(lineitem, c).withColumn("target", F.lit(c)) for c in ("returned", "l_quantity", "l_linenumber", "l_extendedprice")
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def regression_metrics(spark, folder):
    return rounded(e.regression_metrics(_lineitem(spark, folder), "l_extendedprice", "estimate", ["l_returnflag"]), 4)


def regression_bands(spark, folder):
    found = e.regression_quality(_lineitem(spark, folder), "l_extendedprice", "estimate", ["l_linestatus"])
    return rounded(found.drop("mape"), 3)


def classification_metrics(spark, folder):
    return rounded(e.classification_metrics(_lineitem(spark, folder), "returned", "guess", "chance", ["l_linestatus"]))


def classification_metrics_macro(spark, folder):
    return rounded(e.classification_metrics(_lineitem(spark, folder), "class3", "guess3"))


def classification_bands(spark, folder):
    return rounded(e.classification_quality(_lineitem(spark, folder), "returned", "guess", "chance"))


def metrics_of_labels(spark, folder):
    """Long metrics of a length rule against the quality labels of the documents."""
    labelled = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    judged = labelled.withColumn("guess", (F.col("n_chars") > 1000).cast("int"))
    return rounded(e.long_metrics(e.classification_metrics(judged, "quality", "guess", "n_chars")))


# ---- fitted models -------------------------------------------------------------------------------

def _embedded(spark, folder):
    vectors = table(spark, folder, "embeddings")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0]
    return vectors.select("vec_id", "label", *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(width)])


def logistic_metrics(spark, folder):
    fitted = m.logistic_regression(_lineitem(spark, folder), "returned", ["l_quantity", "l_extendedprice", "l_discount"], LINE_KEY)
    return rounded(fitted.metrics, 4)


def forest_metrics(spark, folder):
    fitted = m.random_forest(_lineitem(spark, folder), "l_extendedprice", ["l_quantity", "l_discount"], LINE_KEY)
    return rounded(fitted.metrics, 2)


def forest_of_classes(spark, folder):
    fitted = m.random_forest(_lineitem(spark, folder), "returned", ["l_quantity", "l_extendedprice"], LINE_KEY)
    return rounded(fitted.metrics, 3)


def logistic_facts(spark, folder):
    """The slopes of the likelihood vanish over the training rows; classes are cut at one half."""
    fitted = m.logistic_regression(
        _lineitem(spark, folder), "returned", ["l_quantity", "l_extendedprice", "l_discount"], ["l_orderkey", "l_linenumber", "l_quantity"]
    )
    train, error = F.col("split") == "train", F.col("score") - F.col("label")
    return fitted.rows.agg(
        F.count_if(~train).alias("n_test"), F.count_if(train).alias("n_train"),
        (F.abs(F.avg(F.when(train, error))) < 1e-4).alias("intercept_settled"),
        (F.abs(F.avg(F.when(train, error * F.col("l_quantity")))) < 1e-2).alias("slope_settled"),
        F.bool_and((F.col("score") > 0.5) == (F.col("prediction") == 1)).alias("cut_at_half"),
    )


def forest_facts(spark, folder):
    """Sizes of the parts; predictions within the training labels; shares of the importances."""
    fitted = m.random_forest(_lineitem(spark, folder), "l_extendedprice", ["l_quantity", "l_discount"], ["l_orderkey", "l_linenumber"])
    train, y, p = F.col("split") == "train", F.col("label"), F.col("prediction")
    mean = fitted.rows.where(train).agg(F.avg("label")).first()[0]
    return fitted.rows.agg(
        F.count_if(~train).alias("n_test"), F.count_if(train).alias("n_train"),
        ((F.min("prediction") >= F.min(F.when(train, y))) & (F.max("prediction") <= F.max(F.when(train, y)))).alias("within_labels"),
        (F.sum(F.when(train, (y - p) * (y - p))) < F.sum(F.when(train, (y - mean) * (y - mean)))).alias("learned"),
        F.lit(abs(sum(v for _, v in fitted.importances) - 1) < 1e-9).alias("shares_of_one"),
    )


def experiment_baselines(spark, folder):
    """The baselines of an experiment, which have a closed form."""
    found = t.run_experiment(table(spark, folder, "part"), "p_retailprice", ["p_size", "p_partkey"], ["p_partkey"], models=["ridge"])
    plain = found.metrics.where(F.col("model").isin("dummy", "linear_logistic") & F.col("metric").isin("rmse", "mae", "r2"))
    return rounded(plain.select("model", "metric", "value").withColumn("best", F.lit(found.best)), 3)


def prepared_fit(spark, folder):
    """Impute, create, encode, select, scale and fit."""
    plan = m.FeaturePlan(
        date_columns=["l_shipdate"], date_parts=["year", "month"], ratio_pairs=[("l_extendedprice", "l_quantity")],
        interaction_pairs=[("l_discount", "l_tax")], aggregate_columns=["l_discount", "l_tax"],
        drop_correlated=0.95, target_correlation=0.01, vif=10.0, scaling="standard",
    )
    types = {"l_returnflag": "categorical"}
    fitted, _ = m.fit_model(
        _lineitem(spark, folder), "l_extendedprice", ["quantity_gaps", "l_discount", "l_tax", "l_returnflag"], LINE_KEY, types, plan=plan
    )
    return rounded(fitted.rows.select("l_orderkey", "l_linenumber", "l_partkey", "prediction", "residual"), 2)


def preparation_parameters(spark, folder):
    """All that a preparation learns from the training rows."""
    rows = e.split(_lineitem(spark, folder), LINE_KEY)
    plan = m.FeaturePlan(date_columns=["l_shipdate"], date_parts=["year"], encoding="target", scaling="standard")
    fitted = m.fit_preparation(rows.where("split = 'train'"), "l_extendedprice", ["quantity_gaps", "l_discount", "l_tax", "l_returnflag"], {"l_returnflag": "categorical"}, plan)
    return rounded(fitted.parameters(rows), 5)


def prepared_rows(spark, folder):
    """Test rows prepared with what the training rows taught."""
    rows = e.split(_lineitem(spark, folder), LINE_KEY)
    plan = m.FeaturePlan(encoding="target", scaling="standard")
    fitted = m.fit_preparation(rows.where("split = 'train'"), "l_extendedprice", ["quantity_gaps", "l_discount", "l_returnflag"], {"l_returnflag": "categorical"}, plan)
    return rounded(fitted.apply(rows.where("split = 'test'")).select(*LINE_KEY, "quantity_gaps", "l_discount", "l_returnflag_target_encoded"), 5)


def components_parameters(spark, folder):
    """Principal components of two columns of the training rows."""
    rows = e.split(_lineitem(spark, folder), LINE_KEY)
    fitted = m.fit_preparation(rows.where("split = 'train'"), "l_discount", ["quantity_gaps", "l_extendedprice"], {}, m.FeaturePlan(pca=1.0))
    return rounded(fitted.parameters(rows).where("step = 'components'").select("column", "name", "value"), 5)


def components_fit(spark, folder):
    plan = m.FeaturePlan(pca=0.9, lasso=1.0)
    fitted, _ = m.fit_model(
        _lineitem(spark, folder), "l_extendedprice", ["quantity_gaps", "l_discount", "l_tax"], LINE_KEY, {}, plan=plan
    )
    return rounded(fitted.metrics.select("n", "r2", "rmse"), 3)


def dummy_baseline(spark, folder):
    data = e.split(_lineitem(spark, folder), ["l_orderkey", "l_linenumber"]).withColumn("label", F.col("l_extendedprice"))
    return rounded(t.dummy_baseline(data, "regression").select("n", "mse", "rmse", "mae"), 3)


def dummy_class_baseline(spark, folder):
    data = e.split(_lineitem(spark, folder), ["l_orderkey", "l_linenumber"]).withColumn("label", F.col("class3"))
    return rounded(t.dummy_baseline(data, "classification").select("n", "accuracy", "precision", "recall", "f1", "mcc"))


def experiment_regression(spark, folder):
    found = t.run_experiment(
        table(spark, folder, "part"), "p_retailprice", ["p_size", "p_partkey"], ["p_partkey"], models=["ridge", "random_forest"],
        draws=2, k=3,
    )
    return rounded(found.metrics, 3)


def experiment_classification(spark, folder):
    labelled = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    found = t.run_experiment(
        labelled, "quality", ["n_chars", "lang"], ["doc_id"], {"lang": "categorical"}, models=["logistic"], draws=2, k=2,
    )
    return rounded(t.comparison(found.metrics), 3)


def experiment_untuned(spark, folder):
    """Boosted trees with default parameters on the document labels."""
    labelled = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    found = t.run_experiment(labelled, "quality", ["n_chars"], ["doc_id"], models=["gradient_boosting"], method="none", k=2)
    return rounded(t.comparison(found.metrics), 2)


def network_fit(spark, folder):
    """A small network on the vector labels, measured on the test part."""
    vectors = _embedded(spark, folder)
    matrix, names = t.model_matrix(vectors, "label", [c for c in vectors.columns if c not in ("vec_id", "label")], ["vec_id"])
    data = e.split(matrix, ["vec_id"])
    classes = int(matrix.agg(F.max("label")).first()[0]) + 1
    network = t.estimator("neural_network", "classification", t.Shape(0, len(names), classes))
    scored = network.fit(data.where("split = 'train'")).transform(data.where("split = 'test'"))
    return rounded(t.measures(scored, "classification"), 2)


def cross_validation(spark, folder):
    events = table(spark, folder, "events").withColumn("hour", F.hour("ts"))
    matrix, names = t.model_matrix(events, "value", ["hour", "user_id"], ["event_id"])
    found = t.cross_validate(matrix, "ridge", "regression", t.Shape(events.count(), len(names)), ["event_id"])
    scores = F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(v).alias("score")) for k, v in enumerate(found["scores"])])
    return rounded(matrix.groupBy().agg(F.count("*").alias("n")).select("n", F.explode(scores).alias("s")).select("n", "s.*"), 4)


def best_model(spark, folder):
    """Rules on the line items compared by R2."""
    lineitem = _lineitem(spark, folder)
    parts = []
    for name, rule in (("small", "l_quantity * 1000"), ("fair", "l_quantity * 1500"), ("large", "l_quantity * 2000")):
        scored = lineitem.withColumn("estimate", F.expr(rule))
        parts.append(e.long_metrics(e.regression_metrics(scored, "l_extendedprice", "estimate")).withColumn("model", F.lit(name)))
    return rounded(e.best_model(parts[0].union(parts[1]).union(parts[2]), "r2"))


# ---- explanation ---------------------------------------------------------------------------------

WEIGHTS = {"l_quantity": 1500.0, "l_discount": -200.0, "l_tax": 50.0}


def permutation_importance(spark, folder):
    found = x.permutation_importance(
        _lineitem(spark, folder), x.linear_predictor(0.0, WEIGHTS), list(WEIGHTS), "l_extendedprice", LINE_KEY, False
    )
    return rounded(found.select("feature", "importance", "rank"), 3)


def linear_attributions(spark, folder):
    return rounded(x.shapley_linear(_lineitem(spark, folder), WEIGHTS, ["l_returnflag"]), 4)


def sampled_attributions(spark, folder):
    predict = lambda df: df.withColumn("prediction", F.col("l_quantity") * F.col("l_discount") + F.col("l_tax"))
    return rounded(x.shapley_sampled(_lineitem(spark, folder), predict, list(WEIGHTS), LINE_KEY), 4)


def local_surrogates(spark, folder):
    customers = table(spark, folder, "customer")
    predict = lambda df: df.withColumn("prediction", F.col("c_acctbal") * 2 + F.col("c_nationkey") * F.col("c_nationkey"))
    found = x.local_surrogate(customers, predict, ["c_acctbal", "c_nationkey"], ["c_custkey"], customers)
    return rounded(found, 3)


def partial_dependence(spark, folder):
    predict = lambda df: df.withColumn("prediction", F.col("l_quantity") * F.col("l_discount") + F.col("l_tax"))
    return rounded(x.partial_dependence(_lineitem(spark, folder), predict, list(WEIGHTS)), 8)


def linear_dependence(spark, folder):
    return rounded(x.partial_dependence_linear(_lineitem(spark, folder), 5.0, WEIGHTS), 4)


def coefficient_table(spark, folder):
    fit = m.linear_model(_lineitem(spark, folder), "l_extendedprice", m.linear_terms(["l_quantity", "l_discount"]), ["l_linestatus"])
    found = x.fit_coefficients(fit, ["l_quantity", "l_discount"], ["l_linestatus"])
    return rounded(x.coefficient_table(found, ["l_linestatus"]), 3)


def odds_table(spark, folder):
    """Log odds ratio of a return per line status as a coefficient."""
    rates = _lineitem(spark, folder).groupBy(F.col("l_linestatus").alias("feature")).agg(F.avg("returned").alias("p"))
    coefficients = rates.select("feature", F.ln(F.col("p") / (1 - F.col("p"))).alias("coefficient"))
    return rounded(x.coefficient_table(coefficients, classification=True), 4)


def forest_importance(spark, folder):
    lineitem = _lineitem(spark, folder)
    fitted = m.random_forest(lineitem, "l_extendedprice", ["l_quantity", "l_discount"], LINE_KEY)
    return rounded(x.builtin_importance(spark, fitted.model, ["l_quantity", "l_discount"]), 3)


def _attribution_levels(spark, folder):
    found = x.shapley_linear(_lineitem(spark, folder), WEIGHTS, ["l_returnflag"]).drop("share")
    return x.importance_levels(found, "mean_abs", ["l_returnflag"])


def importance_levels(spark, folder):
    return rounded(_attribution_levels(spark, folder).select("l_returnflag", "feature", "share", "level"), 3)


def top_features(spark, folder):
    found = x.top_features(x.shapley_linear(_lineitem(spark, folder), WEIGHTS), 2)
    return rounded(found.select("feature", "mean_abs", "rank"), 4)


def _ranks(spark, folder):
    first = x.shapley_linear(_lineitem(spark, folder), WEIGHTS).select(F.lit("attribution").alias("method"), "feature", "rank")
    found = i.pearson(_lineitem(spark, folder), [(c, "l_extendedprice") for c in WEIGHTS])
    second = x._ranked(found.select(F.col("column_a").alias("feature"), F.abs("r").alias("size")), "size")
    return first.unionByName(second.select(F.lit("correlation").alias("method"), "feature", "rank"))


def consensus_ranking(spark, folder):
    return rounded(x.consensus(_ranks(spark, folder)), 4)


def explanation_report(spark, folder):
    """All methods on a forest of the parts; the rows of the consensus."""
    parts = table(spark, folder, "part").withColumns({"size": F.col("p_size").cast("double"), "place": F.col("p_partkey").cast("double")})
    fitted = m.random_forest(parts, "p_retailprice", ["size", "place"], ["p_partkey"])
    data = e.split(parts, ["p_partkey"])
    report = x.explain(
        data.where("split = 'train'"), data.where("split = 'test'"), fitted.model, ["size", "place"], "p_retailprice", ["p_partkey"],
        False,
    )
    return rounded(report["consensus"], 3)


QUERIES = {
    q.__name__: q
    for q in (
        simple_regression, regression_holdout, multiple_regression, ridge_fallback, polynomial_regression, model_choice,
        time_trend, time_trend_of_events, forecast, trend_positions, linear_scores, stride_sample, typical_row,
        largest_classes, hash_split, exact_split, stratified_split, stratified_folds, plain_folds, problem_types,
        regression_metrics, regression_bands, classification_metrics, classification_metrics_macro, classification_bands,
        metrics_of_labels, logistic_metrics, forest_metrics, forest_of_classes, prepared_fit, preparation_parameters, prepared_rows, components_parameters, components_fit,
        dummy_baseline, dummy_class_baseline, experiment_regression, experiment_classification, experiment_untuned, network_fit,
        cross_validation, logistic_facts, forest_facts, experiment_baselines,
        best_model, permutation_importance, linear_attributions, sampled_attributions, local_surrogates,
        partial_dependence, linear_dependence, coefficient_table, odds_table, forest_importance, importance_levels,
        top_features, consensus_ranking, explanation_report,
    )
}

LINEITEM = f"""(SELECT *, {QUANTITY} AS quantity_gaps, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned,
  CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS guess, l_quantity / 50 AS chance, l_quantity * 1500 AS estimate,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS class3, l_linenumber % 4 AS guess3 FROM lineitem)"""


def _hash(*keys, salt="42"):
    text = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST(('0x' || substr(md5({text} || '|{salt}'), 1, 8)) AS BIGINT) / 4294967296.0)"


_DAILY = "(SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)"


def _trend(value, order, source, by="", digits=3):
    keys, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return f"""SELECT {keys} count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2,
      sqrt(var_pop(y) - pow(covar_pop(x, y), 2) / var_pop(x)) AS rmse,
      sqrt((var_pop(y) - pow(covar_pop(x, y), 2) / var_pop(x)) * count(*) / (count(*) - 1)) AS residual_std
      FROM (SELECT {keys} {value} AS y, row_number() OVER ({part} ORDER BY {order}) - 1 AS x FROM {source})
      {f'GROUP BY {by}' if by else ''}"""


def _two_predictors(y, x1, x2, source, by):
    return f"""SELECT {by}, n, my - b1 * m1 - b2 * m2 AS intercept, b1, b2, 1 - (syy - b1 * s1y - b2 * s2y) / syy AS r2,
      sqrt(syy - b1 * s1y - b2 * s2y) AS rmse
      FROM (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2
        FROM (SELECT {by}, count(*) AS n, avg({y}) AS my, avg({x1}) AS m1, avg({x2}) AS m2, var_pop({x1}) AS s11, var_pop({x2}) AS s22,
          covar_pop({x1}, {x2}) AS s12, covar_pop({x1}, {y}) AS s1y, covar_pop({x2}, {y}) AS s2y, var_pop({y}) AS syy
          FROM {source} GROUP BY {by}))"""


def _binary_metrics(keys, group, source):
    return f"""SELECT {keys} tp + tn + fp + fn AS n, (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fp) AS precision,
      tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1,
      (tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)) AS mcc, auc, prevalence
      FROM (SELECT {keys} CAST(count(*) FILTER (WHERE y = 1 AND p = 1) AS DOUBLE) AS tp,
          CAST(count(*) FILTER (WHERE y = 0 AND p = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE y = 0 AND p = 1) AS DOUBLE) AS fp,
          CAST(count(*) FILTER (WHERE y = 1 AND p = 0) AS DOUBLE) AS fn,
          (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * CAST(count(*) - sum(y) AS DOUBLE)) AS auc,
          avg(y) AS prevalence
        FROM (SELECT *, rank() OVER ({f'PARTITION BY {group}' if group else ''} ORDER BY s)
            + (count(*) OVER (PARTITION BY {f'{group}, ' if group else ''} s) - 1) / 2.0 AS rk FROM {source})
        {f'GROUP BY {group}' if group else ''})"""


_SCORED = f"(SELECT *, returned AS y, guess AS p, chance AS s FROM {LINEITEM})"
_MEASURES = ["accuracy", "precision", "recall", "f1", "mcc", "auc"]
_ROUNDED = ", ".join(f"{r(c)} AS {c}" for c in _MEASURES)
_DOCS = """(SELECT quality AS y, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p, n_chars AS s
  FROM labels JOIN documents ON labels.doc_id = documents.doc_id)"""
_MACRO = f"""SELECT {{keys}} CAST(sum(t) AS BIGINT) AS n, sum(hit) / sum(t) AS accuracy, avg(coalesce(hit / nullif(p, 0), 0)) AS precision,
    avg(coalesce(hit / nullif(t, 0), 0)) AS recall, avg(coalesce(2 * hit / nullif(p + t, 0), 0)) AS f1,
    coalesce((sum(hit) * sum(t) - sum(p * t)) / nullif(sqrt(pow(sum(t), 2) - sum(p * p)) * sqrt(pow(sum(t), 2) - sum(t * t)), 0), 0) AS mcc
  FROM (SELECT label, CAST(count(*) FILTER (WHERE y = label) AS DOUBLE) AS t, CAST(count(*) FILTER (WHERE p = label) AS DOUBLE) AS p,
      CAST(count(*) FILTER (WHERE y = label AND p = label) AS DOUBLE) AS hit
    FROM {{source}}, (SELECT DISTINCT label FROM (SELECT y AS label FROM {{source}} UNION ALL SELECT p FROM {{source}})) GROUP BY label)"""


def _placed(group, order):
    part = f"PARTITION BY {group}" if group else ""
    return f"(row_number() OVER ({part} ORDER BY {order}) - 0.5) / count(*) OVER ({part})"


_SPLIT = "CASE WHEN s < 0.2 THEN 'test' WHEN s < {} THEN 'validation' ELSE 'train' END AS split"
_TEST = f"{_hash('l_orderkey', 'l_linenumber')} < 0.2"


def _attributions(by=""):
    keys, over = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    parts = " UNION ALL ".join(
        f"""SELECT {keys} '{c}' AS feature, avg(abs({w} * ({c} - m))) AS mean_abs
        FROM (SELECT *, avg({c}) OVER ({over}) AS m FROM lineitem) {f'GROUP BY {by}' if by else ''}"""
        for c, w in WEIGHTS.items()
    )
    return f"""(SELECT {keys} feature, mean_abs, 100 * mean_abs / sum(mean_abs) OVER ({over}) AS share,
      row_number() OVER ({over} ORDER BY mean_abs DESC, feature) AS rank FROM ({parts}))"""


def _grid(c):
    values = f"(SELECT DISTINCT {c} AS v FROM lineitem)"
    return f"""(SELECT unnest(CASE WHEN (SELECT count(*) FROM {values}) < 50 THEN (SELECT list(v) FROM {values})
      ELSE (SELECT list_transform(range(50), lambda k: lo + (hi - lo) * k / 49.0) FROM
        (SELECT quantile_cont({c}, 0.05) AS lo, quantile_cont({c}, 0.95) AS hi FROM lineitem)) END) AS value)"""


_MEANS = "(SELECT avg(l_quantity) AS l_quantity, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax, avg(l_quantity * l_discount) AS qd FROM lineitem)"

def _learned(dependent="l_extendedprice"):
    """The training rows, their means, the filled rows, and the codes of the flags."""
    return f"""WITH train AS (SELECT * FROM {LINEITEM} WHERE {_hash(*LINE_KEY)} >= 0.2 AND {dependent} IS NOT NULL),
      means AS (SELECT avg(quantity_gaps) AS q, avg(l_discount) AS d, avg(l_tax) AS t, avg({dependent}) AS y, mode(l_returnflag) AS flag FROM train),
      filled AS (SELECT coalesce(quantity_gaps, q) AS quantity_gaps, l_discount, l_tax, l_extendedprice, year(l_shipdate) AS year, l_returnflag FROM train, means),
      codes AS (SELECT l_returnflag AS flag, (count(*) * avg({dependent}) + 10 * any_value(y)) / (count(*) + 10) AS code FROM train, means GROUP BY 1)"""


def _scaled(column, expression, source="filled"):
    return " UNION ALL ".join(
        f"SELECT 'scale' AS step, '{column}' AS \"column\", '{name}' AS name, {r(f'{call}({expression})', 5)} AS value, CAST(NULL AS VARCHAR) AS text FROM {source}"
        for name, call in (("shift", "avg"), ("width", "stddev_pop"))
    )


ORACLES = {
    "preparation_parameters": _learned() + " SELECT * FROM (" + " UNION ALL ".join([
        *(f"SELECT 'fill' AS step, '{c}' AS \"column\", 'mean' AS name, {r(v, 5)} AS value, CAST(NULL AS VARCHAR) AS text FROM means" for c, v in (("quantity_gaps", "q"), ("l_discount", "d"), ("l_tax", "t"))),
        "SELECT 'fill', 'l_returnflag', 'mode', NULL, flag FROM means",
        "SELECT 'dates', 'l_shipdate', 'year', NULL, NULL",
        f"SELECT 'target', 'l_returnflag', 'overall', {r('y', 5)}, NULL FROM means",
        f"SELECT 'target', 'l_returnflag', 'code', {r('code', 5)}, flag FROM codes",
        *(_scaled(c, c) for c in ("quantity_gaps", "l_discount", "l_tax")),
        _scaled("l_shipdate_year", "year"),
        _scaled("l_returnflag_target_encoded", "code", "filled JOIN codes ON filled.l_returnflag = codes.flag"),
    ]) + ")",
    "prepared_rows": _learned() + f""", coded AS (SELECT * FROM filled JOIN codes ON filled.l_returnflag = codes.flag),
      sizes AS (SELECT avg(quantity_gaps) AS q1, stddev_pop(quantity_gaps) AS q2, avg(l_discount) AS d1, stddev_pop(l_discount) AS d2, avg(code) AS c1, stddev_pop(code) AS c2 FROM coded)
      SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_shipdate, {r("(coalesce(quantity_gaps, q) - q1) / q2", 5)} AS quantity_gaps, {r("(l_discount - d1) / d2", 5)} AS l_discount,
        {r("(coalesce(code, y) - c1) / c2", 5)} AS l_returnflag_target_encoded
      FROM (SELECT * FROM {LINEITEM} WHERE {_hash(*LINE_KEY)} < 0.2) rows LEFT JOIN codes ON rows.l_returnflag = codes.flag, means, sizes""",
    "components_parameters": _learned("l_discount") + f""", paired AS (SELECT corr(quantity_gaps, l_extendedprice) AS c FROM filled)
      SELECT "column", name, value FROM ({_scaled("quantity_gaps", "quantity_gaps")} UNION ALL {_scaled("l_extendedprice", "l_extendedprice")})
      UNION ALL SELECT 'quantity_gaps', k, {r("sqrt(0.5)", 5)} FROM (VALUES ('PC1'), ('PC2')) v(k)
      UNION ALL SELECT 'l_extendedprice', k, {r("CASE WHEN (k = 'PC1') = (c > 0) THEN 1 ELSE -1 END * sqrt(0.5)", 5)} FROM paired, (VALUES ('PC1'), ('PC2')) v(k)""",
    "simple_regression": f"""SELECT l_returnflag, count(*) AS n, {r('regr_intercept(l_extendedprice, quantity_gaps)', 4)} AS intercept,
      {r('regr_slope(l_extendedprice, quantity_gaps)', 4)} AS b_quantity, {r('regr_r2(l_extendedprice, quantity_gaps)', 4)} AS r2,
      {r('1 - (1 - regr_r2(l_extendedprice, quantity_gaps)) * (count(*) - 1) / (count(*) - 2)', 4)} AS adjusted_r2,
      {r('sqrt(var_pop(l_extendedprice) * (1 - regr_r2(l_extendedprice, quantity_gaps)))', 4)} AS rmse
      FROM {LINEITEM} WHERE quantity_gaps IS NOT NULL GROUP BY l_returnflag""",
    "regression_holdout": f"""SELECT count(*) AS n, {r('1 - avg(pow(y - p, 2)) / var_pop(y)', 4)} AS r2, {r('sqrt(avg(pow(y - p, 2)))', 4)} AS rmse,
      {r('avg(abs(y - p))', 4)} AS mae FROM (SELECT l_extendedprice AS y, a + b * l_quantity AS p FROM lineitem,
        (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem WHERE NOT {_TEST})
        WHERE {_TEST})""",
    "multiple_regression": f"""SELECT l_linestatus, n, {r('intercept', 4)} AS intercept, {r('b1', 4)} AS b_quantity, {r('b2', 4)} AS b_discount,
      {r('r2', 4)} AS r2, {r('1 - (1 - r2) * (n - 1) / (n - 3)', 4)} AS adjusted_r2, {r('rmse', 4)} AS rmse
      FROM ({_two_predictors('l_extendedprice', 'l_quantity', 'l_discount', 'lineitem', 'l_linestatus')})""",
    "ridge_fallback": f"""SELECT count(*) AS n, {r('regr_slope(l_extendedprice, l_quantity)', 3)} AS slope,
      {r('regr_r2(l_extendedprice, l_quantity)', 3)} AS r2, CAST(0.001 AS DOUBLE) AS ridge FROM lineitem""",
    "polynomial_regression": f"""SELECT event_type, n, {r('intercept', 4)} AS intercept, {r('b1', 4)} AS b_hour, {r('b2', 4)} AS b_hour2,
      {r('r2', 4)} AS r2, {r('rmse', 4)} AS rmse
      FROM ({_two_predictors('value', 'h', 'h2', '(SELECT *, CAST(hour(ts) AS DOUBLE) AS h, CAST(hour(ts) * hour(ts) AS DOUBLE) AS h2 FROM events)', 'event_type')})""",
    "model_choice": """SELECT count(*) AS n, unnest(['binary', 'several', 'dated', 'line', 'curve']) AS "case",
      unnest(['logistic', 'multiple', 'timeseries', 'linear', CASE WHEN regr_r2((l_quantity - 25) * (l_quantity - 25), l_quantity) < 0.6
        THEN 'polynomial' ELSE 'linear' END]) AS model FROM lineitem""",
    "time_trend": f"""SELECT o_orderstatus, n, {r('slope', 3)} AS slope, {r('intercept', 3)} AS intercept, {r('r2', 3)} AS r2, {r('rmse', 3)} AS rmse,
      {r('residual_std', 3)} AS residual_std FROM ({_trend('total', 'day', _DAILY, 'o_orderstatus')})""",
    "time_trend_of_events": f"""SELECT n, {r('slope')} AS slope, {r('intercept')} AS intercept, {r('r2')} AS r2, {r('rmse')} AS rmse,
      {r('residual_std')} AS residual_std FROM ({_trend('value', 'ts, event_id', 'events')})""",
    "forecast": f"""SELECT o_orderstatus, n + k + 1 AS period, {r('intercept + slope * (n + k)', 2)} AS predicted,
      {r('intercept + slope * (n + k) - 1.96 * residual_std', 2)} AS lower, {r('intercept + slope * (n + k) + 1.96 * residual_std', 2)} AS upper
      FROM ({_trend('total', 'day', _DAILY, 'o_orderstatus')}), range(5) AS g(k)""",
    "trend_positions": "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position FROM events",
    "linear_scores": f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey,
      {r('10.5 + 2.0 * quantity_gaps - 3.5 * l_discount', 4)} AS prediction FROM {LINEITEM}""",
    "stride_sample": """SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders
      QUALIFY (row_number() OVER (ORDER BY o_orderkey) - 1) % greatest(1, count(*) OVER () // 500) = 0""",
    "typical_row": """SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer
      QUALIFY row_number() OVER (ORDER BY abs(c_acctbal) + abs(c_nationkey), c_custkey) - 1 = count(*) OVER () // 2""",
    "largest_classes": """SELECT l_returnflag, CAST(place - 1 AS DOUBLE) AS label, n FROM (SELECT l_returnflag, count(*) AS n,
      row_number() OVER (ORDER BY count(*) DESC, l_returnflag) AS place FROM lineitem GROUP BY 1) WHERE place <= 2""",
    "hash_split": f"SELECT o_orderkey, {_SPLIT.format(0.35)} FROM (SELECT o_orderkey, {_hash('o_orderkey')} AS s FROM orders)",
    "exact_split": f"SELECT o_orderkey, {_SPLIT.format(0.2)} FROM (SELECT o_orderkey, {_placed('', _hash('o_orderkey') + ', o_orderkey')} AS s FROM orders)",
    "stratified_split": f"""SELECT o_orderkey, {_SPLIT.format(0.35)} FROM (SELECT o_orderkey,
      {_placed('o_orderstatus', _hash('o_orderkey') + ', o_orderkey')} AS s FROM orders)""",
    "stratified_folds": f"""SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_hash('o_orderkey', salt='fold42')}, o_orderkey) - 1) % 5 AS fold
      FROM orders""",
    "plain_folds": f"SELECT o_orderkey, CAST(floor({_hash('o_orderkey', salt='fold42')} * 5) AS BIGINT) AS fold FROM orders",
    "problem_types": " UNION ALL ".join(
        f"""SELECT '{c}' AS target, CASE WHEN count(DISTINCT {c}) <= 10 AND bool_and({c} = floor({c})) AND max({c}) - min({c}) <= 10
        THEN 'classification' ELSE 'regression' END AS problem FROM {LINEITEM}"""
        for c in ("returned", "l_quantity", "l_linenumber", "l_extendedprice")
    ),
    "regression_metrics": f"""SELECT l_returnflag, count(*) AS n, {r('1 - avg(pow(y - p, 2)) / var_pop(y)', 4)} AS r2, {r('avg(pow(y - p, 2))', 4)} AS mse,
      {r('sqrt(avg(pow(y - p, 2)))', 4)} AS rmse, {r('avg(abs(y - p))', 4)} AS mae, {r('100 * avg(abs((y - p) / nullif(y, 0)))', 4)} AS mape
      FROM (SELECT l_returnflag, l_extendedprice AS y, estimate AS p FROM {LINEITEM}) GROUP BY 1""",
    "regression_bands": f"""SELECT l_linestatus, n, {r('r2', 3)} AS r2, {r('mse', 3)} AS mse, {r('sqrt(mse)', 3)} AS rmse, {r('mae', 3)} AS mae,
      {r('share', 3)} AS error_share,
      CASE WHEN r2 > 0.8 THEN 'excellent' WHEN r2 > 0.6 THEN 'good' WHEN r2 > 0.4 THEN 'moderate' WHEN r2 > 0.2 THEN 'weak' ELSE 'poor' END AS quality,
      CASE WHEN share < 5 THEN 'highly accurate' WHEN share < 15 THEN 'acceptable' WHEN share < 30 THEN 'improvable' ELSE 'needs refinement' END AS error_band,
      CASE WHEN share < 10 THEN 'low' ELSE 'medium' END AS error_magnitude,
      CASE WHEN sqrt(mse) / sd < 0.5 THEN 'much better than the mean' WHEN sqrt(mse) / sd < 1 THEN 'better than the mean'
        ELSE 'not better than the mean' END AS error_vs_spread,
      CASE WHEN r2 > 0.7 THEN 'high' WHEN r2 > 0.4 THEN 'moderate' ELSE 'low' END AS confidence
      FROM (SELECT l_linestatus, count(*) AS n, 1 - avg(pow(y - p, 2)) / var_pop(y) AS r2, avg(pow(y - p, 2)) AS mse, avg(abs(y - p)) AS mae,
          stddev_pop(y) AS sd, 100 * abs(sqrt(avg(pow(y - p, 2))) / avg(y)) AS share
        FROM (SELECT l_linestatus, l_extendedprice AS y, estimate AS p FROM {LINEITEM}) GROUP BY 1)""",
    "classification_metrics": f"""SELECT l_linestatus, CAST(n AS BIGINT) AS n, {_ROUNDED} FROM ({_binary_metrics('l_linestatus,', 'l_linestatus', _SCORED)})""",
    "classification_metrics_macro": f"""SELECT n, {', '.join(f'{r(c)} AS {c}' for c in _MEASURES[:-1])}, CAST(NULL AS DOUBLE) AS auc
      FROM ({_MACRO.format(keys='', source=f'(SELECT class3 AS y, guess3 AS p FROM {LINEITEM})')})""",
    "classification_bands": f"""SELECT CAST(n AS BIGINT) AS n, {_ROUNDED}, {r('prevalence')} AS prevalence,
      CASE WHEN accuracy > 0.9 THEN 'highly reliable' WHEN accuracy > 0.8 THEN 'good' WHEN accuracy > 0.7 THEN 'acceptable'
        WHEN accuracy > 0.6 THEN 'marginal' ELSE 'not reliable' END AS accuracy_band,
      CASE WHEN precision > 0.85 THEN 'very trustworthy' WHEN precision > 0.7 THEN 'few false alarms'
        WHEN precision > 0.5 THEN 'moderate false alarms' ELSE 'high false alarm rate' END AS precision_band,
      CASE WHEN recall > 0.85 THEN 'very few missed' WHEN recall > 0.7 THEN 'some missed' WHEN recall > 0.5 THEN 'many missed'
        ELSE 'most missed' END AS recall_band,
      CASE WHEN f1 > 0.85 THEN 'strong' WHEN f1 > 0.7 THEN 'good' WHEN f1 > 0.5 THEN 'moderate' ELSE 'poor' END AS f1_band,
      CASE WHEN auc > 0.9 THEN 'excellent' WHEN auc > 0.8 THEN 'good' WHEN auc > 0.7 THEN 'moderate' WHEN auc > 0.6 THEN 'weak'
        ELSE 'no better than random' END AS auc_band,
      CASE WHEN prevalence > 0.3 AND prevalence < 0.7 THEN 'balanced' ELSE 'imbalanced' END AS balance,
      CASE WHEN (f1 + auc) / 2 > 0.85 THEN 'high' WHEN (f1 + auc) / 2 > 0.7 THEN 'moderate' ELSE 'low' END AS confidence
      FROM ({_binary_metrics('', '', _SCORED)})""",
    "metrics_of_labels": " UNION ALL ".join(
        f"SELECT '{c}' AS metric, {r(c)} AS value FROM ({_binary_metrics('', '', _DOCS)})" for c in ["n", *_MEASURES]
    ),
    "dummy_baseline": f"""SELECT count(*) AS n, {r('avg(pow(y - g, 2))', 3)} AS mse, {r('sqrt(avg(pow(y - g, 2)))', 3)} AS rmse, {r('avg(abs(y - g))', 3)} AS mae
      FROM (SELECT l_extendedprice AS y, (SELECT avg(l_extendedprice) FROM lineitem WHERE NOT {_TEST}) AS g FROM lineitem WHERE {_TEST})""",
    "dummy_class_baseline": f"""SELECT n, {', '.join(f'{r(c)} AS {c}' for c in _MEASURES[:-1])} FROM ({_MACRO.format(keys='', source=f'''
      (SELECT class3 AS y, (SELECT class3 FROM {LINEITEM} WHERE NOT {_TEST} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS p FROM {LINEITEM} WHERE {_TEST})''')})""",
    "best_model": " ".join(["SELECT model, score FROM (", " UNION ALL ".join(
        f"SELECT '{n}' AS model, {r(f'1 - avg(pow(l_extendedprice - l_quantity * {k}, 2)) / var_pop(l_extendedprice)')} AS score FROM lineitem"
        for n, k in (("small", 1000), ("fair", 1500), ("large", 2000))
    ), ") ORDER BY score DESC, model LIMIT 1"]),
    "linear_attributions": f"""SELECT l_returnflag, feature, {r('mean_abs', 4)} AS mean_abs, {r('share', 4)} AS share, rank
      FROM {_attributions('l_returnflag')}""",
    "partial_dependence": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r('value', 8)} AS value, {r(e_, 8)} AS average FROM {_grid(c)}, {_MEANS} means"
        for c, e_ in (
            ("l_quantity", "value * means.l_discount + means.l_tax"), ("l_discount", "value * means.l_quantity + means.l_tax"),
            ("l_tax", "means.qd + value"),
        )
    ),
    "linear_dependence": " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, {r('value', 4)} AS value, {r(f'5.0 + 1500 * means.l_quantity - 200 * means.l_discount + 50 * means.l_tax + {w} * (value - means.{c})', 4)}
        AS average FROM {_grid(c)}, {_MEANS} means"""
        for c, w in WEIGHTS.items()
    ),
    "coefficient_table": f"""SELECT l_linestatus, feature, {r('b', 3)} AS coefficient, {r('100 * abs(b) / total', 3)} AS share,
      CASE WHEN b > 0 THEN 'positive' ELSE 'negative' END AS direction, CAST(NULL AS DOUBLE) AS odds_ratio,
      row_number() OVER (PARTITION BY l_linestatus ORDER BY abs(b) DESC, feature) AS rank
      FROM (SELECT l_linestatus, unnest(['l_quantity', 'l_discount']) AS feature, unnest([b1, b2]) AS b, abs(b1) + abs(b2) AS total
        FROM ({_two_predictors('l_extendedprice', 'l_quantity', 'l_discount', 'lineitem', 'l_linestatus')}))""",
    "odds_table": f"""SELECT feature, {r('b', 4)} AS coefficient, {r('100 * abs(b) / sum(abs(b)) OVER ()', 4)} AS share,
      CASE WHEN b > 0 THEN 'positive' ELSE 'negative' END AS direction, {r('exp(b)', 4)} AS odds_ratio,
      row_number() OVER (ORDER BY abs(b) DESC, feature) AS rank
      FROM (SELECT l_linestatus AS feature, ln(avg(returned) / (1 - avg(returned))) AS b FROM {LINEITEM} GROUP BY 1)""",
    "importance_levels": f"""SELECT l_returnflag, feature, {r('share', 3)} AS share, CASE WHEN share > 30 THEN 'dominant' WHEN share > 15 THEN 'major'
      WHEN share > 5 THEN 'moderate' ELSE 'minor' END AS level FROM {_attributions('l_returnflag')}""",
    "top_features": f"SELECT feature, {r('mean_abs', 4)} AS mean_abs, rank FROM {_attributions()} WHERE rank <= 2",
    "consensus_ranking": f"""SELECT feature, {r('avg(rank)', 4)} AS average_rank, count(*) AS methods,
      row_number() OVER (ORDER BY avg(rank), feature) AS consensus_rank FROM (SELECT feature, rank FROM {_attributions()} UNION ALL
        SELECT feature, row_number() OVER (ORDER BY size DESC, feature) AS rank FROM ({' UNION ALL '.join(
          f"SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS size FROM lineitem" for c in WEIGHTS)})) GROUP BY feature""",
    "cross_validation": f"""WITH e AS (SELECT value AS y, CAST(hour(ts) AS DOUBLE) AS h, CAST(user_id AS DOUBLE) AS u,
        CAST(floor({_hash('event_id', salt='fold42')} * 5) AS BIGINT) AS f FROM events WHERE value IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL),
      parts AS (SELECT g.i AS fold, e.* FROM e, range(5) AS g(i) WHERE e.f <> g.i),
      fits AS ({_two_predictors('y', 'h', 'u', 'parts', 'fold')})
      SELECT (SELECT count(*) FROM e) AS n, fold, {r('1 - avg(pow(y - intercept - b1 * h - b2 * u, 2)) / var_pop(y)', 4)} AS score
      FROM e JOIN fits ON f = fold GROUP BY fold""",
    "logistic_facts": f"""SELECT count(*) FILTER (WHERE s < 0.2) AS n_test, count(*) FILTER (WHERE s >= 0.2) AS n_train, true AS intercept_settled,
      true AS slope_settled, true AS cut_at_half FROM (SELECT {_hash('l_orderkey', 'l_linenumber', 'l_quantity')} AS s FROM lineitem)""",
    "forest_facts": f"""SELECT count(*) FILTER (WHERE {_TEST}) AS n_test, count(*) FILTER (WHERE NOT {_TEST}) AS n_train, true AS within_labels,
      true AS learned, true AS shares_of_one FROM lineitem""",
    "experiment_baselines": f"""WITH e AS (SELECT 1 AS g, p_retailprice AS y, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey AS DOUBLE) AS b, {_hash('p_partkey')} AS s FROM part),
      train AS (SELECT * FROM e WHERE s >= 0.35),
      fit AS ({_two_predictors('y', 'a', 'b', 'train', 'g')}),
      scored AS (
        SELECT 'dummy' AS model, y, (SELECT avg(y) FROM train) AS p FROM e WHERE s < 0.2
        UNION ALL SELECT 'linear_logistic', y, intercept + b1 * a + b2 * b FROM e, fit WHERE s < 0.2),
      found AS (SELECT model, sqrt(avg(pow(y - p, 2))) AS rmse, avg(abs(y - p)) AS mae, 1 - avg(pow(y - p, 2)) / var_pop(y) AS r2 FROM scored GROUP BY model)
      SELECT model, unnest(['rmse', 'mae', 'r2']) AS metric, unnest([{r('rmse', 3)}, {r('mae', 3)}, {r('r2', 3)}]) AS value, 'ridge' AS best FROM found""",
}
