"""Linear, polynomial, trend, logistic and forest models, and the pipeline that feeds them."""

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.linalg import solve
from ..plans.moments import moments_row
from ..plans.order import positions
from ..plans.segments import TASK_ROWS, attach, is_numeric, measure, quoted
from ..plans.staging import cut, stored
from .evaluate import SEED, TEST_SHARE, classification_metrics, regression_metrics, split
from .forests import ForestClassifier, ForestRegressor
from .infer import fit_terms, predict_terms
from .preparation import FeaturePlan, fit_preparation

MIN_FIT_ROWS = 10
MIN_HOLDOUT_ROWS = 30
MIN_TREND_ROWS = 5
MIN_FOREST_ROWS = 30
HORIZON = 5
Z_95 = 1.96
LINEAR_IS_POOR = 0.6
CURVE_GAIN = 0.1


# ---- least squares -------------------------------------------------------------------------------

def linear_terms(predictors: Sequence[str]) -> dict[str, Column]:
    return {p: measure(p) for p in predictors}


def polynomial_terms(predictor: str, degree: int = 2) -> dict[str, Column]:
    return {f"{predictor}^{k}": F.pow(measure(predictor), F.lit(k)) for k in range(1, degree + 1)}


def linear_model(
    df: DataFrame, dependent: str, terms: dict[str, Column], by: Sequence[str] = (), min_rows: int = MIN_FIT_ROWS
) -> DataFrame:
    """(by..., n, intercept, coefficients, r2, adjusted_r2, mse, rmse, vif, ridge); segments with fewer rows are left out."""
    return fit_terms(df, measure(dependent), terms, by, min_rows)


def holdout(
    df: DataFrame,
    dependent: str,
    terms: dict[str, Column],
    key: Sequence[str],
    by: Sequence[str] = (),
    seed: int = SEED,
) -> DataFrame:
    """(by..., metrics): fitted on the training share, measured on the rest; for segments of 30 rows or more."""
    complete = df.where(measure(dependent).isNotNull())
    for term in terms.values():
        complete = complete.where(term.isNotNull())
    parted = split(complete, key, TEST_SHARE, seed=seed)
    fit = fit_terms(parted.where("split = 'train'"), measure(dependent), terms, by, 2)
    scored = predict_terms(parted.where("split = 'test'"), fit, None, terms, by)
    metrics = regression_metrics(scored, dependent, "prediction", by)
    sizes = complete.groupBy(*by).agg(F.count("*").alias("_rows"))
    return attach(metrics, sizes, by, few=False).where(F.col("_rows") >= MIN_HOLDOUT_ROWS).drop("_rows")


def score_linear(df: DataFrame, intercept: float, coefficients: dict[str, float], name: str = "prediction") -> DataFrame:
    """Add the linear prediction of given coefficients; null where a value is missing."""
    value = F.lit(float(intercept))
    for c, weight in coefficients.items():
        value = value + measure(c) * F.lit(float(weight))
    return df.withColumn(name, value)


def choose_model(df: DataFrame, dependent: str, predictors: Sequence[str], types: dict[str, str]) -> str:
    """The model that suits the types; one predictor is judged by its linear and quadratic fit."""
    if types.get(dependent) == "binary":
        return "logistic"
    if len(predictors) > 1:
        return "multiple"
    if not predictors:
        return "linear"
    if types.get(predictors[0]) == "datetime":
        return "timeseries"
    x = predictors[0]
    n, means, matrix = moments_row(df, {"y": measure(dependent), **polynomial_terms(x)})
    if n < MIN_FIT_ROWS:
        return "linear"
    upper = matrix[np.triu_indices(3)]
    line = solve(n, means[:2], [matrix[0, 0], matrix[0, 1], matrix[1, 1]])
    curve = solve(n, means, upper)
    if line["r2"] < LINEAR_IS_POOR and curve["r2"] > line["r2"] + CURVE_GAIN:
        return "polynomial"
    return "linear"


# ---- trend ---------------------------------------------------------------------------------------

def trend_rows(
    df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), task_rows: int = TASK_ROWS
) -> DataFrame:
    """The rows that hold a value, with ``position`` 0..n-1 in time order."""
    return positions(df.where(measure(value).isNotNull()), order, by, task_rows=task_rows)


def time_trend(
    df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), task_rows: int = TASK_ROWS
) -> DataFrame:
    """(by..., n, slope, intercept, r2, rmse, residual_std) of the value on its position in time order."""
    placed = trend_rows(df, value, order, by, task_rows)
    y, x = measure(value), F.col("position").cast("double")
    moments = placed.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(y).alias("my"), F.avg(x).alias("mx"), F.var_pop(x).alias("sxx"),
        F.covar_pop(x, y).alias("sxy"), F.var_pop(y).alias("syy"),
    ).where(F.col("n") >= MIN_TREND_ROWS)
    slope = F.col("sxy") / F.col("sxx")
    mse = F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0))
    return moments.select(
        *by, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"),
        F.when(F.col("syy") > 0, 1 - mse / F.col("syy")).otherwise(0.0).alias("r2"), F.sqrt(mse).alias("rmse"),
        F.sqrt(mse * F.col("n") / (F.col("n") - 1)).alias("residual_std"),
    )


def forecast(trend: DataFrame, by: Sequence[str] = (), horizon: int = HORIZON) -> DataFrame:
    """(by..., period, predicted, lower, upper) of the periods after the last one."""
    ahead = F.explode(F.sequence(F.col("n"), F.col("n") + (horizon - 1))).alias("position")
    rows = trend.select("*", ahead)
    value, width = F.col("intercept") + F.col("slope") * F.col("position"), Z_95 * F.col("residual_std")
    return rows.select(
        *by, (F.col("position") + 1).alias("period"), value.alias("predicted"),
        (value - width).alias("lower"), (value + width).alias("upper"),
    )


# ---- picks ---------------------------------------------------------------------------------------

def stride_sample(df: DataFrame, order: Sequence[str], most: int = 500, task_rows: int = TASK_ROWS) -> DataFrame:
    """Every n-th row in a unique order, so that about ``most`` points remain for a plot."""
    step = max(1, df.count() // most)
    placed = positions(df, order, name="_place", task_rows=task_rows)
    return placed.where(F.col("_place") % step == 0).drop("_place")


def typical_row(df: DataFrame, columns: Sequence[str], key: Sequence[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """The middle row by the sum of absolute values over the complete rows."""
    complete = df.dropna(subset=list(columns))
    size = sum((F.abs(measure(c)) for c in columns[1:]), F.abs(measure(columns[0])))
    placed = positions(complete.withColumn("_size", size), ["_size", *key], name="_place", task_rows=task_rows)
    middle = complete.count() // 2
    return placed.where(F.col("_place") == middle).drop("_size", "_place")


def two_largest_classes(df: DataFrame, target: str) -> list:
    """The two most frequent values, the smaller one first on equal counts."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
    return [r[target] for r in counts.orderBy(F.desc("n"), target).limit(2).collect()]


def binary_target(df: DataFrame, target: str) -> DataFrame:
    """Add ``label`` 0/1.

    Two values: the smaller is 0. More: the two most frequent ones stay, the most frequent is 0.
    """
    y = measure(target)
    facts = df.agg(F.min(y).alias("low"), F.max(y).alias("high"), F.bool_and(y.isin(0.0, 1.0)).alias("bits")).first()
    if facts["bits"]:
        return df.where(y.isNotNull()).withColumn("label", y)
    third = df.where(y.isNotNull() & (y != facts["low"]) & (y != facts["high"])).limit(1)
    if third.isEmpty():
        return df.where(y.isNotNull()).withColumn("label", F.when(y == facts["high"], 1.0).otherwise(0.0))
    first, second = two_largest_classes(df, target)
    kept = df.where(F.col(target).isin([first, second]))
    return kept.withColumn("label", F.when(F.col(target) == F.lit(first), 0.0).otherwise(1.0))


# ---- fitted by pyspark.ml ------------------------------------------------------------------------

@dataclass
class Fitted:
    """A fitted model with its scored rows and metrics."""

    kind: str
    predictors: list[str]
    model: object = None
    metrics: DataFrame | None = None
    rows: DataFrame | None = None
    coefficients: dict[str, float] = field(default_factory=dict)
    intercept: float | None = None
    importances: list[tuple[str, float]] = field(default_factory=list)
    extra: dict = field(default_factory=dict)


def measured(df: DataFrame, predictors: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., label, _x0, _x1...) of the complete rows."""
    rows = df.select(*keep, measure(label).alias("label"), *[measure(p).alias(f"_x{i}") for i, p in enumerate(predictors)])
    return rows.dropna(subset=["label", *[f"_x{i}" for i in range(len(predictors))]])


def assemble(df: DataFrame, predictors: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., label, features) of the complete rows."""
    return _gathered(measured(df, predictors, label, keep), predictors, keep)


def _gathered(rows: DataFrame, predictors: Sequence[str], keep: Sequence[str]) -> DataFrame:
    assembler = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(predictors))], outputCol="features")
    return assembler.transform(rows).select(*keep, "label", "features")


def with_score(scored: DataFrame) -> DataFrame:
    """Add ``score``, the probability of class 1, where the model gives probabilities."""
    if "probability" in scored.columns:
        return scored.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored


def logistic_regression(
    df: DataFrame, dependent: str, predictors: Sequence[str], key: Sequence[str], c: float = 100.0, seed: int = SEED
) -> Fitted:
    """Weakly penalised logistic regression on 80 percent of the rows, measured on the rest."""
    coded = binary_target(df, dependent)
    data = split(coded, key, TEST_SHARE, seed=seed)
    matrix = assemble(data, predictors, "label", [*key, "split"]).persist()
    train = matrix.where("split = 'train'")
    n = train.count()
    if n < MIN_FIT_ROWS:
        matrix.unpersist()
        return Fitted("logistic", list(predictors), extra={"note": "insufficient data"})

    def fit(strength, iterations):
        # The penalty of 1/(C n) per row mean equals the usual C form; the intercept is free.
        return LogisticRegression(
            regParam=1.0 / (strength * n), elasticNetParam=0.0, standardization=False, maxIter=iterations
        ).fit(train)

    model = fit(c, 5000)
    if model.summary.totalIterations >= 5000:
        model = fit(c / 10, 10000)
    # scored once; the metrics and the caller read what is written
    rows = cut(with_score(model.transform(matrix)).select(*key, "split", "label", "prediction", "score"))
    matrix.unpersist()
    tiny = 1e-15
    y, p = F.col("label"), F.col("score")
    metrics = classification_metrics(rows.where("split = 'test'"), "label", "prediction", "score")
    root = rows.where("split = 'test'").agg(F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"))
    training = rows.where("split = 'train'").agg(
        F.avg((y == F.col("prediction")).cast("double")).alias("train_accuracy"),
        F.sum(y * F.ln(p + tiny) + (1 - y) * F.ln(1 - p + tiny)).alias("_full"),
        F.avg(y).alias("_mean"), F.count("*").alias("_n"),
    )
    mean = F.col("_mean")
    null = F.col("_n") * (mean * F.ln(mean + tiny) + (1 - mean) * F.ln(1 - mean + tiny))
    training = training.select("train_accuracy", F.coalesce(1 - F.col("_full") / F.nullif(null, F.lit(0.0)), F.lit(0.0)).alias("mcfadden_r2"))
    return Fitted(
        "logistic", list(predictors), model, attach(attach(metrics, root), training), rows,
        dict(zip(predictors, (float(v) for v in model.coefficients))), float(model.intercept),
    )


def random_forest(
    df: DataFrame,
    dependent: str,
    predictors: Sequence[str],
    key: Sequence[str],
    trees: int = 50,
    depth: int = 10,
    seed: int = SEED,
) -> Fitted:
    """Random forest on 80 percent of the rows; a classifier when the target has at most two values."""
    data = split(df, key, TEST_SHARE, seed=seed)
    # columns on disk: vectors held in memory cost more than the trees, and the largest tables do not fit
    plain = stored(measured(data, predictors, dependent, [*key, "split"]))
    if plain.limit(MIN_FOREST_ROWS).count() < MIN_FOREST_ROWS:
        return Fitted("randomforest", list(predictors), extra={"note": "insufficient data"})
    narrow = _gathered(plain, predictors, [*key, "split"])
    ends = plain.agg(F.min("label").alias("low"), F.max("label").alias("high")).first()
    two = plain.where((F.col("label") != ends["low"]) & (F.col("label") != ends["high"])).isEmpty()
    matrix = narrow
    if two:
        matrix = narrow.withColumn("label", F.when(F.col("label") == ends["high"], 1.0).otherwise(0.0))
        forest = ForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)
    else:
        forest = ForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all")
    model = forest.fit(matrix.where("split = 'train'"))
    scored = with_score(model.transform(matrix))
    rows = stored(scored.select(*key, "split", "label", "prediction", *(["score"] if two else [])))
    test = rows.where("split = 'test'")
    if two:
        metrics = attach(
            classification_metrics(test, "label", "prediction", "score"),
            regression_metrics(test, "label", "prediction").select("r2"),
        )
    else:
        metrics = regression_metrics(test, "label", "prediction")
    values = model.featureImportances.toArray()
    total = float(values.sum()) or 1.0
    ranked = sorted(((p, float(v) / total) for p, v in zip(predictors, values)), key=lambda x: (-x[1], x[0]))
    return Fitted("randomforest", list(predictors), model, metrics, rows, importances=ranked)


# ---- pipeline ------------------------------------------------------------------------------------

def prepare(
    df: DataFrame, dependent: str, predictors: Sequence[str], types: dict[str, str], plan: FeaturePlan | None = None
) -> tuple[DataFrame, list[str], dict]:
    """A preparation learned on the table itself; returns the table, the final predictors and a report."""
    fitted = fit_preparation(df, dependent, predictors, types, plan)
    return fitted.apply(df), fitted.predictors, fitted.report


def fit_model(
    df: DataFrame,
    dependent: str,
    predictors: Sequence[str],
    key: Sequence[str],
    types: dict[str, str],
    model: str | None = None,
    plan: FeaturePlan | None = None,
    order: Sequence[str] = (),
) -> tuple[Fitted, dict]:
    """Choose a model, prepare the predictors and fit; the report tells what happened to the columns.

    The preparation and the coefficients are learned on the training rows alone, 80 percent by the hash of ``key``; the
    scored rows carry their ``split``, and ``extra`` holds the metrics of the test rows. Tables of fewer than 30 rows have no test rows.
    """
    known = [p for p in predictors if p in df.columns]
    kind = model or choose_model(df, dependent, known, types)
    if kind == "timeseries":
        time_order = list(order) or [known[0], *key]
        trend = time_trend(df, dependent, time_order)
        return Fitted(kind, known[:1], metrics=trend, rows=forecast(trend)), {"predictors": known[:1]}
    complete = df.where(measure(dependent).isNotNull() if is_numeric(df, dependent) else quoted(dependent).isNotNull())
    parted = split(complete, key, TEST_SHARE)
    if complete.limit(MIN_HOLDOUT_ROWS).count() < MIN_HOLDOUT_ROWS:
        parted = complete.withColumn("split", F.lit("train"))
    fitted = fit_preparation(parted.where("split = 'train'"), dependent, known, types, plan)
    data, chosen, report = fitted.apply(parted), fitted.predictors, {**fitted.report, "preparation": fitted}
    if kind == "logistic":
        return logistic_regression(data, dependent, chosen, key), report
    if kind == "randomforest":
        return random_forest(data, dependent, chosen, key), report
    terms = polynomial_terms(chosen[0]) if kind == "polynomial" and len(chosen) == 1 else linear_terms(chosen)
    fit = linear_model(data.where("split = 'train'"), dependent, terms)
    row = fit.first()
    if row is None:
        return Fitted(kind, chosen, extra={"note": "insufficient data"}), report
    rows = predict_terms(data, fit, measure(dependent), terms)
    return Fitted(
        kind, chosen, None, fit, rows, dict(zip(terms, row["coefficients"])), row["intercept"],
        extra={"holdout": regression_metrics(rows.where("split = 'test'"), dependent, "prediction"), "vif": dict(zip(terms, row["vif"]))},
    ), report
