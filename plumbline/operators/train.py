"""Training, tuning and comparing models on a split table."""

import random
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, functions as F

from ..plans.staging import cut
from . import features
from .evaluate import (
    SEED, TEST_SHARE, VALIDATION_SHARE, best_model, class_labels, classification_metrics, folds, label_at, label_index, long_metrics,
    problem_type, regression_metrics, split,
)
from .explain import REPEATS, explain
from .forests import ForestClassifier, ForestRegressor
from .models import assemble, with_score

MIN_ROWS = 10
DRAWS = 15

# Search spaces. Depth 30 stands for unlimited depth; it is the deepest tree Spark grows.
GRIDS = {
    "random_forest": {
        "numTrees": [50, 100, 200],
        "maxDepth": [30, 5, 10, 20],
        "minInstancesPerNode": [1, 5, 10],
        "featureSubsetStrategy": ["sqrt", "log2"],
    },
    "logistic": {"C": [0.01, 0.1, 1.0, 10.0], "maxIter": [1000, 2000]},
    "ridge": {"alpha": [0.01, 0.1, 1.0, 10.0]},
    "neural_network": {"hidden": [(32,), (64,), (32, 16)]},
    "gradient_boosting": {"maxIter": [50, 100, 200], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.05, 0.1]},
}


@dataclass
class Shape:
    """What estimators need to know about the training rows."""

    rows: int
    inputs: int
    classes: int = 0
    target_std: float = 1.0


@dataclass
class Experiment:
    problem: str
    features: list[str]
    sizes: dict[str, int] = field(default_factory=dict)
    metrics: DataFrame | None = None
    tuning: dict[str, dict] = field(default_factory=dict)
    models: dict[str, object] = field(default_factory=dict)
    best: str | None = None
    best_score: float | None = None
    cross_validation: dict[str, dict] = field(default_factory=dict)
    data: DataFrame | None = None
    # Class labels as given, in rising order; ``data``, models and metrics work on their places 0..k-1.
    labels: list[float] = field(default_factory=list)
    # What ``explain_best`` says of the winner, where it was asked for.
    explanation: dict[str, DataFrame] = field(default_factory=dict)

    def release(self) -> None:
        """Give back the memory that ``data`` is held in; it is computed again where it is used afterwards."""
        if self.data is not None:
            self.data.unpersist()

    def as_given(self, scored: DataFrame) -> DataFrame:
        """Scored rows with the class labels as given in ``label`` and ``prediction``."""
        if not self.labels:
            return scored
        return scored.withColumns({c: label_at(F.col(c), self.labels) for c in ("label", "prediction") if c in scored.columns})


def model_matrix(
    df: DataFrame, dependent: str, predictors: Sequence[str], key: Sequence[str], types: dict[str, str] | None = None
) -> tuple[DataFrame, list[str]]:
    """(key..., label, features) of the complete rows, categorical predictors one-hot, and the feature names."""
    types = types or {}
    known = [p for p in predictors if p in df.columns]
    named = [p for p in known if types.get(p) == "categorical"]
    names = [p for p in known if p not in named]
    encoded = df
    if named:
        levels = features.one_hot_levels(df, named)
        encoded = features.one_hot(df, named, levels)
        names += [f"{c}_{value}" for c in named for value in levels.get(c, [])]
    matrix = assemble(encoded, names, dependent, key)
    if not names or matrix.limit(MIN_ROWS).count() < MIN_ROWS:
        raise ValueError("too few complete rows or no usable feature")
    return matrix, names


def available_models(problem: str) -> list[str]:
    if problem == "classification":
        return ["random_forest", "logistic", "neural_network", "gradient_boosting"]
    return ["random_forest", "ridge", "gradient_boosting"]


def estimator(name: str, problem: str, shape: Shape, parameters: dict | None = None, seed: int = SEED):
    """An untrained model with the given parameters."""
    p = dict(parameters or {})
    classify = problem == "classification"
    if name == "random_forest":
        p.setdefault("numTrees", 100)
        p.setdefault("maxDepth", 30)
        return (ForestClassifier if classify else ForestRegressor)(seed=seed, **p)
    if name == "logistic":
        strength = p.pop("C", 1.0)
        return LogisticRegression(regParam=1.0 / (strength * shape.rows), standardization=False, **{"maxIter": 1000, **p})
    if name == "ridge":
        # Spark divides the penalty by the target's deviation; this undoes it.
        alpha = p.pop("alpha", 1.0)
        return LinearRegression(regParam=alpha / shape.rows * shape.target_std, elasticNetParam=0.0, standardization=False, solver="normal")
    if name == "neural_network":
        hidden = p.pop("hidden", (64, 32))
        return MultilayerPerceptronClassifier(layers=[shape.inputs, *hidden, shape.classes], maxIter=600, seed=seed, **p)
    if name == "gradient_boosting":
        p = {"maxIter": 20, "maxDepth": 5, **p}
        if not classify:
            return GBTRegressor(seed=seed, **p)
        tree = GBTClassifier(seed=seed, **p)
        return tree if shape.classes == 2 else OneVsRest(classifier=tree)
    if name == "linear":
        return LinearRegression(regParam=0.0)
    raise ValueError(f"unknown model {name!r}")


def combinations_of(name: str) -> list[dict]:
    grid = GRIDS.get(name, {})
    return [dict(zip(grid, values)) for values in product(*grid.values())] if grid else []


def evaluator(problem: str, shape: Shape):
    if problem == "regression":
        return RegressionEvaluator(metricName="r2")
    if shape.classes == 2:
        return BinaryClassificationEvaluator(metricName="areaUnderROC")
    return MulticlassClassificationEvaluator(metricName="accuracy")


def tune(
    train: DataFrame,
    name: str,
    problem: str,
    shape: Shape,
    key: Sequence[str],
    method: str = "random",
    draws: int = DRAWS,
    k: int = 3,
    parallelism: int = 4,
    seed: int = SEED,
) -> tuple[object, dict]:
    """The refitted best model of a grid or of seeded draws from it, and how it was found."""
    start = time.time()
    options = combinations_of(name)
    if method == "none" or not options:
        model = estimator(name, problem, shape, None, seed).fit(train)
        return model, {"method": "none", "parameters": {}, "score": None, "seconds": time.time() - start}
    if method != "grid":
        options = random.Random(seed).sample(options, min(draws, len(options)))
    parted = folds(train, key, k, "label" if problem == "classification" else None, seed).persist()
    judge = evaluator(problem, shape)
    base = estimator(name, problem, shape, options[0], seed)
    grid = []
    for option in options:
        candidate = estimator(name, problem, shape, option, seed)
        names = {p.name for p, _ in candidate.extractParamMap().items()}
        grid.append({base.getParam(n): candidate.getOrDefault(n) for n in names if n not in ("seed",)})
    cross = CrossValidator(
        estimator=base, estimatorParamMaps=grid, evaluator=judge, numFolds=k, foldCol="fold", parallelism=parallelism
    ).fit(parted)
    parted.unpersist()
    best = max(range(len(options)), key=lambda i: cross.avgMetrics[i])
    return cross.bestModel, {
        "method": method, "parameters": options[best], "score": float(cross.avgMetrics[best]), "folds": k,
        "seconds": time.time() - start,
    }


def cross_validate(
    train: DataFrame, name: str, problem: str, shape: Shape, key: Sequence[str], parameters: dict | None = None,
    k: int = 5, seed: int = SEED,
) -> dict:
    """Scores per fold with their mean and population deviation."""
    parted = folds(train, key, k, "label" if problem == "classification" else None, seed).persist()
    judge = evaluator(problem, shape)
    scores = []
    for i in range(k):
        model = estimator(name, problem, shape, parameters, seed).fit(parted.where(F.col("fold") != i))
        scores.append(float(judge.evaluate(model.transform(parted.where(F.col("fold") == i)))))
    parted.unpersist()
    mean = sum(scores) / k
    return {"scores": scores, "mean": mean, "std": (sum((s - mean) ** 2 for s in scores) / k) ** 0.5}


def measures(scored: DataFrame, problem: str, by: Sequence[str] = ()) -> DataFrame:
    if problem == "classification":
        score = "score" if "score" in scored.columns else None
        return classification_metrics(scored, "label", "prediction", score, by)
    return regression_metrics(scored, "label", "prediction", by)


def dummy_baseline(data: DataFrame, problem: str) -> DataFrame:
    """Test metrics of always predicting the training mean or the most frequent class."""
    train = data.where("split = 'train'")
    if problem == "classification":
        counts = train.groupBy("label").agg(F.count("*").alias("n"))
        guess = counts.agg(F.max_by("label", F.struct(F.col("n"), -F.col("label")))).first()[0]
    else:
        guess = train.agg(F.avg("label")).first()[0]
    scored = data.where("split = 'test'").withColumn("prediction", F.lit(guess))
    if problem == "classification":
        scored = scored.withColumn("score", F.lit(0.5))
    return measures(scored, problem)


def baselines(data: DataFrame, problem: str, shape: Shape, seed: int = SEED) -> DataFrame:
    """(model, metric, value) of the dummy and the plain linear or logistic model on the test rows."""
    name = "logistic" if problem == "classification" else "linear"
    model = estimator(name, problem, shape, None, seed).fit(data.where("split = 'train'"))
    scored = with_score(model.transform(data.where("split = 'test'")))
    parts = [
        long_metrics(dummy_baseline(data, problem)).withColumn("model", F.lit("dummy")),
        long_metrics(measures(scored, problem)).withColumn("model", F.lit("linear_logistic")),
    ]
    return parts[0].unionByName(parts[1]).select("model", "metric", "value")


def run_experiment(
    df: DataFrame,
    dependent: str,
    predictors: Sequence[str],
    key: Sequence[str],
    types: dict[str, str] | None = None,
    models: Sequence[str] | None = None,
    problem: str | None = None,
    method: str = "random",
    draws: int = DRAWS,
    k: int = 5,
    test: float = TEST_SHARE,
    validation: float = VALIDATION_SHARE,
    select_on: str = "validation",
    seed: int = SEED,
    explained: bool = False,
) -> Experiment:
    """Split, fit baselines, tune every model, measure on all parts, cross-validate, pick the best and, if asked, explain it.

    The best model is chosen on the validation part; ``select_on="test"`` chooses on the test part. Classes
    may have any numeric codes. Each model's measures are computed once. ``release`` the experiment when its rows are no longer needed.
    """
    matrix, names = model_matrix(df, dependent, predictors, key, types)
    problem = problem or problem_type(matrix, "label").first()["problem"]
    stratify = "label" if problem == "classification" else None
    labels = class_labels(matrix, "label") if stratify else []
    if labels:
        matrix = matrix.withColumn("label", label_index(F.col("label"), labels))
    data = split(matrix, key, test, validation, stratify, seed=seed).persist()
    sizes = {r["split"]: r["n"] for r in data.groupBy("split").agg(F.count("*").alias("n")).collect()}
    train = data.where("split = 'train'")
    std = train.agg(F.stddev_pop("label")).first()[0]
    shape = Shape(sizes.get("train", 0), len(names), len(labels), std or 1.0)
    found = Experiment(problem, names, sizes, data=data, labels=labels)
    metrics = cut(baselines(data, problem, shape, seed).withColumn("split", F.lit("test")))
    for name in [m for m in available_models(problem) if models is None or m in models]:
        model, how = tune(train, name, problem, shape, key, method, draws, min(k, 3) if method != "none" else k, seed=seed)
        scored = with_score(model.transform(data))
        columns = ["split", "label", "prediction", *(["score"] if "score" in scored.columns else [])]
        rows = long_metrics(measures(scored.select(*columns), problem, ["split"]), ["split"])
        metrics = metrics.unionByName(cut(rows.withColumn("model", F.lit(name))))
        found.models[name], found.tuning[name] = model, how
        found.cross_validation[name] = cross_validate(train, name, problem, shape, key, how["parameters"], k, seed)
    found.metrics = metrics.select("model", "split", "metric", "value")
    part = select_on if sizes.get(select_on) else "test"
    contest = found.metrics.where((F.col("split") == part) & F.col("model").isin(list(found.models)))
    winner = best_model(contest, "f1" if stratify else "r2", "accuracy").first()
    found.best, found.best_score = winner["model"], winner["score"]
    if explained:
        found.explanation = explain_best(found, key)
    return found


def explain_best(found: Experiment, key: Sequence[str], repeats: int = REPEATS, local_instances: int = 1, top: int | None = None) -> dict[str, DataFrame]:
    """Every explanation that suits the winner of an experiment: learned on its training rows, measured on its test rows.

    ``key`` names the key columns of the experiment's rows. Class labels are the places in ``found.labels``.
    """
    values = vector_to_array("features")
    wide = found.data.select(*key, "split", "label", *[F.get(values, F.lit(i)).alias(name) for i, name in enumerate(found.features)])
    parts = [wide.where(F.col("split") == part).drop("split") for part in ("train", "test")]
    return explain(*parts, found.models[found.best], found.features, "label", key, found.problem == "classification", repeats, local_instances, top)


def comparison(metrics: DataFrame) -> DataFrame:
    """One row per model with its train and test measures side by side."""
    wanted = metrics.where(F.col("split").isin("train", "test"))
    named = wanted.withColumn("_name", F.concat_ws("_", "split", "metric"))
    shown = ["test_accuracy", "test_f1", "test_auc", "train_accuracy", "test_r2", "test_rmse", "train_r2"]
    return named.groupBy("model").pivot("_name", shown).agg(F.max("value"))

