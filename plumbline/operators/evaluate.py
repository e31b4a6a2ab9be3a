"""Splits, folds and metrics."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bands import classification_bands, regression_bands
from ..plans.order import running_total
from ..plans.segments import attach, measure

TEST_SHARE = 0.2
VALIDATION_SHARE = 0.15
SEED = 42
FEW_CLASSES = 10


# ---- splits --------------------------------------------------------------------------------------

def hash_share(key: Sequence[str], seed: int | str = SEED) -> Column:
    """A number in [0, 1) that depends on the key and the seed only, however rows are partitioned."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def _cut_points(share: Column, test: float, validation: float) -> Column:
    return F.when(share < test, "test").when(share < test + validation, "validation").otherwise("train")


def split(
    df: DataFrame,
    key: Sequence[str],
    test: float = TEST_SHARE,
    validation: float = 0.0,
    stratify: str | None = None,
    exact: bool = False,
    seed: int = SEED,
) -> DataFrame:
    """Add ``split``: train, validation or test.

    The plain form is a projection. ``exact`` and ``stratify`` order the rows (of each class) by
    hash, so that the shares hold to the row.
    """
    if stratify is None and not exact:
        return df.withColumn("split", _cut_points(hash_share(key, seed), test, validation))
    by = [stratify] if stratify else []
    hashed = df.withColumn("_h", hash_share(key, seed))
    placed = running_total(hashed, ["_h", *key], by, name="_place")
    sizes = df.groupBy(*by).agg(F.count("*").alias("_size"))
    share = (F.col("_place") + 0.5) / F.col("_size")
    return attach(placed, sizes, by).withColumn("split", _cut_points(share, test, validation)).drop("_h", "_place", "_size")


def folds(
    df: DataFrame, key: Sequence[str], k: int = 5, stratify: str | None = None, seed: int = SEED
) -> DataFrame:
    """Add ``fold`` 0..k-1; stratified folds deal out the rows of each class in turn."""
    # Another hash than that of the split, so that the training rows fall into all folds.
    hashed = hash_share(key, f"fold{seed}")
    if stratify is None:
        return df.withColumn("fold", F.floor(hashed * k).cast("int"))
    placed = running_total(df.withColumn("_h", hashed), ["_h", *key], [stratify], name="_place")
    return placed.withColumn("fold", (F.col("_place") % k).cast("int")).drop("_h", "_place")


def problem_type(df: DataFrame, target: str) -> DataFrame:
    """(problem): classification for at most ten whole values within a range of ten."""
    y = measure(target)
    facts = df.agg(F.bool_and(y == F.floor(y)).alias("whole"), F.min(y).alias("low"), F.max(y).alias("high"))
    # Whole values within a span of ten are at most eleven different ones, so they can be listed.
    narrow = F.col("whole") & (F.col("high") - F.col("low") <= FEW_CLASSES)
    known = attach(df.select(y.alias("_y")), facts)
    kinds = F.size(F.collect_set(F.when(narrow, F.col("_y"))))
    listed = known.agg(kinds.alias("kinds"), F.first(narrow).alias("narrow"), F.count("_y").alias("n"))
    few = (F.col("n") == 0) | (F.col("narrow") & (F.col("kinds") <= FEW_CLASSES))
    return listed.select(F.when(F.coalesce(few, F.lit(True)), "classification").otherwise("regression").alias("problem"))


def class_labels(df: DataFrame, label: str) -> list[float]:
    """The distinct class labels in rising order. A classifier needs all of them; their number is that of its outputs."""
    return sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(measure(label)).distinct().collect())


def label_index(column: Column, labels: Sequence[float]) -> Column:
    """The place of a label among the sorted ``labels``, as double; order is kept, so the larger of two is 1."""
    return (F.array_position(F.array(*[F.lit(float(v)) for v in labels]), column.cast("double")) - 1).cast("double")


def label_at(column: Column, labels: Sequence[float]) -> Column:
    """The label at a place among the sorted ``labels``."""
    return F.get(F.array(*[F.lit(float(v)) for v in labels]), column.cast("int"))


# ---- metrics -------------------------------------------------------------------------------------

def regression_metrics(df: DataFrame, target: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, r2, mse, rmse, mae, mape); zero targets do not count in the percentage."""
    y, p = measure(target), measure(prediction)
    rows = df.where(y.isNotNull() & p.isNotNull())
    gap = y - p
    mse = F.avg(gap * gap)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        (1 - mse / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"),
        mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(gap)).alias("mae"),
        (F.avg(F.abs(gap / F.nullif(y, F.lit(0.0)))) * 100).alias("mape"),
    )


def confusion(df: DataFrame, target: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., actual, predicted, n)."""
    rows = df.where(F.col(target).isNotNull() & F.col(prediction).isNotNull())
    return rows.groupBy(
        *by, F.col(target).cast("double").alias("actual"), F.col(prediction).cast("double").alias("predicted")
    ).agg(F.count("*").alias("n"))


def classification_metrics(
    df: DataFrame, target: str, prediction: str, score: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """(by..., n, accuracy, precision, recall, f1, mcc, auc).

    With two actual classes the larger label is the positive one; otherwise the measures are the
    plain mean over classes. Everything after the first count works on class pairs only.
    """
    cells = confusion(df, target, prediction, by)
    right = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), right.cast("long").alias("hit")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("hit")),
    )).alias("s")
    labels = cells.select(*by, sides).select(*by, "s.*").groupBy(*by, "label").agg(
        F.sum("t").cast("double").alias("t"), F.sum("p").cast("double").alias("p"), F.sum("hit").cast("double").alias("hit")
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.col("hit") / F.nullif(F.col("p"), zero), zero)
    recall = F.coalesce(F.col("hit") / F.nullif(F.col("t"), zero), zero)
    both = F.col("t") + F.col("p")
    f1 = F.coalesce(2 * F.col("hit") / F.nullif(both, zero), zero)
    scored = labels.withColumns({"_precision": precision, "_recall": recall, "_f1": f1})
    top = F.struct(F.when(F.col("t") > 0, F.col("label")))
    total = scored.groupBy(*by).agg(
        F.sum("t").alias("n"), F.sum("hit").alias("hits"), F.count_if(F.col("t") > 0).alias("classes"),
        *[F.avg(f"_{m}").alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[F.max_by(f"_{m}", top).alias(f"binary_{m}") for m in ("precision", "recall", "f1")],
        F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"),
    )
    n = F.col("n")
    spread = F.sqrt(n * n - F.col("pp")) * F.sqrt(n * n - F.col("tt"))
    result = total.select(
        *by, n.cast("long").alias("n"), (F.col("hits") / n).alias("accuracy"),
        *[F.when(F.col("classes") == 2, F.col(f"binary_{m}")).otherwise(F.col(f"macro_{m}")).alias(m) for m in ("precision", "recall", "f1")],
        F.coalesce((F.col("hits") * n - F.col("tp")) / F.nullif(spread, zero), zero).alias("mcc"),
        F.col("classes").alias("_classes"),
    )
    if score is None:
        return result.withColumn("auc", F.lit(None).cast("double")).drop("_classes")
    found = attach(result, auc(df, target, score, by), by, few=False)
    return found.withColumn("auc", F.when(F.col("_classes") == 2, F.col("auc"))).drop("_classes")


def auc(df: DataFrame, target: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., auc) of the larger of two labels.

    Counts positives and negatives per distinct score; only those counts are put in order.
    """
    rows = df.where(F.col(target).isNotNull() & measure(score).isNotNull())
    top = rows.groupBy(*by).agg(F.max(F.col(target).cast("double")).alias("_top"))
    marked = attach(rows.select(*by, F.col(target).cast("double").alias("_y"), measure(score).alias("_s")), top, by)
    positive = F.col("_y") == F.col("_top")
    counts = marked.groupBy(*by, "_s").agg(F.count_if(positive).alias("_pos"), F.count_if(~positive).alias("_neg"))
    ordered = running_total(counts, ["_s"], by, weight="_neg", name="_below")
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0))
    pairs = F.sum(F.col("_pos")).cast("double") * F.sum(F.col("_neg"))
    return ordered.groupBy(*by).agg((wins / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def long_metrics(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., metric, value) from one row of metrics per segment."""
    names = [c for c in metrics.columns if c not in by]
    wide = metrics.select(*by, *[F.col(c).cast("double").alias(c) for c in names])
    return wide.unpivot(list(by), names, "metric", "value").where(F.col("value").isNotNull())


# ---- words for metrics ---------------------------------------------------------------------------

def regression_quality(df: DataFrame, target: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Metrics and their bands per segment."""
    metrics = regression_metrics(df, target, prediction, by)
    spread = df.where(measure(target).isNotNull()).groupBy(*by).agg(
        F.avg(measure(target)).alias("_mean"), F.stddev_pop(measure(target)).alias("_std")
    )
    known = attach(metrics, spread, by, few=False)
    return known.withColumns(
        regression_bands(F.col("r2"), F.col("rmse"), F.col("_mean"), F.col("_std"))
    ).drop("_mean", "_std")


def classification_quality(
    df: DataFrame, target: str, prediction: str, score: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Metrics, class balance and their bands per segment."""
    metrics = classification_metrics(df, target, prediction, score, by)
    share = df.where(F.col(target).isNotNull()).groupBy(*by).agg(F.avg((F.col(target) == 1).cast("double")).alias("prevalence"))
    known = attach(metrics, share, by, few=False)
    return known.withColumns(classification_bands(*[F.col(c) for c in ("accuracy", "precision", "recall", "f1", "auc", "prevalence")]))


def best_model(metrics: DataFrame, metric: str, fallback: str | None = None) -> DataFrame:
    """(model, score) of the best row of (model, metric, value); the first name on ties."""
    wanted = metrics.where(F.col("metric") == metric)
    if fallback and wanted.isEmpty():
        wanted = metrics.where(F.col("metric") == fallback)
    # Highest value, then the alphabetically first name.
    ranked = wanted.groupBy("value").agg(F.min("model").alias("model"))
    return ranked.agg(F.max_by("model", "value").alias("model"), F.max("value").alias("score"))
