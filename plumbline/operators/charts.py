"""The rows behind the plots."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.segments import TASK_ROWS, as_long, attach, measure
from .describe import describe, frequencies
from .infer import correlation_matrix
from .models import stride_sample

BINS = 10
RESIDUAL_BINS = (5, 20)


def _bin(value: Column, low: Column, high: Column, bins: Column) -> Column:
    """Bin number 1..bins; the highest value belongs to the last bin."""
    return F.least(F.floor((value - low) / (high - low) * bins) + 1, bins)


def histogram(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """(by..., column, bin, lower, upper, count) of the bins that hold values; constant columns have none."""
    long = as_long(df, columns, by).where(F.col("value").isNotNull())
    keys = [*by, "column"]
    ends = long.groupBy(*keys).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    placed = attach(long, ends, keys, few=None if by else True).where(F.col("_low") < F.col("_high"))
    number = _bin(F.col("value"), F.col("_low"), F.col("_high"), F.lit(bins)).cast("long")
    width = (F.col("_high") - F.col("_low")) / bins
    counts = placed.groupBy(*keys, "_low", "_high", number.alias("bin")).agg(F.count("*").alias("count"))
    return counts.select(
        *keys, "bin", (F.col("_low") + (F.col("bin") - 1) * width).alias("lower"),
        (F.col("_low") + F.col("bin") * width).alias("upper"), "count",
    )


def residual_histogram(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., bin, midpoint, count, density, mean, std, min, max): the square root of n bins, five to twenty."""
    fewest, most = RESIDUAL_BINS
    rows = df.select(*by, (measure(actual) - measure(predicted)).alias("_r")).where(F.col("_r").isNotNull())
    facts = rows.groupBy(*by).agg(
        F.count("*").alias("_n"), F.avg("_r").alias("mean"), F.stddev_samp("_r").alias("std"),
        F.min("_r").alias("min"), F.max("_r").alias("max"),
    ).where(F.col("_n") >= 2)
    facts = facts.withColumn("_bins", F.least(F.greatest(F.floor(F.sqrt("_n")), F.lit(fewest)), F.lit(most)))
    facts = facts.withColumn("_width", (F.col("max") - F.col("min")) / F.col("_bins"))
    known = attach(rows, facts, by).where(F.col("_width") > 0)
    number = _bin(F.col("_r"), F.col("min"), F.col("max"), F.col("_bins")).cast("long")
    counts = known.groupBy(*by, number.alias("bin")).agg(
        F.count("*").alias("count"), *[F.first(c).alias(c) for c in ("mean", "std", "min", "max", "_n", "_width")]
    )
    return counts.select(
        *by, "bin", (F.col("min") + (F.col("bin") - 0.5) * F.col("_width")).alias("midpoint"), "count",
        (F.col("count") / (F.col("_n") * F.col("_width"))).alias("density"), "mean", "std", "min", "max",
    )


def box_plot(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return describe(df, columns, by).select(*by, "column", "min", "q1", "median", "q3", "max")


def bar_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), top: int | None = None) -> DataFrame:
    """Counts and shares for bar and pie plots; with ``top`` the most frequent values of each column."""
    counts = frequencies(df, columns, by)
    if top is None:
        return counts
    order = Window.partitionBy(*by, "column").orderBy(F.desc("count"), "value")
    return counts.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= top).drop("_place")


def scatter(df: DataFrame, x: str, y: str, order: Sequence[str], most: int = 500, task_rows: int = TASK_ROWS) -> DataFrame:
    """(order..., x, y): about ``most`` complete points, evenly spaced in a unique order."""
    points = df.select(*order, measure(x).alias("x"), measure(y).alias("y")).dropna(subset=["x", "y"])
    return stride_sample(points, order, most, task_rows)


def predicted_against_actual(
    df: DataFrame, actual: str, predicted: str, order: Sequence[str], most: int = 500, task_rows: int = TASK_ROWS
) -> DataFrame:
    return scatter(df, actual, predicted, order, most, task_rows).withColumnsRenamed({"x": "actual", "y": "predicted"})


def heatmap(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return correlation_matrix(df, columns, by)


def importance_bars(ranking: DataFrame, top: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, importance, relative, rank, methods) from a consensus ranking; the ``top`` features if given."""
    strength = F.round(1 / F.nullif(F.col("average_rank"), F.lit(0.0)), 4)
    kept = ranking if top is None else ranking.where(F.col("consensus_rank") <= top)
    bars = kept.withColumn("importance", F.coalesce(strength, F.lit(0.0)))
    best = F.max("importance").over(Window.partitionBy(*(by or [F.lit(0)])))
    return bars.select(
        *by, "feature", "importance", F.round(F.col("importance") / best, 4).alias("relative"),
        F.col("consensus_rank").alias("rank"), "methods",
    )


def forecast_band(forecasts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., name, predicted, lower, upper), named by period."""
    name = F.concat(F.lit("Period "), F.col("period").cast("string")).alias("name")
    return forecasts.select(*by, name, "predicted", "lower", "upper")


def dependence_lines(dependence: DataFrame, ranking: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(feature, x, y) of all features, or of the ``most`` leading ones of a ``ranking`` (feature, rank)."""
    lines = dependence
    if most is not None:
        if ranking is None:
            raise ValueError("the leading features need a ranking")
        lines = lines.join(ranking.where(F.col("rank") <= most).select("feature"), "feature", "left_semi")
    return lines.select("feature", F.round("value", 4).alias("x"), F.round("average", 4).alias("y"))


def attribution_bars(attributions: DataFrame, top: int | None = None) -> DataFrame:
    bars = attributions.select("feature", "mean_abs", "share", "rank")
    return bars if top is None else bars.where(F.col("rank") <= top)
