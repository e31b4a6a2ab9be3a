"""Outlier bounds, reports and treatment."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.quantiles import wide_percentiles
from ..plans.segments import attach, measure, numeric_columns, stack_columns

IQR_FACTOR = 1.5
Z_THRESHOLD = 3.0
MIN_VALUES = 4


def bounds(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), method: str = "iqr", factor: float | None = None
) -> DataFrame:
    """One row per segment with ``lower__c`` and ``upper__c``; null where there are too few values."""
    if method == "zscore":
        width = Z_THRESHOLD if factor is None else factor
        limits = []
        for c in columns:
            v = measure(c)
            usable = (F.count(v) >= MIN_VALUES) & (F.stddev_samp(v) > 0)
            limits += [
                F.when(usable, F.avg(v) - width * F.stddev_samp(v)).alias(f"lower__{c}"),
                F.when(usable, F.avg(v) + width * F.stddev_samp(v)).alias(f"upper__{c}"),
            ]
        return df.groupBy(*by).agg(*limits)
    width = IQR_FACTOR if factor is None else factor
    wide = wide_percentiles(df, columns, [0.25, 0.75], by)
    limits = []
    for c in columns:
        q1, q3 = F.col(f"pct__{c}")[0], F.col(f"pct__{c}")[1]
        usable = F.col(f"n__{c}") >= MIN_VALUES
        limits += [
            F.when(usable, q1 - width * (q3 - q1)).alias(f"lower__{c}"),
            F.when(usable, q3 + width * (q3 - q1)).alias(f"upper__{c}"),
        ]
    return wide.select(*by, *limits)


def _beyond(column: str) -> Column:
    v = measure(column)
    return (v < F.col(f"lower__{column}")) | (v > F.col(f"upper__{column}"))


def outlier_report(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: Sequence[str] = (),
    method: str = "iqr",
    factor: float | None = None,
) -> DataFrame:
    """(by..., column, lower, upper, outlier_count), bounds to four decimals."""
    columns = list(columns or numeric_columns(df, exclude=by))
    limits = bounds(df, columns, by, method, factor)
    counted = attach(df.select(*by, *columns), limits, by).groupBy(*by).agg(*[
        a for c in columns for a in (
            F.round(F.first(f"lower__{c}"), 4).alias(f"lower__{c}"),
            F.round(F.first(f"upper__{c}"), 4).alias(f"upper__{c}"),
            F.count_if(_beyond(c)).alias(f"outlier_count__{c}"),
        )
    ])
    return stack_columns(counted, columns, ["lower", "upper", "outlier_count"], by)


def outlier_rows(
    df: DataFrame,
    column: str,
    by: Sequence[str] = (),
    method: str = "iqr",
    factor: float | None = None,
) -> DataFrame:
    """The rows beyond the bounds of one column; order and limit them as needed."""
    limits = bounds(df, [column], by, method, factor)
    return attach(df, limits, by).where(_beyond(column)).drop(f"lower__{column}", f"upper__{column}")


def mark_outliers(df: DataFrame, columns: Sequence[str], limits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``beyond__c``: whether a value lies beyond the bounds; null where the value or the bounds are missing."""
    marked = attach(df, limits, by).withColumns({f"beyond__{c}": _beyond(c) for c in columns})
    return marked.drop(*[f"{side}__{c}" for c in columns for side in ("lower", "upper")])


def treat_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: Sequence[str] = (),
    method: str = "iqr",
    action: str = "clip",
    factor: float | None = None,
    limits: DataFrame | None = None,
) -> DataFrame:
    """Remove, clip, log- or square-root-transform the columns that have outliers.

    All bounds come from the table as given, so the outcome does not depend on column order. With
    ``remove`` a row goes when any of its columns is beyond its bounds; missing values stay. ``limits`` are
    the ``bounds`` where they are known already.
    """
    columns = list(columns or numeric_columns(df, exclude=by))
    if action in ("none", "detect"):
        return df
    limits = bounds(df, columns, by, method, factor) if limits is None else limits
    bounded = attach(df, limits, by)
    added = [f"{side}__{c}" for c in columns for side in ("lower", "upper")]
    if action == "remove":
        beyond = F.lit(False)
        for c in columns:
            beyond = beyond | F.coalesce(_beyond(c), F.lit(False))
        return bounded.where(~beyond).drop(*added)
    if action == "clip":
        clipped = {}
        for c in columns:
            v = measure(c)
            inside = F.greatest(F.least(v, F.col(f"upper__{c}")), F.col(f"lower__{c}"))
            clipped[c] = F.when(v.isNotNull(), inside)
        return bounded.withColumns(clipped).drop(*added)
    # Logarithm and root apply to a column only if it has outliers.
    facts = bounded.groupBy(*by).agg(*[
        a for c in columns for a in (
            F.coalesce(F.bool_or(_beyond(c)), F.lit(False)).alias(f"hit__{c}"),
            F.min(measure(c)).alias(f"least__{c}"),
            F.min(F.when(measure(c) > 0, measure(c))).alias(f"least_positive__{c}"),
        )
    ])
    known = attach(df, facts, by)
    changed = {}
    for c in columns:
        v = measure(c)
        if action == "log":
            floor = F.when(F.col(f"least__{c}") <= 0, F.coalesce(F.col(f"least_positive__{c}"), F.lit(1.0)))
            new = F.log1p(F.greatest(v, floor))
        elif action == "sqrt":
            new = F.sqrt(F.greatest(v, F.lit(0.0)))
        else:
            raise ValueError(f"unknown action {action!r}")
        changed[c] = F.when(v.isNotNull(), F.when(F.col(f"hit__{c}"), new).otherwise(v))
    return known.withColumns(changed).drop(*[c for c in facts.columns if c not in by])
