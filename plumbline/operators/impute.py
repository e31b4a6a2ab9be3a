"""Filling missing values."""

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.moments import moments_row
from ..plans.order import carry
from ..plans.quantiles import wide_percentiles
from ..plans.segments import TASK_ROWS, as_long_text, attach, is_numeric, measure, numeric_columns
from ..plans.staging import cut
from .describe import value_modes

SKEW_LIMIT = 1.0
MIN_SKEW_VALUES = 8
UNKNOWN = "Unknown"
ROUNDS = 10


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in columns})


def _filled(df: DataFrame, stats: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    known = attach(df, stats, by)
    fills = {c: F.coalesce(measure(c), F.col(f"_fill_{c}")) for c in columns}
    return known.withColumns(fills).drop(*[f"_fill_{c}" for c in columns])


def fill_mean(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    stats = df.groupBy(*by).agg(*[F.avg(measure(c)).alias(f"_fill_{c}") for c in columns])
    return _filled(df, stats, columns, by)


def fill_median(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    found = wide_percentiles(df, columns, [0.5], by)
    stats = found.select(*by, *[F.col(f"pct__{c}")[0].alias(f"_fill_{c}") for c in columns])
    return _filled(df, stats, columns, by)


def fill_mode(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value, the smallest on ties."""
    result = df
    for c in columns:
        long = df.select(*by, F.col(c).alias("value"))
        modes = value_modes(long, by).withColumnRenamed("mode", "_fill")
        result = attach(result, modes, by).withColumn(c, F.coalesce(F.col(c), F.col("_fill"))).drop("_fill")
    return result


def fill_carried(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[str],
    by: Sequence[str] = (),
    forward: bool = True,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Nearest earlier (or later) value in a unique order."""
    return carry(df, columns, order, by, forward, task_rows)


def fill_for_model(df: DataFrame, dependent: str, predictors: Sequence[str]) -> DataFrame:
    """Median for clearly skewed numbers, mean for others, mode for text; rows without a target go."""
    numbers = [c for c in predictors if is_numeric(df, c)]
    others = [c for c in predictors if c not in numbers]
    result = df
    if numbers:
        facts = df.agg(*[
            a for c in numbers for a in (
                F.avg(measure(c)).alias(f"mean__{c}"),
                ((F.count(measure(c)) >= MIN_SKEW_VALUES) & (F.abs(F.skewness(measure(c))) > SKEW_LIMIT)).alias(f"skewed__{c}"),
                F.count_if(measure(c).isNull()).alias(f"gaps__{c}"),
            )
        ]).first()
        gaps = [c for c in numbers if facts[f"gaps__{c}"]]
        skewed = [c for c in gaps if facts[f"skewed__{c}"]]
        even = [c for c in gaps if c not in skewed and facts[f"mean__{c}"] is not None]
        result = result.withColumns({c: F.coalesce(measure(c), F.lit(facts[f"mean__{c}"])) for c in even})
        if skewed:
            result = fill_median(result, skewed)
    if others:
        result = fill_mode(result, others)
        result = result.fillna(UNKNOWN, subset=[c for c in others if dict(df.dtypes)[c] == "string"])
    return result.dropna(subset=[dependent])


def fill_by_type(df: DataFrame, types: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Mean for continuous, median for ordinal, mode for other columns."""
    result = df
    continuous = [c for c, kind in types.items() if kind == "continuous"]
    ordinal = [c for c, kind in types.items() if kind == "ordinal"]
    other = [c for c, kind in types.items() if kind not in ("continuous", "ordinal", "datetime")]
    if continuous:
        result = fill_mean(result, continuous, by)
    if ordinal:
        result = fill_median(result, ordinal, by)
    return fill_mode(result, other, by) if other else result


def apply_strategies(
    df: DataFrame, strategies: dict[str, str], order: Sequence[str] = (), by: Sequence[str] = ()
) -> DataFrame:
    """One strategy per column, in the order given; knn and iterative columns are filled together at the end."""
    from .neighbours import fill_nearest

    result = df
    late = {"knn": [], "iterative": []}
    for c, strategy in strategies.items():
        if c not in result.columns:
            continue
        if strategy in late:
            late[strategy].append(c)
        elif strategy == "drop_rows":
            result = drop_incomplete(result, [c])
        elif strategy == "drop_column":
            result = result.drop(c)
        elif strategy == "zero":
            result = fill_zero(result, [c])
        elif strategy == "mean":
            result = fill_mean(result, [c], by) if is_numeric(df, c) else fill_mode(result, [c], by)
        elif strategy == "median":
            result = fill_median(result, [c], by) if is_numeric(df, c) else fill_mode(result, [c], by)
        elif strategy == "mode":
            result = fill_mode(result, [c], by)
        elif strategy in ("forward_fill", "backward_fill"):
            result = fill_carried(result, [c], order, by, strategy == "forward_fill")
        else:
            raise ValueError(f"unknown strategy {strategy!r}")
    if late["knn"]:
        result = fill_nearest(result, late["knn"], list(order))
    if late["iterative"]:
        result = fill_iterative(result, late["iterative"])
    return result


def apply_suggested(df: DataFrame, report: DataFrame, order: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """The suggested strategy of every column with missing values."""
    wanted = {r["column"]: r["strategy"] for r in report.where("null_count > 0").collect()}
    return apply_strategies(df, wanted, order, by)


def fill_iterative(df: DataFrame, columns: Sequence[str] | None = None, rounds: int = ROUNDS, tolerance: float = 1e-3) -> DataFrame:
    """Chained equations: each gappy column is regressed on the others, round after round.

    A round needs one covariance aggregate per gappy column. The fits stay coefficient vectors;
    the rows are written once per round, so the plan does not grow with the rounds.
    """
    columns = list(columns or numeric_columns(df))
    facts = df.agg(*[a for c in columns for a in (
        F.avg(measure(c)).alias(f"mean__{c}"), F.count_if(measure(c).isNull()).alias(f"gaps__{c}"),
        F.max(F.abs(measure(c))).alias(f"size__{c}"),
    )]).first()
    columns = [c for c in columns if facts[f"mean__{c}"] is not None]
    gappy = sorted((c for c in columns if facts[f"gaps__{c}"]), key=lambda c: facts[f"gaps__{c}"])
    if not gappy or len(columns) < 2:
        return fill_mean(df, gappy) if gappy else df
    state = df.withColumns({f"_gap_{c}": measure(c).isNull() for c in gappy})
    state = state.withColumns({c: F.coalesce(measure(c), F.lit(facts[f"mean__{c}"])) for c in columns})
    scale = max(facts[f"size__{c}"] for c in columns)
    for _ in range(rounds):
        before = {c: f"_old_{c}" for c in gappy}
        state = state.withColumns({old: F.col(c) for c, old in before.items()})
        for c in gappy:
            others = [x for x in columns if x != c]
            seen = state.where(~F.col(f"_gap_{c}"))
            n, means, matrix = moments_row(seen, {x: F.col(x) for x in [c, *others]})
            weights = np.linalg.lstsq(matrix[1:, 1:], matrix[1:, 0], rcond=1e-10)[0]
            fitted: Column = F.lit(float(means[0] - weights @ means[1:]))
            for w, x in zip(weights, others):
                fitted = fitted + F.lit(float(w)) * F.col(x)
            state = state.withColumn(c, F.when(F.col(f"_gap_{c}"), fitted).otherwise(F.col(c)))
        state = cut(state)
        change = state.agg(F.max(F.greatest(*[F.abs(F.col(c) - F.col(o)) for c, o in before.items()], F.lit(0.0)))).first()[0]
        state = state.drop(*before.values())
        if change is None or change < tolerance * scale:
            break
    return state.drop(*[f"_gap_{c}" for c in gappy])
