"""A preparation of predictors that is learned on training rows and applied to any rows.

Every step learns its parameters from the rows it is fitted on, after the steps before it, and keeps nothing else of them.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..plans.quantiles import wide_percentiles
from ..plans.segments import attach, is_numeric, measure, quoted, small
from ..plans.staging import cut
from . import features, select
from .describe import value_modes
from .impute import MIN_SKEW_VALUES, SKEW_LIMIT, UNKNOWN

PARAMETERS = "step string, column string, name string, value double, text string"


@dataclass
class FeaturePlan:
    """What happens to the predictors before the fit."""

    date_columns: list[str] = field(default_factory=list)
    date_parts: list[str] = field(default_factory=lambda: list(features.DATE_PARTS))
    ratio_pairs: list[tuple[str, str]] = field(default_factory=list)
    interaction_pairs: list[tuple[str, str]] = field(default_factory=list)
    aggregate_columns: list[str] = field(default_factory=list)
    aggregate_group: str | None = None
    encoding: str | None = None
    encoding_columns: list[str] = field(default_factory=list)
    ordinal_orders: dict[str, list] = field(default_factory=dict)
    drop_correlated: float | None = None
    target_correlation: float | None = None
    vif: float | None = None
    lasso: float | None = None
    pca: float | None = None
    importance_top: int | None = None
    scaling: str | None = None
    scaling_exclude: list[str] = field(default_factory=list)


@dataclass
class Step:
    """What a step does to rows, and what it learned: (column, name, number, text), or a table of these for dictionaries of any size."""

    name: str
    change: Callable[[DataFrame], DataFrame]
    learned: list[tuple] = field(default_factory=list)
    table: DataFrame | None = None


@dataclass
class Preparation:
    """Fitted steps, the predictors that come out of them, and a report of what happened to the columns."""

    steps: list[Step] = field(default_factory=list)
    predictors: list[str] = field(default_factory=list)
    report: dict = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        """The rows with all steps done to them; nothing is learned from them."""
        return reduce(lambda rows, step: step.change(rows), self.steps, df)

    def parameters(self, df: DataFrame) -> DataFrame:
        """(step, column, name, value, text): everything that was learned. ``df`` lends its session."""
        rows = [(step.name, *learned) for step in self.steps for learned in step.learned]
        found = df.sparkSession.createDataFrame(rows, PARAMETERS)
        for step in self.steps:
            if step.table is not None:
                found = found.unionAll(step.table.select(F.lit(step.name), "column", "name", "value", "text"))
        return found


def _fill(df: DataFrame, columns: Sequence[str]) -> Step:
    """Median for clearly skewed numbers, mean for others, mode for what is no number."""
    numbers = [c for c in columns if is_numeric(df, c)]
    others = [c for c in columns if c not in numbers]
    learned, values = [], {}
    if numbers:
        facts = df.agg(*[
            a for i, c in enumerate(numbers) for a in (
                F.avg(measure(c)).alias(f"mean{i}"), ((F.count(measure(c)) >= MIN_SKEW_VALUES) & (F.abs(F.skewness(measure(c))) > SKEW_LIMIT)).alias(f"skewed{i}"),
            )
        ]).first()
        skewed = [c for i, c in enumerate(numbers) if facts[f"skewed{i}"]]
        medians = wide_percentiles(df, skewed, [0.5]).first() if skewed else {}
        for i, c in enumerate(numbers):
            name, value = ("median", medians[f"pct__{c}"][0]) if c in skewed else ("mean", facts[f"mean{i}"])
            if value is not None:
                values[c] = F.coalesce(measure(c), F.lit(value))
                learned.append((c, name, float(value), None))
    for c in others:
        text = dict(df.dtypes)[c] == "string"
        row = value_modes(df.select(quoted(c).alias("value")), []).first()
        value = row["mode"] if row is not None and row["mode"] is not None else (UNKNOWN if text else None)
        if value is not None:
            values[c] = F.coalesce(quoted(c), F.lit(value))
            learned.append((c, "mode", None, str(value)))
    return Step("fill", lambda rows: rows.withColumns(values), learned)


def _dates(df: DataFrame, columns: Sequence[str], parts: Sequence[str]) -> Step:
    """The parts of dates; the hour only where it varies in the rows of the fit."""
    kept = {c: list(parts) for c in columns}
    if "hour" in parts:
        found = df.agg(*[F.max(F.hour(quoted(c))).alias(f"_{i}") for i, c in enumerate(columns)]).first()
        kept = {c: [p for p in parts if p != "hour" or (found[f"_{i}"] or 0) > 0] for i, c in enumerate(columns)}
    return Step("dates", lambda rows: reduce(lambda r, c: features.date_columns(r, c, kept[c]), columns, rows), [(c, p, None, None) for c in columns for p in kept[c]])


def _aggregates(df: DataFrame, columns: Sequence[str], group: str | None) -> Step:
    means, table = None, None
    if group:
        means = cut(df.where(quoted(group).isNotNull()).groupBy(group).agg(*[F.avg(measure(c)).alias(f"{c}_group_mean") for c in columns]))
        pieces = [means.select(F.lit(c).alias("column"), F.lit("mean").alias("name"), quoted(f"{c}_group_mean").alias("value"), quoted(group).cast("string").alias("text")) for c in columns]
        table = reduce(DataFrame.unionAll, pieces)

    def change(rows: DataFrame) -> DataFrame:
        wide = features.row_aggregates(rows, columns)
        return attach(wide, means, [group]) if group else wide

    return Step("aggregates", change, table=table)


def _one_hot(df: DataFrame, columns: Sequence[str]) -> Step:
    levels = features.one_hot_levels(df, columns)
    return Step("one_hot", lambda rows: features.one_hot(rows, list(levels), levels), [(c, "level", None, str(v)) for c, values in levels.items() for v in values])


def _target(df: DataFrame, column: str, target: str) -> Step:
    """Values that the fit never saw get the overall mean."""
    overall = df.agg(F.avg(measure(target))).first()[0]
    codes = cut(features.target_means(df, column, target).drop("_overall"))

    def change(rows: DataFrame) -> DataFrame:
        coded = attach(rows, codes, [column])
        return coded.withColumn(f"{column}_target_encoded", F.coalesce("_code", F.lit(overall))).drop("_code", column)

    table = codes.select(F.lit(column).alias("column"), F.lit("code").alias("name"), F.col("_code").alias("value"), quoted(column).cast("string").alias("text"))
    return Step("target", change, [(column, "overall", overall, None)], table)


def _ordinal(df: DataFrame, column: str, order: Sequence | None) -> Step:
    """Places among the sorted values of the fit, or in a given order; other values are null."""
    from ..plans.order import positions

    if order is not None:
        return Step("ordinal", lambda rows: features.ordinal_encode(rows, [column], {column: order}), [(column, "place", float(i), str(v)) for i, v in enumerate(order)])
    values = df.where(quoted(column).isNotNull()).select(quoted(column).cast("string").alias("_value")).distinct()
    codes = cut(positions(values, ["_value"], name="_place"))

    def change(rows: DataFrame) -> DataFrame:
        coded = rows.join(small(codes), quoted(column).cast("string") == F.col("_value"), "left")
        return coded.withColumn(column, F.col("_place")).drop("_value", "_place")

    return Step("ordinal", change, table=codes.select(F.lit(column).alias("column"), F.lit("place").alias("name"), F.col("_place").cast("double").alias("value"), F.col("_value").alias("text")))


def _encoding(df: DataFrame, columns: Sequence[str], strategy: str, target: str, orders: dict) -> list[Step]:
    if strategy == "auto":
        counts = features.distinct_counts(df, columns)
        few = [c for c in columns if 1 < counts[c] <= features.FEW_CATEGORIES]
        many = [c for c in columns if counts[c] > features.FEW_CATEGORIES]
        return ([_one_hot(df, few)] if few else []) + [_target(df, c, target) for c in many]
    if strategy == "target":
        return [_target(df, c, target) for c in columns]
    if strategy == "ordinal":
        return [_ordinal(df, c, orders.get(c)) for c in columns]
    return [_one_hot(df, columns)]


def _components(df: DataFrame, columns: Sequence[str], variance: float) -> tuple[Step | None, list[float]]:
    fitted = select.fit_components(df, columns, variance=variance)
    if fitted is None:
        return None, []
    learned = [(c, name, float(value), None) for c, *numbers in zip(columns, fitted.shifts, fitted.widths) for name, value in zip(("shift", "width"), numbers)]
    learned += [(c, f"PC{k + 1}", float(w), None) for k, loading in enumerate(fitted.loadings) for c, w in zip(columns, loading)]
    return Step("components", lambda rows: select.apply_components(rows, columns, fitted), learned), fitted.shares


def _scaling(df: DataFrame, columns: Sequence[str], method: str) -> Step:
    row = features.scale_parameters(df, columns, method).first()
    learned = [(c, name, row[f"{name}__{c}"], None) for c in columns for name in ("shift", "width")]

    def change(rows: DataFrame) -> DataFrame:
        known = {c: (row[f"shift__{c}"], row[f"width__{c}"]) for c in columns}
        return rows.withColumns({c: measure(c) if width is None else (measure(c) - F.lit(shift)) / F.lit(width) for c, (shift, width) in known.items()})

    return Step("scale", change, learned)


def fit_preparation(train: DataFrame, dependent: str, predictors: Sequence[str], types: dict[str, str], plan: FeaturePlan | None = None) -> Preparation:
    """Impute, create, encode, select and scale, all learned on ``train``; rows without a target go when it is applied."""
    plan = plan or FeaturePlan()
    fitted = Preparation()
    chosen = [p for p in predictors if p in train.columns]
    data = train

    def add(step: Step) -> list[str]:
        nonlocal data
        before = set(data.columns)
        data = step.change(data)
        fitted.steps.append(step)
        return [c for c in data.columns if c not in before]

    def grow(step: Step, name: str) -> None:
        fitted.report[name] = add(step)
        chosen.extend(fitted.report[name])

    add(Step("complete", lambda rows: rows.where(quoted(dependent).isNotNull())))
    add(_fill(data, chosen))
    if plan.date_columns:
        grow(_dates(data, plan.date_columns, plan.date_parts), "date_parts")
    if plan.ratio_pairs:
        grow(Step("ratios", lambda rows: features.ratios(rows, plan.ratio_pairs)), "ratios")
    if plan.interaction_pairs:
        grow(Step("interactions", lambda rows: features.interactions(rows, plan.interaction_pairs)), "interactions")
    if plan.aggregate_columns:
        grow(_aggregates(data, plan.aggregate_columns, plan.aggregate_group), "aggregates")
    named = plan.encoding_columns or [p for p in chosen if types.get(p) in ("categorical", "binary")]
    if named:
        fitted.report["encoded"] = [c for step in _encoding(data, named, plan.encoding or "auto", dependent, plan.ordinal_orders) for c in add(step)]
        chosen = [p for p in chosen if p in data.columns] + fitted.report["encoded"]
    kinds = dict(data.dtypes)
    chosen = [p for p in dict.fromkeys(chosen) if p != dependent and kinds[p] not in ("string", "timestamp", "timestamp_ntz", "date")]
    if plan.drop_correlated is not None:
        chosen, fitted.report["correlated"] = select.correlated_features(data, chosen, plan.drop_correlated)
    if plan.target_correlation is not None:
        found = select.selected(select.target_correlations(data, chosen, dependent, plan.target_correlation))
        chosen = [p for p in chosen if p in found]
    if plan.vif is not None and len(chosen) > 2:
        chosen, fitted.report["vif"] = select.vif_filter(data, chosen, plan.vif)
    if plan.lasso is not None and len(chosen) >= 2:
        found = select.selected(select.lasso_selection(data, chosen, dependent, plan.lasso))
        chosen = [p for p in chosen if p in found]
    if plan.pca is not None and len(chosen) >= 2:
        step, shares = _components(data, chosen, plan.pca)
        fitted.report["pca"] = shares
        if step is not None:
            add(step)
            chosen = [f"PC{i + 1}" for i in range(len(shares))]
    if plan.importance_top is not None and len(chosen) >= 2:
        found = select.selected(select.importance_selection(data, chosen, dependent, plan.importance_top))
        chosen = [p for p in chosen if p in found]
    if plan.scaling:
        scaled = [c for c in chosen if c not in (dependent, *plan.scaling_exclude) and is_numeric(data, c)]
        if scaled:
            add(_scaling(data, scaled, plan.scaling))
    fitted.predictors = fitted.report["predictors"] = chosen
    return fitted
