"""A whole analysis: clean, fill, profile again, and compute what was asked for."""

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.states import STATES
from ..plans.segments import quoted
from ..plans.staging import cut
from . import clean, dedup, describe, impute, infer, models, outliers, profile, train


@dataclass
class Cleaning:
    """Which cleaning steps run, in this order."""

    drop_exact: bool = False
    exact_subset: list[str] | None = None
    keep: str = "first"
    fuzzy_columns: list[str] = field(default_factory=list)
    fuzzy_threshold: float = dedup.FUZZY_THRESHOLD
    text_columns: list[str] = field(default_factory=list)
    case: str = "title"
    state_columns: list[str] = field(default_factory=list)
    state_output: str = "full"
    date_columns: list[str] = field(default_factory=list)
    day_first: bool = False
    typo_columns: list[str] = field(default_factory=list)
    corrections: dict[str, dict[str, str]] = field(default_factory=dict)
    outlier_columns: list[str] = field(default_factory=list)
    outlier_method: str = "iqr"
    outlier_action: str = "clip"
    outlier_factor: float | None = None


def clean_table(df: DataFrame, key: str, steps: Cleaning) -> DataFrame:
    """Apply the chosen steps: duplicates, near-duplicates, case, states, dates, typos, outliers."""
    if steps.drop_exact:
        df = dedup.drop_duplicates(df, [key], steps.exact_subset, steps.keep)
    if steps.fuzzy_columns:
        df = dedup.drop_fuzzy_duplicates(df, key, steps.fuzzy_columns, steps.fuzzy_threshold, steps.keep)
    if steps.text_columns:
        df = clean.standardise_text(df, steps.text_columns, steps.case)
    if steps.state_columns:
        df = clean.standardise_states(df, steps.state_columns, steps.state_output)
    if steps.date_columns:
        df = clean.parse_dates(df, steps.date_columns, steps.day_first)
    if steps.corrections:
        df = clean.correct_with(df, steps.corrections)
    if steps.typo_columns:
        df = clean.repair_typos(df, [c for c in steps.typo_columns if c not in steps.corrections])
    if steps.outlier_columns:
        df = outliers.treat_outliers(
            df, steps.outlier_columns, (), steps.outlier_method, steps.outlier_action, steps.outlier_factor
        )
    return df


def clean_with_report(df: DataFrame, key: str, steps: Cleaning) -> tuple[DataFrame, DataFrame]:
    """The table that ``clean_table`` gives, and (step, column, name, value): what each step did.

    Rows: ``rows_before`` and ``rows_after``. Duplicates and near-duplicates: ``rows_removed``, ``rows_remaining``. Text:
    ``values_changed``, ``old_unique_count``, ``new_unique_count`` of the columns that change. States: ``values_changed`` (values
    recognised) of ``total_rows`` values. Dates: ``parsed``, ``failed``, ``accepted``. Typos: ``values_corrected``. Outliers: ``lower``,
    ``upper``, ``outlier_count`` by the bounds that the treatment uses.

    A step leaves flags in its rows, the table is written once before the outliers are treated, and all flags are
    added up in one scan of it. Sums over rows are the same when a task runs twice, unlike counters on the side.
    """
    rows = [("rows", None, "rows_before", float(df.count()))]
    flags: dict[tuple, str] = {}

    def removed(step: str, before: DataFrame, after: DataFrame) -> DataFrame:
        after = cut(after)
        n = after.count()
        rows.extend([(step, None, "rows_removed", float(before.count() - n)), (step, None, "rows_remaining", float(n))])
        return after

    def flag(data: DataFrame, step: str, name: str, column: str, value) -> DataFrame:
        flags[step, column, name] = f"__flag{len(flags)}"
        return data.withColumn(flags[step, column, name], F.coalesce(value, F.lit(False)).cast("int"))

    def compared(data: DataFrame, columns: Sequence[str], change) -> DataFrame:
        old = {c: f"__old{i}" for i, c in enumerate(columns)}
        data = change(data.withColumns({o: quoted(c) for c, o in old.items()}))
        for c, o in old.items():
            data = flag(data, "typos", "values_corrected", c, ~quoted(c).eqNullSafe(F.col(o)))
        return data.drop(*old.values())

    data = df
    if steps.drop_exact:
        data = removed("duplicates", data, dedup.drop_duplicates(data, [key], steps.exact_subset, steps.keep))
    if steps.fuzzy_columns:
        data = removed("near_duplicates", data, dedup.drop_fuzzy_duplicates(data, key, steps.fuzzy_columns, steps.fuzzy_threshold, steps.keep))
    text = None
    if steps.text_columns:
        text = clean.text_changes(data, steps.text_columns, steps.case)
        data = clean.standardise_text(data, steps.text_columns, steps.case)
    if steps.state_columns:
        data = clean.standardise_states(data, steps.state_columns, steps.state_output)
        known = list(STATES.values() if steps.state_output == "full" else STATES)
        for c in steps.state_columns:
            data = flag(flag(data, "states", "values_changed", c, quoted(c).isin(known)), "states", "total_rows", c, quoted(c).isNotNull())
    if steps.date_columns:
        dates = clean.date_report(data, steps.date_columns, steps.day_first).collect()
        rows.extend(("dates", r["column"], name, float(r[name])) for r in dates for name in ("parsed", "failed", "accepted"))
        data = clean.parse_accepted(data, [r["column"] for r in dates if r["accepted"]], steps.day_first)
    if steps.corrections:
        data = compared(data, list(steps.corrections), lambda d: clean.correct_with(d, steps.corrections))
    typos = [c for c in steps.typo_columns if c not in steps.corrections]
    if typos:
        data = compared(data, typos, lambda d: clean.repair_typos(d, typos))
    data = cut(data)
    counted = data
    if steps.outlier_columns:
        # the bounds are learned once, for the report and the treatment
        limits = cut(outliers.bounds(data, steps.outlier_columns, (), steps.outlier_method, steps.outlier_factor))
        counted = outliers.mark_outliers(data, steps.outlier_columns, limits)
        for c in steps.outlier_columns:
            counted = flag(counted, "outliers", "outlier_count", c, F.col(f"beyond__{c}"))
        ends = limits.first()
        rows.extend(("outliers", c, side, ends[f"{side}__{c}"]) for c in steps.outlier_columns for side in ("lower", "upper"))
        data = outliers.treat_outliers(data, steps.outlier_columns, (), steps.outlier_method, steps.outlier_action, steps.outlier_factor, limits)
    data = data.drop(*flags.values())
    rows.append(("rows", None, "rows_after", float(data.count())))
    report = df.sparkSession.createDataFrame(rows, "step string, column string, name string, value double")
    if flags:
        sums = counted.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("double").alias(n) for n in flags.values()])
        each = F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.lit(c).alias("column"), F.lit(n).alias("name"), F.col(f).alias("value")) for (s, c, n), f in flags.items()]))
        report = report.unionAll(sums.select(each.alias("_r")).select("_r.*"))
    if text is not None:
        parts = [text.where("values_changed > 0").select(F.lit("text"), "column", F.lit(n), F.col(n).cast("double")) for n in ("values_changed", "old_unique_count", "new_unique_count")]
        report = reduce(DataFrame.unionAll, parts, report)
    return data, report


@dataclass
class Analysis:
    """The tables of a whole analysis."""

    data: DataFrame
    profile: DataFrame
    missing: DataFrame
    descriptive: dict[str, DataFrame] = field(default_factory=dict)
    inferential: dict[str, DataFrame] = field(default_factory=dict)
    predictive: list[models.Fitted] = field(default_factory=list)
    training: train.Experiment | None = None
    cleaning: DataFrame | None = None


def analyse(
    df: DataFrame,
    key: str,
    cleaning: Cleaning | None = None,
    strategies: dict[str, str] | None = None,
    codebook: DataFrame | None = None,
    describe_columns: Sequence[str] | None = None,
    pairs: Sequence[tuple[str, str]] = (),
    tests: Sequence[dict] = (),
    regressions: Sequence[tuple[str, Sequence[str]]] = (),
    predictions: Sequence[tuple[str, Sequence[str]]] = (),
    training: tuple[str, Sequence[str]] | None = None,
    plan: models.FeaturePlan | None = None,
    by: Sequence[str] = (),
) -> Analysis:
    """Profile, clean, fill, profile again, then describe, test, predict and train as asked.

    Missing values follow ``strategies``; without any, the suggestion for each gappy column is used.
    """
    data, cleaned = clean_with_report(df, key, cleaning) if cleaning else (df, None)
    columns = [c for c in data.columns if c != key]
    first = profile.profile(data.select(*columns))
    missing = profile.missing_report(first)
    if strategies is None:
        data = impute.apply_suggested(data, missing, [key], by)
    else:
        data = impute.apply_strategies(data, strategies, [key], by)
    kept = [c for c in data.columns if c != key]
    profiled = profile.profile(data.select(*kept))
    if codebook is not None:
        profiled = profile.apply_codebook(profiled, codebook)
    types = {r["column"]: r["type"] for r in profiled.select("column", "type").collect()}
    found = Analysis(data, profiled, missing, cleaning=cleaned)
    found.descriptive = describe.describe_by_type(data, profiled, describe_columns or kept, by)
    typed = infer.correlations(data, pairs, by, types) if pairs else None
    found.inferential = infer.inferential_report(data, (), tests, regressions, by)
    if typed is not None:
        found.inferential["correlations"] = typed
    for dependent, predictors in predictions:
        found.predictive.append(models.fit_model(data, dependent, predictors, [key], types, plan=plan)[0])
    if training:
        found.training = train.run_experiment(data, training[0], training[1], [key], types)
    return found
