"""Feature creation, encoding and scaling."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.segments import attach, is_numeric, measure, quoted, small

FEW_CATEGORIES = 15
SMOOTHING = 10.0
DATE_PARTS = ["year", "month", "day", "day_of_week", "hour", "is_weekend", "quarter"]


# ---- creation ------------------------------------------------------------------------------------

def date_parts(df: DataFrame, columns: Sequence[str], parts: Sequence[str] = DATE_PARTS) -> DataFrame:
    """Numeric parts of dates; Monday is day 0, and the hour appears only where it varies or is not zero."""
    hours = {}
    if "hour" in parts:
        found = df.agg(*[F.max(F.hour(c)).alias(c) for c in columns]).first()
        hours = {c for c in columns if (found[c] or 0) > 0}
    return reduce(lambda rows, c: date_columns(rows, c, [p for p in parts if p != "hour" or c in hours]), columns, df)


def date_columns(df: DataFrame, column: str, parts: Sequence[str]) -> DataFrame:
    """The given parts of one date."""
    c = quoted(column)
    value = {
        "year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "day_of_week": F.weekday(c), "hour": F.hour(c),
        "is_weekend": F.coalesce((F.weekday(c) >= 5).cast("int"), F.lit(0)), "quarter": F.quarter(c), "week_of_year": F.weekofyear(c),
    }
    return df.withColumns({f"{column}_{part}": value[part] for part in parts})


def ratios(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """a / b; null where b is zero."""
    return df.withColumns({
        f"{a}_div_{b}": F.col(a).cast("double") / F.nullif(F.col(b).cast("double"), F.lit(0.0)) for a, b in pairs
    })


def interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Product and difference."""
    made = {}
    for a, b in pairs:
        made[f"{a}_x_{b}"] = F.col(a) * F.col(b)
        made[f"{a}_minus_{b}"] = F.col(a) - F.col(b)
    return df.withColumns(made)


def row_aggregates(df: DataFrame, columns: Sequence[str], group: str | None = None) -> DataFrame:
    """Mean, sample deviation, extremes and range across the columns of a row, and group means."""
    values = [measure(c) for c in columns]
    if len(values) < 2:
        return df
    n = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values[1:]), F.when(values[0].isNotNull(), 1).otherwise(0))
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values[1:]), F.coalesce(values[0], F.lit(0.0)))
    named = df.withColumns({"_n": n, "_row_mean": total / F.nullif(n.cast("double"), F.lit(0.0))})
    gaps = [F.coalesce((v - F.col("_row_mean")) * (v - F.col("_row_mean")), F.lit(0.0)) for v in values]
    squares = sum(gaps[1:], gaps[0])
    named = named.withColumns({
        "_row_std": F.when(F.col("_n") > 1, F.sqrt(squares / F.nullif(F.col("_n") - 1, F.lit(0)))),
        "_row_max": F.greatest(*values), "_row_min": F.least(*values),
    })
    named = named.withColumn("_row_range", F.col("_row_max") - F.col("_row_min")).drop("_n")
    return group_means(named, columns, group) if group else named


def group_means(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """The mean of the row's group as ``<column>_group_mean``; groups are aggregated before the join."""
    means = df.where(F.col(group).isNotNull()).groupBy(group).agg(*[F.avg(measure(c)).alias(f"{c}_group_mean") for c in columns])
    return attach(df, means, [group])


# ---- encoding ------------------------------------------------------------------------------------

def categories(df: DataFrame, column: str, most: int | None = None) -> list:
    """The sorted distinct values; with ``most``, at most one value more than that is fetched."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    if most is not None:
        values = values.limit(most + 1)
    return sorted((r[0] for r in values.collect()), key=str)


def distinct_counts(df: DataFrame, columns: Sequence[str], limit: int = FEW_CATEGORIES) -> dict[str, int]:
    """Distinct values per column, exact up to twice the limit and by sketch beyond it."""
    rough = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    counts = {}
    for c in columns:
        near = rough[c] <= 3 * limit
        counts[c] = df.where(F.col(c).isNotNull()).select(c).distinct().count() if near else rough[c]
    return counts


def one_hot_levels(df: DataFrame, columns: Sequence[str], most: int = 1000) -> dict[str, list]:
    """The levels that get a 0/1 column; the first is the reference. A wide column is an error."""
    levels = {}
    for c in columns:
        found = categories(df, c, most)
        if len(found) > most:
            raise ValueError(f"{c} has more than {most} values; use target or ordinal encoding")
        if len(found) > 1:
            levels[c] = found[1:]
    return levels


def one_hot(df: DataFrame, columns: Sequence[str], levels: dict[str, list] | None = None) -> DataFrame:
    """0/1 columns ``<column>_<value>`` without the first value; a missing value is all zeros."""
    levels = one_hot_levels(df, columns) if levels is None else levels
    made = {
        f"{c}_{value}": F.coalesce((quoted(c) == F.lit(value)).cast("int"), F.lit(0))
        for c, values in levels.items() for value in values
    }
    return df.withColumns(made).drop(*levels)


def target_means(df: DataFrame, column: str, target: str, smoothing: float = SMOOTHING) -> DataFrame:
    """(column, _code): the target mean of each value, pulled towards the overall mean."""
    overall = df.agg(F.avg(measure(target))).first()[0]
    groups = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.avg(measure(target)).alias("m"), F.count(measure(target)).alias("n")
    )
    pulled = (F.col("n") * F.coalesce(F.col("m"), F.lit(0.0)) + smoothing * F.lit(overall)) / (F.col("n") + smoothing)
    return groups.select(column, pulled.alias("_code"), F.lit(overall).alias("_overall"))


def target_encode(
    df: DataFrame, columns: Sequence[str], target: str, smoothing: float = SMOOTHING, fit_on: DataFrame | None = None
) -> DataFrame:
    """Replace columns by ``<column>_target_encoded``; values unseen in ``fit_on`` get the overall mean."""
    source = df if fit_on is None else fit_on
    overall = source.agg(F.avg(measure(target))).first()[0]
    result = df
    for c in columns:
        codes = target_means(source, c, target, smoothing).drop("_overall")
        result = attach(result, codes, [c])
        result = result.withColumn(f"{c}_target_encoded", F.coalesce(F.col("_code"), F.lit(overall))).drop("_code", c)
    return result


def ordinal_encode(df: DataFrame, columns: Sequence[str], orders: dict[str, Sequence] | None = None) -> DataFrame:
    """Replace values by their place in a given order or among the sorted values; unknown is null."""
    from ..plans.order import positions

    result = df
    for c in columns:
        given = (orders or {}).get(c)
        if given is not None:
            places = F.create_map(*[F.lit(x) for place, value in enumerate(given) for x in (str(value), place)])
            result = result.withColumn(c, places[F.col(c).cast("string")].cast("long"))
        else:
            # The dictionary of distinct values is numbered as a table, so it may be large.
            values = df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("_value")).distinct()
            codes = positions(values, ["_value"], name="_code")
            result = result.join(small(codes), F.col(c).cast("string") == F.col("_value"), "left")
            result = result.withColumn(c, F.col("_code")).drop("_value", "_code")
    return result


def auto_encode(
    df: DataFrame, columns: Sequence[str], target: str | None = None, threshold: int = FEW_CATEGORIES
) -> DataFrame:
    """One-hot up to the threshold; beyond it target encoding, or ordinal encoding without a target."""
    counts = distinct_counts(df, columns, threshold)
    few = [c for c in columns if 1 < counts[c] <= threshold]
    many = [c for c in columns if counts[c] > threshold]
    result = one_hot(df, few) if few else df
    if many:
        result = target_encode(result, many, target) if target in df.columns else ordinal_encode(result, many)
    return result


def encode(
    df: DataFrame, columns: Sequence[str], strategy: str = "auto", target: str | None = None, orders: dict | None = None
) -> DataFrame:
    if strategy == "auto":
        return auto_encode(df, columns, target)
    if strategy == "target" and target in df.columns:
        return target_encode(df, columns, target)
    if strategy == "ordinal":
        return ordinal_encode(df, columns, orders)
    return one_hot(df, columns)


# ---- scaling -------------------------------------------------------------------------------------

def scale_parameters(df: DataFrame, columns: Sequence[str], method: str = "standard", by: Sequence[str] = ()) -> DataFrame:
    """One row per segment: ``shift__c`` and ``width__c``; null width where the column is constant."""
    parts = []
    for c in columns:
        v = measure(c)
        if method == "standard":
            shift, width, usable = F.avg(v), F.stddev_pop(v), (F.count(v) >= 2) & (F.min(v) < F.max(v))
        else:
            shift, width, usable = F.min(v), F.max(v) - F.min(v), F.min(v) < F.max(v)
        parts += [F.when(usable, shift).alias(f"shift__{c}"), F.when(usable, width).alias(f"width__{c}")]
    return df.groupBy(*by).agg(*parts)


def _apply(df: DataFrame, parameters: DataFrame, columns: Sequence[str], by: Sequence[str], back: bool) -> DataFrame:
    known = attach(df, parameters, by)
    changed = {}
    for c in columns:
        shift, width = quoted(f"shift__{c}"), quoted(f"width__{c}")
        new: Column = measure(c) * width + shift if back else (measure(c) - shift) / width
        changed[c] = F.when(width.isNull(), measure(c)).otherwise(new)
    return known.withColumns(changed).drop(*[c for c in parameters.columns if c not in by])


def scale(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "standard",
    by: Sequence[str] = (),
    parameters: DataFrame | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Z-scores (population deviation) or the range [0, 1]; constant columns stay as they are."""
    columns = [c for c in columns if c not in exclude and is_numeric(df, c)]
    if not columns:
        return df
    if parameters is None:
        parameters = scale_parameters(df, columns, method, by)
    return _apply(df, parameters, columns, by, back=False)


def unscale(df: DataFrame, columns: Sequence[str], parameters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Undo ``scale`` with the same parameters."""
    return _apply(df, parameters, columns, by, back=True)
