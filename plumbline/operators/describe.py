"""Descriptive statistics: one row per column, or per segment and column."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.bands import skewness_label
from ..plans.quantiles import percentiles, value_counts
from ..plans.segments import BUFFER_VALUES, as_long_text, attach, measure, numeric_columns, stack_columns

FIELDS = [
    "count", "null_count", "mean", "median", "mode", "std", "variance", "min", "max", "range",
    "q1", "q3", "iqr", "skewness", "kurtosis", "outlier_count",
]
OUTLIER_FACTOR = 1.5


def describe(
    df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), bound: int = BUFFER_VALUES
) -> DataFrame:
    """Numeric summary: a pass for the moments, two that select the quartiles, and one that counts values for mode and outliers.

    An exact mode needs all values counted; copies are merged before that shuffle.
    """
    columns = list(columns or numeric_columns(df, exclude=by))
    keys = [*by, "column"]
    aggregates = []
    for c in columns:
        v = measure(c)
        n = F.count(v)
        aggregates += [
            n.alias(f"count__{c}"),
            (F.count(F.lit(1)) - n).alias(f"null_count__{c}"),
            F.avg(v).alias(f"mean__{c}"),
            F.when(n > 1, F.stddev_samp(v)).when(n == 1, F.lit(0.0)).alias(f"std__{c}"),
            F.when(n > 1, F.var_samp(v)).when(n == 1, F.lit(0.0)).alias(f"variance__{c}"),
            F.min(v).alias(f"min__{c}"),
            F.max(v).alias(f"max__{c}"),
            F.when(n >= 3, F.skewness(v)).when(n > 0, F.lit(0.0)).alias(f"skewness__{c}"),
            F.when(n >= 3, F.kurtosis(v)).when(n > 0, F.lit(0.0)).alias(f"kurtosis__{c}"),
        ]
    moments = stack_columns(
        df.groupBy(*by).agg(*aggregates), columns,
        ["count", "null_count", "mean", "std", "variance", "min", "max", "skewness", "kurtosis"], by,
    )
    q1, median, q3 = (F.col("percentiles")[i] for i in range(3))
    placed = percentiles(df, columns, [0.25, 0.5, 0.75], by, bound)
    placed = placed.select(*keys, q1.alias("q1"), median.alias("median"), q3.alias("q3"), (q3 - q1).alias("iqr"))
    lower, upper = F.col("q1") - OUTLIER_FACTOR * F.col("iqr"), F.col("q3") + OUTLIER_FACTOR * F.col("iqr")
    value, n = F.col("value"), F.col("n")
    # Without segments there is one row per column, which is a proven bound.
    few = None if by else True
    shape = attach(value_counts(df, columns, by), placed, keys, few=few).groupBy(*keys).agg(
        F.max_by(value, F.struct(n, -value)).alias("mode"),
        F.sum(F.when((value < lower) | (value > upper), n).otherwise(0)).alias("outlier_count"),
        *[F.first(c).alias(c) for c in ("q1", "median", "q3", "iqr")],
    )
    summary = attach(moments, shape, keys, few=bool(few)).withColumns({
        "range": F.col("max") - F.col("min"), "outlier_count": F.coalesce("outlier_count", F.lit(0)),
    })
    return summary.select(*keys, *FIELDS)


def value_modes(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., mode): most frequent value, the smallest on ties; counted before it is compared."""
    counts = long.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count("*").alias("n"))
    top = counts.groupBy(*keys).agg(F.max("n").alias("n"))
    winners = counts.join(top, [*keys, "n"])
    return winners.groupBy(*keys).agg(F.min("value").alias("mode"))


def frequencies(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, value, count, share): frequency table without missing values."""
    long = as_long_text(df, columns, by).where(F.col("value").isNotNull())
    counts = long.groupBy(*by, "column", "value").agg(F.count("*").alias("count"))
    totals = counts.groupBy(*by, "column").agg(F.sum("count").alias("_total"))
    shares = attach(counts, totals, [*by, "column"], few=None if by else True).withColumn("share", F.col("count") / F.col("_total"))
    return shares.drop("_total")


def text_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, count, null_count, distinct_count, mode) of non-numeric columns."""
    counted = as_long_text(df, columns, by).groupBy(*by, "column", "value").agg(F.count("*").alias("n"))
    seen = F.col("value").isNotNull()
    summary = counted.groupBy(*by, "column").agg(
        F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(~seen, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.max(F.when(seen, F.col("n"))).alias("_top"),
    )
    few = None if by else True
    winners = attach(counted.where(seen), summary.select(*by, "column", "_top"), [*by, "column"], few=few)
    modes = winners.where(F.col("n") == F.col("_top")).groupBy(*by, "column").agg(F.min("value").alias("mode"))
    return attach(summary.drop("_top"), modes, [*by, "column"], few=bool(few))


def column_percentiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), bound: int = BUFFER_VALUES
) -> DataFrame:
    """(by..., column, prob, value): arbitrary exact percentiles."""
    found = percentiles(df, columns, probs, by, bound)
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), F.col("percentiles").alias("value"))
    return found.select(*by, "column", F.explode(pairs).alias("_p")).select(
        *by, "column", F.col("_p").getField("prob").alias("prob"), F.col("_p").getField("value").alias("value")
    )


def date_range(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, count, null_count, min, max) of date and time columns."""
    aggregates = []
    for c in columns:
        aggregates += [
            F.count(c).alias(f"count__{c}"),
            (F.count(F.lit(1)) - F.count(c)).alias(f"null_count__{c}"),
            F.min(c).cast("timestamp").alias(f"min__{c}"),
            F.max(c).cast("timestamp").alias(f"max__{c}"),
        ]
    wide = df.groupBy(*by).agg(*aggregates)
    return stack_columns(wide, columns, ["count", "null_count", "min", "max"], by)


def describe_by_type(
    df: DataFrame, profile: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """The measures that suit each column's semantic type: numeric, text and date tables."""
    types = {r["column"]: r["type"] for r in profile.select("column", "type").collect()}
    wanted = [c for c in (columns or types) if c in types and c not in by]
    numeric = [c for c in wanted if c in numeric_columns(df) and types[c] in ("continuous", "ordinal", "binary")]
    dates = [c for c in wanted if types[c] == "datetime"]
    other = [c for c in wanted if c not in numeric and c not in dates]
    result = {}
    if numeric:
        result["numeric"] = describe(df, numeric, by)
    if other:
        result["text"] = text_summary(df, other, by)
    if dates:
        result["datetime"] = date_range(df, dates, by)
    return result


def with_skewness_label(summary: DataFrame) -> DataFrame:
    return summary.withColumn("skewness_label", skewness_label(F.col("skewness")))
