"""Global order without a single partition: running totals, positions, ranks and carried values.

A group that fits one task is ordered with a plain window. A larger one is spread by range over
(by, order), written once, and stitched together from one subtotal per range.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .segments import TASK_ROWS, attach, largest_group
from .staging import stored


def _spread(df: DataFrame, order: Sequence[Column], by: Sequence[str]) -> DataFrame:
    ranged = df.repartitionByRange(*[F.col(k) for k in by], *order)
    return stored(ranged.withColumn("_range", F.spark_partition_id()))


def running_total(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    weight: str | None = None,
    name: str = "before",
    task_rows: int = TASK_ROWS,
    fits: bool | None = None,
) -> DataFrame:
    """Add the total weight (default: number) of the rows that precede each row.

    ``order`` must be unique within a segment. ``fits`` tells whether the largest segment is known to
    fit a task; otherwise it is counted.
    """
    amount = F.col(weight) if weight else F.lit(1)
    keys = [F.col(c) for c in order]
    if largest_group(df, by) <= task_rows if fits is None else fits:
        window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*keys)
        window = window.rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(amount).over(window), F.lit(0)).cast("long"))
    spread = _spread(df, keys, by)
    # One row per range and segment, so this window stays small however large the data is.
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        spread.groupBy(*by, "_range").agg(F.sum(amount).alias("_sum"))
        .select(*by, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_range", *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (
        attach(spread, offsets, [*by, "_range"])
        .withColumn(name, (F.col("_offset") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).cast("long"))
        .drop("_range", "_offset")
    )


def positions(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "position", task_rows: int = TASK_ROWS
) -> DataFrame:
    """Position 0..n-1 of each row in a unique order."""
    return running_total(df, order, by, name=name, task_rows=task_rows)


def average_ranks(
    df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank", task_rows: int = TASK_ROWS, fits: bool | None = None
) -> DataFrame:
    """One row per distinct value with its count and its average rank.

    Ranks come from the counted values, so a value held by a third of all rows costs one row here.
    """
    if fits is None:
        # There are no more distinct values than rows, and rows are cheaper to count.
        fits = True if largest_group(df, by) <= task_rows else None
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n_value"))
    ordered = running_total(counts, [value], by, weight="n_value", name="_before", task_rows=task_rows, fits=fits)
    return ordered.withColumn(name, F.col("_before") + (F.col("n_value") + 1) / 2).drop("_before")


def carry(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[str],
    by: Sequence[str] = (),
    forward: bool = True,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Fill missing values with the nearest earlier (or later) value in a unique order."""
    keys = [F.col(c) if forward else F.col(c).desc() for c in order]
    if largest_group(df, by) <= task_rows:
        window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*keys)
        window = window.rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(window) for c in columns})
    spread = _spread(df, [F.col(c) for c in order], by)
    nearest = F.max_by if forward else F.min_by
    # max_by skips rows whose ordering value is null: only rows that hold a value compete.
    where = F.struct(*order)
    edges = spread.groupBy(*by, "_range").agg(
        *[nearest(F.col(c), F.when(F.col(c).isNotNull(), where)).alias(f"_edge_{c}") for c in columns]
    )
    turn = F.col("_range") if forward else F.col("_range").desc()
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        *by, "_range", *[F.last(f"_edge_{c}", ignorenulls=True).over(earlier).alias(f"_edge_{c}") for c in columns]
    )
    inside = Window.partitionBy("_range", *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    filled = attach(spread, edges, [*by, "_range"]).withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_edge_{c}")) for c in columns}
    )
    return filled.drop("_range", *[f"_edge_{c}" for c in columns])
