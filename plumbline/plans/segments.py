"""Working with optional segment keys (``by``) and the statistics of each segment."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Rows that one task may sort or hold as a group. Larger groups take a spread-out path.
TASK_ROWS = 4_000_000
# Distinct values that one aggregation buffer may hold.
BUFFER_VALUES = 1_000_000
# Rows up to which a table of statistics or a dictionary is sent to every executor.
BROADCAST_ROWS = 100_000
# Bytes of text in such a table up to which the same holds.
BROADCAST_BYTES = 32 << 20


def same_keys(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality of key columns; Spark hashes on it like on plain equality."""
    return reduce(lambda a, b: a & b, [left[f"`{a}`"].eqNullSafe(right[f"`{b}`"]) for a, b in pairs])


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has few rows and little text; at most one row more than ``rows`` is looked at."""
    text = F.lit(0).cast("long")
    for place, field in enumerate(df.schema.fields):
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            text = text + F.coalesce(F.octet_length(F.col(f"_{place}")), F.lit(0))
    places = df.toDF(*[f"_{place}" for place in range(len(df.columns))])
    facts = places.select(text.alias("bytes")).limit(rows + 1).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    return facts["n"] <= rows and (facts["bytes"] or 0) <= BROADCAST_BYTES


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its rows and their text are few; Spark joins by shuffle otherwise."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df


def attach(
    rows: DataFrame, stats: DataFrame, by: Sequence[str] = (), how: str = "left", few: bool | None = None
) -> DataFrame:
    """Add each segment's statistics to its rows.

    Without segments there is exactly one row of statistics, which becomes literals. With segments
    the segments and the bytes of their text are counted (a scan of keys and text only): few are broadcast,
    so the rows need no shuffle; many are joined by shuffle, where Spark splits skewed segments.
    ``few`` skips the count: True for a known bound, False to leave the choice to Spark.
    """
    if not by:
        values = stats.first() or dict.fromkeys(stats.columns)
        literals = [F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in stats.schema.fields]
        return rows.select("*", *literals)
    keyed = stats.select(
        *[quoted(k).alias(f"__{k}") for k in by], *[quoted(c) for c in stats.columns if c not in by]
    )
    if few is None:
        texts = [f.name for f in stats.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in by]
        few = fits_broadcast(stats.select(*[quoted(k) for k in by], *[stats[f"`{c}`"] for c in texts]))
    if few:
        keyed = F.broadcast(keyed)
    joined = rows.join(keyed, same_keys(rows, keyed, [(k, f"__{k}") for k in by]), how)
    return joined.drop(*[f"__{k}" for k in by])


def largest_group(df: DataFrame, by: Sequence[str] = ()) -> int:
    """Rows of the largest segment; decides between a plain window and a spread-out one."""
    if not by:
        return df.count()
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def text_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def quoted(column: str) -> Column:
    """The column with exactly this name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def measure(column: str) -> Column:
    """A column as double, with NaN and text that is no number read as missing; any name will do."""
    return F.nanvl(quoted(column).try_cast("double"), F.lit(None).cast("double"))


def as_long(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, value): one row per cell of the numeric columns."""
    wide = df.select(*by, *[measure(c).alias(f"__v_{c}") for c in columns])
    long = wide.unpivot(list(by), [f"__v_{c}" for c in columns], "column", "value")
    return long.withColumn("column", F.substring("column", 5, 100_000))


def as_long_text(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, value): one row per cell, values as text."""
    wide = df.select(*by, *[F.col(c).cast("string").alias(f"__v_{c}") for c in columns])
    long = wide.unpivot(list(by), [f"__v_{c}" for c in columns], "column", "value")
    return long.withColumn("column", F.substring("column", 5, 100_000))


def stack_columns(
    wide: DataFrame, columns: Sequence[str], fields: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Turn ``field__column`` aggregates (one row per segment) into one row per column."""
    per_column = [
        F.struct(F.lit(c).alias("column"), *[quoted(f"{f}__{c}").alias(f) for f in fields]) for c in columns
    ]
    return wide.select(*by, F.explode(F.array(*per_column)).alias("_r")).select(*by, "_r.*")
