"""Exact percentiles (linear interpolation) at any number of distinct values.

Percentiles are selected by brackets. A sketch brackets each wanted rank, a scan counts what lies below and inside each
bracket, and only values inside brackets that hold more than one value are gathered. Where segments are very
many, the table is condensed to counted values instead.
"""

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .order import running_total
from .segments import BUFFER_VALUES, TASK_ROWS, as_long, attach, measure

# Rank error of the sketches, as a share: of one sketch a column, and of one a segment and column.
ACCURACY, SEGMENT_ACCURACY = 10_000, 1_000
# Segments up to which each has a bracket for every column and probability, which the driver holds.
SEGMENTS = 2_000


def fits_buffer(df: DataFrame, columns: Sequence[str], bound: int = BUFFER_VALUES) -> bool:
    """Whether every column has few enough distinct values to be held in one aggregation buffer."""
    if bound <= 0:
        return False
    counts = df.agg(*[F.approx_count_distinct(measure(c)).alias(c) for c in columns]).first()
    # The sketch errs by about 5 percent; the factor keeps the bound safe.
    return max(counts) * 1.2 <= bound


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, value, n): the table condensed to its distinct values, merged before the shuffle."""
    long = as_long(df, columns, by).where(F.col("value").isNotNull())
    return long.groupBy(*by, "column", "value").agg(F.count("*").alias("n"))


def _probs(probs: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(p)) for p in probs])


def percentiles_of_counts(
    counts: DataFrame, probs: Sequence[float], keys: Sequence[str], held: bool, task_rows: int = TASK_ROWS
) -> DataFrame:
    """(keys..., percentiles, total) from counted values.

    ``held`` says that the distinct values of a key fit an aggregation buffer. Otherwise running totals
    over the ordered values find the two neighbours of each position.
    """
    if held:
        found = F.percentile("value", _probs(probs), F.col("n"))
        return counts.groupBy(*keys).agg(found.alias("percentiles"), F.sum("n").alias("total"))
    ordered = running_total(counts, ["value"], keys, weight="n", name="_before", task_rows=task_rows)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    placed = attach(ordered, totals, keys, few=True if list(keys) == ["column"] else None)

    def at(position):
        return F.max(F.when(F.col("_before") <= position, F.col("value")))

    spots = [(F.col("total") - 1) * F.lit(float(p)) for p in probs]
    parts = []
    for i, spot in enumerate(spots):
        parts += [at(F.floor(spot)).alias(f"_lo{i}"), at(F.ceil(spot)).alias(f"_hi{i}")]
    found = placed.groupBy(*keys).agg(*parts, F.max("total").alias("total"))
    values = [
        F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (spot - F.floor(spot)) for i, spot in enumerate(spots)
    ]
    return found.select(*keys, F.array(*values).alias("percentiles"), "total")


def _brackets(edges: Sequence[float] | None) -> list[tuple[float, float]]:
    """Disjoint intervals from (low, high, low, high, ...), overlapping ones merged."""
    merged = []
    for low, high in sorted(zip(edges[::2], edges[1::2])) if edges else []:
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _inside(v: Column, low: Column, high: Column) -> Column:
    return F.coalesce((v >= low) & (v <= high), F.lit(False))


def _bracketed(df: DataFrame, columns: Sequence[str], by: Sequence[str], brackets: list[tuple[tuple, list]], most: int) -> tuple[DataFrame, list]:
    """(by..., _m0, _m1, ...) with, for each column, the (low, high) columns of its brackets: literals without segments."""
    values = df.select(*by, *[measure(c).alias(f"_m{i}") for i, c in enumerate(columns)])
    if not by:
        return values, [[(F.lit(low), F.lit(high)) for low, high in own] for own in brackets[0][1]]
    names = [f"_{side}{i}_{n}" for i in range(len(columns)) for n in range(most) for side in ("low", "high")]
    shape = T.StructType([df.schema[k] for k in by] + [T.StructField(name, T.DoubleType()) for name in names])
    rows = [(*key, *[end for own in each for pair in [*own, *[(None, None)] * (most - len(own))] for end in pair]) for key, each in brackets]
    values = attach(values, df.sparkSession.createDataFrame(rows, shape), by, few=True)
    return values, [[(F.col(f"_low{i}_{n}"), F.col(f"_high{i}_{n}")) for n in range(most)] for i in range(len(columns))]


def _gathered(values: DataFrame, ends: list, by: Sequence[str]) -> DataFrame:
    """(by..., place, bracket, value, n): the counted values inside the brackets that have more than one."""
    cells, wanted = [], F.lit(False)
    for i, own in enumerate(ends):
        v = F.col(f"_m{i}")
        for b, (low, high) in enumerate(own):
            here = _inside(v, low, high) & (low < high)
            wanted = wanted | here
            cells.append(F.when(here, F.struct(F.lit(i).alias("place"), F.lit(b).alias("bracket"), v.alias("value"))))
    found = values.where(wanted).select(*by, F.explode(F.array_compact(F.array(*cells))).alias("_c")).select(*by, "_c.*")
    return found.groupBy(*by, "place", "bracket", "value").agg(F.count("*").alias("n"))


def _select(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str], bound: int, task_rows: int) -> list[tuple] | None:
    """(by..., column, percentiles, total) by brackets; None if segments are too many, or a sketch missed a rank.

    The driver holds the brackets and counts of each segment and column, whose number is bounded.
    """
    if by and df.select(*by).distinct().limit(SEGMENTS + 1).count() > SEGMENTS:
        return None
    accuracy = SEGMENT_ACCURACY if by else ACCURACY
    edges = [min(max(p + side * 2.0 / accuracy, 0.0), 1.0) for p in probs for side in (-1, 1)]
    sketches = df.groupBy(*by).agg(
        *[F.percentile_approx(measure(c), edges, accuracy).alias(f"_s{i}") for i, c in enumerate(columns)],
        *[F.count(measure(c)).alias(f"_n{i}") for i, c in enumerate(columns)],
    ).collect()
    if not sketches:
        return []
    brackets = [(tuple(r[k] for k in by), [_brackets(r[f"_s{i}"]) for i in range(len(columns))]) for r in sketches]
    totals = {tuple(r[k] for k in by): [r[f"_n{i}"] for i in range(len(columns))] for r in sketches}
    most = max((len(own) for _, each in brackets for own in each), default=0)
    values, ends = _bracketed(df, columns, by, brackets, most)
    below = [
        a for i, own in enumerate(ends) for b, (low, high) in enumerate(own)
        for a in (F.count_if(F.col(f"_m{i}") < low).alias(f"_b{i}_{b}"), F.count_if(F.col(f"_m{i}") <= high).alias(f"_u{i}_{b}"))
    ]
    counts = {tuple(r[k] for k in by): r for r in values.groupBy(*by).agg(*below).collect()} if below else {}

    # each rank, its bracket, and how many values of the bracket precede it
    wanted: dict[tuple, set] = {}
    spots = {}
    for key, each in brackets:
        for i, own in enumerate(each):
            for p in probs if totals[key][i] else ():
                spot = (totals[key][i] - 1) * p
                for rank in (floor(spot), ceil(spot)):
                    at = next((b for b in range(len(own)) if counts[key][f"_b{i}_{b}"] <= rank < counts[key][f"_u{i}_{b}"]), None)
                    if at is None:
                        return None
                    spots[key, i, rank] = at, rank - counts[key][f"_b{i}_{at}"]
                    if own[at][0] < own[at][1]:
                        wanted.setdefault((i, at), set()).add(rank - counts[key][f"_b{i}_{at}"])
    picked = {}
    if wanted:
        gathered, keys = _gathered(values, ends, by), [*by, "place", "bracket"]
        largest = max(counts[key][f"_u{i}_{b}"] - counts[key][f"_b{i}_{b}"] for key, each in brackets for i, own in enumerate(each) for b in range(len(own)))
        ordered = running_total(gathered, ["value"], keys, weight="n", name="_before", task_rows=task_rows, fits=largest <= min(bound, task_rows))
        ranks = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(b).alias("bracket"), F.lit(rank).cast("long").alias("rank")) for (i, b), own in wanted.items() for rank in own])
        hits = F.filter(ranks, lambda w: (w["place"] == F.col("place")) & (w["bracket"] == F.col("bracket")) & (w["rank"] >= F.col("_before")) & (w["rank"] < F.col("_before") + F.col("n")))
        for r in ordered.select(*keys, "value", F.explode(hits).alias("_h")).collect():
            picked[tuple(r[k] for k in by), r["place"], r["bracket"], r["_h"]["rank"]] = r["value"]
    rows = []
    for key, each in brackets:
        for i, own in enumerate(each):
            if not totals[key][i]:
                continue
            found = []
            for p in probs:
                spot = (totals[key][i] - 1) * p
                low, high = (
                    own[at][0] if own[at][0] == own[at][1] else picked[key, i, at, rest] for at, rest in (spots[key, i, r] for r in (floor(spot), ceil(spot)))
                )
                found.append(low + (high - low) * (spot - floor(spot)) if high != low else low)
            rows.append((*key, columns[i], found, totals[key][i]))
    return rows


def percentiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    bound: int = BUFFER_VALUES,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """(by..., column, percentiles, total): exact percentiles of each numeric column, and how many values it has.

    ``bound`` is the number of values inside brackets, or of distinct values of a segment, that one task holds.
    """
    rows = _select(df, columns, probs, by, bound, task_rows)
    if rows is not None:
        shape = T.StructType([*[df.schema[k] for k in by], T.StructField("column", T.StringType()), T.StructField("percentiles", T.ArrayType(T.DoubleType())), T.StructField("total", T.LongType())])
        return df.sparkSession.createDataFrame(rows, shape)
    held = fits_buffer(df, columns, bound)
    found = percentiles_of_counts(value_counts(df, columns, by), probs, [*by, "column"], held, task_rows)
    return found.select(*by, "column", "percentiles", "total")


def wide_percentiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    bound: int = BUFFER_VALUES,
) -> DataFrame:
    """One row per segment with an array ``pct__<column>`` and a number of values ``n__<column>`` for each column."""
    long = percentiles(df, columns, probs, by, bound)
    return long.groupBy(*by).agg(
        *[F.first(F.when(F.col("column") == c, F.col("percentiles")), ignorenulls=True).alias(f"pct__{c}") for c in columns],
        *[F.coalesce(F.first(F.when(F.col("column") == c, F.col("total")), ignorenulls=True), F.lit(0)).alias(f"n__{c}") for c in columns],
    )
