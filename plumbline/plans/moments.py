"""Counts, means and covariances of complete rows: one pass, one row per segment."""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.linalg import square

# Beyond this many columns the pair aggregates outgrow generated code; matrix products take over.
FEW_TERMS = 10
_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def complete_moments(
    df: DataFrame, terms: dict[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """(by..., n, means, covariance): population covariance as an upper triangle, row by row.

    Rows with a missing term are left out. Spark's covariance aggregates merge centred partial
    sums, so large offsets cost no precision and only one small row per task is shuffled.
    """
    names = list(terms)
    rows = df.select(*by, *[e.cast("double").alias(f"_t{i}") for i, e in enumerate(terms.values())])
    rows = rows.dropna(subset=[f"_t{i}" for i in range(len(names))])
    means = F.array(*[F.avg(f"_t{i}") for i in range(len(names))])
    upper = F.array(*[
        F.covar_pop(f"_t{i}", f"_t{j}") for i in range(len(names)) for j in range(i, len(names))
    ])
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), means.alias("means"), upper.alias("covariance")
    )


def pairwise_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) per pair of double columns over its complete rows.

    Values are centred on the column means first. Each task adds up matrix products of its Arrow
    batches and hands on one small row per pair.
    """
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    shift = np.array([means[c] if means[c] is not None else 0.0 for c in columns])
    names, size = list(columns), len(columns)
    left, right = np.triu_indices(size)

    def add_up(batches):
        total = np.zeros((6, size, size))
        for batch in batches:
            values = batch[names].to_numpy(dtype=float) - shift
            held = (~np.isnan(values)).astype(float)
            values = np.where(held > 0, values, 0.0)
            squares = values * values
            total += np.stack([
                held.T @ held, values.T @ held, held.T @ values, squares.T @ held, held.T @ squares, values.T @ values,
            ])
        sums = total[:, left, right]
        yield pd.DataFrame({"i": left, "j": right, **dict(zip(_SUMS, sums))})

    schema = "i int, j int, " + ", ".join(f"{name} double" for name in _SUMS)
    partial = df.select(*columns).mapInPandas(add_up, schema)
    return partial.groupBy("i", "j").agg(*[F.sum(name).alias(name) for name in _SUMS])


def moments_row(df: DataFrame, terms: dict[str, Column]) -> tuple[int, np.ndarray, np.ndarray]:
    """The moments of the complete rows of an unsegmented table as (n, means, matrix)."""
    size = len(terms)
    if size > FEW_TERMS:
        return _matrix_moments(df, terms)
    row = complete_moments(df, terms).first()
    if not row["n"]:
        return 0, np.zeros(size), np.zeros((size, size))
    return row["n"], np.array(row["means"]), square(np.array(row["covariance"]), size)


def _matrix_moments(df: DataFrame, terms: dict[str, Column]) -> tuple[int, np.ndarray, np.ndarray]:
    names = [f"_t{i}" for i in range(len(terms))]
    rows = df.select(*[e.cast("double").alias(n) for n, e in zip(names, terms.values())]).dropna()
    means = rows.agg(*[F.avg(n).alias(n) for n in names]).first()
    matrix, n = np.zeros((len(names), len(names))), 0
    for r in pairwise_sums(rows, names).collect():
        n = int(r["n"])
        if n:
            value = (r["sxy"] - r["sx"] * r["sy"] / n) / n
            matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = value
    return n, np.array([means[c] if means[c] is not None else 0.0 for c in names]), matrix
