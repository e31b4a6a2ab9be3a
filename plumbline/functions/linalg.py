"""Least squares on covariance matrices, one matrix per row: each segment is solved where it lives."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_NUMBER, _LIST = T.DoubleType(), T.ArrayType(T.DoubleType())
SOLUTION = T.StructType([
    T.StructField("intercept", _NUMBER), T.StructField("coefficients", _LIST), T.StructField("r2", _NUMBER),
    T.StructField("adjusted_r2", _NUMBER), T.StructField("mse", _NUMBER), T.StructField("rmse", _NUMBER),
    T.StructField("vif", _LIST), T.StructField("ridge", _NUMBER),
])
FIELDS = SOLUTION.fieldNames()
VIF_CAP = 10_000.0
SINGULAR = 1e-12


def square(flat, size: int) -> np.ndarray:
    """A symmetric matrix from its upper triangle, row by row."""
    matrix = np.zeros((size, size))
    matrix[np.triu_indices(size)] = flat
    return matrix + np.triu(matrix, 1).T


def without_noise(covariance: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Set the rounding noise that a constant column leaves to zero."""
    still = np.sqrt(np.abs(np.diag(covariance))) <= 1e-12 * np.abs(means)
    cleaned = covariance.copy()
    cleaned[still, :] = 0.0
    cleaned[:, still] = 0.0
    return cleaned


def ridge_for(predictors: int) -> float:
    return 1.0 if predictors > 5 else 0.001


def inflation(covariance: np.ndarray) -> list[float]:
    """Variance inflation factors: the diagonal of the inverse correlation matrix."""
    size = len(covariance)
    if size == 1:
        return [1.0]
    spread = np.sqrt(np.diag(covariance))
    factors = []
    for i in range(size):
        if spread[i] == 0.0:
            factors.append(1.0)
            continue
        others = [j for j in range(size) if j != i and spread[j] > 0.0]
        inner = covariance[np.ix_(others, others)] / np.outer(spread[others], spread[others])
        cross = covariance[others, i] / (spread[others] * spread[i])
        explained = float(cross @ np.linalg.lstsq(inner, cross, rcond=1e-12)[0]) if others else 0.0
        factors.append(min(VIF_CAP, 1.0 / (1.0 - explained)) if explained < 1.0 - 1e-13 else VIF_CAP)
    return factors


def solve(n: float, means, flat) -> dict | None:
    """Regress the first variable on the others. Falls back to ridge on a singular matrix."""
    size = len(means)
    means = np.asarray(means, dtype=float)
    covariance = without_noise(square(np.asarray(flat, dtype=float), size), means)
    xx, xy, yy = covariance[1:, 1:], covariance[1:, 0], covariance[0, 0]
    spread = np.sqrt(np.diag(xx))
    if not np.all(np.isfinite(covariance)):
        return None
    scale = np.where(spread > 0.0, spread, 1.0)
    correlation = xx / np.outer(scale, scale)
    ridge = None
    if np.linalg.eigvalsh(correlation)[0] > SINGULAR:
        coefficients = np.linalg.solve(correlation, xy / scale) / scale
    else:
        ridge = ridge_for(size - 1)
        coefficients = np.linalg.solve(xx + np.eye(size - 1) * ridge / n, xy)
    # Also right for ridge, where the residual is not orthogonal to the predictors.
    mse = max(0.0, float(yy - 2 * coefficients @ xy + coefficients @ xx @ coefficients))
    r2 = 1.0 - mse / yy if yy > 0.0 else 0.0
    p = size - 1
    return {
        "intercept": float(means[0] - coefficients @ means[1:]),
        "coefficients": [float(c) for c in coefficients],
        "r2": r2,
        "adjusted_r2": 1.0 - (1.0 - r2) * (n - 1) / (n - p - 1) if n > p + 1 else r2,
        "mse": mse,
        "rmse": float(np.sqrt(mse)),
        "vif": inflation(xx),
        "ridge": ridge,
    }


@F.pandas_udf(SOLUTION)
def _solve_rows(n: pd.Series, means: pd.Series, flat: pd.Series) -> pd.DataFrame:
    rows = []
    for count, mean, upper in zip(n, means, flat):
        usable = mean is not None and not any(v is None or np.isnan(v) for v in [*mean, *upper])
        solution = solve(float(count), mean, upper) if usable else None
        rows.append(solution or dict.fromkeys(FIELDS))
    return pd.DataFrame(rows, columns=FIELDS)


def least_squares(n: Column, means: Column, covariance: Column) -> Column:
    """Struct of the fit, from one row of complete-case moments (target first)."""
    return _solve_rows(n.cast("double"), means, covariance)


@F.pandas_udf(_LIST)
def _inflation_rows(means: pd.Series, flat: pd.Series) -> pd.Series:
    out = []
    for mean, upper in zip(means, flat):
        if any(v is None or np.isnan(v) for v in mean):
            out.append(None)
            continue
        matrix = square(np.asarray(upper, dtype=float), len(mean))
        out.append(inflation(without_noise(matrix, np.asarray(mean, dtype=float))))
    return pd.Series(out)


def vif(means: Column, covariance: Column) -> Column:
    return _inflation_rows(means, covariance)
