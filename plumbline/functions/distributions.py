"""Tail probabilities of the t, chi-square, F and normal distributions for small result tables."""

import math
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_TINY = 1e-300
# Degrees of freedom above which tails are integrated instead of expanded in series. Both agree there.
MANY = 1_000.0
# Fall of the log density beyond which nothing is left to add, and the grid of the integral up to there.
_DEPTH, _PANELS = 45.0, 24
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)


def _log_gamma(values):
    return np.array([math.lgamma(v) for v in np.ravel(values)]).reshape(np.shape(values))


def _stirling_rest(values):
    """What Stirling's formula leaves out of log gamma; found without a difference of large numbers."""
    z = np.asarray(values, dtype=float)
    near = np.minimum(z, 16.0)
    small = _log_gamma(near) - (near - 0.5) * np.log(near) + near - 0.5 * math.log(2 * math.pi)
    far = np.maximum(z, 16.0)
    square = far * far
    large = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * square)) / square) / square) / square) / far
    return np.where(z < 16.0, small, large)


def _upper_tail(fall, peak, start):
    """Integral from ``start`` of ``peak`` * exp(``fall``(w)); the density of w is log-concave with its mode at 0.

    The ends of the integral are where the density has vanished on either side, found by doubling and halving.
    """
    def edge(sign, origin):
        reach = np.full_like(origin, 1e-9)
        base = fall(origin)
        deep = lambda r: ~(fall(origin + sign * r) > base - _DEPTH)
        while not np.all(done := deep(reach)):
            reach = np.where(done, reach, reach * 2)
        low, high = reach / 2, reach
        for _ in range(20):
            middle = (low + high) / 2
            low, high = np.where(deep(middle), low, middle), np.where(deep(middle), middle, high)
        return origin + sign * high

    start = np.maximum(start, edge(-1.0, np.zeros_like(start)))
    width = (edge(1.0, np.maximum(start, 0.0)) - start) / _PANELS
    total = np.zeros_like(start)
    for panel in range(_PANELS):
        for node, weight in zip(_NODES, _WEIGHTS):
            total += weight * np.exp(fall(start + width * (panel + (node + 1) / 2)))
    return np.clip(peak * total * width / 2, 0.0, 1.0)


def _chi2_integral(x, dof):
    """Upper tail of chi-square over w = log(x / dof)."""
    k = dof / 2
    return _upper_tail(lambda w: k * (w - np.expm1(w)), np.sqrt(k / (2 * np.pi)) * np.exp(-_stirling_rest(k)), np.log(x / dof))


def _f_integral(f, dof1, dof2):
    """Upper tail of F over w = log(f)."""
    a, b = dof1 / 2, dof2 / 2
    rest = _stirling_rest(a + b) - _stirling_rest(a) - _stirling_rest(b)
    share = a / (a + b)
    # for large w the exponential is taken out of the logarithm
    grown = lambda w: np.where(w < 30, np.log1p(share * np.expm1(np.minimum(w, 30))), w + np.log(share))
    return _upper_tail(lambda w: a * w - (a + b) * grown(w), np.sqrt(a * (b / (a + b)) / (2 * np.pi)) * np.exp(rest), np.log(f))


def _either(first, second, choice, *values):
    """``first`` of the values where ``choice`` holds, ``second`` of the others."""
    values = np.broadcast_arrays(*values)
    out = np.empty(values[0].shape)
    for function, where in ((first, choice), (second, ~choice)):
        if where.any():
            out[where] = function(*(v[where] for v in values))
    return out


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz iteration)."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in count(1):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + numerator / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
        if not np.any(np.abs(d * c - 1.0) >= 1e-14):
            return h


def incomplete_beta(a, b, x):
    """Regularised incomplete beta function, for parameters up to about ``MANY``."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    x = np.clip(x, 0.0, 1.0)
    below = x < (a + 1.0) / (a + b + 2.0)
    # the fraction converges fast on its own side only
    one, two, at = np.where(below, a, b), np.where(below, b, a), np.where(below, x, 1.0 - x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(
            _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + one * np.log(at) + two * np.log1p(-at)
        )
        part = front * _beta_fraction(one, two, at) / one
    result = np.where(below, part, 1.0 - part)
    return np.where(x <= 0.0, 0.0, np.where(x >= 1.0, 1.0, result))


def upper_gamma(a, x):
    """Regularised upper incomplete gamma function, for a up to about ``MANY``: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(a * np.log(x) - x - _log_gamma(a))
        near, far = np.minimum(x, a + 1.0), np.maximum(x, a + 1.0)
        term = 1.0 / a
        total = term.copy()
        for k in count(1):
            term = term * near / (a + k)
            total = total + term
            if not np.any(term >= 1e-16 * total):
                break
        b = far + 1.0 - a
        c = np.full_like(far, 1.0 / _TINY)
        d = 1.0 / np.where(np.abs(b) < _TINY, _TINY, b)
        h = d.copy()
        for k in count(1):
            step = -k * (k - a)
            b = b + 2.0
            d = step * d + b
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + step / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
            if not np.any(np.abs(d * c - 1.0) >= 1e-14):
                break
        result = np.where(x < a + 1.0, 1.0 - front * total, front * h)
    return np.where(x <= 0.0, 1.0, np.where(np.isinf(x), 0.0, np.clip(result, 0.0, 1.0)))


def t_two_sided(t, dof):
    """Two-sided tail of t, which is the upper tail of F with one degree of freedom at t * t."""
    t, dof = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(dof, dtype=float))
    return f_upper(t * t, np.ones_like(dof), dof)


def chi2_upper(x, dof):
    x, dof = np.broadcast_arrays(np.asarray(x, dtype=float), np.asarray(dof, dtype=float))
    integrated = (dof > MANY) & (x > 0) & np.isfinite(x)
    return _either(_chi2_integral, lambda v, d: upper_gamma(d / 2.0, v / 2.0), integrated, x, dof)


def f_upper(f, dof1, dof2):
    f, dof1, dof2 = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (f, dof1, dof2)))

    def series(v, d1, d2):
        v = np.maximum(v, 0.0)
        with np.errstate(invalid="ignore"):
            x = np.where(np.isinf(v), 0.0, d2 / (d2 + d1 * np.where(np.isinf(v), 1.0, v)))
        return np.where(v <= 0.0, 1.0, incomplete_beta(d2 / 2.0, d1 / 2.0, x))

    integrated = (np.maximum(dof1, dof2) > MANY) & (f > 0) & np.isfinite(f)
    return _either(_f_integral, series, integrated, f, dof1, dof2)


def normal_two_sided(z):
    return upper_gamma(0.5, np.asarray(z, dtype=float) ** 2 / 2.0)


def _tail(function, *columns: pd.Series) -> pd.Series:
    frame = pd.concat(columns, axis=1).astype(float)
    known = frame.notna().all(axis=1) & (frame.iloc[:, 1:] > 0).all(axis=1)
    values = frame.to_numpy()[known.to_numpy()]
    result = np.full(len(frame), np.nan)
    result[known.to_numpy()] = function(*values.T)
    return pd.Series(result, index=frame.index)


@F.pandas_udf(T.DoubleType())
def _t_tail(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _tail(t_two_sided, t, dof)


@F.pandas_udf(T.DoubleType())
def _chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _tail(chi2_upper, x, dof)


@F.pandas_udf(T.DoubleType())
def _f_tail(f: pd.Series, dof1: pd.Series, dof2: pd.Series) -> pd.Series:
    return _tail(f_upper, f, dof1, dof2)


def _double(column: Column) -> Column:
    return column.cast("double")


def t_pvalue(t: Column, dof: Column) -> Column:
    """Two-sided p-value; null where the statistic or a positive dof is missing."""
    return F.nanvl(_t_tail(_double(t), _double(dof)), F.lit(None).cast("double"))


def chi2_pvalue(x: Column, dof: Column) -> Column:
    return F.nanvl(_chi2_tail(_double(x), _double(dof)), F.lit(None).cast("double"))


def f_pvalue(f: Column, dof1: Column, dof2: Column) -> Column:
    return F.nanvl(_f_tail(_double(f), _double(dof1), _double(dof2)), F.lit(None).cast("double"))
