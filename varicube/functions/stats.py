"""Exact binomial tails and the normal quantile."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from varicube.functions.scalars import INFINITY

# Wichura's algorithm AS 241 (PPND16), coefficients by ascending power.
AS241_CENTRE = (
    (
        3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
        4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
    ),
    (
        1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
        2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
    ),
)
AS241_MIDDLE = (
    (
        1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
        1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
    ),
    (
        1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
        1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
    ),
)
AS241_TAIL = (
    (
        6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
        2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
    ),
    (
        1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
        7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
    ),
)


def _polynomial(coefficients, x: Column) -> Column:
    value = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        value = value * x + F.lit(c)
    return value


def _rational(table, x: Column) -> Column:
    # The denominators are positive over their ranges.
    return F.try_divide(_polynomial(table[0], x), _polynomial(table[1], x))


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution function; -inf at 0 and +inf at 1."""
    q = p - F.lit(0.5)
    r = F.sqrt(-F.log(F.when(q < 0, p).otherwise(F.lit(1.0) - p)))
    tail = F.when(r <= 5, _rational(AS241_MIDDLE, r - F.lit(1.6))).otherwise(_rational(AS241_TAIL, r - F.lit(5.0)))
    centre = q * _rational(AS241_CENTRE, F.lit(0.180625) - q * q)
    return (
        F.when((p < 0) | (p > 1) | F.isnan(p), F.lit(float("nan")))
        .when(p == 0, F.lit(-INFINITY))
        .when(p == 1, F.lit(INFINITY))
        .when(F.abs(q) <= 0.425, centre)
        .otherwise(F.when(q < 0, -tail).otherwise(tail))
    )


def normal_cdf_values(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2.0)) for v in z])


# log n! less Stirling's leading terms: exact below 16, a series from there on.
_SMALL_ERRORS = np.array(
    [0.0] + [math.lgamma(n + 1.0) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2.0 * math.pi) for n in range(1, 16)]
)


def _stirling_error(n: np.ndarray) -> np.ndarray:
    inverse = 1.0 / np.maximum(n, 16.0) ** 2
    series = (1.0 / 12 - inverse * (1.0 / 360 - inverse * (1.0 / 1260 - inverse / 1680))) / np.maximum(n, 16.0)
    return np.where(n < 16, _SMALL_ERRORS[np.minimum(n, 15.0).astype(int)], series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x without cancellation near the mean."""
    t = (x - mean) / mean
    near = np.abs(t) < 0.1
    small = np.where(near, t, 0.0)
    series = np.zeros_like(small)
    for k in range(18, 1, -1):
        series = series * small + (-1.0) ** k / (k * (k - 1.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = np.where(t > -1.0, (1.0 + t) * np.log1p(np.maximum(t, -1.0 + 1e-300)) - t, 1.0)
    return mean * np.where(near, series * small * small, plain)


def log_mass(x: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Log probability of ``x`` successes in ``n`` trials; -inf outside 0..n. Arrays of floats, 0 < p < 1."""
    inside = (x >= 0) & (x <= n) & (n > 0)
    m = np.where(inside, n, 2.0)
    k = np.where(inside & (x > 0) & (x < n), x, 1.0)
    k = np.where(m > 1, k, 0.5)
    body = (
        _stirling_error(m) - _stirling_error(np.round(k)) - _stirling_error(np.round(m - k))
        - _deviance(k, m * p) - _deviance(m - k, m * (1.0 - p)) + 0.5 * np.log(m / (2.0 * math.pi * k * (m - k)))
    )
    value = np.where(x == 0, m * math.log1p(-p), np.where(x == n, m * math.log(p), body))
    return np.where(inside, value, np.where((n == 0) & (x == 0), 0.0, -INFINITY))


def _fraction(a: np.ndarray, b: np.ndarray, x: float | np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by modified Lentz steps over all rows at once."""
    tiny = 1e-300
    c = np.ones_like(a)
    d = 1.0 / np.where(np.abs(1.0 - (a + b) * x / (a + 1.0)) < tiny, tiny, 1.0 - (a + b) * x / (a + 1.0))
    value, open_, m = d.copy(), np.ones(a.shape, dtype=bool), 0
    while open_.any():
        m += 1
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0)),
        ):
            d, c = 1.0 + step * d, 1.0 + step / c
            d, c = 1.0 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            change = c * d
            value = np.where(open_, value * change, value)
        open_ &= np.abs(change - 1.0) > 1e-15
        if m > 1_000_000:
            raise ArithmeticError("the incomplete beta function did not converge")
    return value


def upper_tail(x: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """P(X >= x) for X ~ Bin(n, p), relative accuracy also deep in the tail; constant memory per row."""
    q = 1.0 - p
    sure, never = x <= 0, x > n
    a, b = np.where(sure | never, 1.0, x), np.where(sure | never, 1.0, n - x + 1.0)
    direct = p < (a + 1.0) / (a + b + 2.0)
    forward = np.exp(log_mass(a, a + b - 1.0, p)) * q * _fraction(np.where(direct, a, 1.0), np.where(direct, b, 1.0), p)
    other = np.exp(log_mass(a - 1.0, a + b - 1.0, p)) * p * _fraction(np.where(direct, 1.0, b), np.where(direct, 1.0, a), q)
    return np.where(sure, 1.0, np.where(never, 0.0, np.clip(np.where(direct, forward, 1.0 - other), 0.0, 1.0)))


def lower_tail(x: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    return upper_tail(n - x, n, 1.0 - p)


def tails(x: np.ndarray, n: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """(two-sided, greater) exact p-values of ``x`` successes in ``n`` trials, row by row.

    Two-sided adds to the observed tail every outcome on the other side that is no likelier than the observed one,
    with the relative slack of 1e-7; a bisection finds where these begin, because the mass falls from the mean on.
    """
    x, n = np.asarray(x, dtype=float), np.asarray(n, dtype=float)
    if p <= 0.0 or p >= 1.0:
        certain = np.zeros_like(n) if p <= 0.0 else n
        return (x == certain).astype(float), (x <= certain).astype(float)
    greater = upper_tail(x, n, p)
    level = log_mass(x, n, p) + math.log1p(1e-7)
    below = x < n * p
    # First outcome above the mean (x below it), or last one below the mean (x above it), that counts.
    low = np.where(below, np.maximum(x + 1, np.ceil(n * p)), -1.0)
    high = np.where(below, n + 1.0, np.minimum(x - 1, np.floor(n * p)))
    while (low < high).any():
        middle = np.where(below, np.floor((low + high) / 2), np.ceil((low + high) / 2))
        counts = log_mass(middle, n, p) <= level
        going = low < high
        new_low = np.where(below, np.where(counts, low, middle + 1), np.where(counts, middle, low))
        new_high = np.where(below, np.where(counts, middle, high), np.where(counts, high, middle - 1))
        low, high = np.where(going, new_low, low), np.where(going, new_high, high)
    far = np.where(below, upper_tail(low, n, p), np.where(low < 0, 0.0, lower_tail(low, n, p)))
    near = np.where(below, lower_tail(x, n, p), greater)
    return np.where((n == 0) | (x == n * p), 1.0, np.minimum(1.0, near + far)), greater


def binomial_tails(x: int, n: int, p: float) -> tuple[float, float]:
    """(two-sided, greater) exact p-values of ``x`` successes in ``n`` trials."""
    two_sided, greater = tails(np.array([x]), np.array([n]), p)
    return float(two_sided[0]), float(greater[0])


def distinct_tails(x: np.ndarray, n: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Tails for arrays of counts; every distinct (x, n) is computed once."""
    pairs, back = np.unique(np.stack([x, n], axis=1), axis=0, return_inverse=True)
    two_sided, greater = tails(pairs[:, 0], pairs[:, 1], p)
    back = back.reshape(-1)
    return two_sided[back], greater[back]


def binomial_two_sided(n1: Column, n2: Column, p: float) -> Column:
    @F.pandas_udf(DoubleType())
    def two_sided(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.to_numpy(dtype=np.int64), b.to_numpy(dtype=np.int64)
        return pd.Series(distinct_tails(x, x + y, p)[0])

    return two_sided(n1.cast("bigint"), n2.cast("bigint"))


def binomial_greater(n1: Column, n2: Column, p: float) -> Column:
    @F.pandas_udf(DoubleType())
    def greater(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.to_numpy(dtype=np.int64), b.to_numpy(dtype=np.int64)
        return pd.Series(distinct_tails(x, x + y, p)[1])

    return greater(n1.cast("bigint"), n2.cast("bigint"))


def count_threshold(p: float, alpha: float = 0.05) -> int:
    """Smallest m for which m-1 or more of m falls below ``alpha`` under Bin(m, p)."""
    if not 0.0 < p < 1.0:
        raise ValueError("the case share must lie between 0 and 1")
    m = 1
    while m * p ** (m - 1) * (1.0 - p) + p**m >= alpha:
        m += 1
    return m
