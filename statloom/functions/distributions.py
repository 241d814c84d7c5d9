"""Probability distributions: normal, Student t, chi-squared, Poisson, binomial.

Each function is written for numbers; ``column`` makes it a vectorised column function. None (null) where a value is undefined.
The special functions follow the published series and continued fractions (Lentz's method).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Acklam's rational approximation of the normal quantile, in three regions that meet at TAIL and 1 - TAIL.
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
TAIL = 0.02425


def _fine(*values: float) -> bool:
    return all(v is not None and math.isfinite(v) for v in values)


# Special functions


def _fraction(step: Callable[[int], tuple[float, float]], first: float, rounds: int = 10_000) -> float | None:
    """The continued fraction first + a1 / (b1 + a2 / (b2 + ...)) with step(i) = (a, b)."""
    tiny = 1e-300
    value = first or tiny
    c, d = value, 0.0
    for i in range(1, rounds):
        a, b = step(i)
        d = 1 / ((b + a * d) or tiny)
        c = (b + a / c) or tiny
        value *= c * d
        if abs(c * d - 1) < 3e-16:
            return value
    return None


def incomplete_beta(x: float, a: float, b: float) -> float | None:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        other = incomplete_beta(1 - x, b, a)
        return None if other is None else 1 - other

    def step(i: int) -> tuple[float, float]:
        m, odd = divmod(i - 1, 2)
        if i == 1:
            return 1.0, 1.0
        m = (i - 1) // 2
        if odd == 0:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    value = _fraction(step, 0.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return None if value is None else min(1.0, front * value)


def incomplete_gamma(a: float, x: float) -> float | None:
    """The regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 100_000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-17:
                break
        return min(1.0, front * total)
    value = _fraction(lambda i: (1.0 if i == 1 else -(i - 1) * (i - 1 - a), x + 2 * i - 1 - a), 0.0)
    return None if value is None else max(0.0, 1 - front * value)


# Normal


def normal_log_pdf(x: float, mean: float = 0.0, sd: float = 1.0) -> float | None:
    if not _fine(x, mean, sd) or sd <= 0:
        return None
    return -0.5 * ((x - mean) / sd) ** 2 - math.log(sd) - 0.5 * math.log(2 * math.pi)


def normal_pdf(x: float, mean: float = 0.0, sd: float = 1.0) -> float | None:
    if not _fine(x, mean, sd) or sd <= 0:
        return None
    return math.exp(-0.5 * ((x - mean) / sd) ** 2) / (sd * math.sqrt(2 * math.pi))


def normal_cdf(x: float, mean: float = 0.0, sd: float = 1.0) -> float | None:
    if not _fine(x, mean, sd) or sd <= 0:
        return None
    return 0.5 * (1 + math.erf((x - mean) / (sd * math.sqrt(2))))


def _horner(coefficients: tuple[float, ...], x):
    value = coefficients[0]
    for c in coefficients[1:]:
        value = value * x + c
    return value


def normal_quantile(p: float, mean: float = 0.0, sd: float = 1.0) -> float | None:
    if not _fine(p, mean, sd) or sd <= 0 or not 1e-15 < p < 1 - 1e-15:
        return None
    if p < TAIL or p > 1 - TAIL:
        q = math.sqrt(-2 * math.log(min(p, 1 - p)))
        z = _horner(QUANTILE_C, q) / _horner((*QUANTILE_D, 1.0), q)
        return mean + sd * (z if p < TAIL else -z)
    q = p - 0.5
    return mean + sd * q * _horner(QUANTILE_A, q * q) / _horner((*QUANTILE_B, 1.0), q * q)


def normal_quantile_column(p: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    """The same as a column expression, without Python on the executors."""
    q = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _horner(tuple(map(F.lit, QUANTILE_C)), q) / _horner((*map(F.lit, QUANTILE_D), F.lit(1.0)), q)
    c = p - 0.5
    middle = c * _horner(tuple(map(F.lit, QUANTILE_A)), c * c) / _horner((*map(F.lit, QUANTILE_B), F.lit(1.0)), c * c)
    z = F.when(p < TAIL, tail).when(p > 1 - TAIL, -tail).otherwise(middle)
    return F.when((p > 1e-15) & (p < 1 - 1e-15), F.lit(float(mean)) + F.lit(float(sd)) * z)


def normal_pdf_column(x: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    return F.exp(normal_log_pdf_column(x, mean, sd))


def normal_log_pdf_column(x: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    if sd <= 0:
        return F.lit(None).cast("double")
    z = (x - F.lit(float(mean))) / F.lit(float(sd))
    return -0.5 * z * z - F.lit(math.log(sd) + 0.5 * math.log(2 * math.pi))


# Student t and chi-squared


def t_cdf(x: float, df: float) -> float | None:
    if not _fine(x, df) or df <= 0:
        return None
    if x == 0:
        return 0.5
    tail = incomplete_beta(df / (df + x * x), df / 2, 0.5)
    return None if tail is None else 1 - tail / 2 if x > 0 else tail / 2


def t_quantile(p: float, df: float) -> float | None:
    """By bracketing and bisection of the tail that p leaves, the lower of p and 1 - p, which loses no digits."""
    if not _fine(p, df) or df <= 0 or not 0 < p < 1:
        return None
    if p == 0.5:
        return 0.0
    tail = min(p, 1 - p)

    def beyond(t: float) -> float:
        if t * t < min(1.0, df):
            return 0.5 - incomplete_beta(t * t / (df + t * t), 0.5, df / 2) / 2
        return incomplete_beta(df / (df + t * t), df / 2, 0.5) / 2

    low, high = 0.0, 1.0
    while beyond(high) > tail:
        low, high = high, high * 2
        if high > 1e300:
            return None
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if beyond(middle) > tail else (low, middle)
        if high - low <= 1e-12 * max(1.0, low):
            break
    return math.copysign((low + high) / 2, p - 0.5)


def chi_squared_cdf(x: float, df: float) -> float | None:
    if not _fine(x, df) or df <= 0:
        return None
    return incomplete_gamma(df / 2, x / 2) if x > 0 else 0.0


# Poisson and binomial


def poisson_log_pmf(k: int, rate: float) -> float | None:
    if not _fine(k, rate) or rate <= 0 or k < 0:
        return None
    return k * math.log(rate) - rate - math.lgamma(k + 1)


def poisson_pmf(k: int, rate: float) -> float | None:
    value = poisson_log_pmf(k, rate)
    return None if value is None else math.exp(value)


def poisson_cdf(k: int, rate: float) -> float | None:
    if not _fine(k, rate) or rate <= 0:
        return None
    if k < 0:
        return 0.0
    below = incomplete_gamma(k + 1, rate)
    return None if below is None else 1 - below


def _least(p: float, cdf: Callable[[int], float], guess: int, top: int | None) -> int:
    """The least k with cdf(k) >= p, walking from a guess."""
    k = max(0, guess if top is None else min(guess, top))
    while k > 0 and cdf(k - 1) >= p:
        k -= 1
    while (top is None or k < top) and cdf(k) < p:
        k += 1
    return k


def poisson_quantile(p: float, rate: float) -> int | None:
    if not _fine(p, rate) or rate <= 0 or not 0 <= p <= 1:
        return None
    if p == 1:
        return (1 << 63) - 1
    guess = rate + math.sqrt(rate) * (normal_quantile(p) or -6.0)
    return _least(p, lambda k: poisson_cdf(k, rate), round(guess), None)


def poisson_mean(rate: float) -> float | None:
    return rate if _fine(rate) and rate > 0 else None


poisson_variance = poisson_mean


def _binomial(n: int, p: float) -> bool:
    return _fine(n, p) and n >= 0 and 0 <= p <= 1


def binomial_log_pmf(k: int, n: int, p: float) -> float | None:
    if not _binomial(n, p) or not 0 <= k <= n:
        return None
    if p in (0, 1):
        return 0.0 if k == n * p else -math.inf
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)


def binomial_pmf(k: int, n: int, p: float) -> float | None:
    value = binomial_log_pmf(k, n, p)
    return None if value is None else math.exp(value)


def binomial_cdf(k: int, n: int, p: float) -> float | None:
    if not _binomial(n, p):
        return None
    if k < 0 or k >= n:
        return 0.0 if k < 0 else 1.0
    return incomplete_beta(1 - p, n - k, k + 1)


def binomial_quantile(q: float, n: int, p: float) -> int | None:
    if not _binomial(n, p) or not _fine(q) or not 0 <= q <= 1:
        return None
    if q == 1:
        return n if p > 0 else 0
    guess = n * p + math.sqrt(n * p * (1 - p)) * (normal_quantile(q) or -6.0)
    return _least(q, lambda k: binomial_cdf(k, n, p), round(guess), n)


def binomial_mean(n: int, p: float) -> float | None:
    return n * p if _binomial(n, p) else None


def binomial_variance(n: int, p: float) -> float | None:
    return n * p * (1 - p) if _binomial(n, p) else None


# Array forms: the same series and continued fractions for all values at once, NaN where a value is undefined

_lgamma = np.frompyfunc(lambda v: math.lgamma(v) if v > 0 else math.nan, 1, 1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of the positive numbers x; each different one is computed once."""
    different, place = np.unique(x, return_inverse=True)
    return _lgamma(different).astype(float)[place].reshape(x.shape)


def _fractions(step: Callable[[int], tuple[np.ndarray, np.ndarray]], size: int, rounds: int = 10_000) -> np.ndarray:
    """_fraction from 0 for arrays: values that have settled are left as they are; NaN for those that don't."""
    tiny = 1e-300
    value, c, d = np.full(size, tiny), np.full(size, tiny), np.zeros(size)
    open_ = np.ones(size, bool)
    for i in range(1, rounds):
        a, b = step(i)
        d = b + a * d
        d = 1 / np.where(d == 0, tiny, d)
        c = b + a / c
        c = np.where(c == 0, tiny, c)
        change = c * d
        value = np.where(open_, value * change, value)
        open_ &= ~(np.abs(change - 1) < 3e-16)
        if not open_.any():
            return value
    return np.where(open_, math.nan, value)


def incomplete_beta_array(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, math.nan))
    inside = np.flatnonzero((x > 0) & (x < 1))
    if not len(inside):
        return out
    x, a, b = x[inside], a[inside], b[inside]
    turned = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(turned, 1 - x, x), np.where(turned, b, a), np.where(turned, a, b)

    def step(i: int) -> tuple[np.ndarray, np.ndarray]:
        m = (i - 1) // 2
        if i == 1:
            return np.ones(len(x)), np.ones(len(x))
        if i % 2:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), np.ones(len(x))
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), np.ones(len(x))

    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    value = np.minimum(1.0, front * _fractions(step, len(x)))
    out[inside] = np.where(turned, 1 - value, value)
    return out


def incomplete_gamma_array(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    some = np.flatnonzero((x > 0) & (x < a + 1))
    if len(some):
        shape, v = a[some], x[some]
        term = total = 1 / shape
        for n in range(1, 100_000):
            term = term * v / (shape + n)
            total = total + term
            if (term < total * 1e-17).all():
                break
        out[some] = np.minimum(1.0, np.exp(shape * np.log(v) - v - log_gamma(shape)) * total)
    some = np.flatnonzero((x > 0) & (x >= a + 1))
    if len(some):
        shape, v = a[some], x[some]
        value = _fractions(lambda i: (np.full(len(v), 1.0) if i == 1 else -(i - 1) * (i - 1 - shape), v + 2 * i - 1 - shape), len(v))
        out[some] = np.maximum(0.0, 1 - np.exp(shape * np.log(v) - v - log_gamma(shape)) * value)
    return out


def _where(fine: np.ndarray, f: Callable, *values: np.ndarray) -> np.ndarray:
    """f of the values where fine, NaN elsewhere."""
    out = np.full(len(fine), math.nan)
    if fine.any():
        out[fine] = f(*(v[fine] for v in values))
    return out


def _t_cdf_array(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    tail = incomplete_beta_array(df / (df + x * x), df / 2, np.full(len(x), 0.5)) / 2
    return np.where(x > 0, 1 - tail, np.where(x == 0, 0.5, tail))


def _binomial_pmf_array(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    certain = (p == 0) | (p == 1)
    q = np.where(certain, 0.5, p)
    value = np.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * np.log(q) + (n - k) * np.log1p(-q))
    return np.where(certain, (k == n * p).astype(float), value)


def _binomial_cdf_array(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    inside = (k >= 0) & (k < n)
    out = np.where(k < 0, 0.0, 1.0)
    out[inside] = incomplete_beta_array(1 - p[inside], (n - k)[inside], k[inside] + 1)
    return out


#: For each function of numbers that has one, where it is defined and its array form.
ARRAYS: dict[Callable, tuple[Callable, Callable]] = {
    normal_cdf: (lambda x, m=None, sd=None: np.isfinite(x) if sd is None else np.isfinite(x) & np.isfinite(m) & (sd > 0) & np.isfinite(sd), lambda x, m=0.0, sd=1.0: 0.5 * (1 + np.frompyfunc(math.erf, 1, 1)((x - m) / (sd * math.sqrt(2))).astype(float))),
    chi_squared_cdf: (lambda x, df: np.isfinite(x) & np.isfinite(df) & (df > 0), lambda x, df: incomplete_gamma_array(df / 2, x / 2)),
    t_cdf: (lambda x, df: np.isfinite(x) & np.isfinite(df) & (df > 0), _t_cdf_array),
    poisson_pmf: (lambda k, rate: np.isfinite(rate) & (rate > 0) & (k >= 0), lambda k, rate: np.exp(k * np.log(rate) - rate - log_gamma(k + 1))),
    poisson_cdf: (lambda k, rate: np.isfinite(k) & np.isfinite(rate) & (rate > 0), lambda k, rate: np.where(k < 0, 0.0, 1 - incomplete_gamma_array(np.maximum(k, 0) + 1, rate))),
    binomial_pmf: (lambda k, n, p: (n >= 0) & (p >= 0) & (p <= 1) & (k >= 0) & (k <= n), _binomial_pmf_array),
    binomial_cdf: (lambda k, n, p: np.isfinite(k) & (n >= 0) & (p >= 0) & (p <= 1), _binomial_cdf_array),
}


#: Newton steps of a quantile; what has not settled by then is bracketed and bisected by itself.
STEPS = 60


def _t_quantile_array(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """By Newton's method on the upper tail: on its logarithm by that of t where the tail is thin, on itself elsewhere, both without overshooting for good."""
    tail = np.where(p < 0.5, p, 1 - p)
    thin = tail < 0.2
    start = np.where(thin, np.maximum(_normal_quantile_array(1 - tail), 0.8), 0.0)
    t = np.where(tail == 0.5, 0.0, start)
    open_ = np.flatnonzero(tail < 0.5)
    scale = log_gamma((df + 1) / 2) - log_gamma(df / 2) - 0.5 * np.log(df * math.pi)
    for _ in range(STEPS):
        if not len(open_):
            break
        x, n, want = t[open_], df[open_], tail[open_]
        near, half = x * x < np.minimum(1.0, n), np.full(len(x), 0.5)
        have = incomplete_beta_array(np.where(near, x * x, n) / (n + x * x), np.where(near, half, n / 2), np.where(near, n / 2, half)) / 2
        have = np.where(near, 0.5 - have, have)
        density = np.exp(scale[open_] - (n + 1) / 2 * np.log1p(x * x / n))
        moved = np.where(thin[open_], x * np.exp((np.log(have) - np.log(want)) * have / (x * density)), x + (have - want) / density)
        t[open_] = moved
        open_ = open_[~(np.abs(moved - x) <= 1e-12 * np.maximum(1.0, x))]
    fine = np.isfinite(t)
    fine[open_] = False
    for k in np.flatnonzero(~fine):
        own = t_quantile(float(tail[k]), float(df[k]))
        t[k] = math.nan if own is None else -own
    return np.where(p < 0.5, -t, t)


def _normal_quantile_array(p: np.ndarray) -> np.ndarray:
    """normal_quantile of the standard distribution; a value of the tail's end where that is undefined."""
    low = np.clip(np.minimum(p, 1 - p), 1e-15, 0.5)
    q = np.sqrt(-2 * np.log(low))
    c = low - 0.5
    z = np.where(low < TAIL, _horner(QUANTILE_C, q) / _horner((*QUANTILE_D, 1.0), q), c * _horner(QUANTILE_A, c * c) / _horner((*QUANTILE_B, 1.0), c * c))
    return np.where(p > 0.5, -z, z)


def _least_array(p: np.ndarray, cdf: Callable[[np.ndarray, np.ndarray], np.ndarray], guess: np.ndarray, top: np.ndarray) -> np.ndarray:
    """_least for arrays; cdf takes numbers and the places they are for."""
    k = np.clip(np.round(guess), 0, top)
    going = np.flatnonzero(k > 0)
    while len(going):
        going = going[cdf(k[going] - 1, going) >= p[going]]
        k[going] -= 1
        going = going[k[going] > 0]
    going = np.flatnonzero(k < top)
    while len(going):
        going = going[cdf(k[going], going) < p[going]]
        k[going] += 1
        going = going[k[going] < top[going]]
    return k


def _poisson_quantile_array(p: np.ndarray, rate: np.ndarray) -> np.ndarray:
    whole = p == 1
    guess = np.where(p > 0, rate + np.sqrt(rate) * _normal_quantile_array(p), 0.0)
    found = _least_array(np.where(whole, 0.5, p), lambda k, at: ARRAYS[poisson_cdf][1](k, rate[at]), guess, np.full(len(p), math.inf))
    return np.where(whole, float((1 << 63) - 1), found)


def _binomial_quantile_array(q: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    guess = np.where(q > 0, n * p + np.sqrt(n * p * (1 - p)) * _normal_quantile_array(q), 0.0)
    found = _least_array(q, lambda k, at: _binomial_cdf_array(k, n[at], p[at]), guess, n)
    return np.where(q == 1, np.where(p > 0, n, 0.0), found)


#: The same for quantiles.
QUANTILES: dict[Callable, tuple[Callable, Callable]] = {
    t_quantile: (lambda p, df: np.isfinite(df) & (df > 0) & (p > 0) & (p < 1), _t_quantile_array),
    poisson_quantile: (lambda p, rate: np.isfinite(rate) & (rate > 0) & (p >= 0) & (p <= 1), _poisson_quantile_array),
    binomial_quantile: (lambda q, n, p: np.isfinite(n) & (n >= 0) & (p >= 0) & (p <= 1) & (q >= 0) & (q <= 1), _binomial_quantile_array),
}


def column(f: Callable, *fixed: float, kind: str = "double") -> Callable[..., Column]:
    """f(x, *fixed) as a function of a column, or of columns for its first arguments: Arrow batches, null where f is undefined.

    Functions of ARRAYS and QUANTILES take a batch at once; others are called once for each different row of values of a batch.
    """

    def values(columns: tuple[pd.Series, ...]) -> pd.Series:
        known = np.logical_and.reduce([c.notna().to_numpy() for c in columns])
        if f in ARRAYS or f in QUANTILES:
            defined, whole = ARRAYS.get(f) or QUANTILES[f]
            arrays = [c.to_numpy(float, na_value=math.nan) for c in columns]
            arrays += [np.full(len(known), float(v)) for v in fixed]
            with np.errstate(all="ignore"):
                return pd.Series(_where(known & defined(*arrays), whole, *arrays)).replace(math.nan, None).astype("Float64")
        places, different = pd.factorize(pd.MultiIndex.from_arrays(columns) if len(columns) > 1 else columns[0])
        rows = different.tolist()
        made = [*(f(*(v if len(columns) > 1 else (v,)), *fixed) for v in rows), None]
        places = np.where(known, places, len(rows))
        return pd.Series(made, dtype="float64" if kind == "double" else "Int64").take(places).reset_index(drop=True)

    @F.pandas_udf(kind)
    def one(x: pd.Series) -> pd.Series:
        return values((x,))

    @F.pandas_udf(kind)
    def two(x: pd.Series, y: pd.Series) -> pd.Series:
        return values((x, y))

    @F.pandas_udf(kind)
    def three(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return values((x, y, z))

    return lambda *columns: {1: one, 2: two, 3: three}[len(columns)](*columns)
