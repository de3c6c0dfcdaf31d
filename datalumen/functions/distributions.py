"""Tail probabilities and quantiles of the t, F and chi-square distributions for small result tables.

Spark has no such functions. They run as Arrow-batched UDFs over rows that are already aggregated.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TINY = 1e-300


def _lentz(term, steps: int = 2000) -> float:
    """Value of the continued fraction 1/(1 + a1/(1 + a2/(1 + ...))) with ``term(i)`` giving a_i."""
    c, d, value = 1.0, 0.0, 1.0
    for i in range(1, steps):
        a = term(i)
        d = 1.0 + a * d
        d = 1.0 / (d if abs(d) > TINY else TINY)
        c = 1.0 + a / (c if abs(c) > TINY else TINY)
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return 1.0 / value


def _log_gamma_step(a: float, b: float) -> float:
    """``lgamma(a + b) - lgamma(a)``; by Stirling's series where both are large and the difference would lose its digits."""
    if a < 1e4:
        return math.lgamma(a + b) - math.lgamma(a)
    c = a + b
    return (a - 0.5) * math.log1p(b / a) + b * math.log(c) - b + (1 / c - 1 / a) / 12 - (1 / c**3 - 1 / a**3) / 360


def beta_tail(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta function; ``y`` is ``1 - x`` where the caller knows it with more digits."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_tail(b, a, y, x)

    def term(i: int) -> float:
        m = i // 2
        if i % 2 == 0:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

    log_x = math.log1p(-y) if y < 0.5 else math.log(x)
    log_y = math.log1p(-x) if x < 0.5 else math.log(y)
    large, small = max(a, b), min(a, b)
    front = a * log_x + b * log_y + _log_gamma_step(large, small) - math.lgamma(small)
    return math.exp(front) * _lentz(term) / a


def gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1.0:
        part = total = 1.0 / s
        k = s
        while abs(part) > abs(total) * 1e-17:
            k += 1.0
            part *= x / k
            total += part
        return max(0.0, 1.0 - front * total)
    # Legendre's fraction, evaluated from the far end.
    depth = 400 + int(4 * math.sqrt(x))
    value = x + 2 * depth + 1 - s
    for i in range(depth, 0, -1):
        value = x + 2 * i - 1 - s - i * (i - s) / value
    return front / value


#: Degrees of freedom beyond which F is taken as a rescaled chi-square: the fraction loses digits, the limit gains them.
MANY = 1e7


def _as_chi2(f: float, d1: float, d2: float) -> float:
    """The chi-square value with ``d1`` degrees whose tail is that of F up to terms of ``1 / d2**2``."""
    x = d1 * f
    return x * (2 * d2 + x / 3 + d1 - 2) / (2 * d2 + 4 * x / 3)


def t_two_sided(t: float, df: float) -> float:
    if df > MANY:
        return math.erfc(math.sqrt(_as_chi2(t * t, 1.0, df) / 2.0))
    return beta_tail(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    if d2 > MANY and d1 < d2 / 1e4:
        return chi2_upper(_as_chi2(f, d1, d2), d1)
    return beta_tail(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def t_quantile(p: float, df: float) -> float:
    """The value below which a share ``p`` (at least one half) of the t distribution lies."""
    goal = 2.0 * (1.0 - p)
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > goal:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if t_two_sided(mid, df) > goal else (low, mid)
    return (low + high) / 2.0


def _rowwise(function):
    """An Arrow-batched column function from one over plain floats; null or NaN arguments give null."""

    def over(*series: pd.Series) -> pd.Series:
        out = []
        for row in zip(*series):
            usable = all(v is not None and not math.isnan(v) for v in row)
            out.append(function(*map(float, row)) if usable else None)
        return pd.Series(out, dtype="float64")

    def one(a: pd.Series, b: pd.Series) -> pd.Series:
        return over(a, b)

    def two(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return over(a, b, c)

    body = two if function is f_upper else one
    udf = F.pandas_udf(body, T.DoubleType())
    return lambda *columns: udf(*[c.cast("double") for c in columns])


def t_p_value(t: Column, df: Column) -> Column:
    return _rowwise(t_two_sided)(t, df)


def f_p_value(f: Column, d1: Column, d2: Column) -> Column:
    return _rowwise(f_upper)(f, d1, d2)


def chi2_p_value(x: Column, df: Column) -> Column:
    return _rowwise(chi2_upper)(x, df)


def t_critical(p: Column, df: Column) -> Column:
    return _rowwise(t_quantile)(p, df)
