"""Tail probabilities of test statistics, for result tables (a row per test, not per case)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F

EPS = 1e-16
TINY = 1e-300


def log_beta_tail(x: float, a: float, b: float) -> float:
    """log of the regularised incomplete beta function I_x(a, b) by its continued fraction (Lentz)."""
    if x <= 0.0:
        return -math.inf
    if x >= 1.0:
        return 0.0
    if x > (a + 1.0) / (a + b + 2.0):
        other = math.exp(log_beta_tail(1.0 - x, b, a))
        return math.log1p(-other) if other < 1.0 else -math.inf
    front = a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) - math.log(a)
    c, d = 1.0, 1.0 / max(abs(1.0 - (a + b) * x / (a + 1.0)), TINY)
    f = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / (1.0 + even * d or TINY)
        c = 1.0 + even / c or TINY
        f *= c * d
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + odd * d or TINY)
        c = 1.0 + odd / c or TINY
        step = c * d
        f *= step
        if abs(step - 1.0) < EPS:
            break
    return front + math.log(f)


def correlation_p(r: float, dof: float) -> float:
    """Two-sided p of a correlation coefficient by Student's t with ``dof`` degrees of freedom."""
    if r is None or dof is None or math.isnan(r) or dof <= 0:
        return math.nan
    return math.exp(log_beta_tail(max(0.0, 1.0 - r * r), dof / 2.0, 0.5))


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0)) if z is not None and not math.isnan(z) else math.nan


def chi2_p(x: float, dof: float) -> float:
    """Upper tail of the chi-square distribution."""
    if x is None or dof is None or math.isnan(x) or dof <= 0:
        return math.nan
    a, x = dof / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * EPS:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - math.exp(front + math.log(total)))
    b = x + 1.0 - a
    c, d = 1.0 / TINY, 1.0 / b
    f = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b or TINY)
        c = b + an / c or TINY
        f *= c * d
        if abs(c * d - 1.0) < EPS:
            break
    return math.exp(front + math.log(f))


def correlation_p_value(r: Column, dof: Column) -> Column:
    @F.pandas_udf("double")
    def p(r: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([correlation_p(a, b) for a, b in zip(r, dof)], dtype="float64")

    return F.when(r.isNotNull() & dof.isNotNull() & (dof > 0), p(r, dof.cast("double")))


def normal_p_value(z: Column) -> Column:
    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return pd.Series([normal_p(a) for a in z], dtype="float64")

    return F.when(z.isNotNull(), p(z))


def chi2_p_value(x: Column, dof: Column) -> Column:
    @F.pandas_udf("double")
    def p(x: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([chi2_p(a, b) for a, b in zip(x, dof)], dtype="float64")

    return F.when(x.isNotNull() & dof.isNotNull(), p(x, dof.cast("double")))
