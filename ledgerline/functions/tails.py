"""Tail probabilities for small result tables (a few rows per model pair)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            break
    return value


def regularized_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def regularized_gamma_upper(s: float, x: float) -> float:
    if x <= 0.0:
        return 1.0
    scale = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        k = s
        while abs(term) > abs(total) * 1e-17:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - total * scale
    tiny = 1e-300
    b = x + 1.0 - s
    c, d = 1.0 / tiny, 1.0 / b
    value = d
    for i in range(1, 1000):
        an = -i * (i - s)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value * scale


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def t_two_sided(t: float, df: float) -> float:
    return 0.0 if math.isinf(t) else regularized_beta(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return regularized_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(h: float, df: float) -> float:
    return regularized_gamma_upper(df / 2.0, h / 2.0)


def _by_row(fn, *series: pd.Series) -> pd.Series:
    rows = zip(*[s.astype(float) for s in series])
    return pd.Series([None if any(v != v for v in row) else fn(*row) for row in rows], dtype="float64")


@pandas_udf(DoubleType())
def _normal_udf(z: pd.Series) -> pd.Series:
    return _by_row(normal_two_sided, z)


@pandas_udf(DoubleType())
def _t_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _by_row(t_two_sided, t, df)


@pandas_udf(DoubleType())
def _f_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _by_row(f_upper, f, d1, d2)


@pandas_udf(DoubleType())
def _chi2_udf(h: pd.Series, df: pd.Series) -> pd.Series:
    return _by_row(chi2_upper, h, df)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def normal_p(z) -> Column:
    return _normal_udf(_c(z))


def t_p(t, df) -> Column:
    return _t_udf(_c(t), _c(df).cast("double"))


def f_p(f, d1, d2) -> Column:
    return _f_udf(_c(f), _c(d1).cast("double"), _c(d2).cast("double"))


def chi2_p(h, df) -> Column:
    return _chi2_udf(_c(h), _c(df).cast("double"))
