"""Tail probabilities of test statistics, for results of a few rows.

Incomplete beta and gamma functions by continued fractions and series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    out = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or 1e-300)
            c = 1 + step / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * total:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = out = 1 / b
    for k in range(1, 10_000):
        b += 2
        d = 1 / (-k * (k - a) * d + b or 1e-300)
        c = b - k * (k - a) / c or 1e-300
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def kolmogorov_tail(x: float) -> float:
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def _each(f, *columns: Column) -> Column:
    def value(*row: float) -> float | None:
        return None if any(x is None or math.isnan(x) for x in row) else f(*row)

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([value(*row) for row in zip(*part, strict=True)], dtype="float64")

    given = [c.cast("double") for c in columns]
    return run(*given, *([F.lit(0.0)] if len(given) == 1 else []))


def f_tail(f: Column, between: Column, within: Column) -> Column:
    """P(F > f)."""
    return _each(lambda x, a, b: beta_share(b / (b + a * x), b / 2, a / 2) if x > 0 else 1.0, f, between, within)


def t_tails(t: Column, dof: Column) -> Column:
    """P(|T| > |t|)."""
    return _each(lambda x, v: beta_share(v / (v + x * x), v / 2, 0.5), t, dof)


def corr_tails(r: Column, n: Column) -> Column:
    """P of a greater correlation, by size, of n pairs that are independent."""
    return _each(lambda x, k: beta_share(min(1.0, max(0.0, 1 - x * x)), (k - 2) / 2, 0.5) if k > 2 else 1.0, r, n)


def chi2_tail(x: Column, dof: Column) -> Column:
    return _each(lambda v, k: gamma_tail(k / 2, v / 2), x, dof)


def ks_tail(distance: Column, n: Column, m: Column) -> Column:
    """Asymptotic P of a greater distance of two samples of n and m values."""
    return _each(lambda d, a, b: kolmogorov_tail(d * math.sqrt(a * b / (a + b))), distance, n, m)


def normal_tails(z: Column) -> Column:
    return _each(lambda x, _: math.erfc(abs(x) / math.sqrt(2)), z)
