"""Column functions on numbers, and on arrays as vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: Column, high: Column) -> Column:
    """Within the bounds; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, high), low))


def cut(c: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the right-closed bin (lo, hi]; null outside, the lowest edge included."""
    out = F.when(F.lit(False), F.lit(""))
    for low, high, label in zip(edges, edges[1:], labels, strict=False):
        out = out.when((c > low) & (c <= high), label)
    return out


def digitize(c: Column, edges: list[Column]) -> Column:
    """Number of edges that the value reaches."""
    return sum(((c >= e).cast("int") for e in edges), F.lit(0))


def change(c: Column, before: Column) -> Column:
    """Per cent change, 0 where the value before is 0."""
    return F.when(before == 0, 0.0).otherwise((c - before) / before * 100)


def adjusted_skew(c: Column) -> Column:
    """Bias-adjusted skewness G1 (aggregate)."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(c: Column) -> Column:
    """Bias-adjusted excess kurtosis G2 (aggregate)."""
    n = F.count(c)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation, null where a side does not vary (aggregate)."""
    return F.when((F.var_pop(a) > 0) & (F.var_pop(b) > 0), F.corr(a, b))


def distance(a: Column, b: Column, p: float = 2) -> Column:
    """Minkowski distance of two arrays; p = 1 Manhattan, 2 Euclidean."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p))), F.lit(0.0), lambda s, x: s + x)
    return F.pow(total, F.lit(1 / p))


def norm(a: Column, p: float = 2) -> Column:
    if p == 0:
        return F.size(F.filter(a, lambda x: x != 0)).cast("double")
    if math.isinf(p):
        return (F.array_max if p > 0 else F.array_min)(F.transform(a, F.abs))
    return F.pow(F.aggregate(F.transform(a, lambda x: F.pow(F.abs(x), F.lit(p))), F.lit(0.0), lambda s, x: s + x), F.lit(1 / p))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def poisson_pmf(k: Column, rate: float) -> Column:
    return F.pow(F.lit(rate), k) * math.exp(-rate) / F.factorial(k)


def geometric_pmf(k: Column, p: float) -> Column:
    return F.pow(F.lit(1 - p), k - 1) * p


def cauchy_cdf(x: Column, at: float = 0, scale: float = 1) -> Column:
    return F.atan((x - at) / scale) / math.pi + 0.5


def normal_cdf(x: Column) -> Column:
    """By a rational approximation of the error function (error below 1.5e-7)."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def beta_pdf(x: Column, a: float, b: float) -> Column:
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return F.pow(x, F.lit(a - 1)) * F.pow(1 - x, F.lit(b - 1)) * scale


def smallest_type(c: str) -> Column:
    """The smallest whole-number type that holds a column (aggregate)."""
    out = F.when(F.lit(False), "")
    for name, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)):
        out = out.when((F.max(c) < 2**bits) & (F.min(c) >= -(2**bits)), name)
    return out.otherwise("bigint")
