"""Transforms and models whose parameters come from one or few aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .totals import with_totals


def moments(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and sample covariance of the columns, by one aggregation."""
    row = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).agg(*[F.avg(c) for c in columns], *[F.covar_samp(a, b) for a in columns for b in columns]).first()
    k = len(columns)
    return np.array(row[:k], float), np.array(row[k:], float).reshape(k, k)


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, vif, level): the diagonal of the inverse correlation matrix."""
    _, cov = moments(df, columns)
    sd = np.sqrt(np.diag(cov))
    values = np.diag(np.linalg.pinv(cov / np.outer(sd, sd)))
    level = F.when(F.col("vif") > 10, "high").when(F.col("vif") > 5, "moderate").otherwise("low")
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, values, strict=True)], "column string, vif double").withColumn("level", level)


def pca_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(component, share): explained variance of the standardised columns."""
    _, cov = moments(df, columns)
    sd = np.sqrt(np.diag(cov))
    values = np.linalg.eigvalsh(cov / np.outer(sd, sd))[::-1]
    return df.sparkSession.createDataFrame([(i + 1, float(v)) for i, v in enumerate(values / values.sum())], "component int, share double")


def linear_fit(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(term, weight) of ordinary least squares, from means and covariances."""
    mean, cov = moments(df, [*features, target])
    weights = np.linalg.lstsq(cov[:-1, :-1], cov[:-1, -1], rcond=None)[0]
    rows = [("intercept", float(mean[-1] - weights @ mean[:-1])), *zip(features, map(float, weights), strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, weight double")


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual information of two categories, in nats."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias(f"_{c}"))
    every = with_totals(cells, _all=F.sum("n")).join(side(a), a).join(side(b), b)
    p = F.col("n") / F.col("_all")
    return every.agg(F.sum(p * F.ln(p * F.col("_all") * F.col("_all") / (F.col(f"_{a}") * F.col(f"_{b}")))).alias("mi"))


def benjamini_hochberg(tests: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """tests (one row a test) with selected: those up to the largest p below its step alpha * rank / n."""
    ranked = tests.withColumn("_r", F.rank().over(Window.orderBy(p)))
    last = with_totals(ranked, _n=F.count("*"))
    return with_totals(last, _top=F.max(F.when(F.col(p) <= alpha * F.col("_r") / F.col("_n"), F.col(p)))).withColumn("selected", F.coalesce(F.col(p) <= F.col("_top"), F.lit(False))).drop("_r", "_n", "_top")


def box_cox_lambda(df: DataFrame, column: str, grid: tuple[float, ...] = tuple(k / 10 for k in range(-20, 21))) -> float:
    """The power of a positive column with the greatest likelihood on the grid, in one aggregation."""
    x = F.col(column)
    power = lambda k: F.ln(x) if abs(k) < 1e-9 else (F.pow(x, F.lit(k)) - 1) / k
    row = df.where(x > 0).agg(F.count("*"), F.sum(F.ln(x)), *[F.var_pop(power(k)) for k in grid]).first()
    return max(zip(grid, row[2:], strict=True), key=lambda kv: -row[0] / 2 * np.log(kv[1]) + (kv[0] - 1) * row[1] if kv[1] else -np.inf)[0]


def box_cox(df: DataFrame, column: str, out: str) -> DataFrame:
    k = box_cox_lambda(df, column)
    x = F.when(F.col(column) > 0, F.col(column))
    return df.withColumn(out, F.ln(x) if abs(k) < 1e-9 else (F.pow(x, F.lit(k)) - 1) / k)


def detrend(df: DataFrame, column: str, time: str, out: str) -> DataFrame:
    """Column out: the column less its regression on time."""
    t = F.col(time).cast("double")
    fitted = with_totals(df, _a=F.regr_intercept(F.col(column), t), _b=F.regr_slope(F.col(column), t))
    return fitted.withColumn(out, F.col(column) - F.col("_a") - F.col("_b") * t).drop("_a", "_b")


def savitzky_golay(column: str, order: str, size: int = 5, degree: int = 2, keys: list[str] | None = None):
    """Smoothed value by a local polynomial over ``size`` rows; null where the frame isn't full."""
    half = size // 2
    weights = np.linalg.pinv(np.vander(np.arange(-half, half + 1), degree + 1, increasing=True))[0]
    w = Window.partitionBy(*(keys or [])).orderBy(order)
    return sum((F.lag(column, half - i).over(w) * float(x) for i, x in enumerate(weights)), F.lit(0.0))


def time_split(df: DataFrame, time: str, folds: int) -> DataFrame:
    """df with fold 1..folds by equal spans of time; fold k trains on the folds before it."""
    t = F.unix_timestamp(F.col(time).cast("timestamp"))
    ends = with_totals(df, _a=F.min(t), _b=F.max(t))
    return ends.withColumn("fold", F.least(F.floor((t - F.col("_a")) * folds / F.greatest(F.col("_b") - F.col("_a"), F.lit(1))) + 1, F.lit(folds))).drop("_a", "_b")
