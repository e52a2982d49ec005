"""Profiles, distributions, correlation and tests as aggregations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import adjusted_kurtosis, adjusted_skew, safe_corr
from .totals import exact_quantiles, running_sums, with_totals


def rows_of(exprs: list[Column]) -> Column:
    return F.inline(F.array(*exprs))


def describe(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """One row a column: count, mean, std, min, exact quartiles, max."""
    r = lambda c: F.round(c, digits)
    quartiles = {c: exact_quantiles(df, c, [0.25, 0.5, 0.75]) for c in columns}
    cut = lambda c: [r(F.lit(v).cast("double")).alias(n) for n, v in zip(("q25", "median", "q75"), quartiles[c], strict=True)]
    stat = lambda c: F.struct(
        F.lit(c).alias("column"), F.count(c).alias("count"), r(F.avg(c)).alias("mean"), r(F.stddev_samp(c)).alias("std"),
        r(F.min(c).cast("double")).alias("min"), *cut(c), r(F.max(c).cast("double")).alias("max"),
    )
    return df.agg(F.array(*[stat(c) for c in columns]).alias("_a")).select(F.inline("_a"))


def profile(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """One row a numeric column: nulls, distinct values, moments, shape, zeros, negatives."""
    r = lambda c: F.round(c, digits)
    stat = lambda c: F.struct(
        F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.countDistinct(c).alias("n_unique"),
        r(F.avg(c)).alias("mean"), r(F.stddev_samp(c)).alias("std"), r(adjusted_skew(F.col(c))).alias("skew"), r(adjusted_kurtosis(F.col(c))).alias("kurtosis"),
        F.count_if(F.col(c) == 0).alias("zeros"), F.count_if(F.col(c) < 0).alias("negatives"),
    )
    return df.agg(F.array(*[stat(c) for c in columns]).alias("_a")).select(F.inline("_a"))


def profile_text(df: DataFrame, column: str) -> DataFrame:
    """One row: n, n_unique, the most frequent value (the smaller on ties), its count, high_cardinality."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    return counts.agg(F.sum("n").alias("n"), F.count("*").alias("n_unique"), F.min_by("v", F.struct(-F.col("n"), "v")).alias("top"), F.max("n").alias("top_count")).withColumn("high_cardinality", F.col("n_unique") / F.col("n") > 0.5)


def null_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: column, nulls, pct, status."""
    stat = lambda c: F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.round(F.avg(F.col(c).isNull().cast("double")) * 100, 4).alias("pct"))
    status = F.when(F.col("pct") == 0, "complete").when(F.col("pct") < 5, "good").when(F.col("pct") < 20, "moderate").when(F.col("pct") < 50, "poor").when(F.col("pct") < 80, "critical").otherwise("mostly empty")
    return df.agg(F.array(*[stat(c) for c in columns]).alias("_a")).select(F.inline("_a")).withColumn("status", status)


def value_counts(df: DataFrame, column: str, normalize: bool = False) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())) if normalize else counts


def mode(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The most frequent value of each group, the smallest on ties; nulls don't count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("mode"), F.max("n").alias("n"))


def order_statistics(df: DataFrame, column: str, ranks) -> list[float | None]:
    """The values at the given places, from 1, of the sorted column; ranks(n) lists the places for n values."""
    n = df.where(F.col(column).isNotNull()).count()
    return exact_quantiles(df, column, [(min(max(k, 1), n) - 1) / max(n - 1, 1) for k in ranks(n)]) if n else [None for _ in ranks(1)]


def quantiles_exclusive(df: DataFrame, column: str, qs: list[float]) -> list[float | None]:
    """Quantiles at (n + 1) q, with linear steps between neighbours, held inside the ends."""
    return order_statistics(df, column, lambda n: [(n + 1) * q for q in qs])


def correlation_pairs(df: DataFrame, columns: list[str], digits: int = 6, least: float = 0.0) -> DataFrame:
    """(a, b, r, strength) of all pairs of columns in one pass; |r| at least ``least``."""
    stat = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(safe_corr(F.col(a).cast("double"), F.col(b).cast("double")), digits).alias("r")) for a, b in combinations(columns, 2)]
    r = F.abs("r")
    strength = F.when(r >= 0.9, "very strong").when(r >= 0.7, "strong").when(r >= 0.5, "moderate").when(r >= 0.3, "weak").otherwise("none")
    return df.agg(F.array(*stat).alias("_a")).select(F.inline("_a")).withColumn("strength", strength).where(r >= least if least else F.lit(True))


def average_rank(column: str, keys: list[str] | None = None) -> Column:
    """Rank with ties sharing their mean."""
    w = Window.partitionBy(*(keys or []))
    return F.rank().over(w.orderBy(column)) + (F.count("*").over(Window.partitionBy(*(keys or []), column)) - 1) / 2


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the rank of a numeric column, ties sharing their mean, by counts of its values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    ranks = running_sums(counts, "_v", ["_c"]).select("_v", (F.col("run__c") - (F.col("_c") - 1) / 2).alias(out))
    return df.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cells with observed and expected counts under independence."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("observed"))
    total = lambda *k: F.sum("observed").over(Window.partitionBy(*k))
    return cells.withColumn("expected", total(a) * total(b) / total())


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2, dof, cramers_v.  Cells that don't occur count by their expected value."""
    cells = crosstab(df, a, b)
    sums = cells.agg((F.sum(F.col("observed") * F.col("observed") / F.col("expected")) - F.sum("observed")).alias("chi2"), F.countDistinct(a).alias("r"), F.countDistinct(b).alias("c"), F.sum("observed").alias("n"))
    return sums.select("chi2", ((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"), F.sqrt(F.col("chi2") / (F.col("n") * F.least(F.col("r") - 1, F.col("c") - 1))).alias("cramers_v"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: f, df_between, df_within."""
    per = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    grand = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    off = F.col("m") - F.col("_g")  # squares of differences: a difference of squares loses the digits that large means share
    sums = with_totals(per, _g=grand).agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * off * off).alias("between"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"))
    return sums.select(((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"), (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"))


def t_test(df: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """One row: Welch's t of two groups."""
    s = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    parts = df.agg(*[s(g, f).alias(f"{n}{i}") for i, g in enumerate((a, b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    return parts.select(((F.col("m0") - F.col("m1")) / F.sqrt(F.col("v0") / F.col("n0") + F.col("v1") / F.col("n1"))).alias("t"))


def ks_statistic(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: the greatest distance of two empirical distribution functions."""
    both = a.select(F.col(column).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(F.col(column).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = both.where("x is not null").groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    both = with_totals(running_sums(per, "x", ["a", "b"]), _a=F.max("run_a"), _b=F.max("run_b"))
    return both.agg(F.max(F.abs(F.try_divide("run_a", "_a") - F.try_divide("run_b", "_b"))).alias("ks"))


def psi(a: DataFrame, b: DataFrame, column: str, edges: list[float], least: float = 1e-4) -> DataFrame:
    """One row: population stability index over left-closed bins."""
    bin_ = sum(((F.col(column) >= e).cast("int") for e in edges), F.lit(0)).alias("bin")
    share = lambda df, n: df.where(F.col(column).isNotNull()).groupBy(bin_).agg(F.count("*").alias("c")).select("bin", (F.col("c") / F.sum("c").over(Window.partitionBy())).alias(n))
    both = share(a, "p").join(share(b, "q"), "bin", "full").select(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(least)).alias("p"), F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(least)).alias("q"))
    return both.agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))


def fences(df: DataFrame, column: str, method: str = "iqr", k: float | None = None) -> DataFrame:
    """df with low and high, the bounds of ordinary values: iqr, z, mad or percentile."""
    c = F.col(column)
    put = lambda low, high: df.withColumn("low", F.lit(low).cast("double")).withColumn("high", F.lit(high).cast("double"))
    if method == "z":
        step = (3 if k is None else k) * F.col("_s")
        return with_totals(df, _m=F.avg(c), _s=F.stddev_samp(c)).withColumn("low", F.col("_m") - step).withColumn("high", F.col("_m") + step).drop("_m", "_s")
    if method == "iqr":
        q1, q3 = exact_quantiles(df, column, [0.25, 0.75])
        step = None if q1 is None else (1.5 if k is None else k) * (q3 - q1)
        return put(None, None) if step is None else put(q1 - step, q3 + step)
    if method == "mad":
        mid = exact_quantiles(df, column, [0.5])[0]
        mad = None if mid is None else exact_quantiles(df, F.abs(c - mid), [0.5])[0]
        step = (3.5 if k is None else k) * (mad or 0) / 0.6745
        return put(mid - step, mid + step) if mad else put(None, None)
    if method == "percentile":
        p = (1 if k is None else k) / 100
        return put(*exact_quantiles(df, column, [p, 1 - p]))
    raise ValueError(f"no outlier method {method!r}")
