"""Types that texts hold, strategies for missing values, overviews and issues of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import FORMATS
from ..functions.text import FALSE_WORDS, TRUE_WORDS, as_boolean, as_number
from .lineage import cut
from .totals import exact_quantiles, with_totals

#: Shares of values that must fit for a column to have the type.
BOOLEAN_SHARE, NUMBER_SHARE, DATE_SHARE = 0.9, 0.8, 0.7


def infer_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, type): boolean, percentage, numeric, datetime or string, by the share of values that fit."""
    share = lambda ok, c: F.coalesce(F.avg(F.when(F.col(c).isNotNull(), F.coalesce(ok, F.lit(False)).cast("double"))), F.lit(0.0))
    text = lambda c: F.col(c).cast("string")
    word = lambda c: F.lower(F.trim(text(c))).isin(*TRUE_WORDS, *FALSE_WORDS)
    date = lambda c: F.coalesce(*[F.try_to_date(text(c), f) for f in FORMATS]).isNotNull()
    stat = lambda c: F.struct(
        F.lit(c).alias("column"), share(word(c), c).alias("b"), share(as_number(text(c)).isNotNull(), c).alias("n"),
        share(date(c), c).alias("d"), F.count_if(text(c).contains("%")).alias("p"),
    )
    number = F.when(F.col("p") > 0, "percentage").otherwise("numeric")
    kind = F.when(F.col("b") > BOOLEAN_SHARE, "boolean").when(F.col("n") > NUMBER_SHARE, number).when(F.col("d") > DATE_SHARE, "datetime").otherwise("string")
    return df.agg(F.array(*[stat(c) for c in columns]).alias("_a")).select(F.inline("_a")).select("column", kind.alias("type"))


def convert(c: Column, kind: str) -> Column:
    """The text as a value of an inferred type; null where it doesn't fit."""
    text = c.cast("string")
    by = {"boolean": as_boolean, "numeric": as_number, "percentage": as_number, "datetime": lambda x: F.coalesce(*[F.try_to_date(x, f) for f in FORMATS])}
    return by[kind](text) if kind in by else text


def fill_rule(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rule): drop above 70 % missing, flag above 50 %, median where |skew| > 1, else mean."""
    stat = lambda c: F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("double")).alias("m"), F.abs(F.skewness(c)).alias("s"))
    rule = F.when(F.col("m") > 0.7, "drop").when(F.col("m") > 0.5, "flag").when(F.col("s") > 1, "median").otherwise("mean")
    return df.agg(F.array(*[stat(c) for c in columns]).alias("_a")).select(F.inline("_a")).select("column", rule.alias("rule"))


def fill_by_rule(df: DataFrame, columns: list[str]) -> DataFrame:
    """df after each column's rule: dropped, flagged in <column>_missing, or filled."""
    rules = {r["column"]: r["rule"] for r in fill_rule(df, columns).collect()}
    means = df.agg(*[F.avg(c).alias(c) for c, rule in rules.items() if rule == "mean"] or [F.lit(0)]).first()
    out = []
    for c in df.columns:
        rule = rules.get(c)
        if rule == "drop":
            continue
        if rule in ("mean", "median"):
            value = means[c] if rule == "mean" else exact_quantiles(df, c, [0.5])[0]
            out.append(F.coalesce(F.col(c).cast("double"), F.lit(value).cast("double")).alias(c))
        else:
            out.append(F.col(c))
        if rule == "flag":
            out.append(F.col(c).isNull().alias(f"{c}_missing"))
    return df.select(*out)


def mechanism(df: DataFrame, column: str, numbers: list[str], alpha: float = 0.05) -> DataFrame:
    """(column, pct, evidence, verdict): MCAR below 5 % missing without evidence, MAR where another column differs, else MNAR.

    Evidence is Welch's t between rows with and without a value, in any of the number columns.
    """
    from ..functions.distributions import t_tails

    gone = F.col(column).isNull()
    side = lambda c, is_gone: F.when(gone if is_gone else ~gone, F.col(c).cast("double"))
    parts = [f(side(c, g)).alias(f"{n}{int(g)}") for c in ["_x"] for g in (True, False) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))]
    long = df.select(column, F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_x")) for c in numbers])).alias("_s")).select(column, "_s.*")
    per = long.groupBy("_c").agg(*parts).where("n0 > 1 and n1 > 1")
    a, b = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    t = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(a + b))
    dof = F.try_divide((a + b) * (a + b), a * a / (F.col("n0") - 1) + b * b / (F.col("n1") - 1))
    tests = per.select("_c", t_tails(t, dof).alias("p"))
    evidence = tests.agg(F.coalesce(F.count_if(F.col("p") < alpha), F.lit(0)).alias("evidence"))
    pct = df.agg((F.avg(gone.cast("double")) * 100).alias("pct"))
    verdict = F.when(F.col("evidence") > 0, "MAR").when(F.col("pct") < 5, "MCAR").otherwise("MNAR")
    return pct.crossJoin(evidence).select(F.lit(column).alias("column"), F.round("pct", 4).alias("pct"), "evidence", verdict.alias("verdict"))


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, duplicate rows and their share, columns by family of type."""
    family = lambda t: "number" if t.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")) else "text" if t == "string" else "time" if t in ("date", "timestamp") else "other"
    kinds = [family(t) for _, t in df.dtypes]
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    cells = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0))
    found = groups.agg(F.sum("_n").alias("rows"), F.sum(cells * F.col("_n")).alias("missing"), F.sum(F.col("_n") - 1).alias("duplicates"))
    counts = [F.lit(kinds.count(k)).alias(f"{k}_columns") for k in ("number", "text", "time")]
    return found.select("rows", F.lit(len(kinds)).alias("columns"), "missing", "duplicates", F.round(F.col("duplicates") * 100 / F.col("rows"), 4).alias("duplicate_pct"), *counts)


def issues(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, issue, severity) of columns that are mostly missing, constant, of too many values, or numbers kept as text."""
    kinds = dict(df.dtypes)
    # one count a value: distinct values are never held in one buffer
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("_s")).select("_s.*")
    per = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    stat = per.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("v").alias("unique"),
        F.sum(F.when(as_number(F.col("v")).isNotNull(), F.col("n")).otherwise(0)).alias("numeric"),
    )
    text = F.col("column").isin(*[c for c in columns if kinds[c] == "string"])
    found = F.array(
        F.when(F.col("nulls") > 0.5 * F.col("rows"), F.struct(F.lit("Mostly Missing").alias("issue"), F.lit("High").alias("severity"))),
        F.when(F.col("unique") <= 1, F.struct(F.lit("Zero Variance").alias("issue"), F.lit("High").alias("severity"))),
        F.when(text & (F.col("unique") > 0.5 * F.col("rows")), F.struct(F.lit("High Cardinality").alias("issue"), F.lit("Medium").alias("severity"))),
        F.when(text & (F.col("numeric") > 0) & (F.col("numeric") == F.col("rows") - F.col("nulls")), F.struct(F.lit("Numeric Text").alias("issue"), F.lit("Low").alias("severity"))),
    )
    return stat.select("column", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_i")).select("column", "_i.*")


def distribution_report(df: DataFrame, column: str, digits: int = 4) -> DataFrame:
    """One row: mean, median, mode, std, skew, kurtosis, share of outliers by IQR, and the shape they tell."""
    q1, mid, q3 = exact_quantiles(df, column, [0.25, 0.5, 0.75])
    c = F.col(column).cast("double")
    low, high = (None, None) if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    r = lambda x: F.round(x, digits)
    values = cut(df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count("*").alias("n")))
    mode = values.agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("mode"))
    stat = df.agg(
        r(F.avg(c)).alias("mean"), r(F.lit(mid).cast("double")).alias("median"), r(F.stddev_samp(c)).alias("std"), (r(F.skewness(c)) + F.lit(0.0)).alias("skew"), r(F.kurtosis(c)).alias("kurtosis"),
        r(F.avg(((c < F.lit(low)) | (c > F.lit(high))).cast("double")) * 100).alias("outlier_pct"),
    )
    s, k = F.abs("skew"), F.col("kurtosis")
    label = F.when((s < 0.5) & (F.abs(k) < 0.5), "normal-like").when(s < 0.5, F.when(k > 0, "symmetric, heavy tails").otherwise("symmetric, light tails"))
    label = label.when(s < 1, "moderately skewed").otherwise("highly skewed")
    return stat.crossJoin(mode).withColumn("shape", label)


def null_drift(old: DataFrame, new: DataFrame, columns: list[str], points: float = 5.0) -> DataFrame:
    """(column, before, after, drifted): share of nulls in per cent, drifted where it moved by more than so many points."""
    pct = lambda df, n: df.agg(F.array(*[F.struct(F.lit(c).alias("column"), (F.avg(F.col(c).isNull().cast("double")) * 100).alias(n)) for c in columns]).alias("_a")).select(F.inline("_a"))
    both = pct(old, "before").join(pct(new, "after"), "column")
    return both.withColumn("drifted", F.abs(F.col("after") - F.col("before")) > points)


#: Points of a drift score, which ends at 100.
SCHEMA_POINTS, NEW_POINTS, REMOVED_POINTS, TYPE_POINTS = 30, 5, 10, 8


def drift_score(new: int, removed: int, changed: int, severe: Column) -> Column:
    """Score of changed columns and of the points of other findings, at most 100."""
    base = (SCHEMA_POINTS if new + removed + changed else 0) + new * NEW_POINTS + removed * REMOVED_POINTS + changed * TYPE_POINTS
    return F.least(F.lit(100), F.lit(base) + severe)


def severities(df: DataFrame, key: str, column: str, low: float, high: float) -> DataFrame:
    """(key, kind, severity) of values that are impossible, outside their domain, or far from the mean; one finding a value, in that order."""
    c = F.col(column).cast("double")
    z = F.abs(F.try_divide(c - F.col("_m"), F.col("_s")))
    finite = F.when(F.abs(c) <= 1e308, c)
    base = with_totals(df, _m=F.avg(finite), _s=F.stddev_samp(finite))
    kind = F.when(F.abs(c) > 1e308, "impossible").when((c < low) | (c > high), "domain").when(z > 3, "statistical")
    severity = F.when(kind == "statistical", F.when(z > 5, "critical").when(z > 4, "high").otherwise("medium")).otherwise("critical")
    return base.select(key, kind.alias("kind"), severity.alias("severity")).where("kind is not null")


def local_outlier_factor(df: DataFrame, key: str, column: str, k: int = 10) -> DataFrame:
    """(key, lof) in one dimension: the k nearest of a value lie among its k neighbours on either side.

    Values are sorted in ranges with k-row margins copied from the ranges beside them, so no task
    holds more than a range.
    """
    import pandas as pd

    x = df.select(F.col(key).alias("key"), F.col(column).cast("double").alias("x")).where("x is not null")
    n = x.count()
    parts = max(1, n // 50_000)
    edges = exact_quantiles(x, "x", [i / parts for i in range(1, parts)]) if parts > 1 else []
    # the reach of a value needs its neighbours' neighbours' neighbours: 3 k rows beyond each edge
    ranged = x.withColumn("r", F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), lambda e: e < F.col("x"))))
    from pyspark.sql import Window

    up, down = Window.partitionBy("r").orderBy("x", "key"), Window.partitionBy("r").orderBy(F.col("x").desc(), F.col("key").desc())
    marked = ranged.withColumn("i", F.row_number().over(up)).withColumn("j", F.row_number().over(down))
    margin = 3 * k + 1
    whole = marked.select("r", "key", "x", F.lit(True).alias("own"))
    for side, step in (("i", -1), ("j", 1)):
        whole = whole.unionAll(marked.where(F.col(side) <= margin).select((F.col("r") + step).alias("r"), "key", "x", F.lit(False).alias("own")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        part = part.sort_values(["x", "key"])
        v = part["x"].to_numpy()
        m = min(k, len(v) - 1)
        if m < 1:
            return pd.DataFrame({"key": part["key"], "lof": 1.0})[part["own"].to_numpy()]
        at = np.arange(len(v))[:, None] + np.r_[np.arange(-m, 0), np.arange(1, m + 1)][None]
        far = np.where((at >= 0) & (at < len(v)), np.abs(v[np.clip(at, 0, len(v) - 1)] - v[:, None]), np.inf)
        near = np.argsort(far, axis=1, kind="stable")[:, :m]
        who, dist = np.take_along_axis(at, near, 1), np.take_along_axis(far, near, 1)
        reach = np.maximum(dist, dist[:, -1][who])
        density = 1 / np.maximum(reach.mean(1), 1e-10)
        return pd.DataFrame({"key": part["key"], "lof": density[who].mean(1) / density})[part["own"].to_numpy()]

    kind = dict(x.dtypes)["key"]
    return whole.groupBy("r").applyInPandas(run, f"key {kind}, lof double").withColumnRenamed("key", key)
