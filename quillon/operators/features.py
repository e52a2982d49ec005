"""Encoders, scalers' choice, treatment of outliers and missing values, segments and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .totals import exact_quantiles, with_totals


def scale(df: DataFrame, column: str, how: str, out: str) -> DataFrame:
    """Column out: min_max, z (population), z_sample or robust; null where the column does not vary."""
    c = F.col(column)
    if how == "robust":
        q1, mid, q3 = exact_quantiles(df, column, [0.25, 0.5, 0.75])
        return df.withColumn(out, F.try_divide(c - F.lit(mid), F.lit(q3) - F.lit(q1)))
    by = {"min_max": (F.min(c), F.max(c) - F.min(c)), "z": (F.avg(c), F.stddev_pop(c)), "z_sample": (F.avg(c), F.stddev_samp(c))}
    at, unit = by[how]
    return with_totals(df, _at=at, _unit=unit).withColumn(out, F.try_divide(c - F.col("_at"), "_unit")).drop("_at", "_unit")


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Codes from 0 in the order of values; null stays null.  Only distinct values are ordered."""
    book = codes(df, column).withColumnsRenamed({"value": "_value", "code": out})
    return df.join(book, F.col(column) == F.col("_value"), "left").drop("_value")


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values])


def codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): a code book for label_encode on large tables, one row a value."""
    return df.select(F.col(column).alias("value")).where("value is not null").distinct().withColumn("code", F.row_number().over(Window.orderBy("value")) - 1)


def target_encode(df: DataFrame, column: str, target: str, smooth: float = 10.0) -> DataFrame:
    """(column, encoded): (n * mean + s * global mean) / (n + s) of each value."""
    per = df.groupBy(column).agg(F.count(target).alias("n"), F.sum(target).cast("double").alias("s"))
    every = F.sum("s").over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy())
    return per.select(column, ((F.col("s") + smooth * every) / (F.col("n") + smooth)).alias("encoded"))


def frequency_encode(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).select(column, (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("frequency"))


def group_rare(df: DataFrame, column: str, least: float, other: str = "__RARE__") -> DataFrame:
    """Values with a smaller share than ``least`` become one."""
    rare = frequency_encode(df, column).where(F.col("frequency") < least).select(F.col(column).alias("_rare"))
    return df.join(rare, F.col(column).eqNullSafe(F.col("_rare")), "left").withColumn(column, F.when(F.col("_rare").isNotNull(), other).otherwise(F.col(column))).drop("_rare")


def treat_outliers(column: str, low: Column, high: Column, how: str) -> Column:
    c = F.col(column)
    out = (c < low) | (c > high)
    if how == "cap":
        return F.when(c < low, low).when(c > high, high).otherwise(c)
    if how == "flag":
        return F.coalesce(out, F.lit(False))
    if how == "null":
        return F.when(~out, c)
    raise ValueError(f"no treatment {how!r}")


def fill(df: DataFrame, column: str, how: str, value=None) -> DataFrame:
    """Missing values of a column: mean, median, mode, zero, constant, flag."""
    c = F.col(column)
    if how == "flag":
        return df.withColumn(f"{column}_missing", c.isNull())
    if how == "median":
        return df.withColumn(column, F.coalesce(c, F.lit(exact_quantiles(df, column, [0.5])[0])))
    if how in ("zero", "constant"):
        return df.withColumn(column, F.coalesce(c, F.lit(0 if how == "zero" else value)))
    if how == "mode":
        counts = df.where(c.isNotNull()).groupBy(c.alias("_v")).agg(F.count("*").alias("_n"))
        total = counts.agg(F.min_by("_v", F.struct(-F.col("_n"), "_v")).alias("_fill"))
    else:
        total = df.agg(F.avg(c).alias("_fill"))
    return df.crossJoin(F.broadcast(total)).withColumn(column, F.coalesce(c, "_fill")).drop("_fill")


def sentinels(c: Column, words: tuple[str, ...] = ("", "n/a", "na", "null", "none", "unknown", "missing", "-")) -> Column:
    """Null for words that mean a missing value."""
    return F.when(~F.lower(F.trim(c)).isin(*words), c)


def quantile_bins(df: DataFrame, column: str, q: int, out: str) -> DataFrame:
    """Right-closed bins 1..q at interpolated quantiles; equal edges fall together."""
    edges = F.array(*[F.lit(e) for e in exact_quantiles(df, column, [i / q for i in range(1, q)])])
    return df.withColumn(out, F.size(F.filter(edges, lambda e: e < F.col(column))) + 1)


def rfm(orders: DataFrame, customer: str, when: str, amount: str) -> DataFrame:
    """(customer, recency, frequency, monetary); recency in days to the last order of all."""
    per = orders.groupBy(customer).agg(F.max(when).alias("_m"), F.count("*").alias("frequency"), F.round(F.sum(amount), 2).alias("monetary"))
    return with_totals(per, _last=F.max("_m")).select(customer, F.datediff("_last", "_m").alias("recency"), "frequency", "monetary")


#: Customer labels by the scores of recency, frequency and amount; the first list that holds a score counts.
RFM_LABELS = {
    "Champions": ("555", "554", "544", "545", "454", "455", "445"),
    "Loyal Customers": ("543", "444", "435", "355", "354", "345", "344"),
    "Potential Loyalists": ("553", "551", "552", "541", "542", "533", "532", "531", "452", "451"),
    "New Customers": ("512", "511", "422", "421", "412", "411", "311"),
    "At Risk": ("155", "154", "144", "214", "215", "115", "114"),
    "Can't Lose Them": ("155", "254", "245"),
}


def rfm_label(score: Column) -> Column:
    """The label of a score of three digits, each from 1 to 5."""
    out = F.when(F.lit(False), "")
    for name, scores in RFM_LABELS.items():
        out = out.when(score.isin(*scores), name)
    return out.otherwise("Others")


def fold(key: str, k: int) -> Column:
    """Fold of a row by the hash of its key: rows of one key stay together."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(k))


def class_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row a class: support, precision, recall, f1."""
    pairs = df.select(F.col(actual).alias("a"), F.col(predicted).alias("p"))
    per = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.lit(1).alias("s"), F.lit(0).alias("g")), F.struct(F.col("p").alias("c"), F.lit(0).alias("s"), F.lit(1).alias("g")))).alias("x"), (F.col("a") == F.col("p")).cast("int").alias("hit")).select("x.*", "hit")
    sums = per.groupBy(F.col("c").alias("class")).agg(F.sum("s").alias("support"), F.sum("g").alias("guessed"), F.sum(F.col("s") * F.col("hit")).alias("hits"))
    p, r = F.coalesce(F.try_divide("hits", "guessed"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    return sums.select("class", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    return df.agg(F.round(F.avg(e * e), 4).alias("mse"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(1 - F.sum(e * e) / (F.var_pop(actual) * F.count("*")), 6).alias("r2"))


def feature_filter(df: DataFrame, columns: list[str], least: float) -> list[str]:
    """Columns whose population variance, over their squared range, is at least ``least``."""
    row = df.agg(*[F.try_divide(F.var_pop(c), F.pow(F.max(c) - F.min(c), F.lit(2))).alias(c) for c in columns]).first()
    return [c for c in columns if (row[c] or 0) >= least]
