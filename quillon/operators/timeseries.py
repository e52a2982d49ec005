"""Time series: resampling, gaps, filling, smoothing, anomalies, decomposition."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .totals import with_totals


def spine(df: DataFrame, ts: str, unit: str) -> DataFrame:
    """Every bin between the first and last time: (bin)."""
    ends = df.agg(F.date_trunc(unit, F.min(ts)).alias("a"), F.date_trunc(unit, F.max(ts)).alias("b"))
    return ends.where("a is not null").select(F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias("bin"))


def resample(df: DataFrame, ts: str, unit: str, aggs: dict[str, Column]) -> DataFrame:
    """One row a bin, also where it is empty (nulls)."""
    bins = df.where(F.col(ts).isNotNull()).groupBy(F.date_trunc(unit, ts).alias("bin")).agg(*[c.alias(n) for n, c in aggs.items()])
    return spine(df, ts, unit).join(bins, "bin", "left")


def gaps(df: DataFrame, ts: str, unit: str) -> DataFrame:
    """Bins without rows."""
    return spine(df, ts, unit).join(df.select(F.date_trunc(unit, ts).alias("bin")), "bin", "left_anti")


def gap_islands(df: DataFrame, ts: str, unit: str, seconds: int) -> DataFrame:
    """(start, end, missing) of runs of bins without rows."""
    w = Window.orderBy("bin")
    runs = gaps(df, ts, unit).withColumn("_run", F.unix_timestamp(F.col("bin").cast("timestamp")) - F.row_number().over(w) * seconds)
    return runs.groupBy("_run").agg(F.min("bin").alias("start"), F.max("bin").alias("end"), F.count("*").alias("missing")).drop("_run")


def ffill(column: str, order: str, keys: list[str] | None = None) -> Column:
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*(keys or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def bfill(column: str, order: str, keys: list[str] | None = None) -> Column:
    return F.first(column, ignorenulls=True).over(Window.partitionBy(*(keys or [])).orderBy(order).rowsBetween(0, Window.unboundedFollowing))


def interpolate(df: DataFrame, column: str, order: str, keys: list[str] | None = None) -> DataFrame:
    """Linear in ``order`` between neighbours; before the first value null, after the last that value."""
    w = Window.partitionBy(*(keys or [])).orderBy(order)
    at = F.when(F.col(column).isNotNull(), F.col(order).cast("double"))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    x0, x1 = F.last(column, ignorenulls=True).over(back), F.first(column, ignorenulls=True).over(ahead)
    t0, t1 = F.last(at, ignorenulls=True).over(back), F.first(at, ignorenulls=True).over(ahead)
    between = F.when(F.col(column).isNotNull(), F.col(column)).when(x1.isNull(), x0).when(x0.isNotNull(), x0 + (x1 - x0) * F.try_divide(F.col(order).cast("double") - t0, t1 - t0))
    return df.withColumn(column, between)


def rolling(column: str, size: int, order: str, how, keys: list[str] | None = None, center: bool = False, least: int = 1, exclude_current: bool = False) -> Column:
    """Rolling aggregate over rows; null where the frame has fewer than ``least`` values."""
    frame = (-size, -1) if exclude_current else (-(size // 2), (size - 1) // 2) if center else (-(size - 1), 0)
    w = Window.partitionBy(*(keys or [])).orderBy(order).rowsBetween(*frame)
    return F.when(F.count(column).over(w) >= least, how(F.col(column)).over(w))


def rolling_corr(a: str, b: str, size: int, order: str) -> Column:
    """Correlation over the ``size`` rows before each row; null where they are fewer or a side doesn't vary."""
    w = Window.orderBy(order).rowsBetween(-size, -1)
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    r = F.try_divide(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))
    return F.when(F.count(a).over(w) == size, r)


def ewma(df: DataFrame, key: str, column: str, order: str, alpha: float) -> DataFrame:
    """(key, order, ewma) with the first value as start; a key's series is one task's."""
    source = df.select(key, order, F.col(column).cast("double").alias("ewma"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        return part.assign(ewma=part["ewma"].ewm(alpha=alpha, adjust=False).mean())

    return source.groupBy(key).applyInPandas(run, source.schema)


def infer_frequency(df: DataFrame, ts: str) -> DataFrame:
    """One row: frequency by the median step."""
    steps = df.select(((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(F.col(ts).cast("timestamp")).over(Window.orderBy(ts)))) / 1e6).alias("s"))
    m = F.median("s")
    return steps.agg(F.when(m < 120, "T").when(m < 7200, "H").when(m < 2 * 86400, "D").when(m < 8 * 86400, "W").when(m < 35 * 86400, "M").otherwise("Y").alias("frequency"))


def anomalies(df: DataFrame, column: str, order: str, window: int = 24, k: float = 3.0, keys: list[str] | None = None) -> DataFrame:
    """Flags by z-score, IQR fences and rolling deviation, and whether any holds."""
    c = F.col(column)
    stats = {"_m": F.avg(c), "_sd": F.stddev_samp(c), "_q": F.percentile(c, [0.25, 0.75])}
    base = with_totals(df, keys, **stats)
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    mean, dev = (rolling(column, window, order, f, keys, center=True) for f in (F.avg, F.stddev_samp))
    no = lambda x: F.coalesce(x, F.lit(False))
    out = base.withColumn("z_flag", no((F.col("_sd") > 0) & (F.abs(c - F.col("_m")) > k * F.col("_sd")))).withColumn("iqr_flag", no((c < q1 - 1.5 * (q3 - q1)) | (c > q3 + 1.5 * (q3 - q1))))
    out = out.withColumn("rolling_flag", no((dev > 0) & (F.abs(c - mean) > k * dev))).withColumn("anomaly", F.expr("z_flag or iqr_flag or rolling_flag"))
    return out.drop(*stats)


def decompose(df: DataFrame, column: str, order: str, period: int) -> DataFrame:
    """Additive trend (centred moving average), seasonal means that add up to 0, and residual; ends without trend are null."""
    w = Window.orderBy(order)
    frame = w.rowsBetween(-(period // 2), period // 2)
    if period % 2:
        trend = F.avg(column).over(frame)
    else:
        half = F.lag(column, period // 2).over(w) + F.lead(column, period // 2).over(w)
        trend = (F.sum(column).over(w.rowsBetween(-(period // 2 - 1), period // 2 - 1)) + half / 2) / period
    base = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("trend", F.when(F.count(column).over(frame) == 2 * (period // 2) + 1, trend))
    phase = base.withColumn("_p", F.col("_i") % period)
    means = phase.groupBy("_p").agg(F.avg(F.col(column) - F.col("trend")).alias("_s"))
    means = means.withColumn("seasonal", F.col("_s") - F.avg("_s").over(Window.partitionBy())).drop("_s")
    return phase.join(F.broadcast(means), "_p").withColumn("resid", F.col(column) - F.col("trend") - F.col("seasonal")).drop("_p", "_i")


def autocorrelation(df: DataFrame, column: str, order: str, lags: int) -> DataFrame:
    """(lag, r): correlation of the series with itself moved by each lag."""
    w = Window.orderBy(order)
    moved = df.select(F.col(column).alias("x"), *[F.lag(column, k).over(w).alias(f"l{k}") for k in range(1, lags + 1)])
    return moved.agg(F.array(*[F.struct(F.lit(k).alias("lag"), F.corr("x", f"l{k}").alias("r")) for k in range(1, lags + 1)]).alias("_a")).select(F.inline("_a"))


def cross_correlation(df: DataFrame, a: str, b: str, order: str, lags: int) -> DataFrame:
    """(lag, r) of standardised a and b moved by lags from -lags to lags; sums are over all n."""
    every, w = Window.partitionBy(), Window.orderBy(order)
    z = lambda c: (F.col(c) - F.avg(c).over(every)) / F.stddev_pop(c).over(every)
    base = df.select(order, z(a).alias("x"), z(b).alias("y"))
    shifted = base.select("x", *[(F.lag("y", k) if k >= 0 else F.lead("y", -k)).over(w).alias(f"y{k + lags}") for k in range(-lags, lags + 1)])
    return shifted.agg(F.array(*[F.struct(F.lit(k).alias("lag"), (F.sum(F.col("x") * F.col(f"y{k + lags}")) / F.count("*")).alias("r")) for k in range(-lags, lags + 1)]).alias("_a")).select(F.inline("_a"))


def neighbours(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """df with prev_<c>, the value in the row before by ``order`` (unique), without a window over all rows.

    Rows are dealt to ranges of the order; a range's first row takes its values from the last
    row of the range before, one row a range.
    """
    ends = df.agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count("*").alias("n"))
    parts = F.broadcast(ends.select("a", ((F.col("b") - F.col("a") + 1) / F.greatest(F.lit(1.0), F.ceil(F.col("n") / 100_000))).alias("w")))
    dealt = df.crossJoin(parts).withColumn("_r", F.floor((F.col(order) - F.col("a")) / F.col("w"))).drop("a", "w")
    inside = Window.partitionBy("_r").orderBy(order)
    last = dealt.groupBy("_r").agg(F.max_by(F.struct(*columns), order).alias("_last"))
    before = last.select("_r", F.lag("_last").over(Window.orderBy("_r")).alias("_before"))
    own = dealt.withColumn("_own", F.lag(F.struct(*columns)).over(inside)).withColumn("_n", F.row_number().over(inside))
    both = own.join(F.broadcast(before), "_r").withColumn("_p", F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_own")))
    return both.select(*df.columns, *[F.col(f"_p.{c}").alias(f"prev_{c}") for c in columns])
