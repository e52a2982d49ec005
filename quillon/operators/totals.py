"""Totals of a whole table beside its rows, and exact quantiles, without a window over all rows.

A window without keys puts every row into one task.  Here totals are aggregated first and come
back as one broadcast row (or by a join on the keys), and quantiles are found by narrowing
brackets: a sketch proposes one around each rank, counts confirm it, and only what lies inside
is looked at again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_totals(df: DataFrame, keys: list[str] | None = None, **aggs: Column) -> DataFrame:
    """df with aggregates of all its rows, or of its rows with the same keys (nulls are equal)."""
    named = [c.alias(n) for n, c in aggs.items()]
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*named)))
    per = df.groupBy(*[F.col(k).alias(f"_t_{k}") for k in keys]).agg(*named)
    same = [df[k].eqNullSafe(per[f"_t_{k}"]) for k in keys]
    return df.join(per, same, "left").drop(*[f"_t_{k}" for k in keys])


def exact_quantiles(df: DataFrame, column: str | Column, qs: list[float], most: int = 200_000) -> list[float | None]:
    """Quantiles with linear steps between neighbours; nulls and NaN don't count; None for no values."""
    col = F.col(column) if isinstance(column, str) else column
    x = df.select(col.cast("double").alias("x")).where("x is not null and not isnan(x)")
    n = x.count()
    if not n:
        return [None] * len(qs)
    ranks = sorted({f((n - 1) * q) for q in qs for f in (math.floor, math.ceil)})
    found: dict[int, float] = {}
    low, high = dict.fromkeys(ranks, -math.inf), dict.fromkeys(ranks, math.inf)
    while todo := [k for k in ranks if k not in found]:
        inside = lambda k: (F.col("x") >= low[k]) & (F.col("x") <= high[k])
        counts = x.agg(*[e for k in todo for e in (F.count_if(F.col("x") < low[k]), F.count_if(inside(k)))]).first()
        at = {k: (counts[2 * i], counts[2 * i + 1]) for i, k in enumerate(todo)}
        small = [k for k in todo if at[k][1] <= most]
        if small:
            any_ = F.lit(False)
            for k in small:
                any_ = any_ | inside(k)
            values = [(r[0], r[1]) for r in x.where(any_).groupBy("x").count().orderBy("x").collect()]
            for k in small:
                seen = at[k][0]
                for v, c in values:
                    if low[k] <= v <= high[k]:
                        seen += c
                        if seen > k:
                            found[k] = v
                            break
        for k in [k for k in todo if k not in found]:
            below, within = at[k]
            share, eps = (k - below) / within, 0.001
            a, b = x.where(inside(k)).agg(F.percentile_approx("x", [max(0.0, share - eps), min(1.0, share + eps)], 10_000)).first()[0]
            lo = x.agg(F.count_if(F.col("x") < a), F.count_if(F.col("x") <= b)).first()
            if lo[0] <= k < lo[1] and (a, b) != (low[k], high[k]):
                low[k], high[k] = a, b
                if a == b:
                    found[k] = a
            else:  # the bracket cannot be narrowed: many equal values
                found[k] = x.where(inside(k)).groupBy("x").count().orderBy("x").agg(F.percentile("x", share, F.col("count"))).first()[0]
    out = []
    for q in qs:
        r = (n - 1) * q
        a, b = found[math.floor(r)], found[math.ceil(r)]
        out.append(a + (b - a) * (r - math.floor(r)))
    return out


def running_sums(df: DataFrame, order: str, columns: list[str], buckets: int = 256) -> DataFrame:
    """df, with one row for each value of a numeric ``order``, and run_<c>: sums of c up to the row.

    Rows are dealt to buckets of values by sketched quantiles; sums run inside each bucket and
    over the buckets' totals.
    """
    from pyspark.sql import Window

    edges = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    cut = F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(edges))]), lambda e: e < F.col(order))) if edges else F.lit(0)
    rows = df.withColumn("_b", cut)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_b").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns]).select("_b", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in columns])
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(F.broadcast(totals), "_b").select("*", *[(F.col(f"_s_{c}") + F.sum(c).over(inside)).alias(f"run_{c}") for c in columns]).drop("_b", *[f"_s_{c}" for c in columns])
