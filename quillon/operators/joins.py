"""Joins and key checks.  Null child keys never match; each function states what they count as."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Join on equal names; other names of both sides get suffixes."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    name = lambda df, s: df.withColumnsRenamed({c: c + s for c in both})
    return name(left, suffixes[0]).join(name(right, suffixes[1]), on, how)


def merge_spread(left: DataFrame, right: DataFrame, on: list[str], parts: int = 240, shares: int = 16, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """merge (inner) for few keys with many rows on both sides, whose output is far larger than its inputs.

    The left rows of a key are dealt to ``shares`` shares by their contents, the right rows are
    copied to each, and the number of tasks is fixed: by input size a few tasks would write all.
    A task holds the right rows of its keys in memory.
    """
    share = F.pmod(F.xxhash64(*left.columns), F.lit(shares)).cast("int")
    dealt = left.withColumn("_share", share).repartition(parts, *on, "_share")
    copied = right.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(parts, *on, "_share")
    return merge(dealt, copied.hint("shuffle_hash"), [*on, "_share"], "inner", suffixes).drop("_share")


def invalid_keys(child: DataFrame, fk: str, parent: DataFrame, key: str, allow_null: bool = True) -> DataFrame:
    """Child rows whose key is no parent's; with allow_null=False also those without a key."""
    keys = parent.select(F.col(key).alias("_key")).where("_key is not null").distinct()
    bad = child.where(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("_key"), "left_anti")
    return bad if allow_null else bad.unionByName(child.where(F.col(fk).isNull()))


def orphan_values(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """Distinct not null keys of the child that no parent has."""
    return child.select(F.col(fk).alias("value")).where("value is not null").distinct().join(parent.select(F.col(key).alias("value")).distinct(), "value", "left_anti")


def childless(parent: DataFrame, key: str, child: DataFrame, fk: str) -> DataFrame:
    return parent.join(child.select(F.col(fk).alias("_fk")), F.col(key) == F.col("_fk"), "left_anti")


def cascade_counts(parent: DataFrame, key: str, child: DataFrame, fk: str) -> DataFrame:
    """Parents that children refer to, with their number: what a delete would take along."""
    counts = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_fk")).agg(F.count("*").alias("child_count"))
    return parent.join(counts, F.col(key) == F.col("_fk")).drop("_fk")


def delete_cascade(gone: Column, parent: DataFrame, key: str, children: list[tuple[DataFrame, str]]) -> list[DataFrame]:
    """Parent and children without the rows that go, and without theirs."""
    left = parent.where(~F.coalesce(gone, F.lit(False)))
    keys = parent.where(gone).select(F.col(key).alias("_gone"))
    return [left, *(c.join(keys, F.col(fk) == F.col("_gone"), "left_anti") for c, fk in children)]


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old rows of their key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def add_aligned(a: DataFrame, b: DataFrame, key: str, value: str, fill: float = 0.0) -> DataFrame:
    """Sum by label; a label of one side counts as fill on the other."""
    return a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full").select(key, (F.coalesce("_a", F.lit(fill)) + F.coalesce("_b", F.lit(fill))).alias(value))


def overlap(frames: list[DataFrame], column: str) -> DataFrame:
    """Values that all frames have."""
    return reduce(lambda a, b: a.intersect(b), [f.select(column).where(F.col(column).isNotNull()) for f in frames])


def drop_duplicates(df: DataFrame, keys: list[str], order: list[Column], keep: str = "first") -> DataFrame:
    """First or last row of each key in the given order."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if keep == "first":
        return df.withColumn("_n", first).where("_n = 1").drop("_n")
    size = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_n", first).withColumn("_of", size).where("_n = _of").drop("_n", "_of")


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once, with the key's digest and group size."""
    size = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("group_size", size).where("group_size > 1").withColumn("group_hash", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])))


def most_complete(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key with the most values, ties by the order."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    return drop_duplicates(df.withColumn("_filled", filled), keys, [F.col("_filled").desc(), *order]).drop("_filled")


def merge_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, of the first value that is not null in every other column."""
    rest = [c for c in df.columns if c not in keys]
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_n"))).alias(c)
    return ranked.groupBy(*keys).agg(*[first(c) for c in rest]).select(*df.columns)
