"""Rules on rows and tables.  A rule is a name with a Column that is true where a row passes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    passes: Column
    severity: str = "high"
    nulls_fail: bool = True

    @property
    def fails(self) -> Column:
        return ~F.coalesce(self.passes, F.lit(not self.nulls_fail))


def not_null(c: str) -> Rule:
    return Rule(f"{c}_not_null", F.col(c).isNotNull())


def unique(c: str, order: str) -> Rule:
    """Fails on later repeats only."""
    return Rule(f"{c}_unique", F.row_number().over(Window.partitionBy(c).orderBy(order)) == 1)


def between(c: str, low, high, nulls_fail: bool = True) -> Rule:
    return Rule(f"{c}_between", F.col(c).between(low, high), nulls_fail=nulls_fail)


def matches(c: str, pattern: str, nulls_fail: bool = True) -> Rule:
    return Rule(f"{c}_matches", F.col(c).rlike(f"^(?:{pattern})"), nulls_fail=nulls_fail)


def within_std(df: DataFrame, c: str, k: float = 3) -> Rule:
    """Within k sample deviations of the mean of df, which is aggregated here."""
    mean, std = df.agg(F.avg(c), F.stddev_samp(c)).first()
    return Rule(f"{c}_within_std", F.abs(F.col(c) - F.lit(mean)) <= F.lit(std) * k)


def is_in(c: str, values: list, nulls_fail: bool = True) -> Rule:
    return Rule(f"{c}_in", F.col(c).isin(*values), nulls_fail=nulls_fail)


def ordered(a: str, b: str, strict: bool = False) -> Rule:
    """a does not come after b; rows without either pass."""
    return Rule(f"{a}_before_{b}", F.col(a) < F.col(b) if strict else F.col(a) <= F.col(b), nulls_fail=False)


def implies(name: str, if_: Column, then: Column) -> Rule:
    return Rule(name, ~F.coalesce(if_, F.lit(False)) | F.coalesce(then, F.lit(False)))


def close_to(name: str, value: Column, wanted: Column, tolerance: float = 0.01) -> Rule:
    return Rule(name, F.abs(value - wanted) <= tolerance, nulls_fail=False)


def exclusive(name: str, columns: list[str]) -> Rule:
    """At most one of the columns is filled; '' and 0 are not."""
    filled = sum((F.coalesce(~F.col(c).cast("string").isin("", "0"), F.lit(False)).cast("int") for c in columns), F.lit(0))
    return Rule(name, filled <= 1)


def report(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row a rule in one pass: rule, severity, failed, passed, pass_rate."""
    flagged = df.select(*[r.fails.alias(f"_{i}") for i, r in enumerate(rules)])
    stat = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.count_if(F.col(f"_{i}")).alias("failed"), F.count_if(~F.col(f"_{i}")).alias("passed")) for i, r in enumerate(rules)]
    return flagged.agg(F.array(*stat).alias("_a")).select(F.inline("_a")).withColumn("pass_rate", F.round(F.try_divide("passed", F.col("passed") + F.col("failed")) * 100, 2))


def violations(df: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """(key, rule, severity) of every failure."""
    flagged = df.select(F.col(key), *[r.fails.alias(f"_{i}") for i, r in enumerate(rules)])
    named = F.array(*[F.when(F.col(f"_{i}"), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))) for i, r in enumerate(rules)])
    return flagged.select(F.col(key), F.explode(F.filter(named, lambda x: x.isNotNull())).alias("_v")).select(key, "_v.*")


def summary(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy("rule", "severity").agg(F.count("*").alias("violations"), F.countDistinct(key).alias("rows"))


def split_valid(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with errors, the names of the rules that fail, and valid."""
    named = F.filter(F.array(*[F.when(r.fails, F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return df.withColumn("errors", named).withColumn("valid", F.size("errors") == 0)


def fingerprint(df: DataFrame) -> str:
    """A digest of column names and types, the same in every process."""
    from hashlib import sha256

    return sha256("|".join(sorted(f"{n}:{t}" for n, t in df.dtypes)).encode()).hexdigest()


def schema_drift(old: DataFrame, new: DataFrame) -> dict[str, list[str]]:
    a, b = dict(old.dtypes), dict(new.dtypes)
    return {"added": sorted(b.keys() - a.keys()), "removed": sorted(a.keys() - b.keys()), "retyped": sorted(c for c in a.keys() & b.keys() if a[c] != b[c])}


def drift(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: mean and std change in per cent, whether the range grew, severity."""
    stat = lambda df, t: df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.avg(c).alias(f"mean_{t}"), F.stddev_samp(c).alias(f"std_{t}"), F.min(c).cast("double").alias(f"min_{t}"), F.max(c).cast("double").alias(f"max_{t}")) for c in columns]).alias("_a")).select(F.inline("_a"))
    both = stat(old, "a").join(stat(new, "b"), "column")
    pct = lambda n: F.round(F.try_divide((F.col(f"{n}_b") - F.col(f"{n}_a")) * 100, F.abs(f"{n}_a")), 4)
    out = both.select("column", pct("mean").alias("mean_change"), pct("std").alias("std_change"), ((F.col("min_b") < F.col("min_a")) | (F.col("max_b") > F.col("max_a"))).alias("range_grew"))
    return out.withColumn("severity", F.when(F.abs("mean_change") > 50, "high").when(F.abs("mean_change") > 25, "medium").when((F.abs("mean_change") > 10) | (F.abs("std_change") > 20) | F.col("range_grew"), "low").otherwise("none"))


def assert_columns(df: DataFrame, names: list[str]) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
