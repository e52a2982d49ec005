"""Rules that are data: formulas as text, samples of what breaks them, formats of columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def formula(text: str) -> Column:
    """A SQL expression over the columns of one row; statements and subqueries are refused."""
    if re.search(r";|--|/\*|\b(select|reflect|java_method)\b", text, re.I):
        raise ValueError(f"not a formula: {text}")
    return F.expr(text)


def check(df: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, violations) for a control table (rule, formula); a null result is a violation."""
    listed = [(row["rule"], formula(row["formula"])) for row in rules.orderBy("rule").collect()]
    counts = [F.struct(F.lit(name).alias("rule"), F.count_if(~F.coalesce(rule, F.lit(False))).alias("violations")) for name, rule in listed]
    return df.agg(F.array(*counts).alias("_a")).select(F.inline("_a"))


def samples(df: DataFrame, key: str, rules: dict[str, Column], n: int = 3) -> DataFrame:
    """(rule, key) of the first n rows that break each rule."""
    parts = [df.where(~F.coalesce(rule, F.lit(False))).orderBy(key).limit(n).select(F.lit(name).alias("rule"), key) for name, rule in rules.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def formats(df: DataFrame, key: str, wanted: dict[str, tuple[str, object]]) -> DataFrame:
    """(key, column, kind) of values that don't have their column's format; nulls and missing columns are not looked at.

    Formats: integer and float with a range, pattern, category, date, boolean.
    """

    def fits(column: str, kind: str, how) -> Column:
        text = F.col(column).cast("string")
        if kind in ("integer", "float"):
            value = text.try_cast("double")
            whole = (value == F.floor(value)) if kind == "integer" else ~F.isnan(value)
            return value.isNotNull() & whole & value.between(*how)
        return {"pattern": lambda: text.rlike(how), "category": lambda: text.isin(*how), "date": lambda: F.try_to_date(text, how).isNotNull(), "boolean": lambda: F.lower(text).isin("true", "false")}[kind]()

    bad = [
        F.when(F.col(column).isNotNull() & ~F.coalesce(fits(column, kind, how), F.lit(False)), F.struct(F.lit(column).alias("column"), F.lit(kind).alias("kind")))
        for column, (kind, how) in wanted.items()
        if column in df.columns
    ]
    return df.select(key, F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("_b")).select(key, "_b.*")
