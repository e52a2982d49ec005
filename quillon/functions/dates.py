"""Column functions on dates and times."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date formats that are tried in this order.
FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd MMM yyyy", "MMM dd, yyyy", "yyyyMMdd")


def parse_date(c: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The date by the first format that reads it, else null."""
    return F.coalesce(*[F.try_to_date(c, f) for f in formats])


def day_of_week(c: Column) -> Column:
    """Monday is 0."""
    return F.weekday(c)


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def calendar(c: Column) -> dict[str, Column]:
    """Components and flags of a date."""
    d = F.to_date(c)
    return {
        "year": F.year(d), "quarter": F.quarter(d), "month": F.month(d), "week": F.weekofyear(d), "day": F.dayofmonth(d),
        "day_of_year": F.dayofyear(d), "day_of_week": day_of_week(d), "is_weekend": day_of_week(d) >= 5,
        "is_month_start": F.dayofmonth(d) == 1, "is_month_end": d == F.last_day(d),
        "is_quarter_start": d == F.to_date(F.date_trunc("quarter", d)), "is_year_start": F.dayofyear(d) == 1,
        "is_business_day": day_of_week(d) < 5, "season": season(d),
    }


def season(c: Column) -> Column:
    m = F.month(c)
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("autumn")


def age_hours(c: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(c.cast("timestamp"))) / F.lit(3.6e9)


def since(c: Column, as_of: Column) -> dict[str, Column]:
    """Days, whole weeks toward zero and calendar years to a reference date."""
    days = F.datediff(as_of, c)
    return {"days": days, "weeks": (days / 7).cast("int"), "years": F.year(as_of) - F.year(c)}


def week_end(c: Column) -> Column:
    """The Sunday that ends the date's week."""
    return F.date_add(F.to_date(F.date_trunc("week", c)), 6)
