"""Pipelines of DataFrame functions: steps, decorators, templates and rules read from data."""

from __future__ import annotations

import functools
import hashlib
import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
Step = Callable[[DataFrame], DataFrame]


def chain(df: DataFrame, *steps: Step) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


def retry(times: int = 3, wait: float = 1.0, growth: float = 2.0, on: tuple[type[Exception], ...] = (OSError, TimeoutError)):
    """Repeat an action that fails by one of the errors; waits grow."""

    def wrap(f):
        @functools.wraps(f)
        def run(*args, **kwargs):
            pause = wait
            for attempt in range(1, times + 1):
                try:
                    return f(*args, **kwargs)
                except on:
                    if attempt == times:
                        raise
                    log.warning("%s failed, attempt %d of %d", f.__name__, attempt, times)
                    time.sleep(pause)
                    pause *= growth

        return run

    return wrap


def timed(f):
    """Log the seconds of a function; a DataFrame it returns is not run by this."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        began = time.perf_counter()
        try:
            return f(*args, **kwargs)
        finally:
            log.info("%s took %.3f s", f.__name__, time.perf_counter() - began)

    return run


def needs(*columns: str):
    """The step's input must have the columns."""

    def wrap(f: Step) -> Step:
        @functools.wraps(f)
        def run(df: DataFrame, *args, **kwargs):
            if missing := [c for c in columns if c not in df.columns]:
                raise ValueError(f"{f.__name__} misses columns {missing}")
            return f(df, *args, **kwargs)

        return run

    return wrap


class ReportCache:
    """Results by the digest of their query, for ``ttl`` seconds."""

    def __init__(self, ttl: float, clock: Callable[[], float] = time.time):
        self.ttl, self.clock, self.held = ttl, clock, {}

    def get(self, query: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = hashlib.md5(query.encode()).hexdigest()
        for k in [k for k, (until, _) in self.held.items() if until <= self.clock()]:
            self.held.pop(k)[1].unpersist()
        if key not in self.held:
            self.held[key] = self.clock() + self.ttl, make().persist()
        return self.held[key][1]


def metric_report(df: DataFrame, value: str, dimension: str | None = None, since: tuple[str, str] | None = None, least: float | None = None, top: int | None = None) -> DataFrame:
    """Total, count and mean of a value by an optional dimension, with optional date filter, floor and top n."""
    if since:
        df = df.where(F.col(since[0]) >= F.to_timestamp(F.lit(since[1])))
    out = df.groupBy(*([dimension] if dimension else [])).agg(F.round(F.sum(value), 2).alias("total"), F.count("*").alias("n"), F.round(F.avg(value), 2).alias("mean"))
    if least is not None:
        out = out.where(F.col("total") >= least)
    order = [F.col("total").desc(), *([F.col(dimension)] if dimension else [])]
    return out.orderBy(*order).limit(top) if top else out


#: Words of requests and what they ask for; the first that occurs counts.
METRIC_WORDS = {"revenue": "sales", "sales": "sales", "orders": "orders", "customers": "customers"}
DIMENSION_WORDS = {"region": "region", "segment": "segment", "month": "month", "priority": "priority"}


def intent(request: str) -> dict[str, str | None]:
    text = request.lower()
    first = lambda words: next((v for w, v in words.items() if w in text), None)
    return {"metric": first(METRIC_WORDS), "dimension": first(DIMENSION_WORDS)}


def introspect(df: DataFrame) -> DataFrame:
    """(column, type, nullable) as rows."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema], "column string, type string, nullable boolean")


def select_types(df: DataFrame, family: str) -> list[str]:
    """Columns of a family: number, text, time."""
    kinds = {"number": ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"), "text": ("string",), "time": ("date", "timestamp")}[family]
    return [c for c, t in df.dtypes if t.startswith(kinds)]


def run_health(log: DataFrame) -> DataFrame:
    """(job, success, mean_seconds, slow, failures_in_row) of a run log (job, run, ok, seconds).

    Slow runs take over 1.5 times the job's mean; failures_in_row is the longest streak.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("job").orderBy("run")
    mean = log.groupBy("job").agg(F.avg("seconds").alias("_mean"))
    ends = log.withColumn("_good", F.sum(F.col("ok").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    streaks = ends.where("not ok").groupBy("job", "_good").agg(F.count("*").alias("_n")).groupBy("job").agg(F.max("_n").alias("_streak"))
    per = log.join(mean, "job").groupBy("job").agg(F.round(F.avg(F.col("ok").cast("int")) * 100, 4).alias("success"), F.round(F.first("_mean"), 4).alias("mean_seconds"), F.count_if(F.col("seconds") > 1.5 * F.col("_mean")).alias("slow"))
    return per.join(streaks, "job", "left").select("job", "success", "mean_seconds", "slow", F.coalesce("_streak", F.lit(0)).alias("failures_in_row"))
