"""Sinks: files, splits with a manifest, snapshots, managed tables and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, compression: str = "snappy", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def csv_safe(df: DataFrame) -> DataFrame:
    """Text columns without commas and line ends."""
    return df.select(*[F.regexp_replace(F.replace(F.col(c), F.lit(","), F.lit(";")), r"[\r\n]+", " ").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Records as JSON lines; metadata (rows, columns, types) as a JSON text, written beside them to path.meta."""
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    meta = json.dumps({"total_records": rows.get["n"], "columns": df.columns, "data_types": dict(df.dtypes)})
    df.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode(mode).text(f"{path}.meta")
    return meta


def split_by(df: DataFrame, column: str, path: str) -> DataFrame:
    """A folder for each value, and the manifest (value, rows, file)."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)
    return manifest(df, column, path)


def manifest(df: DataFrame, column: str, path: str = "") -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("rows")).withColumn("file", F.concat(F.lit(f"{path}/{column}="), "value"))


def snapshot(df: DataFrame, base: str, version: str) -> None:
    """One more version below base."""
    df.write.mode("errorifexists").parquet(f"{base}/v={version}")


def versions(spark: SparkSession, base: str, keep: int) -> DataFrame:
    """(v, stale): versions below base; all but the last ``keep`` are stale."""
    from pyspark.sql import Window

    found = spark.read.parquet(base).select(F.col("v").cast("string").alias("v")).distinct()
    return found.withColumn("stale", F.row_number().over(Window.orderBy(F.col("v").desc())) > keep)


def save_table(df: DataFrame, name: str, mode: str = "overwrite") -> int:
    """A managed table; returns its rows, read back."""
    df.write.mode(mode).saveAsTable(name)
    return df.sparkSession.table(name).count()
