"""Structured Streaming over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_id(df: DataFrame, keys: list[str], out: str = "event_key") -> DataFrame:
    """The same identifier for the same event, whenever it is processed."""
    return df.withColumn(out, F.md5(F.concat_ws("_", *[F.col(k).cast("string") for k in keys])))


def normalise_versions(df: DataFrame, version: str = "version") -> DataFrame:
    """Events of schema versions 1 and 2 in the shape of 2; other versions raise when read."""
    known = F.when(F.col(version).isin(1, 2), F.col(version)).otherwise(F.raise_error(F.concat(F.lit("unknown schema version "), F.col(version).cast("string"))).cast("int"))
    has = set(df.columns)
    out = df.withColumn(version, known)
    out = out if "session_id" in has else out.withColumn("session_id", F.lit(None).cast("string"))
    return out.withColumn("country", F.coalesce(F.col("country"), F.lit("UNKNOWN")) if "country" in has else F.lit("UNKNOWN"))


def stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A bounded number of files a trigger: the stream's back pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed(df: DataFrame, ts: str, size: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums by window; windows close when the watermark passes."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    return df.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def drain(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now; the rows of its batches, or of the last one in complete mode, from files below out.

    A batch that is run again after a failure overwrites its own folder.
    """
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        last.append(number)

    query = df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    found = df.sparkSession.read.parquet(out)
    return (found.where(F.col("batch") == max(last)) if mode == "complete" and last else found).select(*df.columns)


def micro_batches(df: DataFrame, handle, checkpoint: str) -> None:
    """handle(batch, number) for every micro-batch of what there is now."""
    df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
