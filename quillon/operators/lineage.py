"""Cutting of plans: rows written to the folder that all machines see."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a session on one machine that has none gets a temporary one, any other raises."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir names no shared folder for intermediate tables")
        context.setCheckpointDir(found or tempfile.mkdtemp())
    return context.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()
