"""Shared pieces of the training-data operators: tables, lineage cuts, components."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's checkpoints, that all machines see.

    It is ``spark.checkpoint.dir``; only a session on one machine that has none (tests) gets a
    temporary one, any other raises.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir names no shared folder for intermediate tables")
        context.setCheckpointDir(found or tempfile.mkdtemp())
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared checkpoint folder; the plan before is forgotten."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def whole(text: str | Column) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): for every node of edges (u, v), the smallest node it reaches.

    Alternating large-star and small-star steps; each halves the distance to the smallest
    node, so a chain of n links takes about log n rounds.  Nulls are dropped, repeated links
    and loops count once; no edges give no rows.  Raises if the rounds don't suffice.
    """

    def tidy(pairs: DataFrame) -> DataFrame:
        return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def near(pairs: DataFrame, both: bool) -> DataFrame:
        return pairs.union(pairs.select(F.col("v"), F.col("u"))) if both else pairs

    links = cut(tidy(edges.select("u", "v").dropna()))
    nodes = links
    before = None
    for _ in range(rounds):
        ends = near(links, True)
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ends.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = tidy(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(tidy(small.union(least.select("u", F.col("m").alias("v")))))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: not done after {rounds} rounds")
    flat = links.groupBy("u").agg(F.min("v").alias("component"))
    every = near(nodes, True).select(F.col("u").alias("node")).distinct()
    return every.join(flat.withColumnRenamed("u", "node").hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def groups(batches, keys: int):
    """Tables of consecutive rows whose first ``keys`` columns agree, from sorted Arrow batches.

    Only the group at the end of a batch is held over to the next one.
    """
    import numpy as np
    import pyarrow as pa

    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def reach(linked):
    """For a symmetric boolean matrix: the least index that each index reaches."""
    import numpy as np

    n = len(linked)
    label = np.arange(n)
    i, j = np.nonzero(linked)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new
