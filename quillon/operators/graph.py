"""Hierarchies and lineage by recursive queries."""

from __future__ import annotations

import re
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def depths(df: DataFrame, node: str, parent: str, most: int | None = None) -> DataFrame:
    """(node, depth) from the roots, 0 for rows without a parent; nodes of cycles are not reached.

    Runs until a level is empty; raises where that takes more than ``most`` steps, by default the
    number of nodes, which only a cycle below a root exceeds.
    """
    edges = cut(df.select(F.col(node).alias("n"), F.col(parent).alias("p")))
    if most is None:
        most = edges.select("n").distinct().count()
    out = level = cut(edges.where("p is null").select("n", F.lit(0).alias("depth")).distinct())
    for k in count(1):
        level = cut(edges.join(level.select(F.col("n").alias("p")), "p").select("n", F.lit(k).alias("depth")).distinct())
        if level.isEmpty():
            return out
        if k > most:
            raise RuntimeError(f"nodes deeper than {most} steps")
        out = out.unionAll(level)


def reachable(edges: DataFrame, source: str, target: str, most: int | None = None) -> DataFrame:
    """(source, target, hops): the shortest number of steps between all connected nodes.

    Runs until no pair is new; raises where that takes more than ``most`` steps.
    """
    step = cut(edges.select(F.col(source).alias("a"), F.col(target).alias("b")).distinct())
    known = front = step.select("a", "b", F.lit(1).alias("hops"))
    for k in count(2):
        further = front.select("a", F.col("b").alias("m")).join(step.withColumnRenamed("a", "m"), "m").select("a", "b").distinct()
        front = cut(further.join(known, ["a", "b"], "left_anti").select("a", "b", F.lit(k).alias("hops")))
        if front.isEmpty():
            return known.withColumnsRenamed({"a": source, "b": target})
        if most is not None and k > most:
            raise RuntimeError(f"paths of more than {most} steps")
        known = known.unionAll(front)


def cycles(df: DataFrame, node: str, parent: str) -> DataFrame:
    """Nodes that are their own ancestors; a node has one parent, repeated rows count once.

    The parent of the parent and so on is found by doubling: after as many steps as there are
    nodes, only starts that lead to a cycle have an ancestor left, and each cycle's nodes are
    among these ancestors.  That takes log2(nodes) joins, however long a cycle is.
    """
    edges = df.select(F.col(node).alias("n"), F.col(parent).alias("p")).where("n is not null and p is not null").distinct()
    jump = cut(edges)
    if not jump.groupBy("n").count().where("count > 1").isEmpty():
        raise ValueError("cycles: a node has several parents")
    reach = 1
    while reach < jump.count():
        jump = cut(jump.join(jump.select(F.col("n").alias("p"), F.col("p").alias("far")), "p").select("n", F.col("far").alias("p")))
        reach *= 2
    return jump.select(F.col("p").alias(node)).distinct()


def orphans(df: DataFrame, node: str, parent: str) -> DataFrame:
    """Rows whose parent is no node."""
    return df.where(F.col(parent).isNotNull()).join(df.select(F.col(node).alias("_n")), F.col(parent) == F.col("_n"), "left_anti")


def many_parents(df: DataFrame, node: str, parent: str) -> DataFrame:
    return df.where(F.col(parent).isNotNull()).groupBy(node).agg(F.count("*").alias("n_parents"), F.sort_array(F.collect_list(parent)).alias("parents")).where("n_parents > 1")


def sql_sources(sql: str) -> tuple[str | None, list[str]]:
    """(target, sources) of a statement, by its INSERT INTO or CREATE TABLE, FROM and JOIN."""
    target = re.search(r"\b(?:insert\s+into|create\s+(?:or\s+replace\s+)?(?:table|view))\s+([\w.]+)", sql, re.I)
    return target and target[1], sorted(set(re.findall(r"\b(?:from|join)\s+([\w.]+)", sql, re.I)))
