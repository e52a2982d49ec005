"""Names that nearly agree: pairs within one edit, greedy groups, best matches; and ranking quality."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .stats import average_ranks


def _keys(text: str) -> Column:
    """The text and all texts that lack one of its characters: two texts within one edit share one."""
    c = F.col(text)
    without = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))
    return F.array_distinct(F.concat(F.array(c), F.when(F.length(c) > 0, without).otherwise(F.array().cast("array<string>"))))


def _close(a: str, b: str) -> Column:
    """At most one edit apart; with a threshold only a band of the edit matrix is computed."""
    return F.levenshtein(a, b, 1) >= 0


def _ratio(a: str, b: str) -> Column:
    """Of texts within one edit."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b, 1) / longest)


def near_pairs(df: DataFrame, id_col: str, text_col: str, blocks: list[str]) -> DataFrame:
    """(a, b, ratio), a < b: rows of one block (nulls never match) whose texts are within one edit; ratio is 1 - edits / length.

    Texts of equal length agree but for one place, or one text is the other without one
    character: both are joins on a text that lacks one character, so a block is never compared
    all against all, and only pairs that count come out.  Rows of equal text are one candidate,
    the smallest identifier; the others are paired with it alone, so a copy of one text and a row
    of another are no pair here: all_near_pairs lists those too, near_groups follows them.  Null
    texts pair with nothing.  For short texts such as names.  The joins are merges: the planner's
    estimates ignore what explode adds and what files compress, so it would broadcast the keys of
    a large table through the driver.
    """
    near, same = _near_and_same(df, id_col, text_col, blocks)
    return near.unionAll(same)


def _keyed(df: DataFrame, id_col: str, text_col: str, blocks: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows as (_id, _t, blocks), the first row of each text of a block, and the columns both share."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"), *[F.col(k).alias(f"_b{i}") for i, k in enumerate(blocks)])
    keys = [*[f"_b{i}" for i in range(len(blocks))], "_t"]
    return rows, rows.dropna().groupBy(*keys).agg(F.min("_id").alias("_first")), keys


def _near_and_same(df: DataFrame, id_col: str, text_col: str, blocks: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pairs of first rows of different texts, and of first rows with their copies."""
    rows, first, keys = _keyed(df, id_col, text_col, blocks)
    same = rows.dropna().join(first.hint("merge"), keys).where("_id > _first").select(F.col("_first").alias("a"), F.col("_id").alias("b"), F.lit(1.0).alias("ratio"))
    block = keys[:-1]
    t, at = F.col("_t"), F.col("_at")
    places = first.where(F.length(t) > 0).select(*block, "_first", "_t", F.explode(F.sequence(F.lit(1), F.length(t))).alias("_at"))
    lacking = places.withColumn("_rest", F.concat(F.substr(t, F.lit(1), at - 1), F.substr(t, at + 1)))
    ratio = (1 - 1 / (F.length("_rest") + 1)).alias("ratio")
    left, right = (lacking.select(F.xxhash64("_at", "_rest").alias("_key"), *block, "_at", "_rest", F.col("_first").alias(n)) for n in ("a", "b"))
    swapped = left.join(right.hint("merge"), ["_key", *block, "_at", "_rest"]).where("a < b").select("a", "b", ratio)
    # in a run of one character only the first is left out: each shorter text once
    longer = lacking.where((at == 1) | (F.substr(t, at, F.lit(1)) != F.substr(t, at - 1, F.lit(1)))).select(F.xxhash64("_rest").alias("_key"), *block, "_rest", F.col("_first").alias("_long"))
    shorter = first.select(F.xxhash64("_t").alias("_key"), *block, t.alias("_rest"), F.col("_first").alias("_short"))
    added = longer.join(shorter.hint("merge"), ["_key", *block, "_rest"]).select(F.least("_long", "_short").alias("a"), F.greatest("_long", "_short").alias("b"), ratio)
    return swapped.unionAll(added), same


def all_near_pairs(df: DataFrame, id_col: str, text_col: str, blocks: list[str]) -> DataFrame:
    """near_pairs with copies paired as well: every two rows of a block whose texts are within one edit.

    The rows are as many as the copies ask for, the square of a large group.
    """
    near, same = _near_and_same(df, id_col, text_col, blocks)
    copies = cut(same.select(F.col("a").alias("_of"), F.col("b").alias("_id")))
    if copies.isEmpty():
        return near
    near = cut(near)
    for side in ("a", "b"):
        more = near.join(copies.hint("merge"), F.col(side) == F.col("_of")).withColumn(side, F.col("_id")).select("a", "b", "ratio")
        near = cut(near.unionAll(more)) if side == "a" else near.unionAll(more)
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "ratio")
    left, right = (copies.select("_of", F.col("_id").alias(n)) for n in ("a", "b"))
    among = left.join(right.hint("merge"), "_of").where("a < b").select("a", "b", F.lit(1.0).alias("ratio"))
    return near.unionAll(copies.select(F.col("_of").alias("a"), F.col("_id").alias("b"), F.lit(1.0).alias("ratio"))).unionAll(among)


def _taken(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of all pairs in order of a: the rows that a leader takes."""
    taken = set()
    for part in parts:
        for a, b in zip(part["a"], part["b"], strict=True):
            if a not in taken:
                taken.add(b)
    yield pd.DataFrame({"n": list(taken)})


def greedy_groups(rows: DataFrame, id_col: str, pairs: DataFrame, most: int = 500_000) -> DataFrame:
    """(id, leader) as a pass over the rows in order finds them: a row that no leader has taken leads, and takes all later rows it is paired with."""
    led = _led(pairs, most).withColumnRenamed("_n", id_col)
    return rows.select(id_col).join(led, id_col, "left").select(id_col, F.coalesce("_leader", id_col).alias("leader"))


def near_groups(df: DataFrame, id_col: str, text_col: str, blocks: list[str], most: int = 500_000) -> DataFrame:
    """(id, leader): greedy_groups over all_near_pairs, which are not listed.

    Rows of equal text have the same partners.  A leader before the first of them takes them all;
    if none takes the first, it leads and takes the others.  So only first rows are passed over,
    and every row has the leader of its first.
    """
    rows, first, keys = _keyed(df, id_col, text_col, blocks)
    firsts = rows.join(first.hint("merge"), keys, "left").select("_id", F.coalesce("_first", "_id").alias("_n"))
    led = _led(_near_and_same(df, id_col, text_col, blocks)[0], most)
    return firsts.join(led, "_n", "left").select(F.col("_id").alias(id_col), F.coalesce("_leader", "_n").alias("leader"))


def _led(pairs: DataFrame, most: int) -> DataFrame:
    """(_n, _leader) of the rows that a leader takes.

    Each round takes the partners of all rows that wait for no smaller one, and drops the pairs
    that this decides.  Up to ``most`` open pairs, as counted, are passed over in one task; above
    that the rounds are as many as the longest chain of waiting rows.
    """
    edges = cut(pairs.select("a", "b").distinct())
    open_, taken = edges, []
    while open_.count() > most:
        taken.append(cut(open_.join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti").select(F.col("b").alias("n")).distinct()))
        for side in ("a", "b"):
            open_ = open_.join(taken[-1].withColumnRenamed("n", side), side, "left_anti").select("a", "b")
        open_ = cut(open_)
    taken.append(open_.repartition(1).sortWithinPartitions("a").mapInPandas(_taken, f"n {edges.schema['a'].dataType.simpleString()}"))
    return edges.join(reduce(DataFrame.unionAll, taken).withColumnRenamed("n", "a"), "a", "left_anti").groupBy(F.col("b").alias("_n")).agg(F.min("a").alias("_leader"))


def best_names(left: DataFrame, left_id: str, left_name: str, right: DataFrame, right_id: str, right_name: str, same: Column) -> DataFrame:
    """(left_id, match, score, status): the right row with the highest mean of name ratio and agreement, ties to the smaller identifier.

    Right rows within one edit are looked at; a left row without one is kept for review.  same
    reads columns of both sides.
    """
    a = left.withColumn("_key", F.explode(_keys(left_name)))
    b = right.withColumn("_key", F.explode(_keys(right_name)))
    close = a.join(b, "_key").where(_close(left_name, right_name))
    score = (100 * _ratio(left_name, right_name) + F.when(same, 100).otherwise(0)) / 2
    best = close.groupBy(left_id).agg(F.min(F.struct((-score).alias("s"), F.col(right_id).alias("match"))).alias("_b"))
    found = left.select(left_id).join(best, left_id, "left")
    return found.select(left_id, F.col("_b.match").alias("match"), F.round(-F.col("_b.s"), 4).alias("score"), F.when(F.col("_b").isNull(), "REVIEW NEEDED").otherwise("MATCHED").alias("status"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: the area under the ROC curve, ties counting half."""
    ranked = average_ranks(df, score, "_rank")
    sums = ranked.agg(F.sum(F.when(F.col(label) == 1, F.col("_rank"))).alias("r"), F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    return sums.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p").cast("double") * F.col("n")).alias("auc"))
