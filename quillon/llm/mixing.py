"""Mixing sources to target weights by entropy balancing.

Document rates r solve  min sum(r ln r - r)  with  sum(size * r) = target  for every source and
0 <= r <= most.  The dual is convex with one multiplier a source, and its solution is an
exponential tilt, r = min(most, exp(l * x)) with x the size over the source's mean size.  All
that the dual needs of a source is its histogram of sizes.  A Newton iteration is one
aggregation of that histogram, gradients and curvatures summed by source over all tasks; the
state, one row a source, holds the multiplier and the bracket that keeps steps safe.

Rounding to copies is sequential Poisson sampling: a document gets floor(r) copies, and the
sources' open words go to documents in ascending u / frac(r), with u a hash of the identifier,
until they are used up.  The cut is found by a histogram of 4,096 steps a source, then by one
of 4,096 parts of the step where it falls; running sums only order the documents of one part.
The document at the cut gets the words that remain (``part``), so each source meets its target
to the word where rates allow it.

Documents are read once for their sizes.  They are drawn where they lie: what the draw needs is
one row a source, joined by broadcast while there are few sources, by source and salt beyond.

Results in special cases: a null text, or one of white space, has size 0 and is taken 0 times.
A null source is a source, ordered last.  Null or repeated identifiers are ordinary documents;
rows equal in identifier, source and size are interchangeable.  An empty table gives an empty
result.  Only named columns are read, whatever other names there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole

WORDS = r"[^\x20\x09-\x0D]+"
STEPS = 4096
SALTS = 16
#: Most sources whose rows are broadcast to the documents.
FEW = 20_000


def words(text: str | Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORDS)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (_source, source_size) with target: weighted shares of share * all sizes, none above most * its size.

    Raising a common level until the shares add up is the limit of resharing the excess; the
    sources that stop are those first in the order of most * size / weight.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    placed = sizes.withColumn("_w", F.element_at(listed, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    placed = placed.withColumn("_cap", most * F.col("source_size"))
    all_of = Window.partitionBy()
    by_ratio = Window.orderBy((F.col("_cap") / F.col("_w")), F.col("_source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_of) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    found = placed.withColumn("_level", level).withColumn("_open", F.when(F.col("_cap") > F.col("_level") * F.col("_w"), F.col("_level")))
    aim = F.coalesce(F.least(F.col("_cap"), F.col("_w") * F.max("_open").over(all_of)), F.col("_cap"))
    return found.select("_source", "source_size", aim.alias("target"))


def rate_of(most: float) -> Column:
    """The rate of a document of its size, by its source's row."""
    tilted = F.exp(F.least(F.col("_at") * F.try_divide("size", "_mean"), F.lit(math.log(most))))
    return F.coalesce(F.col("_fixed"), F.least(tilted, F.lit(float(most))))


def balance(hist: DataFrame, aims: DataFrame, most: float, few: bool, rounds: int = 100) -> DataFrame:
    """aims with the multiplier ``_at`` of each source, by Newton iterations over hist (_key, size, _n).

    The steps are those for the logarithm of the gradient's sum, which is nearly linear in the
    multiplier; they stay within a bracket.  ``_fixed`` is the rate of sources whose target leaves
    no choice.  Raises if the rounds don't bring every sum to 1e-9 of its goal.
    """
    tops = hist.groupBy("_key").agg(F.expr("sum(size * _n) / sum(_n)").alias("_mean"), F.sum("_n").alias("_docs"))
    fixed = F.when((F.col("source_size") <= 0) | (F.col("target") <= 0), 0.0).when(F.col("target") >= most * F.col("source_size"), float(most))
    start = {"_goal": "target / nullif(source_size, 0) * _docs", "_at": "0D", "_low": "double('-inf')", "_high": "double('inf')", "_done": "_fixed is not null"}
    state = cut(aims.join(tops, "_key").withColumn("_fixed", fixed).selectExpr("*", *[f"{v} as {k}" for k, v in start.items()]))
    near = F.broadcast if few else lambda df: df
    cap = repr(math.log(most))
    terms = [F.expr(e) for e in (f"sum(_x * _n * exp(least(_at * _x, {cap}))) as _sum", f"sum(if(_at * _x < {cap}, _x * _x * _n * exp(_at * _x), 0D)) as _slope")]
    bracket = ("*", "_done or coalesce(abs(_sum - _goal) <= 1e-9 * _goal, false) as _d", "_at + ln(_goal / nullif(_sum, 0D)) * _sum / nullif(_slope, 0D) as _step")
    narrowed = ("*", "if(not _d and _sum < _goal, _at, _low) as _l", "if(not _d and _sum >= _goal, _at, _high) as _h")
    away = "case when _l > double('-inf') and _h < double('inf') then (_l + _h) / 2 when _sum < _goal then 2 * _at + 1 else 2 * _at - 1 end"
    # a bracket of neighbouring numbers can't be narrowed further
    stuck = "_l > double('-inf') and _h < double('inf') and _h - _l <= 1e-15 * greatest(abs(_l), abs(_h))"
    after = (*aims.columns, "_mean", "_docs", "_fixed", "_goal", f"case when _d then _at when _step > _l and _step < _h then _step else {away} end as _at", "_l as _low", "_h as _high", f"_d or coalesce({stuck}, false) as _done")
    for k in range(rounds):
        if k != 1 and state.where("not _done").isEmpty():
            return state
        rows = hist.join(near(state.where("not _done").select("_key", "_at", "_mean")), "_key").selectExpr("_key", "_at", "_n", "size / _mean as _x")
        sums = rows.groupBy("_key").agg(*terms)
        state = cut(state.join(near(sums), "_key", "left").selectExpr(*bracket).selectExpr(*narrowed).selectExpr(*after))
    raise RuntimeError(f"mixing: rates not found after {rounds} Newton iterations")


def beside(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    """rows with the columns of their source's row; one source may hold a third of rows."""
    if few:
        return rows.join(F.broadcast(per_source), "_key")
    spread = per_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_u"), F.lit(SALTS)).cast("int"))
    return salted.join(spread.hint("merge"), ["_key", "_salt"]).drop("_salt")


def drawn(rows: DataFrame, per_source: DataFrame, most: float, few: bool) -> DataFrame:
    """rows (_key, _u, size) with their rate, whole copies, place in the draw and its step and part of a step."""
    near = beside(rows, per_source, few).withColumn("_rate", rate_of(most)).withColumn("_whole", F.floor("_rate"))
    frac = F.col("_rate") - F.col("_whole")
    near = near.withColumn("_xi", F.when((frac > 0) & (F.col("size") > 0), F.col("_u") / frac))
    at = F.col("_xi") * (STEPS // 4)
    within = lambda cell: F.when(F.col("_xi").isNotNull(), F.least(F.floor(cell), F.lit(STEPS - 1))).cast("int")
    return near.withColumn("_step", within(at)).withColumn("_sub", within((at - F.col("_step")) * STEPS))


def crossing(cells: DataFrame, open_: DataFrame, at: str) -> DataFrame:
    """For each key, the cell where the running words pass the open ones, and the words still open there.

    cells: (_key, at, _words), at most 4,096 a key.
    """
    run = Window.partitionBy("_key").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cells.join(open_, "_key").withColumn("_upto", F.sum("_words").over(run)).where("_upto > _open")
    first = summed.groupBy("_key").agg(F.min(F.struct(at, F.greatest(F.col("_open") - (F.col("_upto") - F.col("_words")), F.lit(0)).alias("_left"))).alias("_s"))
    return first.select("_key", f"_s.{at}", "_s._left")


def identified(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[Column, Column, Column]:
    """(key of the source, hash in (0, 1) for the draw, size) as columns of docs."""
    source = F.col(source_col).cast("string")
    key = F.coalesce(F.concat(F.lit("s"), source), F.lit("-"))
    text = F.col(text_col).cast("string")
    drawn_by = F.coalesce(F.xxhash64(F.col(id_col), F.lit(7)) + F.when(F.col(id_col).isNull(), F.xxhash64(whole(text))).otherwise(0), F.lit(0))
    u = (F.shiftrightunsigned(F.xxhash64(drawn_by), 11) + 1) / F.lit(float(2**53 + 1))
    return key, u, words(text)


def plan(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, bool]:
    """(one row a source: _key, source_size, target, rate's terms, and where the draw ends; whether they are few) for sized (_key, _u, size)."""
    hist = cut(sized.groupBy("_key", "size").agg(F.count("*").alias("_n")))
    few = hist.select("_key").distinct().limit(FEW + 1).count() <= FEW
    sizes = hist.groupBy("_key").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"))
    named = sizes.select("_key", F.when(F.col("_key") != "-", F.substr("_key", F.lit(2))).alias("_source"), "source_size")
    aims = named.select("_key", "_source").join(targets(named.drop("_key"), weights, share, most).withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of"))).select("_key", "source_size", "target")
    solved = balance(hist, aims, most, few).select("_key", "source_size", "target", "_mean", "_fixed", "_at")
    rows = drawn(sized, solved, most, few)
    cells = cut(rows.groupBy("_key", "_step").agg(F.sum("size").alias("_words"), F.sum(F.col("_whole") * F.col("size")).alias("_sure"), F.first("target").alias("_target")))
    open_ = cells.groupBy("_key").agg((F.round(F.first("_target")) - F.sum("_sure")).cast("long").alias("_open"))
    first = cut(crossing(cells.where("_step is not null").select("_key", "_step", "_words"), open_, "_step").select("_key", F.col("_step").alias("_cut"), F.col("_left").alias("_open")))
    inside = beside(rows.select("_key", "_u", "_step", "_sub", "size"), first, few).where("_step = _cut")
    second = crossing(inside.groupBy("_key", "_sub").agg(F.sum("size").alias("_words")), first.select("_key", "_open"), "_sub")
    second = second.select("_key", F.col("_sub").alias("_cut_sub"), F.col("_left"))
    return cut(solved.join(first.select("_key", "_cut"), "_key", "left").join(second, "_key", "left")), few


def taken(rows: DataFrame, per_source: DataFrame, few: bool, most: float, order: list[str]) -> DataFrame:
    """rows (_key, _u, size, ...) with _rate, _copies and _part."""
    near = drawn(rows, per_source, most, few)
    step, sub = F.col("_step"), F.col("_sub")
    before = F.col("_cut").isNull() | (step < F.col("_cut")) | ((step == F.col("_cut")) & (sub < F.col("_cut_sub")))
    full = step.isNotNull() & before
    edge = step.isNotNull() & (step == F.col("_cut")) & (sub == F.col("_cut_sub"))
    near = near.withColumn("_full", F.coalesce(full, F.lit(False))).withColumn("_edge", F.coalesce(edge, F.lit(False)))
    running = Window.partitionBy("_key").orderBy("_xi", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_edge = near.where("_edge").withColumn("_sum", F.sum("size").over(running))
    extra = F.least(F.greatest(F.col("_left") - (F.col("_sum") - F.col("size")), F.lit(0)), F.col("size"))
    at_edge = at_edge.withColumn("_extra", extra.cast("long")).drop("_sum")
    other = near.where("not _edge").withColumn("_extra", F.when(F.col("_full"), F.col("size")).otherwise(0).cast("long"))
    got_whole = (F.col("_extra") >= F.col("size")) & (F.col("_extra") > 0)
    done = other.unionByName(at_edge)
    return done.withColumn("_copies", F.col("_whole") + got_whole.cast("long")).withColumn("_part", F.when(got_whole, 0).otherwise(F.col("_extra")).cast("long"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id_col, size, source_size, target, rate, copies, part, taken."""
    key, u, size = identified(docs, id_col, text_col, source_col)
    sized = cut(docs.select(F.col(id_col).alias("_id"), key.alias("_key"), u.alias("_u"), size.alias("size")))
    done = taken(sized, *plan(sized.drop("_id"), weights, share, most), most, ["_id"])
    return done.select(
        F.col("_id").alias(id_col), "size", "source_size", "target", F.col("_rate").alias("rate"), F.col("_copies").alias("copies"),
        F.col("_part").alias("part"), (F.col("_copies") * F.col("size") + F.col("_part")).cast("long").alias("taken"),
    )


def repeat(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of docs as often as the mix takes them whole, all columns as they were."""
    key, u, size = identified(docs, id_col, text_col, source_col)
    terms = [key.alias("_key"), u.alias("_u"), size.alias("size")]
    per_source, few = plan(cut(docs.select(*terms)), weights, share, most)
    own = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), *terms)
    done = taken(own, per_source, few, most, ["_id"]).select("_row", F.col("_copies").cast("int").alias("_n")).where("_n > 0")
    return done.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_nth")).select("_row.*")
