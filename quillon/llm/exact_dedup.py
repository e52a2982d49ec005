"""Exact dedup: a tree of merges over sorted digest runs.

Every row belongs to one of 2^k leaves, by the hash of its identifier.  A leaf sorts its rows by
digest and folds them into a run: one entry a digest, with the best identifier and the number of
rows.  The runs then climb a binomial tree of exchanges, ``span`` levels at a time: in a round,
the 2^span nodes whose labels differ in those bits alone exchange parts of their runs, each
receiving the digests whose own bits are its label's.  What a node receives are sorted runs;
Spark's external sorter puts them in order by merging, and one pass over the stream folds
neighbours of equal digest, holding one entry at a time.  After the last round a node's label is
the leading bits of its digests, so each digest has one entry.  A digest of which a third of all
rows are copies enters the tree as one entry a leaf and shrinks by each round; no task ever
holds its rows together.  The way back is a join on (leaf, digest), as even.

Equal means, at every level: same SHA-256, same length, same independent 64-bit hash.

Texts are read once for their digests.  The number of leaves follows from the number of
rows (``levels``), so that a small table isn't written in as many files as a large one.

Results in special cases: a null text is the empty text.  A null identifier is the least; a
group of null identifiers keeps one row, with a null keep_id.  Of repeated rows (same
identifier and text) one stays.  An empty table gives an empty result.  Very long texts count
whole.  Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole, width

KEY = ["_digest", "_bytes", "_check"]
#: Most rows that a leaf is made for, and fewest where the table alone decides.
LEAF, LEAST = 4_000_000, 50_000


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _digest, _bytes, _check) of every row; the digest in lowercase hex."""
    text = whole(F.col(text_col).cast("string"))
    return docs.select(F.col(id_col).alias("_id"), F.sha2(text, 256).alias("_digest"), F.octet_length(text).alias("_bytes"), F.xxhash64(text).alias("_check"))


def fold(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """One row for each run of rows that agree in the first ``keys`` columns: the first row, with the sum of its last column.

    The run at the end of a batch is held until it is known to be over.
    """
    held: pa.RecordBatch | None = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch]) if batch.num_rows else held
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        new[0] = True
        for k in range(keys):
            column = batch.column(k)
            a, b = column.slice(0, n - 1), column.slice(1)
            both = pc.and_(a.is_null(), b.is_null())
            new[1:] |= ~pc.or_(pc.fill_null(pc.equal(a, b), False), both).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        total = np.add.reduceat(batch.column(batch.num_columns - 1).to_numpy(), first)
        rows = batch.take(pa.array(first))
        rows = pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(total)], schema=batch.schema)
        held = rows.slice(len(first) - 1)
        if len(first) > 1:
            yield rows.slice(0, len(first) - 1)
    if held is not None:
        yield held


def merged(runs: DataFrame, keys: list[str], *best: F.Column) -> DataFrame:
    """The runs of each partition merged in the order of keys and folded: of rows with equal keys the best, and the sum of the last column."""
    sorted_ = runs.select(*keys, *[c for c in runs.columns if c not in keys]).sortWithinPartitions(*keys, *best)
    return sorted_.mapInArrow(lambda batches: fold(batches, len(keys)), sorted_.schema)


def levels(rows: int, cores: int, shuffle: int) -> int:
    """Levels of the tree: a leaf for each core, one for each shuffle partition that would get LEAST rows, and more once leaves would pass LEAF rows."""
    return max(1, math.ceil(math.log2(max(cores, min(shuffle, rows / LEAST), rows / LEAF, 2))))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", span: int = 4) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    keep: "max" or "min", the identifier that stays of equal texts.
    span: levels of the tree that one exchange climbs; a node merges up to 2^span runs.
    """
    best = {"max": F.col("_id").desc_nulls_last(), "min": F.col("_id").asc_nulls_last()}[keep]
    entries = cut(keyed(docs, id_col, text_col).withColumn("_n", F.lit(1).cast("long")))
    spark = docs.sparkSession
    bits = levels(entries.count(), spark.sparkContext.defaultParallelism, width(spark))
    parts = 1 << bits
    # null identifiers may be very many, and of many texts
    leaf = F.pmod(F.xxhash64("_id", F.when(F.col("_id").isNull(), F.col("_digest"))), F.lit(parts)).cast("int")
    aim = F.pmod(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long"), F.lit(parts)).cast("int")
    dealt = entries.withColumn("_leaf", leaf).repartition(parts, "_leaf")
    rows = cut(merged(dealt, ["_leaf", *KEY, "_id"]))
    leaves = cut(merged(rows.select("_leaf", *KEY, "_id", "_n"), ["_leaf", *KEY], best))
    runs = leaves.withColumnRenamed("_leaf", "_node")
    for low in range(0, bits, span):
        mask = ((1 << min(span, bits - low)) - 1) << low
        label = F.col("_node").bitwiseAND(F.lit((parts - 1) & ~mask)).bitwiseOR(aim.bitwiseAND(F.lit(mask)))
        runs = merged(runs.withColumn("_node", label).repartition(parts, "_node"), ["_node", *KEY], best)
    done = runs.select(*KEY, F.col("_id").alias("_best"), F.col("_n").alias("_rows"))
    back = leaves.select("_leaf", *KEY).join(done.hint("merge"), KEY)
    stays = F.col("_id").eqNullSafe(F.col("_best"))
    every = rows.join(back.hint("merge"), ["_leaf", *KEY])
    nth = F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))
    return every.select("*", nth.alias("_nth")).select(
        F.col("_id").alias(id_col), F.col("_best").alias("keep_id"), F.col("_rows").alias("group_size"),
        (stays & (F.col("_nth") == 1)).alias("kept"), F.col("_digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of docs that exact_dedup keeps, all columns as they were."""
    text = whole(F.col(text_col).cast("string"))
    key = lambda digest: F.concat(digest, F.coalesce(F.concat(F.lit(" "), F.col(id_col).cast("string")), F.lit("")))
    kept = exact_dedup(docs, id_col, text_col, keep).where("kept").select(key(F.col("text_sha256")).alias("_k"))
    own = docs.select(F.struct("*").alias("_row"), key(F.sha2(text, 256)).alias("_k"))
    # rows that repeat identifier and text have one key, and one of them stays
    one = F.row_number().over(Window.partitionBy("_k").orderBy("_k"))
    return own.join(kept.hint("merge"), "_k", "left_semi").withColumn("_n", one).where("_n = 1").select("_row.*")
