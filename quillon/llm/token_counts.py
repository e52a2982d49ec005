"""Token counts: the exact histogram of encoded lengths, and its suffix sums.

Documents are encoded whole where they lie and only their lengths leave the task; the histogram
is an ordinary aggregation.  Suffix sums over lengths answer every context limit L: documents
and tokens of length L or more, and the total when each document is cut to L tokens.  They run
in two levels, inside blocks of 1,024 lengths and over the blocks' totals, so no task gathers
all lengths.

Results in special cases: null and empty texts have length 0 and are counted.  Repeated rows
count each time.  Very long texts are counted whole.  An empty table gives an empty histogram.  Only the text column is read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: The pattern that cuts text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space, as the pattern knows it, that are cut out before matching.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
BLOCK = 1024


@lru_cache(maxsize=2)
def rank_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(encoding, text: str) -> int:
    """len(encode_ordinary(text)); the pattern's engine can't match runs of millions of spaces.

    A long run is one piece, but for its last character where text follows.  What comes before
    it ends, and what is left begins, at a border between pieces.
    """
    n = at = 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() - (run.end() < len(text))
        n += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return n + len(encoding.encode_ordinary(text[at:]))


def token_lengths(docs: DataFrame, path: str, pattern: str = PATTERN, text_col: str = "text") -> DataFrame:
    """One row per document: n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(path, pattern)
        for batch in batches:
            sizes = [token_count(encoding, t.as_py()) if t.is_valid else 0 for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], names=["n_tokens"])

    return docs.select(docs[text_col].cast("string").alias("_text")).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """One row per length: n_tokens, docs, docs_at_least, tokens_at_least, truncated_total,
    docs_total, tokens_total, share_up_to.

    truncated_total: tokens in all when every document is cut to n_tokens.
    share_up_to: the share of documents with at most n_tokens, the inverse of the quantile.
    """
    counted = lengths.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("n_tokens")).agg(F.count("*").alias("docs"))
    counted = cut(counted)  # used twice; encoding again would double the work
    counted = counted.withColumn("_tokens", F.col("n_tokens") * F.col("docs")).withColumn("_block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = counted.groupBy("_block").agg(F.sum("docs").alias("_d"), F.sum("_tokens").alias("_t"))
    above = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select(
        "_block",
        F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_d_above"),
        F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_t_above"),
        F.sum("_d").over(every).alias("docs_total"),
        F.sum("_t").over(every).alias("tokens_total"),
    )
    inside = Window.partitionBy("_block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = counted.join(blocks, "_block").withColumn("docs_at_least", F.col("_d_above") + F.sum("docs").over(inside)).withColumn("tokens_at_least", F.col("_t_above") + F.sum("_tokens").over(inside))
    return full.select(
        "n_tokens", "docs", "docs_at_least", "tokens_at_least",
        (F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        "docs_total", "tokens_total",
        ((F.col("docs_total") - F.col("docs_at_least") + F.col("docs")) / F.col("docs_total")).alias("share_up_to"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """One row per context limit: limit, docs_cut (longer documents), truncated_total, tokens_lost."""
    exprs = [F.struct(F.lit(int(k)).cast("long").alias("limit"), F.sum(F.when(F.col("n_tokens") > k, F.col("docs")).otherwise(0)).alias("docs_cut"), F.sum(F.least(F.col("n_tokens"), F.lit(int(k))) * F.col("docs")).alias("truncated_total"), F.sum(F.greatest(F.col("n_tokens") - int(k), F.lit(0)) * F.col("docs")).alias("tokens_lost")) for k in limits]
    return histogram.agg(F.array(*exprs).alias("_a")).select(F.inline("_a"))


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The least length that a share q of the documents does not exceed, as one row: n_tokens."""
    return histogram.where(F.col("share_up_to") >= q).agg(F.min("n_tokens").alias("n_tokens"))
