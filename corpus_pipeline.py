"""A training corpus from documents: toxic documents out, copies and near copies out, sources mixed, text encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.  The
mix returns a document as often as it is taken; its copies are equal rows.

Results in special cases are those of the operators: a null text counts as empty and is kept as
null by the filters; empty and very long texts are judged whole; rows that repeat identifier and
text leave the second stage as one; an empty table gives an empty result of the same columns.
Columns beside those of documents are carried through every filter, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.bpe import encode_documents
from quillon.llm.common import shared_folder, table
from quillon.llm.exact_dedup import drop_copies
from quillon.llm.mixing import repeat
from quillon.llm.ngram_join import drop_near_copies
from quillon.llm.queries import vocabulary
from quillon.llm.toxicity import drop_toxic


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows of docs, does not reject.

    Without labelled rows of both classes nothing is rejected.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id; null texts are equal to empty ones."""
    return drop_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id; null and wordless texts stay."""
    return drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document in as many whole copies as the mix gives it; documents without words get none."""
    return repeat(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row."""
    return encode_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", not_toxic), ("exact dedup", no_copies), ("n-gram Jaccard join", no_near_copies), ("mixing", mixed), ("BPE", encoded)]

#: The classifier, banding and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again.

    The folders of earlier stages stay until the session's shared folder is cleared: a lost
    executor's work is done again from them.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
