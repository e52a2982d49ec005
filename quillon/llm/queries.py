"""Queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_documents
from .common import table
from .embedding_dedup import embedding_links
from .exact_dedup import exact_dedup
from .html_extract import extract_text
from .mixing import mix
from .ngram_join import jaccard_classes
from .suffix_dedup import drop_repeats
from .token_counts import length_histogram, token_lengths
from .toxicity import toxicity
from .url_filter import url_filter


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op2_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_embedding_near_dedup, op2_bpe_encoding, op3_token_counts, op4_toxicity, op5_ngram_jaccard_join, op6_suffix_array_dedup, op7_url_filters, op8_source_mixing, op9_html_extraction, op10_exact_dedup)
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    sql = {
        "op10_exact_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
            g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t),
            r AS (SELECT d.doc_id, d.t, row_number() OVER (PARTITION BY d.t, d.doc_id ORDER BY d.doc_id) AS n FROM d)
            SELECT r.doc_id, g.keep_id, g.group_size, (r.doc_id = g.keep_id AND r.n = 1) AS kept, sha256(r.t) AS text_sha256
            FROM r JOIN g ON r.t = g.t""",
    }
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
