"""Long texts, clashing names, ties and empty tables; the mix against an independent solution."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline
from quillon.llm import exact_dedup, mixing, token_counts, toxicity


def test_token_counts_of_long_runs():
    encoding = token_counts.rank_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), token_counts.PATTERN)
    for n in (9_999, 10_000, 30_000):
        for text in (" " * n, "a" + " " * n, " " * n + "b", "a b" + "\n" * n + " cd" + " \t" * n + "e", "　" * n + "x", "\x1f" * n + "x"):
            assert token_counts.token_count(encoding, text) == len(encoding.encode_ordinary(text))
    assert token_counts.token_count(encoding, " " * 5_000_000 + "x") > 1
    assert token_counts.token_count(encoding, "a" * 1_000_000 + "!" * 100_000) > 1


def corpus(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, _row string, held_out boolean"
    return spark.createDataFrame([(i, t, "en", s, 0, 1.0, 1, "r", True) for i, t, s in rows], schema)


def test_filter_keeps_columns_of_any_name(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefg", k=5))
    rows = [(i, " ".join([word() for _ in range(20)] + ["vilest"] * (i % 3 == 0)), "s") for i in range(300)] + [(400, None, None), (400, None, None), (401, "", "s")]
    docs = corpus(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns
    kept = [r.doc_id for r in left.collect()]
    clean = [i for i, _, _ in rows if i >= 300 or i % 3]
    assert set(clean) - set(kept) == set() and len([i for i in kept if i < 300 and i % 3 == 0]) <= 5
    assert kept.count(400) == 2
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == len(rows)


def test_mix_against_bisection(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(rng.choice((0, 1, 5, 30, 200)))), rng.choice(("a", "b", "c", None, ""))) for i in range(400)]
    rows += [(500 + k, " ".join("w" for _ in range(30)), "a") for k in range(50)] + [(7, "w w w", "a")] * 20 + [(None, "w w", "b")] * 20
    got = mixing.mix(corpus(spark, rows)).collect()
    assert len(got) == len(rows)
    by_target = {}
    for r in got:
        by_target.setdefault((r.source_size, r.target), []).append(r)
    for (total, target), own in by_target.items():
        assert sum(r.size for r in own) == total
        mean = total / len(own)
        rates = {r.size: r.rate for r in own}
        if 0 < target < 2 * total:
            low, high = -1e6, 1e6
            for _ in range(300):
                mid = (low + high) / 2
                near = sum(r.size * math.exp(min(mid * r.size / mean, math.log(2))) for r in own)
                low, high = (mid, high) if near < target else (low, mid)
            for size, rate in rates.items():
                if size:
                    assert rate == pytest.approx(math.exp(min(low * size / mean, math.log(2))), rel=1e-5)
        assert all(r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 1
    again = sorted(map(tuple, mixing.mix(corpus(spark, rows).repartition(5)).collect()), key=repr)
    assert again == sorted(map(tuple, got), key=repr)
    copies = sum(r.copies for r in got)
    assert mixing.repeat(corpus(spark, rows)).count() == copies


def test_dedup_of_many_copies_and_texts_of_any_length(spark):
    rows = [(i, "same", "s") for i in range(3000)] + [(5000 + i, "x" * 1_000_000 + str(i % 2), "s") for i in range(4)] + [(None, f"n{i % 3}", "s") for i in range(30)]
    for keep, pick in (("max", max), ("min", min)):
        got = exact_dedup.exact_dedup(corpus(spark, rows), keep=keep).collect()
        assert len(got) == len(rows) and sum(r.kept for r in got) == 1 + 2 + 3
        same = [r for r in got if r.text_sha256 == hashlib.sha256(b"same").hexdigest()]
        assert {(r.keep_id, r.group_size) for r in same} == {(pick(range(3000)), 3000)}


def test_pipeline_on_odd_tables(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(1, None, None), (2, "", "a"), (3, text, "a"), (4, text, "b"), (5, text + " end", "b"), (5, text + " end", "b"), (None, "one two", "c")]
    labels = spark.createDataFrame([(3, 1, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for name, found in (("odd", rows), ("none", [])):
        corpus(spark, found).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    out = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()]
    # 3 and 4 are copies, of which 4 stays; 5 is a near copy of it; rows without words are never taken
    assert set(out) == {4, None} and out.count(4) <= 2
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    docs = corpus(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path / "odd")).columns == docs.columns, name
    assert docs.where(F.col("text").isNull()).count() == 1
