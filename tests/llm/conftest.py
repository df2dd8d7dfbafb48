from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


#: Names that operators use for themselves or for results.
CLASHES = ("n_words", "score", "kept", "component_id", "bucket", "key", "doc", "cid", "sig", "node", "labels", "spans", "n_tokens", "model", "hit_items", "matches", "part", "whole", "size", "payload")
LONG = " ".join(f"word{k % 977} the of{k % 13}" for k in range(40_000))
ODD = [
    (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (5, "One"), (6, "a b c d"), (7, "A b\tc  d"), (8, LONG), (9, LONG), (10, LONG + " end"),
    (10, LONG + " end"), (11, "x" * 30_000), (12, "né à 漢字 \U0001f600 &amp; <p>"), (None, "a null id with a few words in it"), (None, None), (13, "!" * 500), (14, "\x00\x01\x7f a\x00b"),
    (15, "The MIT License, (mit\nlicense) General-Public.License apache license"), (16, "<|startoftext|>hi<|endoftext|>"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash."""
    extra = {c: c for c in CLASHES}
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    for name in extra:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
