"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, PII, BPE.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and returns the
columns of documents; the last returns what a trainer reads. Null texts fail the quality rules; an empty
table goes through as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm import bpe, decontaminate, minhash, pii, quality
from relata.llm.queries import table, tokenizer_path
from relata.llm.store import cut, free, last_only

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs).select(*DOCUMENT_COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.drop_near_duplicates(docs).select(*DOCUMENT_COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*DOCUMENT_COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars follows the new text."""
    return pii.replace_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256 and the ids (binary, 4 bytes each) of every document."""
    return bpe.encode_documents(docs, tokenizer_path(), keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii_surrogates", pii_stage),
    ("bpe_encoding", bpe_stage),
]

#: Not expressible: similarity components, keyed surrogates and merges; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage no longer needs is deleted."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = docs
        with last_only(spark):
            docs = cut(stage(spark, before, sf_dir))
        free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
