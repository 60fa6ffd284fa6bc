"""The corpus pipeline: stages over documents, each on what the one before kept.

Every stage but the last returns the columns of ``documents``. Toxic documents go,
then copies, then near-copies; secrets are replaced by a mark; what is left is
tokenised and packed. No stage is expressible in SQL as a whole (a trained model,
MinHash, a tokenizer), so ``tests/llm/test_pipeline.py`` holds it against plain code.

Defined results: a null text is empty, is clean, and links with nothing but its exact
copies, of which one row stays; so of null and empty texts one row stays in all. Of rows
that repeat text and doc_id one stays; a null doc_id loses against any other among exact
copies and is no near-copy. Texts of any length are used whole. Columns beyond those of
``documents`` are kept, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import exact_dedup, minhash, packing, secret_scan, toxicity
from tidewell.sources.tables import settle, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that an ordinal model fitted on ``labels`` takes for toxic go."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the least doc_id stays."""
    return minhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; every document stays."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 4096 tokens."""
    return packing.pack(packing.tokenise(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
