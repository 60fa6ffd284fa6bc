"""The queries of the corpus operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import chat, exact_dedup, minhash, packing, quality, secret_scan, sentence_spans, sentencepiece_codec, suffix_repeats, toxicity
from tidewell.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

PROBE = r"\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.summarise(chat.expand(rows.unionByName(probe)))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenise(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.remove_repeats(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), sentencepiece_codec.FEWEST)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.digest(suffix_repeats.remove_repeats(table(spark, sf_dir, "documents")))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_chat_formatting": (op1_chat_formatting, chat.QUERY_SQL),
    "op2_best_fit_packing": (op2_best_fit_packing, None),
    "op3_sentence_spans": (op3_sentence_spans, None),
    "op4_quality_rules": (op4_quality_rules, quality.QUERY_SQL),
    "op5_secret_scans": (op5_secret_scans, secret_scan.QUERY_SQL),
    "op6_minhash": (op6_minhash, minhash.QUERY_SQL),
    "op7_sentencepiece": (op7_sentencepiece, None),
    "op8_exact_dedup": (op8_exact_dedup, exact_dedup.QUERY_SQL),
    "op9_toxicity": (op9_toxicity, None),
    "op10_suffix_array": (op10_suffix_array, None),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
