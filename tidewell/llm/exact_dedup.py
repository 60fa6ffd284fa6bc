"""Exact deduplication by salted digest groups that compare whole texts at every stage.

Texts are equal when identical after lower-casing A-Z only. Three stages: each
Arrow batch keeps one row per text (local), digest groups merge under a salt,
and the winners of the salts merge globally. Every stage groups by digest *and*
text, so a digest alone never decides. A hot text reaches the shuffle as one
row per batch, and those rows are spread over the salts.

Defined results: a null text is the empty string; an empty table gives an empty
table; a null doc_id loses against any other; of rows that repeat both text and
doc_id every one carries the same flags, and :func:`drop_duplicates` keeps any one
of them; columns other than doc_id and text are never read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from tidewell.llm.text import map_arrow
from tidewell.sources.tables import settle

SALTS = 16
DIGEST, NORM = "__tidewell_digest", "__tidewell_norm"
Digest = Callable[[bytes], bytes]


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _lowered(batch: pa.RecordBatch, digest: Digest) -> tuple[pa.Array, list[bytes]]:
    texts = pc.ascii_lower(pc.fill_null(batch.column("text").cast(pa.string()), ""))
    return texts, [digest(x) for x in texts.cast(pa.binary()).to_pylist()]


def _digests(batches: Iterator[pa.RecordBatch], digest: Digest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_lowered(batch, digest)[1], pa.binary())], ["doc_id", "digest"])


def _local_winners(batches: Iterator[pa.RecordBatch], digest: Digest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lowered, digests = _lowered(batch, digest)
        best: dict[tuple[bytes, str], list] = {}
        for doc_id, key, text in zip(batch.column("doc_id").to_pylist(), digests, lowered.to_pylist(), strict=True):
            seen = best.setdefault((key, text), [None, 0])
            seen[1] += 1
            if doc_id is not None and (seen[0] is None or doc_id > seen[0]):
                seen[0] = doc_id
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in best], pa.binary()),
                pa.array([k[1] for k in best], pa.string()),
                pa.array([v[0] for v in best.values()], pa.int64()),
                pa.array([v[1] for v in best.values()], pa.int64()),
            ],
            ["digest", "norm", "keep_id", "n"],
        )


def duplicate_groups(docs: DataFrame, salts: int = SALTS, digest: Digest = sha256) -> DataFrame:
    """One row per distinct text: digest, norm, keep_id, group_size."""
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    local = map_arrow(narrow, partial(_local_winners, digest=digest), "digest binary, norm string, keep_id long, n long")
    salted = local.groupBy("digest", "norm", (F.spark_partition_id() % salts).alias("salt")).agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    return salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def _by_digest(groups: DataFrame) -> DataFrame:
    """One settled row per digest: keep_id and group_size of its text, and how many texts it has."""
    return settle(groups.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("n_texts")), "digests")


def mark_duplicates(docs: DataFrame, salts: int = SALTS, digest: Digest = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = duplicate_groups(docs, salts, digest)
    by_digest = _by_digest(groups)
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    rows = map_arrow(narrow, partial(_digests, digest=digest), "doc_id long, digest binary").join(by_digest, "digest").drop("n_texts")
    clash = by_digest.filter("n_texts > 1").select("digest")
    if not clash.isEmpty():  # different texts under one digest: the text decides
        by_text = map_arrow(narrow, partial(_with_text, digest=digest), "doc_id long, digest binary, norm string").join(clash, "digest", "left_semi")
        rows = rows.join(clash, "digest", "left_anti").unionByName(by_text.join(groups, ["digest", "norm"]).drop("norm"))
    return rows.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _with_text(batches: Iterator[pa.RecordBatch], digest: Digest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lowered, digests = _lowered(batch, digest)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), lowered], ["doc_id", "digest", "norm"])


def _tagged(batches: Iterator[pa.RecordBatch], digest: Digest, schema: StructType) -> Iterator[pa.RecordBatch]:
    """Whole rows with their digest and, if the schema has it, their text; of rows of a batch that repeat text and doc_id one."""
    for batch in batches:
        lowered, digests = _lowered(batch, digest)
        first: dict[tuple, int] = {}
        for k, key in enumerate(zip(batch.column("doc_id").to_pylist(), digests, lowered.to_pylist(), strict=True)):
            first.setdefault(key, k)
        tags = {DIGEST: pa.array(digests, pa.binary()), NORM: lowered}
        columns = [tags.get(name, batch.column(i) if i < batch.num_columns else None) for i, name in enumerate(schema.names)]
        yield pa.RecordBatch.from_arrays(columns, schema.names).take(pa.array(list(first.values()), pa.int64()))


def drop_duplicates(docs: DataFrame, salts: int = SALTS, digest: Digest = sha256) -> DataFrame:
    """One row of each text, with all its columns: a row whose doc_id is the largest of the text's."""
    groups = duplicate_groups(docs, salts, digest)
    by_digest = _by_digest(groups)
    clash = not by_digest.filter("n_texts > 1").isEmpty()
    keys = [DIGEST, NORM] if clash else [DIGEST]
    schema = StructType([*docs.schema.fields, StructField(DIGEST, BinaryType()), *([StructField(NORM, StringType())] if clash else [])])
    rows = map_arrow(docs, partial(_tagged, digest=digest, schema=schema), schema)
    keep = (groups if clash else by_digest).select(F.col("digest").alias("__tidewell_d"), F.col("keep_id").alias("__tidewell_id"), *([F.col("norm").alias("__tidewell_t")] if clash else []))
    same = (F.col(DIGEST) == F.col("__tidewell_d")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__tidewell_id"))
    winners = rows.join(keep, same & (F.col(NORM) == F.col("__tidewell_t")) if clash else same, "left_semi")
    return winners.dropDuplicates(keys).select(*docs.columns)


QUERY_SQL = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""
