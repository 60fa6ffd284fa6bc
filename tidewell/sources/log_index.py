"""A log index kept on storage: postings, grams and a dictionary, appended in batches and compacted.

``root/<part>/kind=K/n=N/shard=S`` holds Parquet, sorted within files, so that a search
reads the shards of its terms and, of those, the row groups that may hold them. A batch
counts once its dictionary is there, which is written last; a writer that fails leaves
the index as it was. Compaction writes all that counts as one new batch; a reader takes
the newest such batch and what came after it.

Defined results: a posting that a batch repeats counts once; one that two batches hold is
found once, but counted twice in the dictionary until the index is compacted; null tokens
are left out; an empty batch changes nothing.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidewell.operators import search
from tidewell.sources.tables import settle

_COLUMNS = {"postings": "token string, doc_id long", "grams": "gram string, token string", "dictionary": "token string, frequency long"}
SHARDS = 16


def _shard(key: str) -> Column:
    return F.pmod(F.crc32(key), F.lit(SHARDS)).cast("int").alias("shard")


def _read(spark: SparkSession, root: str, part: str) -> DataFrame | None:
    schema = f"{_COLUMNS[part]}, shard int, kind string, n int"
    try:
        return spark.read.schema(schema).option("basePath", f"{root}/{part}").parquet(f"{root}/{part}/kind=*/n=*")
    except AnalysisException:
        return None


def _commits(spark: SparkSession, root: str) -> tuple[int, int]:
    """The newest batch that counts, and the newest compacted one; -1 if there is none. One row, from folder names."""
    rows = _read(spark, root, "dictionary")
    if rows is None:
        return -1, -1
    last, full = rows.agg(F.coalesce(F.max("n"), F.lit(-1)), F.coalesce(F.max(F.when(F.col("kind") == "full", F.col("n"))), F.lit(-1))).first()
    return last, full


def _counting(spark: SparkSession, root: str, part: str) -> DataFrame:
    last, full = _commits(spark, root)
    rows = _read(spark, root, part)
    if rows is None:
        return spark.createDataFrame([], f"{_COLUMNS[part]}, shard int")
    counts = (F.col("n") <= last) & ((F.col("n") > full) | ((F.col("n") == full) & (F.col("kind") == "full")))
    return rows.filter(counts).drop("kind", "n")


def _write(rows: DataFrame, path: str, key: str) -> None:
    """By shard; a shard with a frequent token is split over tasks."""
    dealt = rows.withColumn("shard", _shard(key)).hint("rebalance", "shard").sortWithinPartitions("shard", key)
    dealt.write.mode("overwrite").partitionBy("shard").parquet(path)


def _gram_rows(words: DataFrame) -> DataFrame:
    """(gram, token) of a table that holds each token once, so that no grams need be compared."""
    return words.select(F.explode(search.grams(F.col("token"))).alias("gram"), "token")


def _counted(rows: DataFrame) -> DataFrame:
    return settle(rows.groupBy("token").agg(F.count("*").alias("frequency")), "words")


def append(postings: DataFrame, root: str) -> None:
    """Add a batch of (token, doc_id); tokens that the index knows get no new grams."""
    spark = postings.sparkSession
    n = _commits(spark, root)[0] + 1
    path = f"{root}/postings/kind=batch/n={n}"
    _write(postings.filter("token IS NOT NULL").select("token", F.col("doc_id").cast("long")).distinct(), path, "token")
    words = _counted(spark.read.schema(f"{_COLUMNS['postings']}, shard int").parquet(path))
    unknown = words.join(_counting(spark, root, "dictionary").select("token"), "token", "left_anti")
    _write(_gram_rows(unknown), f"{root}/grams/kind=batch/n={n}", "gram")
    _write(words, f"{root}/dictionary/kind=batch/n={n}", "token")


def compact(spark: SparkSession, root: str) -> None:
    """One new batch of all that counts; the old ones stay until their folders are deleted."""
    n = _commits(spark, root)[0] + 1
    whole = settle(postings(spark, root).distinct(), "postings")
    words = _counted(whole)
    _write(whole, f"{root}/postings/kind=full/n={n}", "token")
    _write(_gram_rows(words), f"{root}/grams/kind=full/n={n}", "gram")
    _write(words, f"{root}/dictionary/kind=full/n={n}", "token")


def postings(spark: SparkSession, root: str, terms: set[str] | None = None) -> DataFrame:
    """(token, doc_id); with ``terms`` only their shards are read."""
    rows = _counting(spark, root, "postings")
    if terms is not None:
        shards = sorted({zlib.crc32(t.encode()) % SHARDS for t in terms})
        rows = rows.filter(F.col("shard").isin(shards) & F.col("token").isin(sorted(terms)))
    return rows.drop("shard")


def grams(spark: SparkSession, root: str) -> DataFrame:
    return _counting(spark, root, "grams").drop("shard")


def dictionary(spark: SparkSession, root: str) -> DataFrame:
    """(token, frequency)."""
    return _counting(spark, root, "dictionary").groupBy("token").agg(F.sum("frequency").alias("frequency"))


def boolean_search(spark: SparkSession, root: str, query) -> DataFrame:
    return search.boolean_search(postings(spark, root, search.terms(query)), query)


def wildcard_search(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return search.wildcard_search(postings(spark, root), grams(spark, root), pattern)
