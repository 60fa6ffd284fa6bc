"""Folders and files as frames: listings, contents with checksums, differences and feeds of new files.

Spark's reader gives no row for a file of no bytes, so empty files are in none of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FILE = "path string, modificationTime timestamp, length long, content binary"


def _named(files: DataFrame) -> DataFrame:
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumnRenamed("modificationTime", "modified")


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, length, modified) of the files below a folder whose names match; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return _named(files).select("path", "name", "length", "modified")


def contents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``listing`` with each file's bytes and their CRC-32; for files of up to 2 GB, each in one row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return _named(files).select("path", "name", "length", "modified", F.crc32("content").alias("crc32"), "content")


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two listings: added, removed, or changed in length, time or checksum."""
    same = [c for c in ("length", "modified", "crc32") if c in old.columns and c in new.columns]
    a, b = (x.select("path", F.struct(*same).alias(name)) for x, name in ((old, "a"), (new, "b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).filter("change IS NOT NULL")


def arrivals(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of the files that come into a folder: (path, name, length, modified, content)."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", pattern).load(folder)
    return _named(files).select("path", "name", "length", "modified", "content")
