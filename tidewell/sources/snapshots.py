"""Key-value tables on storage: a full snapshot, increments after it, and a pointer to what counts.

``root/snapshot=N`` and ``root/increment=N`` hold Parquet; a reader takes the largest
snapshot and the increments after it, and of each key its latest row. A tombstone is a
row of version 0. Commits only add folders, so a failed writer leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidewell.operators.merge import latest_wins


def _state(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", "false").option("basePath", root).parquet(f"{root}/kind=*/")
    except AnalysisException:
        return None


def _next(spark: SparkSession, root: str) -> int:
    at = _state(spark, root)
    return 0 if at is None else 1 + (at.agg(F.max("n")).first()[0] or 0)


def snapshot(rows: DataFrame, root: str) -> int:
    """Write all rows as the table's newest full state."""
    n = _next(rows.sparkSession, root)
    rows.write.parquet(f"{root}/kind=snapshot/n={n}")
    return n


def increment(rows: DataFrame, root: str) -> int:
    """Add changed rows; version 0 marks a deleted key."""
    n = _next(rows.sparkSession, root)
    rows.write.parquet(f"{root}/kind=increment/n={n}")
    return n


def load(spark: SparkSession, root: str, as_of: int | None = None) -> DataFrame:
    """The table's rows after the newest (or the ``as_of``-th) commit; partition pruning skips older ones."""
    at = _state(spark, root)
    if as_of is not None:
        at = at.filter(F.col("n") <= as_of)
    full = at.filter("kind = 'snapshot'").agg(F.max("n")).first()[0]
    rows = at if full is None else at.filter((F.col("n") > full) | ((F.col("n") == full) & (F.col("kind") == "snapshot")))
    return latest_wins(rows.drop("kind", "n")).filter("vsn <> 0")


def changed_since(rows: DataFrame, time: int) -> DataFrame:
    """The rows that an increment after ``time`` (milliseconds) holds."""
    return rows.filter(F.col("time") > time)


def compact(spark: SparkSession, root: str) -> int:
    """A new full snapshot of the present state."""
    return snapshot(load(spark, root), root)
