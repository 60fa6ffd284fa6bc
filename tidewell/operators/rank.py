"""Order statistics: positions in key order, and neighbours of keys.

Ranks over a whole table come from range partitions and their counts (see
``kv.prefix_sums``), so that no task holds all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.kv import prefix_sums


def with_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Dense 1-based positions in a total order."""
    return prefix_sums(df, order, {name: F.lit(1).cast("long")})


def rank_of(df: DataFrame, key: str, value) -> DataFrame:
    """The 1-based position of a key, and whether it is there; an absent key has the place it would take."""
    here = F.col(key) == F.lit(value)
    return df.agg((F.count_if(F.col(key) < F.lit(value)) + 1).alias("rank"), F.coalesce(F.bool_or(here), F.lit(False)).alias("found"))


def ranks_of(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rank_of`` for each row of ``wanted`` (its column has the same name), by one sort of both."""
    marked = df.select(key, F.lit(1).cast("long").alias("__row"), F.lit(1).alias("__is_row")).unionByName(wanted.select(key).distinct().select(key, F.lit(0).cast("long").alias("__row"), F.lit(0).alias("__is_row")))
    summed = prefix_sums(marked, [key, "__is_row"], {"__before": F.col("__row")})
    present = df.select(key).distinct().withColumn("found", F.lit(True))
    out = summed.filter("__is_row = 0").select(key, (F.col("__before") + 1).alias("rank")).join(present, key, "left")
    return out.withColumn("found", F.coalesce("found", F.lit(False)))


def by_rank(df: DataFrame, key: str, n: int) -> DataFrame:
    """The row at position ``n``; none if there are fewer rows."""
    return with_rank(df, [key]).filter(F.col("rank") == n).drop("rank")


def neighbours(df: DataFrame, key: str, value) -> DataFrame:
    """The largest key below and the smallest above ``value``."""
    c = F.col(key)
    return df.agg(F.max(F.when(c < F.lit(value), c)).alias("prev"), F.min(F.when(c > F.lit(value), c)).alias("next"))


def ends(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.min(key).alias("first"), F.max(key).alias("last"))


def without_smallest(df: DataFrame, key: str) -> DataFrame:
    least = df.agg(F.min(key).alias("__least"))
    return df.join(F.broadcast(least), F.col(key) > F.col("__least")).drop("__least")


def without_largest(df: DataFrame, key: str) -> DataFrame:
    most = df.agg(F.max(key).alias("__most"))
    return df.join(F.broadcast(most), F.col(key) < F.col("__most")).drop("__most")


def top(df: DataFrame, by: str, n: int, distinct_values: bool = False) -> DataFrame:
    """The ``n`` rows with the largest values; optionally one row (the least others) for each value."""
    if distinct_values:
        rest = [c for c in df.columns if c != by]
        df = df.groupBy(by).agg(F.min(F.struct(*rest)).alias("r")).select(by, "r.*").select(df.columns)
    return df.orderBy(F.col(by).desc(), *[c for c in df.columns if c != by]).limit(n)


def least_loaded(loads: DataFrame, burden: str, divisor: int, n: int) -> DataFrame:
    """The ``n`` rows of the least load class (``burden`` div ``divisor``) and all that tie with the last of them."""
    load = F.floor(F.col(burden) / divisor).cast("long")
    limit = loads.select(load.alias("load")).orderBy("load").limit(n).agg(F.max("load").alias("__limit"))
    return loads.withColumn("load", load).join(F.broadcast(limit), F.col("load") <= F.col("__limit")).drop("__limit")


def choose(candidates: DataFrame, key: str, seed: int) -> DataFrame:
    """One row of the candidates, decided by ``seed``."""
    return candidates.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(1)
