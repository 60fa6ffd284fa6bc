"""Versioned key-value tables: rows (key, value, vsn, time), read in key order.

A first write has version 2, each later one adds 1; a missing row reads as the
table's default (or null) with version 0 and time 0. Scans return frames; the
order is part of the result only where a function says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIRST_VERSION = 2
FEW_KEYS = 1000
#: Columns of each kind of result.
RESULTS = {"key": ["key"], "attr": ["key", "vsn", "time"], "value": ["key", "value"], "all": ["key", "value", "vsn", "time"]}


def kv_table(df: DataFrame, key: str, value: str | Column, time: str | Column | None = None) -> DataFrame:
    """A frame as first-version rows; ``time`` is a timestamp, kept as milliseconds."""
    value = F.col(value) if isinstance(value, str) else value
    at = F.unix_millis((F.col(time) if isinstance(time, str) else time).cast("timestamp")) if time is not None else F.lit(0).cast("long")
    return df.select(F.col(key).alias("key"), value.alias("value"), F.lit(FIRST_VERSION).alias("vsn"), at.alias("time"))


def scan(kv: DataFrame, order: str = "ascending", bound: str | None = None, start=None) -> DataFrame:
    """All rows, or those from an ``open`` or ``closed`` start onwards in the given direction."""
    up = order == "ascending"
    key = F.col("key")
    if bound is not None:
        at = F.lit(start)
        kv = kv.filter({(True, "open"): key > at, (True, "closed"): key >= at, (False, "open"): key < at, (False, "closed"): key <= at}[up, bound])
    return kv.orderBy(key.asc() if up else key.desc())


def scan_between(kv: DataFrame, start_bound: str, start, end_bound: str, end) -> DataFrame:
    """Rows between two bounds: ascending if start < end, else descending from start down to end."""
    up = start < end
    low, low_open, high, high_open = (start, start_bound == "open", end, end_bound == "open") if up else (end, end_bound == "open", start, start_bound == "open")
    key = F.col("key")
    inside = (key > F.lit(low) if low_open else key >= F.lit(low)) & (key < F.lit(high) if high_open else key <= F.lit(high))
    return kv.filter(inside).orderBy(key.asc() if up else key.desc())


def result(rows: DataFrame, kind: str) -> DataFrame:
    """One of the five kinds of result: count, key, attr, value, all."""
    return rows.agg(F.count("*").alias("n")) if kind == "count" else rows.select(*RESULTS[kind])


def limited(rows: DataFrame, n: int, order: Column) -> DataFrame:
    """The first ``n`` + 1 rows, as the flagged limit returns them; ``more`` tells if there are more than n."""
    first = rows.orderBy(order).limit(n + 1)
    return first.withColumn("more", F.lit(first.count() > n))


def index_scan(kv: DataFrame, low: tuple, high: tuple, kind: str = "key") -> DataFrame:
    """Rows whose (value, key) pair lies in a closed range, in pair order."""
    pair = F.struct("value", "key")
    rows = kv.filter((pair >= F.struct(F.lit(low[0]).alias("value"), F.lit(low[1]).alias("key"))) & (pair <= F.struct(F.lit(high[0]).alias("value"), F.lit(high[1]).alias("key"))))
    rows = rows.orderBy("value", "key")
    return result(rows, "count") if kind == "count" else rows.select(*(["value", "key"] if kind == "key" else ["value", "key", "vsn", "time"]))


def page(kv: DataFrame, after, size: int) -> DataFrame:
    """The next ``size`` rows of a cursor that last returned the key ``after`` (None: the beginning)."""
    return (kv if after is None else kv.filter(F.col("key") > F.lit(after))).orderBy("key").limit(size).select("key", "vsn", "time")


def read(kv: DataFrame, keys: DataFrame, default=None) -> DataFrame:
    """A row for each row of ``keys`` (key, and others such as its position), missing ones with the default.

    Up to ``FEW_KEYS`` keys are counted and broadcast, so that the table is filtered where it lies.
    """
    hits = kv.withColumn("__found", F.lit(True))
    if len(keys.select("key").head(FEW_KEYS + 1)) <= FEW_KEYS:
        hits = hits.join(F.broadcast(keys.select("key").distinct()), "key", "left_semi")
    got = keys.join(hits, "key", "left")
    value = F.when(F.col("__found"), F.col("value")).otherwise(F.lit(default)) if default is not None else F.col("value")
    return got.select(*keys.columns, value.alias("value"), F.coalesce("vsn", F.lit(0)).alias("vsn"), F.coalesce("time", F.lit(0)).alias("time"))


def read_batch(tables: dict[str, DataFrame], requests: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Answers in request order; ``requests`` has pos, table and key. Each key is read once per table."""
    parts = []
    for name, kv in tables.items():
        wanted = requests.filter(F.col("table") == name)
        once = read(kv, wanted.select("key").distinct(), (defaults or {}).get(name))
        parts.append(wanted.join(once, "key").select("pos", "table", "key", "value", "vsn", "time"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("pos")


def prefix_sums(df: DataFrame, order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with the running sum of each value over a global order.

    Rows are range-partitioned and summed within partitions; only one row per
    partition meets the others, so no task sees the whole table.
    """
    from tidewell.sources.tables import settle

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(df.withColumns({f"__{k}": v for k, v in values.items()}).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("__part").agg(*(F.sum(f"__{k}").alias(f"__t_{k}") for k in values))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    bases = totals.select("__part", *(F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in values))
    here = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = dealt.join(F.broadcast(bases), "__part")
    return own.select(*df.columns, *((F.col(f"__b_{k}") + F.sum(f"__{k}").over(here)).alias(k) for k in values))


def take_while(kv: DataFrame, condition: Column, inclusive: bool = False) -> DataFrame:
    """Rows in key order up to the first that fails; ``inclusive`` keeps that one too.

    The first failing key is one aggregate, so the scan stays a plain filter.
    """
    stop = kv.filter(~F.coalesce(condition, F.lit(False))).agg(F.min("key").alias("__stop"))
    before = F.col("key") <= F.col("__stop") if inclusive else F.col("key") < F.col("__stop")
    return kv.join(F.broadcast(stop), F.col("__stop").isNull() | before).drop("__stop")


def running_filter(kv: DataFrame, amount: Column, limit) -> DataFrame:
    """A filter with state: rows in key order while the running sum of ``amount`` stays within ``limit``."""
    return prefix_sums(kv, ["key"], {"__run": amount}).filter(F.col("__run") <= limit).drop("__run")


def estimate_count(kv: DataFrame, fraction: float, seed: int = 7) -> DataFrame:
    return kv.sample(fraction=fraction, seed=seed).agg(F.round(F.count("*") / fraction).cast("long").alias("estimate"))


def cleared(kv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table without rows, and one row with the number that it had."""
    return kv.filter(F.lit(False)), result(kv, "count")
