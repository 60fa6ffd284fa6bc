"""Set algebra on frames, and comparison of replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): ``both``, ``left`` or ``right``, from one full join."""
    left, right = a.select(key).distinct().withColumn("__l", F.lit(1)), b.select(key).distinct().withColumn("__r", F.lit(1))
    side = F.when(F.col("__l").isNull(), "right").when(F.col("__r").isNull(), "left").otherwise("both")
    return left.join(right, key, "full").select(key, side.alias("side"))


def odd_members(sets: list[DataFrame], key: str) -> DataFrame:
    """Symmetric difference: what lies in an odd number of the sets."""
    every = sets[0].select(key).distinct()
    for s in sets[1:]:
        every = every.unionByName(s.select(key).distinct())
    return every.groupBy(key).agg(F.count("*").alias("n")).filter("n % 2 = 1").select(key)


def digest(kv: DataFrame) -> DataFrame:
    """First key, last key, size and an order-free hash of a table; one partial row per task."""
    return kv.agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("size"), F.expr("bit_xor(xxhash64(key, value, vsn, time))").alias("hash"))


def replica_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (key, state) where replicas differ: missing_left, missing_right, older_left, older_right or unequal."""
    left, right = a.select("key", F.struct("value", "vsn", "time").alias("l")), b.select("key", F.struct("value", "vsn", "time").alias("r"))
    state = (
        F.when(F.col("l").isNull(), "missing_left").when(F.col("r").isNull(), "missing_right")
        .when(F.col("l.vsn") < F.col("r.vsn"), "older_left").when(F.col("l.vsn") > F.col("r.vsn"), "older_right")
        .when(~F.col("l").eqNullSafe(F.col("r")), "unequal")
    )
    return left.join(right, "key", "full").select("key", state.alias("state")).filter("state IS NOT NULL")


def unequal_buckets(a: DataFrame, b: DataFrame, buckets: int) -> DataFrame:
    """Buckets of keys whose digests differ: what a repair must look at."""

    def by_bucket(kv: DataFrame, name: str) -> DataFrame:
        bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
        return kv.groupBy(bucket).agg(F.struct(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(key, value, vsn, time))").alias("h")).alias(name))

    both = by_bucket(a, "l").join(by_bucket(b, "r"), "bucket", "full")
    return both.filter(~F.col("l").eqNullSafe(F.col("r"))).select("bucket")


def repair(a: DataFrame, b: DataFrame, buckets: int) -> DataFrame:
    """The rows both replicas should have: only unequal buckets are merged, latest row first."""
    from tidewell.operators.merge import latest_wins

    bad = unequal_buckets(a, b, buckets)
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    same = a.withColumn("bucket", bucket).join(bad, "bucket", "left_anti").drop("bucket")
    apart = a.unionByName(b).withColumn("bucket", bucket).join(bad, "bucket", "left_semi").drop("bucket")
    return same.unionByName(latest_wins(apart).select(same.columns))


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The common part of two closed intervals as struct(start, end); null if there is none."""
    start, end = F.greatest(a_start, b_start), F.least(a_end, b_end)
    return F.when(start <= end, F.struct(start.alias("start"), end.alias("end")))


def merge_maps(a: Column, b: Column) -> Column:
    """Maps merged; of a common key the first map's value stays."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, y))


def overlap_rests(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Two closed intervals as struct(before, common, after), each null where it is empty.

    ``before`` and ``after`` are what only one of the intervals covers, with open bounds
    towards the common part; intervals that lie apart are whole there, the first in ``before``.
    """
    start, end = F.greatest(a_start, b_start), F.least(a_end, b_end)
    apart = start > end

    def part(a: Column, z: Column, a_closed: Column, z_closed: Column) -> Column:
        return F.struct(a.alias("start"), z.alias("end"), a_closed.alias("start_closed"), z_closed.alias("end_closed"))

    yes, no = F.lit(True), F.lit(False)
    before = F.when(apart, part(a_start, a_end, yes, yes)).when(a_start != b_start, part(F.least(a_start, b_start), start, yes, no))
    common = F.when(~apart, part(start, end, yes, yes))
    after = F.when(apart, part(b_start, b_end, yes, yes)).when(a_end != b_end, part(end, F.greatest(a_end, b_end), no, yes))
    return F.struct(before.alias("before"), common.alias("common"), after.alias("after"))


def digest_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the names of the fields in which the digests of two tables differ, none if they are the same."""
    fields = ["first", "last", "size", "hash"]
    both = digest(a).select(F.struct(*fields).alias("l")).join(F.broadcast(digest(b).select(F.struct(*fields).alias("r"))))
    return both.select(F.array_compact(F.array(*[F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f)) for f in fields])).alias("unequal"))


def split_count(length: Column, parts: Column) -> Column:
    """How many go to each of ``parts``; all of them where there are fewer than parts."""
    return F.when((parts > 0) & (length >= parts), F.floor(length / parts)).otherwise(length).cast("long")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with a ``place`` in an order that ``seed`` alone decides, whatever the partitions."""
    from tidewell.operators.rank import with_rank

    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return with_rank(df.withColumn("__mixed", mixed), ["__mixed", key], "place").drop("__mixed")
