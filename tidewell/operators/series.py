"""Series: differences of samples, interpolation, cycles and calendar matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sample_difference(first: DataFrame, last: DataFrame, key: str, value: str) -> DataFrame:
    """last - first by key; a key of one sample only keeps its value."""
    a, b = first.select(key, F.col(value).alias("__a")), last.select(key, F.col(value).alias("__b"))
    change = F.when(F.col("__a").isNull(), F.col("__b")).when(F.col("__b").isNull(), F.col("__a")).otherwise(F.col("__b") - F.col("__a"))
    return a.join(b, key, "full").select(key, change.alias(value))


def steps(df: DataFrame, series: str, order: str, value: str) -> DataFrame:
    """Each row's change against the one before it in its series."""
    return df.withColumn("change", F.col(value) - F.lag(value).over(W.partitionBy(series).orderBy(order)))


def segments(points: DataFrame, series: str, time: str, value: str) -> DataFrame:
    """Consecutive points as (series, t0, t1, v0, v1) with the outer neighbours' values."""
    w = W.partitionBy(series).orderBy(time)
    out = points.select(
        series, F.col(time).alias("t0"), F.lead(time).over(w).alias("t1"), F.col(value).alias("v0"), F.lead(value).over(w).alias("v1"),
        F.lag(value).over(w).alias("before"), F.lead(value, 2).over(w).alias("after"),
    )
    return out.filter("t1 IS NOT NULL").select(series, "t0", "t1", "v0", "v1", F.coalesce("before", "v0").alias("before"), F.coalesce("after", "v1").alias("after"))


def linear(v0: Column, v1: Column, t: Column) -> Column:
    return v0 + (v1 - v0) * t


def hermite(v0: Column, v1: Column, m0: Column, m1: Column, t: Column) -> Column:
    t2, t3 = t * t, t * t * t
    return (2 * t3 - 3 * t2 + 1) * v0 + (t3 - 2 * t2 + t) * m0 + (-2 * t3 + 3 * t2) * v1 + (t3 - t2) * m1


def catmull_rom(before: Column, v0: Column, v1: Column, after: Column, t: Column) -> Column:
    return hermite(v0, v1, (v1 - before) / 2, (after - v0) / 2, t)


def interpolate(points: DataFrame, at: DataFrame, series: str, time: str, value: str, curve: str = "linear") -> DataFrame:
    """``at`` (series, time) with the value of the curve through ``points``; null outside.

    An as-of join by one sort: points and wanted times are united, and each wanted
    time takes the segment that began last before it.
    """
    seg = segments(points, series, time, value)
    own = seg.select(series, F.col("t0").alias(time), F.struct("t0", "t1", "v0", "v1", "before", "after").alias("__seg"), F.lit(0).alias("__kind"))
    both = own.unionByName(at.select(series, time, F.lit(None).cast(own.schema["__seg"].dataType).alias("__seg"), F.lit(1).alias("__kind")))
    last = F.last("__seg", ignorenulls=True).over(W.partitionBy(series).orderBy(time, "__kind").rowsBetween(W.unboundedPreceding, 0))
    got = both.withColumn("__seg", last).filter("__kind = 1")
    t0, t1, v0, v1, before, after = (F.col(f"__seg.{c}") for c in ("t0", "t1", "v0", "v1", "before", "after"))
    t = (F.col(time) - t0) / (t1 - t0)
    y = linear(v0, v1, t) if curve == "linear" else catmull_rom(before, v0, v1, after, t)
    return got.select(series, time, F.when(F.col(time) <= t1, y).alias(value))


def timeline(items: DataFrame, series: str, order: str | list[str], duration: str) -> DataFrame:
    """Items with the time at which each begins and ends: running sums of durations."""
    by = [order] if isinstance(order, str) else order
    upto = F.sum(duration).over(W.partitionBy(series).orderBy(*by).rowsBetween(W.unboundedPreceding, 0))
    return items.withColumns({"t_to": upto}).withColumn("t_from", F.col("t_to") - F.col(duration))


def in_cycle(time: Column, length: Column) -> Column:
    return F.pmod(time, length)


def week_of_year(date: Column) -> Column:
    """Weeks from the week of January 1st, Monday first; not ISO."""
    first = F.date_trunc("year", date)
    return F.floor((F.dayofyear(date) - 1 + F.weekday(first)) / 7).cast("int") + 1


def week_of_month(date: Column) -> Column:
    first = F.date_trunc("month", date)
    return F.floor((F.dayofmonth(date) - 1 + F.weekday(first)) / 7).cast("int") + 1


_CALENDAR = {
    "y": F.year, "m": F.month, "d": F.dayofmonth, "dy": F.dayofyear, "wy": week_of_year, "w": week_of_month,
    "dw": lambda d: F.weekday(d) + 1, "h": F.hour, "mi": F.minute, "s": F.second,
}


def matches_calendar(ts: Column, rules: dict[str, int | list[int]]) -> Column:
    """Whether a time meets every rule: y, m, d, dy (day of year), wy and w (week of year, of month), dw (1: Monday), h, mi, s."""
    out = F.lit(True)
    for unit, wanted in rules.items():
        out = out & _CALENDAR[unit](ts).isin(wanted if isinstance(wanted, list) else [wanted])
    return out


def strongest_per_day(events: DataFrame, ts: str, level: str) -> DataFrame:
    """Of the events of a day only those of its highest level; days meet as one row each."""
    day = F.to_date(ts)
    best = events.groupBy(day.alias("__day")).agg(F.max(level).alias("__best"))
    return events.join(best, day.eqNullSafe(F.col("__day"))).filter(F.col(level) == F.col("__best")).drop("__day", "__best")
