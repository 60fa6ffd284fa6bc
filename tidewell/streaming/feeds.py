"""Streams: change feeds of key-value tables, indexed logs, sessions and metric windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators import merge, search
from tidewell.sources import snapshots


def change_events(old: DataFrame, new: DataFrame, table: str) -> DataFrame:
    """What turned ``old`` into ``new``: rows (table, op, key, value, vsn, time) with op insert, update or delete."""
    a, b = old.select("key", F.struct("value", "vsn", "time").alias("a")), new.select("key", F.struct("value", "vsn", "time").alias("b"))
    op = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").when(~F.col("a").eqNullSafe(F.col("b")), "update")
    rows = a.join(b, "key", "full").withColumn("op", op).filter("op IS NOT NULL")
    return rows.select(F.lit(table).alias("table"), "op", "key", F.coalesce("b", "a").alias("r")).select("table", "op", "key", "r.*")


def apply_changes(changes: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Commit each micro-batch of change events as one increment; a delete becomes a tombstone."""

    def commit(batch: DataFrame, _: int) -> None:
        rows = batch.select("key", "value", F.when(F.col("op") == "delete", 0).otherwise(F.col("vsn")).cast("int").alias("vsn"), "time")
        if not rows.isEmpty():
            snapshots.increment(merge.latest_wins(rows), root)

    return changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dispatch(events: DataFrame, handlers: dict[tuple[str, str], Callable[[DataFrame], None]], checkpoint: str) -> StreamingQuery:
    """Give each micro-batch's events of a (source, type) to its handler."""

    def handle(batch: DataFrame, _: int) -> None:
        for (source, kind), f in handlers.items():
            f(batch.filter((F.col("source") == source) & (F.col("type") == kind)))

    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_logs(logs: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Append messages and their postings by ISO week, so that a time range prunes folders."""

    def write(batch: DataFrame, n: int) -> None:
        rows = search.with_weeks(batch)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("iso_year", "iso_week").parquet(f"{root}/batch={n}/messages")
        weeks = rows.select("doc_id", "iso_year", "iso_week")
        search.entry_tokens(batch).join(weeks, "doc_id").write.mode("overwrite").partitionBy("iso_year", "iso_week").parquet(f"{root}/batch={n}/postings")

    return logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_attributes(updates: DataFrame) -> DataFrame:
    """A session's attributes, each with its highest version's value: a streaming aggregate (complete or update mode)."""
    return updates.groupBy("session", "attr").agg(F.max_by("value", F.struct("vsn", "time")).alias("value"), F.max("vsn").alias("vsn"))


def metric_windows(samples: DataFrame, ts: str, length: str, late: str) -> DataFrame:
    """Counts and sums by key and tumbling window; a window closes ``late`` after its end."""
    return samples.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), "key").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "key", "n", "total")


def expired(messages: DataFrame, minutes_per_file: int, files: int, ts: str = "ts") -> DataFrame:
    """The windows (of ``minutes_per_file`` minutes) that a log of at most ``files`` windows no longer keeps."""
    window = F.floor(F.unix_seconds(F.col(ts)) / (60 * minutes_per_file)).alias("window_id")
    found = messages.select(window).distinct()
    kept = found.orderBy(F.col("window_id").desc()).limit(files)
    return found.join(kept, "window_id", "left_anti")
