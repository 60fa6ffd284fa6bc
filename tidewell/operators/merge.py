"""Writes of versioned key-value tables as merges: a new frame and a report of conflicts.

A change is (key, value, vsn, time): vsn 0 writes in any case, 1 only inserts, and
any other only replaces a row of that version. A frame is never changed in place;
:mod:`tidewell.sources.snapshots` commits what a merge returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.kv import FIRST_VERSION
from tidewell.sources.tables import settle


def _joined(kv: DataFrame, changes: DataFrame) -> DataFrame:
    """Old rows and changes side by side; of changes that repeat a key the one with the largest time counts."""
    once = changes.groupBy("key").agg(F.max_by(F.struct("value", "vsn", "time"), F.struct("time", "vsn")).alias("new"))
    return kv.select("key", F.struct("value", "vsn", "time").alias("old")).join(once, "key", "full")


_ALLOWED = "coalesce(new.vsn = 0 OR (new.vsn = 1 AND old IS NULL) OR (new.vsn > 1 AND new.vsn = old.vsn), false)"


def write(kv: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after ``changes``; those whose version doesn't match leave their row as it is."""
    both = _joined(kv, changes).withColumn("ok", F.expr(f"new IS NOT NULL AND {_ALLOWED}"))
    vsn = F.coalesce(F.col("old.vsn"), F.lit(FIRST_VERSION - 1)) + 1
    row = F.when(F.col("ok"), F.struct(F.col("new.value").alias("value"), vsn.cast("int").alias("vsn"), F.col("new.time").alias("time"))).otherwise(F.col("old"))
    return both.withColumn("row", row).filter("row IS NOT NULL").select("key", "row.*")


def conflicts(kv: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes that don't apply: key, the version asked for and the row's (0: there is none)."""
    both = _joined(kv, changes).filter(f"new IS NOT NULL AND NOT {_ALLOWED}")
    return both.select("key", F.col("new.vsn").alias("asked"), F.coalesce("old.vsn", F.lit(0)).alias("actual"))


def delete(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """The table without ``keys`` (key, vsn); a vsn other than 0 must match."""
    gone = keys.groupBy("key").agg(F.max("vsn").alias("asked"), F.min("vsn").alias("any"))
    left = kv.join(gone, "key", "left")
    return left.filter("asked IS NULL OR NOT (any = 0 OR asked = vsn)").select(kv.columns)


def not_deleted(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys that can't be deleted: absent ones (actual 0) and those of another version."""
    return keys.join(kv.select("key", F.col("vsn").alias("actual")), "key", "left").filter("actual IS NULL OR (vsn <> 0 AND vsn <> actual)").select("key", F.col("vsn").alias("asked"), F.coalesce("actual", F.lit(0)).alias("actual"))


def restore(kv: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with their own versions and times replace the table's; of one key the latest counts."""
    latest = latest_wins(rows)
    return kv.join(latest.select("key"), "key", "left_anti").unionByName(latest.select(kv.columns))


def invalid_restores(rows: DataFrame) -> DataFrame:
    """Keys that a restore names with different versions."""
    return rows.filter("vsn > 0").groupBy("key").agg(F.count_distinct("vsn").alias("versions")).filter("versions > 1")


def restore_counts(kv: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: how many keys :func:`restore` adds, how many it replaces, and how many it leaves as they are."""
    new = rows.select("key").distinct().withColumn("new", F.lit(True))
    both = kv.select("key", F.lit(True).alias("old")).join(new, "key", "full")
    return both.agg(*(F.count_if(F.expr(c)).alias(n) for n, c in (("added", "old IS NULL"), ("replaced", "old AND new"), ("kept", "new IS NULL"))))


def latest_wins(rows: DataFrame) -> DataFrame:
    """Of the rows of a key the one with the largest version, then time; partial aggregates meet, not rows.

    A tombstone (version 0) counts by its time: it wins over every row that is not newer.
    """
    others = [c for c in rows.columns if c != "key"]
    gone = F.max(F.when(F.col("vsn") == 0, F.col("time")))
    best = rows.groupBy("key").agg(F.max_by(F.struct(*others), F.struct("vsn", "time")).alias("r"), F.max_by(F.struct(*others), F.when(F.col("vsn") == 0, F.col("time"))).alias("t"), gone.alias("gone"))
    return best.select("key", F.when(F.col("gone") >= F.col("r.time"), F.col("t")).otherwise(F.col("r")).alias("r")).select("key", "r.*")


def without_tombstones(rows: DataFrame) -> DataFrame:
    return rows.filter("vsn <> 0")


def transaction(tables: dict[str, DataFrame], change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], check: Callable[[dict[str, DataFrame]], DataFrame] | None = None) -> dict[str, DataFrame]:
    """All or nothing: ``change`` gives each table's changes (key, value, vsn, time; null value deletes).

    With ``check`` the changes apply only if it returns no row; any conflict of
    versions in any table leaves all tables as they are.
    """
    changes = change(tables)
    bad = check is not None and not check(tables).isEmpty()
    bad = bad or any(not conflicts(tables[t], c).isEmpty() for t, c in changes.items())
    if bad:
        return dict(tables)
    out = dict(tables)
    for t, c in changes.items():
        written = write(out[t], c.filter("value IS NOT NULL"))
        out[t] = delete(written, c.filter("value IS NULL").select("key", F.lit(0).alias("vsn")))
    return out


def _overlaid(kv: DataFrame, changes: DataFrame | None) -> DataFrame:
    """The table as a later step sees it: changed values, with the versions that the rows will get."""
    if changes is None:
        return kv
    return delete(write(kv, changes.filter("value IS NOT NULL")), changes.filter("value IS NULL").select("key", "vsn"))


def super_transaction(tables: dict[str, DataFrame], steps: list[Callable[[dict[str, DataFrame]], dict[str, DataFrame] | None]], time: int) -> tuple[dict[str, DataFrame], bool]:
    """Steps in order, all or nothing: the tables after them, and whether they apply.

    A step gets the tables with what earlier steps changed, and gives each table's
    changes (key, value; a null value deletes), or None to break off, which leaves all
    tables as they are. A key that several steps change is written once, with the last
    value; of a key that one step repeats the largest value counts. Each step's changes
    are settled, so that the plan doesn't grow with the steps.
    """
    pending: dict[str, DataFrame] = {}
    for step in steps:
        changes = step({t: _overlaid(kv, pending.get(t)) for t, kv in tables.items()})
        if changes is None:
            return dict(tables), False
        for t, c in changes.items():
            new = c.groupBy("key").agg(F.max("value").alias("value")).select("key", "value", F.lit(0).alias("vsn"), F.lit(time).cast("long").alias("time"))
            pending[t] = settle(pending[t].join(new, "key", "left_anti").unionByName(new) if t in pending else new, "changes")
    return {t: _overlaid(kv, pending.get(t)) for t, kv in tables.items()}, True


def dynamic_write(kv: DataFrame, keys: DataFrame, decide: Callable[[Column, Column, Column], tuple[Column, Column, Column]], now: int) -> tuple[DataFrame, DataFrame]:
    """Write each key of ``keys`` as its own row decides: the table after it, and replies (key, reply, vsn, time).

    ``decide(value, vsn, time)`` gives an action ("update", "delete" or "keep"), the new
    value, and a reply or null. An absent key has no value, the version before the first
    and time 0; deleting it does nothing. Keys that repeat are written once, null keys not.
    """
    asked = keys.select("key").distinct().filter("key IS NOT NULL").withColumn("asked", F.lit(True))
    both = kv.select("key", F.struct("value", "vsn", "time").alias("old")).join(asked, "key", "full")
    vsn, time = F.coalesce("old.vsn", F.lit(FIRST_VERSION - 1)), F.coalesce("old.time", F.lit(0).cast("long"))
    action, value, reply = decide(F.col("old.value"), vsn, time)
    both = both.select("key", "old", F.when(F.col("asked"), action).alias("action"), value.alias("new"), F.when(F.col("asked"), reply).alias("reply"), vsn.alias("vsn"), time.alias("time"))
    updated = F.struct(F.col("new").alias("value"), (F.col("vsn") + 1).cast("int").alias("vsn"), F.lit(now).cast("long").alias("time"))
    row = F.when(F.col("action") == "update", updated).when(F.coalesce("action", F.lit("keep")) != "delete", F.col("old"))
    after = both.withColumn("row", row).filter("row IS NOT NULL").select("key", "row.*")
    stamp = F.when(F.col("action") == "update", F.struct((F.col("vsn") + 1).alias("vsn"), F.lit(now).cast("long").alias("time"))).otherwise(F.struct("vsn", "time"))
    replies = both.filter("reply IS NOT NULL").select("key", "reply", stamp.alias("s")).select("key", "reply", F.col("s.vsn").cast("int").alias("vsn"), "s.time")
    return after, replies


def numbered(df: DataFrame, order: list[str], start: int = 1) -> DataFrame:
    """``df`` with dense unique numbers from ``start`` in the given order, in column ``id``."""
    from tidewell.operators.kv import prefix_sums

    return prefix_sums(df, order, {"id": F.lit(1).cast("long")}).withColumn("id", F.col("id") + (start - 1))
