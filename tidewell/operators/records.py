"""Queries, updates and deletions of attribute records.

A condition is a tuple over a wide frame with an ``id``: (attribute, operator, ...)
or (attribute, value) for equality; a list holds if all its conditions do. An absent
attribute (null) makes every condition on its value false, ``has`` and ``lacks``
apart.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VALUE_TESTS: dict[str, Callable[..., Column]] = {
    "=": lambda c, a: c == a,
    "!=": lambda c, a: c != a,
    ">": lambda c, a: c > a,
    ">=": lambda c, a: c >= a,
    "<": lambda c, a: c < a,
    "<=": lambda c, a: c <= a,
    "between": lambda c, a, b: c.between(a, b),
    "outside": lambda c, a, b: (c < a) | (c > b),
    "in": lambda c, items: c.isin(list(items)),
    "out": lambda c, items: ~c.isin(list(items)),
    "member": lambda c, a: F.array_contains(c, a),
    "notmember": lambda c, a: ~F.array_contains(c, a),
    "test": lambda c, f: f(c),
}


def condition(rule) -> Column:
    """A rule, or a list of rules that must all hold, as a column that is never null."""
    if isinstance(rule, list):
        return reduce(Column.__and__, map(condition, rule), F.lit(True))
    name, *rest = rule
    column = F.col(name)
    if len(rest) == 1 and rest[0] in ("has", "lacks"):
        return column.isNotNull() if rest[0] == "has" else column.isNull()
    op, args = (rest[0], rest[1:]) if len(rest) > 1 else ("=", rest)
    return F.coalesce(_VALUE_TESTS[op](column, *args), F.lit(False))


def select(records: DataFrame, rules: list, order: tuple | None = None) -> DataFrame:
    """Records that meet ``rules``; ``order`` = (attribute, v1, v2, limit) keeps the first of a closed range.

    The range runs down if v1 > v2; ties go by id.
    """
    found = records.filter(condition(rules))
    if order is None:
        return found
    name, a, b, limit = order
    up = a <= b
    ranged = found.filter(F.col(name).between(min(a, b), max(a, b)))
    return ranged.orderBy(F.col(name).asc() if up else F.col(name).desc(), "id").limit(limit)


def restrict(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("id").distinct(), "id", "left_semi")


def update(records: DataFrame, rules: list, changes: dict[str, tuple]) -> DataFrame:
    """All records after ``changes`` to those that meet ``rules``, with ``diff``.

    A change is ("set", v), ("drop",), ("+", v), ("-", v), ("*", v), ("/", v) or ("apply", f).
    Arithmetic leaves an absent attribute absent. ``diff`` lists what changed: key,
    kind (insert, modify, delete) and the old and new value as text.
    """
    hit = condition(rules)
    made: dict[str, Column] = {}
    for name, (op, *arg) in changes.items():
        c = F.col(name)
        new = {
            "set": lambda c=c, a=arg: F.lit(a[0]),
            "drop": lambda c=c: F.lit(None),
            "+": lambda c=c, a=arg: c + a[0],
            "-": lambda c=c, a=arg: c - a[0],
            "*": lambda c=c, a=arg: c * a[0],
            "/": lambda c=c, a=arg: c / a[0],
            "apply": lambda c=c, a=arg: a[0](c),
        }[op]()
        made[name] = F.when(hit, new).otherwise(c).cast(records.schema[name].dataType)
    parts = []
    for name, new in made.items():
        old = F.col(name)
        kind = F.when(old.isNull() & new.isNotNull(), "insert").when(old.isNotNull() & new.isNull(), "delete").when(old != new, "modify")
        parts.append(F.when(kind.isNotNull(), F.struct(F.lit(name).alias("key"), kind.alias("kind"), old.cast("string").alias("old"), new.cast("string").alias("new"))))
    diff = F.array_compact(F.array(*parts))
    return records.select(*(made[c].alias(c) if c in made else F.col(c) for c in records.columns), diff.alias("diff"))


def delete(records: DataFrame, rules: list) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes)."""
    hit = condition(rules)
    return records.filter(~hit), records.filter(hit)


def insert(records: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """``records`` with ``new`` rows under the ids that follow the largest one."""
    from tidewell.operators.merge import numbered

    top = records.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = numbered(new, order).join(F.broadcast(top), F.lit(True)).withColumn("id", F.col("id") + F.col("top")).drop("top")
    return records.unionByName(rows)


def to_attributes(records: DataFrame, names: list[str]) -> DataFrame:
    """Wide records as rows (id, attr, value) of the attributes that are present."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("attr"), F.col(n).cast("string").alias("value")) for n in names)))
    return records.select("id", pairs.alias("p")).select("id", "p.*").filter("value IS NOT NULL")


def from_attributes(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.groupBy("id").pivot("attr", names).agg(F.first("value"))


def with_defaults(df: DataFrame, template: dict, overrides: str) -> DataFrame:
    """Template values, each overridden by the map column ``overrides`` where it has the key."""
    return df.withColumns({k: F.coalesce(F.col(overrides)[k], F.lit(v)) for k, v in template.items()})
