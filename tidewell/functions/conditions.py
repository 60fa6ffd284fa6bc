"""Conditions and arithmetic as nested tuples, compiled to columns.

("and", [..]), ("or", [..]), ("not", c), (op, a, b) with ``> >= < <= = != + - * / div rem ^``;
a string names a column, anything else is a literal. ``operators`` may replace any of them.
``div`` is whole-number division towards zero, and ``rem`` what it leaves.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b,
    "div": lambda a, b: F.call_function("div", a, b), "rem": lambda a, b: a % b, "^": F.pow,
}


def compiled(tree, operators: dict[str, Callable[[Column, Column], Column]] | None = None) -> Column:
    known = OPERATORS | (operators or {})
    if isinstance(tree, str):
        return F.col(tree)
    if not isinstance(tree, tuple):
        return F.lit(tree)
    op, *args = tree
    if op == "not":
        return ~compiled(args[0], operators)
    if op in ("and", "or"):
        return reduce(Column.__and__ if op == "and" else Column.__or__, [compiled(x, operators) for x in args[0]])
    return known[op](*(compiled(x, operators) for x in args))


def variables(tree) -> set[str]:
    """The columns that a tree names."""
    if isinstance(tree, str):
        return {tree}
    if not isinstance(tree, tuple):
        return set()
    parts = tree[1] if tree[0] in ("and", "or") else tree[1:]
    return set().union(set(), *map(variables, parts))
