"""Scalar functions: text, numbers, hashes, URLs and JSON as columns; Python UDFs where Spark has none."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

# The base-58 alphabet.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def keep_characters(text: Column, allowed: str) -> Column:
    """Only the characters of a class such as ``a-z0-9``."""
    return F.regexp_replace(text, f"[^{allowed}]", "")


def split_first(text: Column, mark: str) -> Column:
    """struct(head, tail) around the first mark; without one the head is all and the tail null."""
    at = F.instr(text, mark)
    head = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    return F.struct(head.alias("head"), F.when(at > 0, F.substring(text, at + len(mark), F.length(text))).alias("tail"))


def split_nonempty(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda x: x != "")


def padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def ranges_to_list(text: Column) -> Column:
    """"1-3,7" as [1, 2, 3, 7]."""
    parts = F.transform(F.split(text, ","), lambda p: F.split(p, "-"))
    return F.flatten(F.transform(parts, lambda p: F.sequence(p[0].cast("int"), F.element_at(p, -1).cast("int"))))


def in_ranges(n: Column, text: Column) -> Column:
    return F.array_contains(ranges_to_list(text), n)


def match_count(text: Column, piece: str) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def truncated(x: Column, digits: int) -> Column:
    scaled = x * 10**digits
    return F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)) / 10**digits


def integer_log2(n: Column) -> Column:
    return (F.length(F.bin(n)) - 1).cast("int")


def is_prime(n: Column) -> Column:
    """By trial division up to the root; for numbers of moderate size."""
    odd = F.sequence(F.lit(2).cast("long"), F.greatest(F.floor(F.sqrt(n.cast("double"))), F.lit(2).cast("long")))
    return (n >= 2) & F.forall(odd, lambda d: (n % d != 0) | (d == n))


def fibonacci(n: Column) -> Column:
    step = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.struct(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b")), lambda s, _: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).alias("b")))
    return F.when(n <= 0, F.lit(0).cast("long")).otherwise(step["a"])


def next_random(seed: Column) -> Column:
    """One step of the minimal-standard generator."""
    return F.pmod(seed.cast("long") * 16807, F.lit(2147483647).cast("long"))


def matrix_power(a: Column, b: Column, c: Column, d: Column, n: int) -> Column:
    """struct(a, b, c, d): the n-th power of a 2 by 2 matrix."""
    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(1.0).alias("d"))

    def times(m: Column, _: Column) -> Column:
        return F.struct((m["a"] * a + m["b"] * c).alias("a"), (m["a"] * b + m["b"] * d).alias("b"), (m["c"] * a + m["d"] * c).alias("c"), (m["c"] * b + m["d"] * d).alias("d"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), one, times) if n > 0 else one


def password(text: Column, key: list[int]) -> Column:
    """A chain of MD5 digests over a text, one for each number of the key; an empty text stays empty."""
    digest = reduce(lambda d, k: F.md5(F.concat(text, F.lit(f" {k} "), d).cast("binary")), key, F.lit("none"))
    return F.when(text == "", F.lit("")).otherwise(digest)


def double_hash(k: Column, buckets: int, probe: Column) -> Column:
    """The bucket of the ``probe``-th attempt at a hash value; ``buckets`` is prime."""
    return ((k % buckets) + probe * (1 + k % (buckets - 1))) % buckets


def json_equal(a: Column, b: Column) -> Column:
    """Whether two JSON values are the same, members in any order at any depth; 1 and "1" differ."""
    return F.to_json(F.parse_json(a)) == F.to_json(F.parse_json(b))


def _members(text: Column, name: str) -> Column:
    """A JSON object's members but ``name``, each of its own type."""
    return F.map_filter(F.from_json(text, "map<string,variant>"), lambda k, _: k != name)


def json_get(text: Column, *path: str | int) -> Column:
    """The value at a path of member names and positions, as JSON; null if there is none."""
    at = "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)
    return F.to_json(F.try_variant_get(F.parse_json(text), f"${at}", "variant"))


def json_without(text: Column, name: str) -> Column:
    return F.to_json(_members(text, name))


def json_with(text: Column, name: str, value: Column) -> Column:
    """An object with a member set to a value, of whatever type; use ``parse_json`` for a nested one."""
    return F.to_json(F.map_concat(_members(text, name), F.create_map(F.lit(name), value.cast("variant"))))


def url_parts(url: Column) -> Column:
    return F.struct(*(F.parse_url(url, F.lit(p.upper())).alias(p) for p in ("protocol", "host", "path", "query")))


def _parameters(text: Column, mark: str) -> Column:
    """(name, value) in order; a name without a value has the empty one."""
    pairs = F.transform(F.filter(F.split(text, mark), lambda x: x != ""), lambda x: F.split(x, "=", 2))
    return F.transform(pairs, lambda p: F.struct(F.url_decode(p[0]).alias("name"), F.url_decode(F.coalesce(F.try_element_at(p, F.lit(2)), F.lit(""))).alias("value")))


def _last_of_each(entries: Column) -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(entries, empty, lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["name"]), F.create_map(e["name"], e["value"])))


def query_map(query: Column) -> Column:
    """A query string's parameters; the last of a repeated name counts."""
    return _last_of_each(_parameters(query, "&"))


def query_values(query: Column, name: str) -> Column:
    """All values of a parameter, in order."""
    return F.transform(F.filter(_parameters(query, "&"), lambda e: e["name"] == name), lambda e: e["value"])


def cookies(header: Column) -> Column:
    """A Cookie header's values; the last of a repeated name counts."""
    return _last_of_each(_parameters(header, r";\s*"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def byte_range(header: Column, size: Column) -> Column:
    """struct(first, last) of a ``bytes=`` range in a body of ``size`` bytes, the last byte included; null if it can't be met."""

    def number(digits: Column) -> Column:
        return F.when(F.length(digits).between(1, 18), digits.cast("long"))

    def ends(spec: Column) -> Column:
        return F.struct(number(F.substring_index(spec, "-", 1)).alias("first"), number(F.substring_index(spec, "-", -1)).alias("last"), size.alias("size"))

    def met(x: Column) -> Column:
        first, last, full = x["first"], x["last"], x["size"]
        begin = F.when(first.isNull(), F.greatest(full - last, F.lit(0))).otherwise(first)
        end = F.when(first.isNull() | last.isNull() | (last >= full), full - 1).otherwise(last)
        return F.when((begin <= end) & (begin < full), F.struct(begin.alias("first"), end.alias("last")))

    return _let(F.regexp_extract(header, r"^bytes=(\d*-\d*)$", 1), lambda spec: _let(ends(spec), met))


def http_date(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with ``<!--{#name/}-->`` marks, filled with columns; nulls are empty."""
    import re

    parts = re.split(r"<!--\{#(\w+)/\}-->", template)
    return F.concat(*(F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def xor_bytes(a: Column, b: Column) -> Column:
    return _xor(a, b)


@F.pandas_udf(BinaryType())
def _xor(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else bytes(p ^ y[i % len(y)] for i, p in enumerate(x)) if y else x for x, y in zip(a, b, strict=True)])


@F.pandas_udf(StringType())
def base58_encode(data: pd.Series) -> pd.Series:
    def one(x: bytes | None) -> str | None:
        if x is None:
            return None
        n, out = int.from_bytes(x, "big"), ""
        while n:
            n, r = divmod(n, 58)
            out = BASE58[r] + out
        return BASE58[0] * (len(x) - len(x.lstrip(b"\0"))) + out

    return data.map(one)


@F.pandas_udf(BinaryType())
def base58_decode(text: pd.Series) -> pd.Series:
    def one(x: str | None) -> bytes | None:
        if x is None:
            return None
        n = 0
        for c in x:
            n = n * 58 + BASE58.index(c)
        zeros = len(x) - len(x.lstrip(BASE58[0]))
        return b"\0" * zeros + n.to_bytes((n.bit_length() + 7) // 8, "big")

    return text.map(one)


# Plain UDFs: whole texts pass a worker in batches of 100 (Spark's default), where an Arrow batch holds 10,000 of them, or 64 MB, several times over.
@F.udf(BinaryType(), useArrow=False)
def deflate(data: bytes | None) -> bytes | None:
    return None if data is None else zlib.compress(data, 6)


@F.udf(BinaryType(), useArrow=False)
def inflate(data: bytes | None) -> bytes | None:
    return None if data is None else zlib.decompress(data)


@F.udf(BinaryType(), useArrow=False)
def gzipped(data: bytes | None) -> bytes | None:
    return None if data is None else gzip.compress(data, 6, mtime=0)


@F.udf(BinaryType(), useArrow=False)
def gunzipped(data: bytes | None) -> bytes | None:
    return None if data is None else gzip.decompress(data)


def fold_until(values: Column, zero: Column, step: Callable[[Column, Column], Column], stop: Callable[[Column], Column]) -> Column:
    """An array folded from the left, until ``stop`` is true of what has been folded so far."""
    begin = F.struct(zero.alias("acc"), F.coalesce(stop(zero), F.lit(False)).alias("over"))

    def one(state: Column, x: Column) -> Column:
        acc = F.when(state["over"], state["acc"]).otherwise(step(state["acc"], x))
        return F.struct(acc.alias("acc"), F.coalesce(state["over"] | stop(acc), F.lit(False)).alias("over"))

    return F.aggregate(values, begin, one, lambda state: state["acc"])


def get_column(value: Column, column: int | list[int]) -> Column:
    """A field of a row of values by its place from 1; 0 is the row itself, a list gives several fields."""
    if isinstance(column, list):
        return F.array(*[F.element_at(value, i) for i in column])
    return F.element_at(value, column) if column else value


def set_column(value: Column, column: int | list[int], new: Column | list[Column]) -> Column:
    """A row of values with fields replaced, at a place from 1 or at several; 0 replaces the row."""
    if column == 0:
        return new
    columns, news = (column, new) if isinstance(column, list) else ([column], [new])
    replaced = dict(zip(columns, news, strict=True))

    def field(old: Column, at: Column) -> Column:
        return reduce(lambda rest, i: F.when(at == i - 1, replaced[i]).otherwise(rest), replaced, old)

    return F.transform(value, field)
