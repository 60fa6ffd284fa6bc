"""Log search: tokens, postings, a 3-gram dictionary, and Boolean, wildcard and time-range retrieval.

Postings stay exploded rows (token, doc_id, place), so a frequent token is many rows
and never one array; arrays are built only for output. A Boolean query is nested
tuples ("and", a, b), ("or", a, b), ("xor", a, b) over tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WILDCARD = "$"
# The system fields of a log entry.
SYSTEM_FIELDS = ["$time", "$level", "$src", "$mod", "$code", "$type"]


def tokens(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(token, doc_id, place) of the words of a text, places from 0."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\r\n]+"), lambda x: x != "")
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(words).alias("place", "token")).select("token", "doc_id", "place")


def words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(token, doc_id) of the different words of a text."""
    found = F.array_distinct(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\r\n]+"))
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(found).alias("token")).filter("token <> ''").select("token", "doc_id")


def entry_words(data: Column) -> Column:
    """The tokens of a log's map: of a system field its value, the time (milliseconds) in whole minutes; of any other both key and value.

    A time that is no positive number and system fields without a value give none.
    """
    times = F.filter(F.map_entries(data), lambda e: e["key"] == "$time")
    minutes = F.transform(times, lambda e: F.when(e["value"].try_cast("long") > 0, F.floor(e["value"].try_cast("long") / 60000).cast("string")))
    system = F.filter(F.map_values(F.map_filter(data, lambda k, _: k.isin([f for f in SYSTEM_FIELDS if f != "$time"]))), lambda v: v != "")
    others = F.map_filter(data, lambda k, _: ~k.isin(SYSTEM_FIELDS))
    return F.concat(minutes, system, F.map_keys(others), F.map_values(others))


def entry_tokens(logs: DataFrame, data: str = "data", tokenizer: Callable[[Column], Column] = entry_words, linguistics: Callable[[Column], Column] | None = None) -> DataFrame:
    """(token, doc_id) of logs: ``tokenizer`` turns a map into tokens, ``linguistics`` a token into another, or into null to drop it."""
    words = tokenizer(F.col(data))
    if linguistics:
        words = F.transform(words, linguistics)
    return logs.select(F.explode(words).alias("token"), "doc_id").filter("token IS NOT NULL").distinct()


def dictionary(postings: DataFrame, shards: int = 2, mapping: Callable[[Column], Column] = F.crc32) -> DataFrame:
    """(token, frequency, shard); ``mapping`` gives the number that decides a token's shard."""
    return postings.groupBy("token").agg(F.count("*").alias("frequency")).withColumn("shard", F.pmod(mapping(F.col("token")), F.lit(shards)))


def posting_lists(postings: DataFrame) -> DataFrame:
    """(token, docs) with sorted distinct documents; for output."""
    return postings.select("token", "doc_id").distinct().groupBy("token").agg(F.array_sort(F.collect_list("doc_id")).alias("docs"))


def posting_chunks(postings: DataFrame, width: int = 10_000) -> DataFrame:
    """(token, chunk, docs): sorted distinct documents by ranges of ``width`` ids, so that no list of a frequent token outgrows a row.

    Postings meet once, by token and chunk, and copies go there.
    """
    chunk = F.floor(F.col("doc_id") / width).alias("chunk")
    met = postings.select("token", "doc_id", chunk).repartition("token", "chunk")
    return met.groupBy("token", "chunk").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))


def grams(word: Column, n: int = 3) -> Column:
    """The distinct n-grams of ``$word$``."""
    full = F.concat(F.lit(WILDCARD), word, F.lit(WILDCARD))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(full) - (n - 1), F.lit(1))), lambda i: F.substring(full, i, F.lit(n))))


def gram_index(words: DataFrame) -> DataFrame:
    """(gram, token) for every distinct token."""
    return words.select("token").distinct().select(F.explode(grams(F.col("token"))).alias("gram"), "token")


def matching_tokens(index: DataFrame, pattern: str) -> DataFrame:
    """Tokens that match a pattern with ``$`` for any run of characters.

    Grams of the fixed pieces choose candidates from the index; the pieces then decide.
    """
    pieces = pattern.split(WILDCARD)
    full = f"{WILDCARD if pieces[0] else ''}{pattern}{WILDCARD if pieces[-1] else ''}"
    wanted: set[str] = set()
    anchored = [f"{WILDCARD}{pieces[0]}" if pieces[0] else "", *pieces[1:-1], f"{pieces[-1]}{WILDCARD}" if pieces[-1] else ""] if len(pieces) > 1 else [full]
    for piece in anchored:
        wanted |= {piece[i : i + 3] for i in range(len(piece) - 2)}
    if wanted:
        hits = index.filter(F.col("gram").isin(sorted(wanted))).groupBy("token").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(wanted)).select("token")
    else:
        hits = index.select("token").distinct()
    return hits.filter(F.col("token").like("%".join(p.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") for p in pieces)))


def terms(query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(terms, query[1:]))


def boolean_search(postings: DataFrame, query) -> DataFrame:
    """doc_ids that satisfy a Boolean query: one pass over the postings of its terms."""
    names = {t: f"t{i}" for i, t in enumerate(sorted(terms(query)))}

    def holds(q) -> Column:
        if isinstance(q, str):
            return F.col(names[q])
        parts = [holds(x) for x in q[1:]]
        if q[0] == "xor":
            return reduce(lambda a, b: a != b, parts)
        return reduce(Column.__and__ if q[0] == "and" else Column.__or__, parts)

    found = postings.filter(F.col("token").isin(list(names))).groupBy("doc_id").agg(*(F.bool_or(F.col("token") == t).alias(c) for t, c in names.items()))
    return found.filter(holds(query)).select("doc_id")


def wildcard_search(postings: DataFrame, index: DataFrame, pattern: str) -> DataFrame:
    return postings.join(matching_tokens(index, pattern), "token", "left_semi").select("doc_id").distinct()


def time_range(logs: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Logs of a closed time range; the ISO year and week columns of a partitioned log prune folders."""
    low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    rows = logs.filter(F.col(ts).between(low, high))
    if {"iso_year", "iso_week"} <= set(logs.columns):
        week = F.col("iso_year") * 100 + F.col("iso_week")
        rows = rows.filter(week.between(iso_week(low), iso_week(high)))
    return rows


def iso_week(ts: Column) -> Column:
    """ISO year * 100 + ISO week."""
    return F.extract(F.lit("YEAROFWEEK"), ts) * 100 + F.weekofyear(ts)


def with_weeks(logs: DataFrame, ts: str = "ts") -> DataFrame:
    return logs.withColumns({"iso_year": F.extract(F.lit("YEAROFWEEK"), F.col(ts)), "iso_week": F.weekofyear(ts)})


def bounds(logs: DataFrame, key: str, doc_id: str = "doc_id") -> DataFrame:
    """The least and largest document of each value."""
    return logs.groupBy(key).agg(F.min(doc_id).alias("min_doc"), F.max(doc_id).alias("max_doc"))


def doc_ids(logs: DataFrame, ts: str, tie: str) -> DataFrame:
    """``logs`` with doc_id = second << 32 | counter within that second."""
    from pyspark.sql import Window as W

    second = F.unix_seconds(F.col(ts))
    counter = F.row_number().over(W.partitionBy(second).orderBy(ts, tie)) - 1
    return logs.withColumn("doc_id", F.shiftleft(second, 32).bitwiseOR(counter.cast("long")))


def page(docs: DataFrame, start: int, tail: int, order: str = "doc_id") -> DataFrame:
    """Results ``start`` to ``tail``, both included, from 0."""
    return docs.orderBy(order).offset(start).limit(tail - start + 1)


def log_condition(rule, data: str = "data") -> Column:
    """A condition (key, operator, ...) on a log's map; like a record's, with the map's values."""
    from tidewell.operators.records import _VALUE_TESTS

    if isinstance(rule, list):
        return reduce(Column.__and__, [log_condition(r, data) for r in rule], F.lit(True))
    key, *rest = rule
    value = F.try_element_at(F.col(data), F.lit(key))
    if not rest:
        return value.isNotNull()
    op, args = (rest[0], rest[1:]) if len(rest) > 1 else ("=", rest)
    return F.coalesce(_VALUE_TESTS[op](value, *args), F.lit(False))
