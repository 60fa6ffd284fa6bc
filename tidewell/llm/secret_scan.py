r"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regex gives a Boolean trigram query: an AND of clauses, each an OR
of literals, each the AND of its trigrams. The index maps the trigrams that
these queries name to documents (postings of lower-cased texts). Intersecting
postings gives a document's candidate rules, which the regexes then verify on
the whole text. A rule that must contain no trigram (``hex``) scans every text.

A span is kind:start:end in code points, end exclusive. Matches of a kind are
leftmost and don't overlap; then those that are too short are dropped.

Defined results: null text is empty and has no span; rows that repeat a doc_id
(or have none) are scanned on their own text; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """group: the group whose length counts; least: its least length."""

    kind: str
    pattern: str
    group: int
    least: int


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("private", r"-----BEGIN[A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
)
RULES = BASE + MORE
#: A cheap test that every match long enough passes, for rules without a trigram.
SIEVES = {"hex": "[0-9a-f]{32}"}

Query = tuple[tuple[frozenset[str], ...], ...]
WIDE = 32  # literals that one clause may list


def trigram_query(pattern: str) -> Query:
    """Clauses (AND) of alternatives (OR) of trigram sets (AND); () if no trigram is mandatory."""
    clauses: list[set[str]] = []

    def flush(open_: set[str]) -> set[str]:
        if min(map(len, open_)) >= 3:
            clauses.append(open_)
        return {""}

    def strings(token) -> set[str] | None:
        """All the strings that a part of a regex matches, lower-cased, or None."""
        op, arg = token
        name = str(op)
        if name == "LITERAL":
            return {chr(arg).lower()}
        if name == "IN":
            if all(str(o) == "LITERAL" for o, _ in arg):
                return {chr(c).lower() for _, c in arg}
            return None
        if name == "SUBPATTERN":
            return joined(arg[3])
        if name == "BRANCH":
            parts = [joined(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if name == "MAX_REPEAT" and arg[1] == 1:
            once = joined(arg[2])
            return None if once is None else once | ({""} if arg[0] == 0 else set())
        return None

    def joined(tokens) -> set[str] | None:
        found = {""}
        for token in tokens:
            part = strings(token)
            if part is None or len(found) * len(part) > WIDE:
                return None
            found = {a + b for a in found for b in part}
        return found

    open_ = {""}
    for token in re._parser.parse(pattern):
        part = strings(token)
        if part is None or len(open_) * len(part) > WIDE:
            open_ = flush(open_)
        if part is not None and len(part) <= WIDE:
            open_ = {a + b for a in open_ for b in part}
    flush(open_)
    grams = [{frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in c} for c in clauses]
    return tuple(tuple(sorted((a for a in c if not any(b < a for b in c)), key=sorted)) for c in grams)


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the named trigrams in lower-cased texts."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    here = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select("doc_id", F.explode(here).alias("trigram"))


def intersect(postings: DataFrame, wanted: dict[str, Query]) -> DataFrame:
    """The rules whose trigram queries a document's postings satisfy: doc_id, rules."""
    names = sorted({t for q in wanted.values() for c in q for alt in c for t in alt})
    has = {t: f"t{i}" for i, t in enumerate(names)}
    held = postings.groupBy("doc_id").agg(*(F.bool_or(F.col("trigram") == t).alias(c) for t, c in has.items()))

    def holds(q: Query) -> Column:
        clause = [reduce(Column.__or__, [reduce(Column.__and__, [F.col(has[t]) for t in sorted(alt)]) for alt in c]) for c in q]
        return reduce(Column.__and__, clause)

    rules = F.array_compact(F.array(*(F.when(holds(q), F.lit(k)) for k, q in wanted.items())))
    return held.select("doc_id", rules.alias("rules")).filter(F.size("rules") > 0)


def _found(text: Column, rule: Rule) -> Column:
    """array<struct<start, order, kind, end>> of a rule's matches in a text."""
    pattern = F.lit(rule.pattern)
    hits = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("before"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("counted"),
    )
    order = [r.kind for r in RULES].index(rule.kind)
    span = "struct<start:int,ord:int,kind:string,stop:int>"
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + F.length(x["before"])
        end = at + F.length(x["hit"])
        one = F.array(F.struct(at.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("stop")))
        spans = F.when(F.length(x["counted"]) >= rule.least, F.concat(acc["spans"], one)).otherwise(acc["spans"])
        return F.struct(F.coalesce(end, at).alias("pos"), spans.alias("spans"))

    return F.aggregate(hits, start, step, lambda acc: acc["spans"])


def find_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, name: str = "spans") -> DataFrame:
    """``docs`` (doc_id, text, and others) with an array of spans by start, then kind as listed, in the column ``name``.

    A column of that name is replaced.
    """
    wanted = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    names = sorted({t for q in wanted.values() for c in q for alt in c for t in alt})
    candidates = intersect(build_index(docs, names), wanted).select(F.col("doc_id").alias("__tidewell_doc"), F.col("rules").alias("__tidewell_rules"))
    both = docs.join(candidates, docs["doc_id"].eqNullSafe(F.col("__tidewell_doc")), "left")
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,stop:int>>")
    text = F.coalesce(docs["text"], F.lit(""))
    each = []
    for rule in rules:
        test = F.array_contains("__tidewell_rules", rule.kind) if rule.kind in wanted else text.rlike(SIEVES[rule.kind]) if rule.kind in SIEVES else F.lit(True)
        each.append(F.when(F.coalesce(test, F.lit(False)), _found(text, rule)).otherwise(none))
    return both.select(*(docs[c] for c in docs.columns if c != name), F.array_sort(F.concat(*each)).alias(name))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = find_spans(docs.select("doc_id", "text")).select("doc_id", "spans")

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mark``; n_chars follows the text."""
    spans = "__tidewell_spans"
    found = find_spans(docs, name=spans)
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        head = F.when(s["start"] >= acc["pos"], F.concat(F.substring(F.col("text"), acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["pos"], s["stop"]).alias("pos"), F.concat(acc["out"], head).alias("out"))

    text = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, F.length("text"))))
    done = F.when(F.size(spans) > 0, text).otherwise(F.col("text"))
    out = found.withColumn("text", done)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def _sql() -> str:
    each = []
    for order, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        each.append(
            f"SELECT rid, {order} AS ord, '{r.kind}' AS kind, {r.least} AS least, unnest(regexp_extract_all(t, '{p}')) AS hit, "
            f"unnest(regexp_extract_all(t, '{p}', {r.group})) AS counted, unnest(regexp_split_to_array(t, '{p}')) AS piece, "
            f"unnest(range(len(regexp_split_to_array(t, '{p}')))) AS i FROM d"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(each)}),
s AS (SELECT *, CAST(sum(length(piece) + coalesce(length(hit), 0)) OVER (PARTITION BY rid, ord ORDER BY i) AS BIGINT) AS stop FROM m),
k AS (SELECT rid, ord, kind, stop - length(hit) AS start, stop FROM s WHERE hit IS NOT NULL AND length(counted) >= least),
g AS (SELECT rid, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
      string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, ord) FILTER (ord < {len(BASE)}) AS base,
      string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, ord) AS spans FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


QUERY_SQL = _sql()
