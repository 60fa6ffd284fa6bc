r"""Quality rules with adaptive thresholds per language and source.

Each text gives integer metrics. A metric's distribution within a language and
source is a quantile sketch: counts of values kept to their ``BITS`` leading bits.
Such sketches merge by adding counts, don't depend on the order of rows, and answer a
quantile with the right rank and a value at most 1/512 too small, however large it is.
Quartiles of a group are pooled with those of its language as if ``PRIOR`` texts more
had them, and the language's with those of all texts likewise, so a group of few texts
leans on its language and a large one on itself, without a step between. The fence is
the upper quartile plus ``REACH`` times the quartile distance (at least ``SPREAD``).
A text stays if it passes the base rules and every fence.

Defined results: null text counts as empty (it fails the base rules); null
language or source counts as ''; repeated rows are rows of their own; an empty
table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.text import map_arrow, texts
from tidewell.sources.tables import settle

SYMBOLS = "#*$%&|<>"
BITS, REACH, PRIOR = 10, 3, 50
#: Per mille of symbols, of repeated lines and of words in repeated windows; tenths of a character per word.
METRICS = {
    "symbols": "1000 * n_symbols div greatest(word_chars, 1)",
    "lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
    "length": "10 * word_chars div greatest(n_words, 1)",
}
#: The least quartile distance of a metric: one repeated line or a few symbols in a short text are no outlier.
SPREAD = {"symbols": 20, "lines": 150, "repeats": 120, "length": 20}
STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def text_stats(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at \x20 and \x09-\x0D only
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(windows)
    repeated = 0
    if len(times) < len(windows):
        reach = 0
        for i, window in enumerate(windows):
            if times[window] > 1:
                repeated += i + 3 - max(reach, i)
                reach = i + 3
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in STATS.split(", ")]
    for batch in batches:
        found = [text_stats(x) for x in texts(batch)]
        columns = list(zip(*found, strict=True)) if found else [()] * 6
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("source"), *(pa.array(list(c), pa.int64()) for c in columns)], names)


def with_stats(docs: DataFrame) -> DataFrame:
    """One row per document with its counts and ``base_failed``."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    return map_arrow(narrow, _stats, STATS).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def sketches(stats: DataFrame) -> DataFrame:
    """Counts by lang, source, metric and bin of the texts that pass the base rules.

    A null source holds the sketches of a language merged, a null lang those of all texts.
    """
    values = F.expr(f"stack({len(METRICS)}, " + ", ".join(f"'{k}', {v}" for k, v in METRICS.items()) + ") AS (metric, value)")
    cut = f"greatest(length(bin(value)) - {BITS}, 0)"
    bins = F.expr(f"shiftleft(shiftright(value, {cut}), {cut}) AS bin")
    own = stats.filter("NOT base_failed").select("lang", "source", values).select("lang", "source", "metric", bins).groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n"))
    nothing = F.lit(None).cast("string")
    by_lang = own.groupBy("lang", "metric", "bin").agg(F.sum("n").alias("n")).withColumn("source", nothing)
    of_all = by_lang.groupBy("metric", "bin").agg(F.sum("n").alias("n")).withColumn("source", nothing).withColumn("lang", nothing)
    return own.unionByName(by_lang).unionByName(of_all)


def quartiles(sketch: DataFrame) -> DataFrame:
    """lang, source, metric, total, q1 and q3 of each sketch."""
    counted = sketch.selectExpr(
        "*",
        "sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bin) AS upto",
        "sum(n) OVER (PARTITION BY lang, source, metric) AS total",
    )
    return counted.groupBy("lang", "source", "metric").agg(
        F.max("total").alias("total"),
        F.expr("min(CASE WHEN 4 * upto >= total THEN bin END)").alias("q1"),
        F.expr("min(CASE WHEN 4 * upto >= 3 * total THEN bin END)").alias("q3"),
    )


def fences(sketch: DataFrame) -> DataFrame:
    """One row per lang and source with the upper fence of each metric."""
    found = settle(quartiles(sketch), "quartiles")
    of_all = {r["metric"]: r for r in found.filter("lang IS NULL").collect()}  # a row for each metric

    def pooled(total: str, own: str, prior: str) -> str:
        return f"({total} * {own} + {PRIOR} * {prior}) / ({total} + {PRIOR})"

    def of_metric(q: str) -> str:
        return "CASE metric " + " ".join(f"WHEN '{m}' THEN {r[q]}" for m, r in sorted(of_all.items())) + " END" if of_all else "0"

    by_lang = found.filter("lang IS NOT NULL AND source IS NULL").selectExpr("lang", "metric", f"{pooled('total', 'q1', of_metric('q1'))} AS l1", f"{pooled('total', 'q3', of_metric('q3'))} AS l3")
    own = found.filter("source IS NOT NULL").join(by_lang, ["lang", "metric"]).selectExpr("lang", "source", "metric", f"{pooled('total', 'q1', 'l1')} AS p1", f"{pooled('total', 'q3', 'l3')} AS p3")
    each = [F.max(F.expr(f"CASE WHEN metric = '{m}' THEN p3 + {REACH} * greatest(p3 - p1, {SPREAD[m]}) END")).alias(f"fence_{m}") for m in METRICS]
    return own.groupBy("lang", "source").agg(*each)


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, base_failed, and kept."""
    stats = settle(with_stats(docs), "quality")
    found = settle(fences(sketches(stats)), "fences")
    passes = " AND ".join(f"{v} <= fence_{k}" for k, v in METRICS.items())
    judged = stats.join(found, ["lang", "source"], "left")  # both sides as written, so that Spark may split a hot source
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.expr(f"NOT base_failed AND coalesce({passes}, false)").alias("kept"))


_SQL_BINS = {k: v.replace(" div ", " // ") for k, v in METRICS.items()}
QUERY_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tok AS (SELECT rid, unnest(ws) AS a, unnest(range(len(ws))) AS i FROM w),
tri AS (SELECT rid, i, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM tok WINDOW p AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri WHERE c IS NOT NULL),
cov AS (SELECT rid, count(DISTINCT i + d) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS s(d) WHERE n > 1 GROUP BY rid),
lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
base AS (
  SELECT rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN lines USING (rid)),
st AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
own AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, CAST({v} AS BIGINT) AS value FROM st WHERE NOT base_failed" for k, v in _SQL_BINS.items())}),
b AS (SELECT lang, source, metric, (value >> CAST(greatest(length(bin(value)) - {BITS}, 0) AS BIGINT)) << CAST(greatest(length(bin(value)) - {BITS}, 0) AS BIGINT) AS bin FROM own),
sk AS (SELECT lang, source, metric, bin, count(*) AS n FROM b GROUP BY ALL
       UNION ALL SELECT lang, NULL, metric, bin, count(*) FROM b GROUP BY ALL
       UNION ALL SELECT NULL, NULL, metric, bin, count(*) FROM b GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, source, metric) AS total FROM sk),
q AS (SELECT lang, source, metric, CAST(max(total) AS BIGINT) AS total, min(bin) FILTER (4 * upto >= total) AS q1, min(bin) FILTER (4 * upto >= 3 * total) AS q3 FROM cum GROUP BY ALL),
pl AS (SELECT q.lang, q.metric, CAST(q.total * q.q1 + {PRIOR} * a.q1 AS DOUBLE) / (q.total + {PRIOR}) AS l1, CAST(q.total * q.q3 + {PRIOR} * a.q3 AS DOUBLE) / (q.total + {PRIOR}) AS l3
       FROM q JOIN q a ON a.metric = q.metric AND a.lang IS NULL WHERE q.lang IS NOT NULL AND q.source IS NULL),
po AS (SELECT q.lang, q.source, q.metric, (CAST(q.total * q.q1 AS DOUBLE) + {PRIOR} * l1) / (q.total + {PRIOR}) AS p1, (CAST(q.total * q.q3 AS DOUBLE) + {PRIOR} * l3) / (q.total + {PRIOR}) AS p3
       FROM q JOIN pl ON pl.lang = q.lang AND pl.metric = q.metric WHERE q.source IS NOT NULL),
f AS (SELECT lang, source, {", ".join(f"max(p3 + {REACH} * greatest(p3 - p1, {SPREAD[k]})) FILTER (metric = '{k}') AS f_{k}" for k in METRICS)} FROM po GROUP BY ALL)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce({" AND ".join(f"{v} <= f_{k}" for k, v in _SQL_BINS.items())}, false) AS kept
FROM st s LEFT JOIN f o ON o.lang = s.lang AND o.source = s.source
"""
