"""Queries of log search: documents are texts, events are log messages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewell.operators import search
from tidewell.plans.catalogue import query
from tidewell.sources import log_index
from tidewell.sources.tables import shared_dir, table

TOK = r"tok AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \t\r\n]+')) AS token FROM documents)"
POST = f"WITH {TOK}, post AS (SELECT DISTINCT token, doc_id FROM tok) "


def postings(s, d):
    return search.tokens(table(s, d, "documents"))


def logs(s, d):
    e = table(s, d, "events")
    data = F.create_map(F.lit("type"), "event_type", F.lit("user"), F.col("user_id").cast("string"))
    return e.select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", data.alias("data"))


query("log_term_frequency", f"WITH {TOK} SELECT token, count(*) AS frequency FROM tok GROUP BY token")(lambda s, d: search.dictionary(postings(s, d)).drop("shard"))
query("log_shards")(lambda s, d: search.dictionary(postings(s, d), 8))
query("log_tokens", r"SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS place FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\r\n]+') AS w FROM documents)")(lambda s, d: postings(s, d).withColumn("place", F.col("place").cast("long")))
query("log_postings", POST + "SELECT token, string_agg(doc_id, ',' ORDER BY doc_id) AS docs FROM post GROUP BY token")(lambda s, d: search.posting_lists(postings(s, d)).withColumn("docs", F.array_join(F.col("docs").cast("array<string>"), ",")))
query(
    "log_trigrams",
    POST + "SELECT DISTINCT substr('$' || token || '$', CAST(i AS INTEGER), 3) AS gram, token FROM (SELECT token, unnest(range(1, greatest(length(token), 1) + 1)) AS i FROM (SELECT DISTINCT token FROM post))",
)(lambda s, d: search.gram_index(postings(s, d)))
query("log_search_and", POST + "SELECT doc_id FROM post WHERE token = 'the' INTERSECT SELECT doc_id FROM post WHERE token = 'is'")(lambda s, d: search.boolean_search(postings(s, d), ("and", "the", "is")))
query("log_search_or", POST + "SELECT DISTINCT doc_id FROM post WHERE token IN ('der', 'le')")(lambda s, d: search.boolean_search(postings(s, d), ("or", "der", "le")))
query("log_search_xor", POST + "SELECT doc_id FROM post WHERE token IN ('the', 'is') GROUP BY doc_id HAVING count(*) = 1")(lambda s, d: search.boolean_search(postings(s, d), ("xor", "the", "is")))
query("log_search_nested", POST + "SELECT doc_id FROM post GROUP BY doc_id HAVING bool_or(token = 'the') AND (bool_or(token = 'idiot') OR bool_or(token = 'was'))")(lambda s, d: search.boolean_search(postings(s, d), ("and", "the", ("or", "idiot", "was"))))
query("log_wildcard_prefix", POST + "SELECT DISTINCT token FROM post WHERE token LIKE 'then%'")(lambda s, d: search.matching_tokens(search.gram_index(postings(s, d)), "then$"))
query("log_wildcard_middle", POST + "SELECT DISTINCT token FROM post WHERE token LIKE 'th%ing%er'")(lambda s, d: search.matching_tokens(search.gram_index(postings(s, d)), "th$ing$er"))
query("log_wildcard_suffix", POST + "SELECT DISTINCT token FROM post WHERE token LIKE '%tion'")(lambda s, d: search.matching_tokens(search.gram_index(postings(s, d)), "$tion"))
query("log_wildcard_documents", POST + "SELECT DISTINCT doc_id FROM post WHERE token LIKE '%idio%'")(lambda s, d: search.wildcard_search(postings(s, d), search.gram_index(postings(s, d)), "$idio$"))
query("log_entry_tokens", "SELECT DISTINCT unnest(['type', event_type, 'user', CAST(user_id AS VARCHAR)]) AS token, event_id AS doc_id FROM events")(lambda s, d: search.entry_tokens(logs(s, d)))
query("log_time_range", "SELECT event_id AS doc_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'")(
    lambda s, d: search.time_range(search.with_weeks(logs(s, d)), "2024-01-05 00:00:00", "2024-01-12 12:00:00").select("doc_id", "event_type")
)
query("log_iso_weeks", "SELECT event_id AS doc_id, CAST(isoyear(ts) * 100 + weekofyear(ts) AS INTEGER) AS week FROM events")(lambda s, d: logs(s, d).select("doc_id", search.iso_week(F.col("ts")).alias("week")))
query("log_bounds", "SELECT event_type, min(event_id) AS min_doc, max(event_id) AS max_doc FROM events GROUP BY event_type")(lambda s, d: search.bounds(logs(s, d), "event_type"))
query("log_doc_ids", "SELECT event_id, (CAST(floor(epoch(ts)) AS BIGINT) << 32) | (row_number() OVER (PARTITION BY CAST(floor(epoch(ts)) AS BIGINT) ORDER BY ts, event_id) - 1) AS doc_id FROM events")(
    lambda s, d: search.doc_ids(table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")), "ts", "event_id").select("event_id", "doc_id")
)
query("log_page", "SELECT event_id AS doc_id FROM events ORDER BY event_id LIMIT 11 OFFSET 20")(lambda s, d: search.page(logs(s, d), 20, 30).select("doc_id"))
query("log_postings_to_rows", "SELECT event_id AS doc_id, event_type, value FROM events WHERE event_type = 'purchase'")(
    lambda s, d: logs(s, d).join(search.boolean_search(search.entry_tokens(logs(s, d)), "purchase"), "doc_id", "left_semi").select("doc_id", "event_type", "value")
)
for _name, _rule, _sql in (
    ("present", ("user",), "true"),
    ("absent_key", ("nothing",), "false"),
    ("eq", ("type", "click"), "event_type = 'click'"),
    ("in", ("type", "in", ["click", "view"]), "event_type IN ('click', 'view')"),
    ("out", ("type", "out", ["click", "view"]), "event_type NOT IN ('click', 'view')"),
    ("gt", ("user", ">", "5"), "CAST(user_id AS VARCHAR) > '5'"),
    ("between", ("user", "between", "2", "4"), "CAST(user_id AS VARCHAR) BETWEEN '2' AND '4'"),
    ("all_of", [("type", "!=", "click"), ("user", "<=", "3")], "event_type <> 'click' AND CAST(user_id AS VARCHAR) <= '3'"),
):
    query(f"log_filter_{_name}", f"SELECT event_id AS doc_id FROM events WHERE {_sql}")(lambda s, d, rule=_rule: logs(s, d).filter(search.log_condition(rule if isinstance(rule, list) else [rule])).select("doc_id"))
query("log_windows", "SELECT CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS window_id, count(*) AS n FROM events GROUP BY ALL")(lambda s, d: logs(s, d).groupBy(F.floor(F.unix_seconds("ts") / 3600).alias("window_id")).agg(F.count("*").alias("n")))
query("log_posting_chunks", POST + "SELECT token, CAST(doc_id // 100 AS BIGINT) AS chunk, string_agg(doc_id, ',' ORDER BY doc_id) AS docs FROM post GROUP BY ALL")(
    lambda s, d: search.posting_chunks(search.words(table(s, d, "documents")), 100).withColumn("docs", F.array_join(F.col("docs").cast("array<string>"), ","))
)
query(
    "log_entry_system",
    "SELECT DISTINCT unnest([CAST(CAST(floor(epoch(ts)) AS BIGINT) // 60 AS VARCHAR), upper(event_type), 'USER', CAST(user_id AS VARCHAR)]) AS token, event_id AS doc_id FROM events",
)(
    lambda s, d: search.entry_tokens(
        logs(s, d).withColumn("data", F.create_map(F.lit("$time"), F.unix_millis("ts").cast("string"), F.lit("$type"), "event_type", F.lit("user"), F.col("user_id").cast("string"))), linguistics=F.upper
    )
)


def _kept_index(spark, d):
    """An index of all documents in two batches, by language."""
    root = f"{shared_dir(spark)}/log-index-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents")
    english = F.col("lang").eqNullSafe("en")
    for part in (docs.filter(english), docs.filter(~english)):
        log_index.append(search.tokens(part), root)
    return root


@query("log_index_dictionary", POST + "SELECT token, CAST(count(*) AS BIGINT) AS frequency FROM post GROUP BY token")
def log_index_dictionary(spark, d):
    root = _kept_index(spark, d)
    log_index.compact(spark, root)
    return log_index.dictionary(spark, root)


query("log_index_search", POST + "SELECT doc_id FROM post GROUP BY doc_id HAVING bool_or(token = 'the') AND (bool_or(token = 'idiot') OR bool_or(token = 'was'))")(
    lambda s, d: log_index.boolean_search(s, _kept_index(s, d), ("and", "the", ("or", "idiot", "was")))
)
query("log_index_wildcard", POST + "SELECT DISTINCT doc_id FROM post WHERE token LIKE '%idio%'")(lambda s, d: log_index.wildcard_search(s, _kept_index(s, d), "$idio$"))
