"""Queries of key-value tables: orders and customers play the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewell.operators import kv, merge, rank, setops
from tidewell.plans.catalogue import query
from tidewell.sources import snapshots
from tidewell.sources.tables import shared_dir, table

KV = "SELECT o_orderkey AS key, o_totalprice AS value, 2 AS vsn, epoch_ms(o_orderdate) AS time FROM orders"
WITH = f"WITH kv AS ({KV}) "


def orders(spark, d):
    return kv.kv_table(table(spark, d, "orders"), "o_orderkey", "o_totalprice", "o_orderdate")


def balances(spark, d):
    return kv.kv_table(table(spark, d, "customer"), "c_custkey", "c_acctbal")


query("kv_count", "SELECT count(*) AS n FROM orders")(lambda s, d: kv.result(orders(s, d), "count"))
query("kv_select_range", WITH + "SELECT * FROM kv WHERE key > 100 AND key <= 500")(lambda s, d: kv.scan_between(orders(s, d), "open", 100, "closed", 500))
query("kv_select_reverse", WITH + "SELECT * FROM kv WHERE key >= 100 AND key < 500")(lambda s, d: kv.scan_between(orders(s, d), "open", 500, "closed", 100))
query("kv_select_point_range", WITH + "SELECT * FROM kv WHERE key = 300")(lambda s, d: kv.scan_between(orders(s, d), "closed", 300, "closed", 300))
query("kv_select_empty_range", WITH + "SELECT * FROM kv WHERE false")(lambda s, d: kv.scan_between(orders(s, d), "open", 300, "closed", 300))
query("kv_select_all_ascending", KV)(lambda s, d: kv.scan(orders(s, d)))
query("kv_select_from_open", WITH + "SELECT * FROM kv WHERE key > 1000")(lambda s, d: kv.scan(orders(s, d), "ascending", "open", 1000))
query("kv_select_down_closed", WITH + "SELECT * FROM kv WHERE key <= 1000")(lambda s, d: kv.scan(orders(s, d), "descending", "closed", 1000))
query("kv_result_key", WITH + "SELECT key FROM kv WHERE key BETWEEN 10 AND 90")(lambda s, d: kv.result(kv.scan_between(orders(s, d), "closed", 10, "closed", 90), "key"))
query("kv_result_attr", WITH + "SELECT key, vsn, time FROM kv WHERE key BETWEEN 10 AND 90")(lambda s, d: kv.result(kv.scan_between(orders(s, d), "closed", 10, "closed", 90), "attr"))
query("kv_result_value", WITH + "SELECT key, value FROM kv WHERE key BETWEEN 10 AND 90")(lambda s, d: kv.result(kv.scan_between(orders(s, d), "closed", 10, "closed", 90), "value"))
query("kv_filter", WITH + "SELECT key, value FROM kv WHERE value > 200000")(lambda s, d: kv.result(orders(s, d).filter("value > 200000"), "value"))
query("kv_limit_flag", WITH + "SELECT *, true AS more FROM kv ORDER BY key LIMIT 101")(lambda s, d: kv.limited(orders(s, d), 100, F.col("key")))
query("kv_take_while", WITH + "SELECT * FROM kv WHERE key < coalesce((SELECT min(key) FROM kv WHERE NOT value < 400000), 9e18)")(lambda s, d: kv.take_while(orders(s, d), F.col("value") < 400000))
query("kv_take_until", WITH + "SELECT * FROM kv WHERE key <= coalesce((SELECT min(key) FROM kv WHERE NOT value < 400000), 9e18)")(lambda s, d: kv.take_while(orders(s, d), F.col("value") < 400000, inclusive=True))
query("kv_running_filter", WITH + "SELECT key, value, vsn, time FROM (SELECT *, sum(CAST(floor(value) AS BIGINT)) OVER (ORDER BY key) AS run FROM kv) WHERE run <= 5000000")(
    lambda s, d: kv.running_filter(orders(s, d), F.floor("value"), 5000000)
)
query("kv_index_range_key", "SELECT c_acctbal AS value, c_custkey AS key FROM customer WHERE (c_acctbal > 100 OR (c_acctbal = 100 AND c_custkey >= 0)) AND (c_acctbal < 2000 OR (c_acctbal = 2000 AND c_custkey <= 50))")(
    lambda s, d: kv.index_scan(balances(s, d), (100.0, 0), (2000.0, 50))
)
query("kv_index_range_all", "SELECT c_acctbal AS value, c_custkey AS key, 2 AS vsn, CAST(0 AS BIGINT) AS time FROM customer WHERE (c_acctbal > 100 OR (c_acctbal = 100 AND c_custkey >= 0)) AND (c_acctbal < 2000 OR (c_acctbal = 2000 AND c_custkey <= 50))")(
    lambda s, d: kv.index_scan(balances(s, d), (100.0, 0), (2000.0, 50), "all")
)
query("kv_index_range_count", "SELECT count(*) AS n FROM customer WHERE (c_acctbal > 100 OR (c_acctbal = 100 AND c_custkey >= 0)) AND (c_acctbal < 2000 OR (c_acctbal = 2000 AND c_custkey <= 50))")(
    lambda s, d: kv.index_scan(balances(s, d), (100.0, 0), (2000.0, 50), "count")
)
query("kv_cursor_page", WITH + "SELECT key, vsn, time FROM kv WHERE key > 640 ORDER BY key LIMIT 32")(lambda s, d: kv.page(orders(s, d), 640, 32))


@query("kv_read_point", WITH + "SELECT CAST(5 AS BIGINT) AS key, value, coalesce(vsn, 0) AS vsn, coalesce(time, 0) AS time FROM (SELECT 1) LEFT JOIN kv ON key = 5")
def kv_read_point(spark, d):
    return kv.read(orders(spark, d), spark.createDataFrame([(5,)], "key long"))


@query("kv_read_missing_default", WITH + "SELECT k.key, CASE WHEN kv.key IS NULL THEN -1.0 ELSE value END AS value, coalesce(vsn, 0) AS vsn, coalesce(time, 0) AS time FROM (VALUES (CAST(5 AS BIGINT)), (-8)) k(key) LEFT JOIN kv USING (key)")
def kv_read_missing(spark, d):
    return kv.read(orders(spark, d), spark.createDataFrame([(5,), (-8,)], "key long"), default=-1.0)


@query(
    "kv_read_batch",
    WITH + "SELECT pos, r.t AS \"table\", r.key, coalesce(a.value, b.c_acctbal) AS value, CASE WHEN a.key IS NULL AND b.c_custkey IS NULL THEN 0 ELSE 2 END AS vsn, coalesce(a.time, 0) AS time "
    "FROM (VALUES (0, 'orders', CAST(7 AS BIGINT)), (1, 'customer', 3), (2, 'orders', 7), (3, 'orders', -1)) r(pos, t, key) "
    "LEFT JOIN kv a ON r.t = 'orders' AND a.key = r.key LEFT JOIN customer b ON r.t = 'customer' AND b.c_custkey = r.key",
)
def kv_read_batch(spark, d):
    wanted = spark.createDataFrame([(0, "orders", 7), (1, "customer", 3), (2, "orders", 7), (3, "orders", -1)], "pos int, table string, key long")
    return kv.read_batch({"orders": orders(spark, d), "customer": balances(spark, d)}, wanted)


def _changes(spark, d, vsn):
    """Every third order again at another price, and keys that are new."""
    rows = orders(spark, d).filter("key % 3 = 0").select((F.col("key") * F.when(F.col("key") % 2 == 0, 1).otherwise(-1)).alias("key"), (F.col("value") + 1).alias("value"))
    return rows.select("key", "value", F.lit(vsn).alias("vsn"), F.lit(7).cast("long").alias("time"))


_CH = "ch AS (SELECT key * CASE WHEN key % 2 = 0 THEN 1 ELSE -1 END AS key, value + 1 AS value, CAST(7 AS BIGINT) AS time FROM kv WHERE key % 3 = 0)"
_WCH = f"WITH kv AS ({KV}), {_CH} "
query("kv_upsert", _WCH + "SELECT key, coalesce(ch.value, kv.value) AS value, CASE WHEN kv.key IS NULL THEN 2 WHEN ch.key IS NULL THEN kv.vsn ELSE kv.vsn + 1 END AS vsn, coalesce(ch.time, kv.time) AS time FROM kv FULL JOIN ch USING (key)")(
    lambda s, d: merge.write(orders(s, d), _changes(s, d, 0))
)
query("kv_insert_only", _WCH + "SELECT * FROM kv UNION ALL SELECT key, value, 2, time FROM ch WHERE key NOT IN (SELECT key FROM kv)")(lambda s, d: merge.write(orders(s, d), _changes(s, d, 1)))
query("kv_insert_conflicts", _WCH + "SELECT key, 1 AS asked, 2 AS actual FROM ch WHERE key IN (SELECT key FROM kv)")(lambda s, d: merge.conflicts(orders(s, d), _changes(s, d, 1)))
query("kv_compare_and_set", _WCH + "SELECT key, coalesce(ch.value, kv.value) AS value, CASE WHEN ch.key IS NULL THEN 2 ELSE 3 END AS vsn, coalesce(ch.time, kv.time) AS time FROM kv LEFT JOIN ch USING (key)")(
    lambda s, d: merge.write(orders(s, d), _changes(s, d, 2))
)
query("kv_cas_conflicts", _WCH + "SELECT key, 9 AS asked, CASE WHEN key IN (SELECT key FROM kv) THEN 2 ELSE 0 END AS actual FROM ch")(lambda s, d: merge.conflicts(orders(s, d), _changes(s, d, 9)))
query("kv_delete", _WCH + "SELECT * FROM kv WHERE key NOT IN (SELECT key FROM ch)")(lambda s, d: merge.delete(orders(s, d), _changes(s, d, 0).select("key", "vsn")))
query("kv_delete_missing", _WCH + "SELECT key, 0 AS asked, 0 AS actual FROM ch WHERE key NOT IN (SELECT key FROM kv)")(lambda s, d: merge.not_deleted(orders(s, d), _changes(s, d, 0).select("key", "vsn")))
query("kv_restore", _WCH + "SELECT * FROM kv WHERE key NOT IN (SELECT key FROM ch) UNION ALL SELECT key, value, 5, time FROM ch")(lambda s, d: merge.restore(orders(s, d), _changes(s, d, 5)))
query("kv_latest_wins", "SELECT user_id AS key, arg_max(event_type, event_id) AS value, max(event_id) + 1 AS vsn, max(event_id) AS time FROM events GROUP BY user_id")(
    lambda s, d: merge.latest_wins(table(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), (F.col("event_id") + 1).alias("vsn"), F.col("event_id").alias("time")))
)


@query("kv_transaction", _WCH + "SELECT key, coalesce(ch.value, kv.value) AS value, CASE WHEN kv.key IS NULL THEN 2 WHEN ch.key IS NULL THEN 2 ELSE 3 END AS vsn, coalesce(ch.time, kv.time) AS time FROM kv FULL JOIN ch USING (key) WHERE coalesce(key, 0) % 9 <> 0 OR ch.key IS NULL")
def kv_transaction(spark, d):
    changes = _changes(spark, d, 0)
    mixed = changes.withColumn("value", F.when(F.col("key") % 9 != 0, F.col("value")))
    return merge.transaction({"orders": orders(spark, d)}, lambda t: {"orders": mixed})["orders"]


@query("kv_transaction_refused", KV)
def kv_transaction_refused(spark, d):
    return merge.transaction({"orders": orders(spark, d)}, lambda t: {"orders": _changes(spark, d, 9)})["orders"]


@query("kv_snapshot_increment", _WCH + "SELECT key, coalesce(ch.value, kv.value) AS value, CASE WHEN ch.key IS NULL THEN 2 ELSE 8 END AS vsn, coalesce(ch.time, kv.time) AS time FROM kv FULL JOIN ch USING (key) WHERE key % 5 <> 0")
def kv_snapshot_increment(spark, d):
    root = f"{shared_dir(spark)}/kv-{uuid.uuid4().hex}"
    snapshots.snapshot(orders(spark, d), root)
    snapshots.increment(_changes(spark, d, 8), root)
    gone = orders(spark, d).select("key").union(_changes(spark, d, 8).select("key")).distinct().filter("key % 5 = 0")
    snapshots.increment(gone.select("key", F.lit(0.0).alias("value"), F.lit(0).alias("vsn"), F.lit(4102444800000).alias("time")), root)
    return snapshots.load(spark, root)


query("kv_incremental", WITH + "SELECT * FROM kv WHERE time > epoch_ms(TIMESTAMP '1997-01-01')")(lambda s, d: snapshots.changed_since(orders(s, d), 852076800000))
query("kv_rank_all", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders")(
    lambda s, d: rank.with_rank(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).drop("o_totalprice")
)
query("kv_rank_of", WITH + "SELECT count(*) FILTER (key < 333) + 1 AS rank, bool_or(key = 333) AS found FROM kv")(lambda s, d: rank.rank_of(orders(s, d), "key", 333))
query("kv_ranks_of", WITH + "SELECT key, 1 + (SELECT count(*) FROM kv k WHERE k.key < w.key) AS rank, key IN (SELECT key FROM kv) AS found FROM (SELECT c_custkey * 7 AS key FROM customer) w")(
    lambda s, d: rank.ranks_of(orders(s, d).select("key"), "key", table(s, d, "customer").select((F.col("c_custkey") * 7).alias("key")))
)
query("kv_by_rank", WITH + "SELECT * FROM kv ORDER BY key LIMIT 1 OFFSET 49")(lambda s, d: rank.by_rank(orders(s, d), "key", 50))
query("kv_prev_next", WITH + "SELECT max(key) FILTER (key < 100) AS prev, min(key) FILTER (key > 100) AS next FROM kv")(lambda s, d: rank.neighbours(orders(s, d), "key", 100))
query("kv_first_last", WITH + "SELECT min(key) AS first, max(key) AS last FROM kv")(lambda s, d: rank.ends(orders(s, d), "key"))
query("kv_take_smallest", WITH + "SELECT * FROM kv WHERE key > (SELECT min(key) FROM kv)")(lambda s, d: rank.without_smallest(orders(s, d), "key"))
query("kv_take_largest", WITH + "SELECT * FROM kv WHERE key < (SELECT max(key) FROM kv)")(lambda s, d: rank.without_largest(orders(s, d), "key"))
query("kv_numbered", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) + 99 AS id FROM customer")(
    lambda s, d: merge.numbered(table(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], 100).drop("c_acctbal")
)


def _halves(s, d):
    kv_ = orders(s, d)
    return kv_.filter("key <= 8000"), kv_.filter("key >= 4000").withColumn("value", F.when(F.col("key") % 11 == 0, F.col("value") + 1).otherwise(F.col("value"))).withColumn("vsn", F.when(F.col("key") % 11 == 0, 3).otherwise(F.col("vsn")))


_HALF = "SELECT key FROM kv WHERE key <= 8000), r AS (SELECT key FROM kv WHERE key >= 4000) "
_SETS = f"WITH kv AS ({KV}), l AS ({_HALF}"
query("set_union", _SETS + "SELECT key FROM l UNION SELECT key FROM r")(lambda s, d: setops.union(*(h.select("key") for h in _halves(s, d))))
query("set_compare", _SETS + "SELECT coalesce(l.key, r.key) AS key, CASE WHEN l.key IS NULL THEN 'right' WHEN r.key IS NULL THEN 'left' ELSE 'both' END AS side FROM l FULL JOIN r ON l.key = r.key")(
    lambda s, d: setops.compare(*_halves(s, d), "key")
)
query("set_odd_members", _SETS + "SELECT key FROM (SELECT key FROM l UNION ALL SELECT key FROM r) GROUP BY key HAVING count(*) % 2 = 1")(lambda s, d: setops.odd_members(list(_halves(s, d)), "key"))
query(
    "replica_diff",
    WITH + "SELECT key, CASE WHEN key < 4000 THEN 'missing_right' WHEN key > 8000 THEN 'missing_left' ELSE 'older_left' END AS state FROM kv WHERE key < 4000 OR key > 8000 OR key % 11 = 0",
)(lambda s, d: setops.replica_diff(*_halves(s, d)))
query("replica_repair", WITH + "SELECT key, CASE WHEN key >= 4000 AND key % 11 = 0 THEN value + 1 ELSE value END AS value, CASE WHEN key >= 4000 AND key % 11 = 0 THEN 3 ELSE 2 END AS vsn, time FROM kv")(
    lambda s, d: setops.repair(*_halves(s, d), 64)
)
query("replica_digest_size", WITH + "SELECT min(key) AS first, max(key) AS last, count(*) AS size FROM kv")(lambda s, d: setops.digest(orders(s, d)).drop("hash"))
query("replica_digest")(lambda s, d: setops.digest(orders(s, d)))
query(
    "interval_overlap",
    "SELECT o_orderkey, greatest(o_orderkey, 500) AS \"start\", least(o_orderkey + o_custkey, 900) AS \"end\" FROM orders WHERE greatest(o_orderkey, 500) <= least(o_orderkey + o_custkey, 900)",
)(
    lambda s, d: table(s, d, "orders")
    .select("o_orderkey", setops.overlap(F.col("o_orderkey"), F.col("o_orderkey") + F.col("o_custkey"), F.lit(500).cast("long"), F.lit(900).cast("long")).alias("x"))
    .filter("x IS NOT NULL")
    .select("o_orderkey", "x.*")
)
query("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")(lambda s, d: rank.top(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20))
query("top_n_distinct", "SELECT p_size, min(p_partkey) AS p_partkey FROM part GROUP BY p_size ORDER BY p_size DESC LIMIT 10")(lambda s, d: rank.top(table(s, d, "part").select("p_size", "p_partkey"), "p_size", 10, distinct_values=True))


@query("kv_clear", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS after FROM orders")
def kv_clear(spark, d):
    rest, before = kv.cleared(orders(spark, d))
    return before.join(F.broadcast(rest.agg(F.count("*").alias("after"))))


query("kv_estimate_count", "SELECT count(*) AS estimate FROM orders")(lambda s, d: kv.estimate_count(orders(s, d), 1.0))


@query(
    "interval_overlap_rests",
    """WITH i AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) AS a, CAST(l_linenumber + l_quantity AS BIGINT) AS z, CAST(l_suppkey % 20 AS BIGINT) AS b, CAST(l_suppkey % 20 + l_partkey % 30 AS BIGINT) AS y FROM lineitem)
    SELECT l_orderkey, l_linenumber,
      CASE WHEN z < b OR y < a THEN '[' || a || ',' || z || ']' WHEN a < b THEN '[' || a || ',' || b || ')' WHEN b < a THEN '[' || b || ',' || a || ')' END AS before,
      CASE WHEN z >= b AND y >= a THEN '[' || greatest(a, b) || ',' || least(z, y) || ']' END AS common,
      CASE WHEN z < b OR y < a THEN '[' || b || ',' || y || ']' WHEN z < y THEN '(' || z || ',' || y || ']' WHEN y < z THEN '(' || y || ',' || z || ']' END AS after FROM i""",
)
def interval_overlap_rests(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CAST(l_linenumber AS LONG) AS a", "CAST(l_linenumber + l_quantity AS LONG) AS z", "CAST(l_suppkey % 20 AS LONG) AS b", "CAST(l_suppkey % 20 + l_partkey % 30 AS LONG) AS y")
    parts = rows.select("l_orderkey", "l_linenumber", setops.overlap_rests(F.col("a"), F.col("z"), F.col("b"), F.col("y")).alias("o"))
    shown = "concat(if(o.{0}.start_closed, '[', '('), o.{0}.start, ',', o.{0}.end, if(o.{0}.end_closed, ']', ')')) AS {0}"
    return parts.selectExpr("l_orderkey", "l_linenumber", *[f"if(o.{x} IS NULL, NULL, {shown.format(x).rsplit(' AS ', 1)[0]}) AS {x}" for x in ("before", "common", "after")])


query("replica_digest_diff", "SELECT 'last,size,hash' AS unequal")(
    lambda s, d: setops.digest_diff(orders(s, d), orders(s, d).join(F.broadcast(orders(s, d).agg(F.max("key").alias("most"))), F.col("key") < F.col("most")).drop("most")).select(F.array_join("unequal", ",").alias("unequal"))
)
query("set_split_count", "SELECT o_orderkey, CAST(CASE WHEN o_custkey > 0 AND o_orderkey >= o_custkey THEN o_orderkey // nullif(o_custkey, 0) ELSE o_orderkey END AS BIGINT) AS n FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", setops.split_count(F.col("o_orderkey"), F.col("o_custkey")).alias("n"))
)
query("set_shuffled", "SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:' || o_orderkey)) AS place FROM orders")(lambda s, d: setops.shuffled(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 7))
query("set_merge_maps", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS a, 'y' AS b, o_orderstatus AS c FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", setops.merge_maps(F.create_map(F.lit("a"), F.col("o_custkey").cast("string"), F.lit("b"), F.lit("y")), F.create_map(F.lit("b"), F.lit("z"), F.lit("c"), F.col("o_orderstatus"))).alias("m"))
    .selectExpr("o_orderkey", "m['a'] AS a", "m['b'] AS b", "m['c'] AS c")
)
LOADS = "SELECT s_nationkey, count(*) AS n, count(*) // 2 AS load FROM supplier GROUP BY s_nationkey"
CANDIDATES = f"WITH l AS ({LOADS}), c AS (SELECT * FROM l WHERE load <= (SELECT max(load) FROM (SELECT load FROM l ORDER BY load LIMIT 4))) "


def loads(s, d):
    return table(s, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))


query("least_loaded_candidates", CANDIDATES + "SELECT * FROM c")(lambda s, d: rank.least_loaded(loads(s, d), "n", 2, 4))
query("least_loaded_choice", CANDIDATES + "SELECT * FROM c ORDER BY md5('3:' || s_nationkey) LIMIT 1")(lambda s, d: rank.choose(rank.least_loaded(loads(s, d), "n", 2, 4), "s_nationkey", 3))
query("kv_restore_counts", _WCH + "SELECT count(*) FILTER (WHERE kv.key IS NULL) AS added, count(*) FILTER (WHERE kv.key IS NOT NULL AND ch.key IS NOT NULL) AS replaced, count(*) FILTER (WHERE ch.key IS NULL) AS kept FROM kv FULL JOIN ch ON kv.key = ch.key")(
    lambda s, d: merge.restore_counts(orders(s, d), _changes(s, d, 5))
)


@query("kv_super_transaction", WITH + "SELECT key, CASE WHEN value < 50000 THEN value * 2 + 1 ELSE value END AS value, CAST(CASE WHEN value < 50000 THEN 3 ELSE 2 END AS INTEGER) AS vsn, CASE WHEN value < 50000 THEN 7 ELSE time END AS time FROM kv WHERE value < 150000")
def kv_super_transaction(spark, d):
    doubled = lambda t: {"orders": t["orders"].filter("value < 50000").select("key", (F.col("value") * 2).alias("value"))}
    raised = lambda t: {"orders": t["orders"].filter("vsn = 3").select("key", (F.col("value") + 1).alias("value"))}
    dropped = lambda t: {"orders": t["orders"].filter("value >= 150000").select("key", F.lit(None).cast("double").alias("value"))}
    return merge.super_transaction({"orders": orders(spark, d)}, [doubled, raised, dropped], 7)[0]["orders"]


query("kv_super_transaction_broken", KV)(
    lambda s, d: merge.super_transaction({"orders": orders(s, d)}, [lambda t: {"orders": t["orders"].select("key", F.lit(0.0).alias("value"))}, lambda t: None], 7)[0]["orders"]
)


def _by_value(value, vsn, time):
    action = F.when(value.isNull() | (value < 50000), "update").when(value > 200000, "delete").otherwise("keep")
    return action, F.coalesce(value, F.lit(0.0)) + 1, F.when(value.isNull() | (value < 100000), F.coalesce(value, F.lit(-1.0)))


_ASKED = WITH + ", k AS (SELECT DISTINCT key + 1 AS key FROM kv), b AS (SELECT coalesce(kv.key, k.key) AS key, value, vsn, time, k.key IS NOT NULL AS asked FROM kv FULL JOIN k ON kv.key = k.key) "


def _asked(spark, d):
    return merge.dynamic_write(orders(spark, d), orders(spark, d).select((F.col("key") + 1).alias("key")), _by_value, 9)


query(
    "kv_dynamic_write",
    _ASKED + """SELECT key, CASE WHEN asked AND coalesce(value, 0) < 50000 THEN coalesce(value, 0) + 1 ELSE value END AS value,
    CAST(CASE WHEN asked AND coalesce(value, 0) < 50000 THEN coalesce(vsn, 1) + 1 ELSE vsn END AS INTEGER) AS vsn,
    CASE WHEN asked AND coalesce(value, 0) < 50000 THEN 9 ELSE time END AS time FROM b WHERE NOT (asked AND coalesce(value, 0) > 200000)""",
)(lambda s, d: _asked(s, d)[0])
query(
    "kv_dynamic_replies",
    _ASKED + """SELECT key, coalesce(value, -1) AS reply, CAST(coalesce(vsn, 1) + CASE WHEN coalesce(value, 0) < 50000 THEN 1 ELSE 0 END AS INTEGER) AS vsn,
    CASE WHEN coalesce(value, 0) < 50000 THEN 9 ELSE time END AS time FROM b WHERE asked AND coalesce(value, 0) < 100000""",
)(lambda s, d: _asked(s, d)[1])
