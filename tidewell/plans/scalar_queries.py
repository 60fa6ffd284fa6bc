"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import scalars as S
from tidewell.plans.catalogue import query
from tidewell.sources.tables import table


def _of(name, *columns):
    """A query that selects ``columns`` (builders) from a table."""
    return lambda s, d: table(s, d, name).select(*(c() if callable(c) else c for c in columns))


query("str_filter", "SELECT p_partkey, regexp_replace(p_name, '[^a-z0-9]', '', 'g') AS v FROM part")(_of("part", "p_partkey", lambda: S.keep_characters(F.col("p_name"), "a-z0-9").alias("v")))
query("str_replace", "SELECT p_partkey, translate(p_brand, '#', '-') AS v FROM part")(_of("part", "p_partkey", lambda: F.translate("p_brand", "#", "-").alias("v")))
query("str_split_first", "SELECT c_custkey, split_part(c_name, '#', 1) AS head, CASE WHEN contains(c_name, '#') THEN substr(c_name, instr(c_name, '#') + 1) END AS tail FROM customer")(
    lambda s, d: table(s, d, "customer").select("c_custkey", S.split_first(F.col("c_name"), "#").alias("x")).select("c_custkey", "x.*")
)
query("str_split_nonempty", "SELECT p_partkey, array_to_string(regexp_extract_all(p_type, '[^ ]+'), '|') AS v FROM part")(_of("part", "p_partkey", lambda: F.array_join(S.split_nonempty(F.col("p_type"), " "), "|").alias("v")))
query("str_pad", "SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 6, '0') AS v FROM part")(_of("part", "p_partkey", lambda: S.padded(F.col("p_size"), 6).alias("v")))
query("str_ranges", "SELECT p_partkey FROM part WHERE p_size IN (1, 2, 3, 7, 20, 21, 22)")(lambda s, d: table(s, d, "part").filter(S.in_ranges(F.col("p_size"), F.lit("1-3,7,20-22"))).select("p_partkey"))
query("str_match_count", "SELECT doc_id, CAST((length(text) - length(replace(text, 'th', ''))) / 2 AS INTEGER) AS v FROM documents")(_of("documents", "doc_id", lambda: S.match_count(F.col("text"), "th").alias("v")))
query("str_join", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS v FROM orders GROUP BY o_custkey")(
    lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("v"))
)
query("enc_hex", "SELECT c_custkey, hex(c_name) AS v FROM customer")(_of("customer", "c_custkey", lambda: F.hex("c_name").alias("v")))
query("enc_base64", "SELECT c_custkey, base64(encode(c_name)) AS v FROM customer")(_of("customer", "c_custkey", lambda: F.base64(F.encode("c_name", "UTF-8")).alias("v")))
query("enc_base58_round_trip", "SELECT c_custkey, c_name AS v FROM customer")(_of("customer", "c_custkey", lambda: F.decode(S.base58_decode(S.base58_encode(F.encode("c_name", "UTF-8"))), "UTF-8").alias("v")))
query("enc_base58")(_of("customer", "c_custkey", lambda: S.base58_encode(F.encode("c_name", "UTF-8")).alias("v")))
query("enc_deflate_round_trip", "SELECT doc_id, md5(text) AS v FROM documents")(_of("documents", "doc_id", lambda: F.md5(S.inflate(S.deflate(F.encode("text", "UTF-8")))).alias("v")))
query("enc_gzip_round_trip", "SELECT doc_id, md5(text) AS v FROM documents")(_of("documents", "doc_id", lambda: F.md5(S.gunzipped(S.gzipped(F.encode("text", "UTF-8")))).alias("v")))
query("enc_xor_round_trip", "SELECT c_custkey, c_name AS v FROM customer")(
    _of("customer", "c_custkey", lambda: F.decode(S.xor_bytes(S.xor_bytes(F.encode("c_name", "UTF-8"), F.lit(b"key")), F.lit(b"key")), "UTF-8").alias("v"))
)
query("hash_md5", "SELECT c_custkey, md5(c_name) AS v FROM customer")(_of("customer", "c_custkey", lambda: F.md5("c_name").alias("v")))
query("hash_sha256", "SELECT c_custkey, sha256(c_name) AS v FROM customer")(_of("customer", "c_custkey", lambda: F.sha2("c_name", 256).alias("v")))
query("hash_crc32")(_of("customer", "c_custkey", lambda: F.crc32("c_name").alias("v")))
query("crypt_aes_round_trip", "SELECT c_custkey, c_name AS v FROM customer")(
    _of("customer", "c_custkey", lambda: F.decode(F.aes_decrypt(F.aes_encrypt("c_name", F.lit("0123456789abcdef"), F.lit("ECB"), F.lit("PKCS")), F.lit("0123456789abcdef"), F.lit("ECB"), F.lit("PKCS")), "UTF-8").alias("v"))
)
query("math_rounding", "SELECT p_partkey, CAST(ceil(p_retailprice) AS BIGINT) AS up, CAST(floor(p_retailprice) AS BIGINT) AS down, round(trunc(p_retailprice * 10) / 10, 6) AS cut FROM part")(
    _of("part", "p_partkey", lambda: F.ceil("p_retailprice").alias("up"), lambda: F.floor("p_retailprice").alias("down"), lambda: F.round(S.truncated(F.col("p_retailprice"), 1), 6).alias("cut"))
)
query("math_log2", "SELECT o_orderkey, CAST(length(bin(o_orderkey + 1)) - 1 AS INTEGER) AS v FROM orders")(_of("orders", "o_orderkey", lambda: S.integer_log2(F.col("o_orderkey") + 1).alias("v")))
query(
    "math_prime",
    "WITH r AS (SELECT unnest(range(2, (SELECT CAST(floor(sqrt(max(o_orderkey))) AS BIGINT) + 2 FROM orders))) AS k) SELECT o_orderkey FROM orders o WHERE o_orderkey >= 2 AND NOT EXISTS (SELECT 1 FROM r WHERE k < o.o_orderkey AND o.o_orderkey % k = 0)",
)(lambda s, d: table(s, d, "orders").filter(S.is_prime(F.col("o_orderkey"))).select("o_orderkey"))
query("math_fibonacci", "WITH RECURSIVE f(n, a, b) AS (SELECT 0, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 24) SELECT n_nationkey, a AS v FROM nation JOIN f ON n = n_nationkey")(
    _of("nation", "n_nationkey", lambda: S.fibonacci(F.col("n_nationkey")).alias("v"))
)
query("math_random", "SELECT o_orderkey, (o_orderkey * 16807) % 2147483647 AS v FROM orders")(_of("orders", "o_orderkey", lambda: S.next_random(F.col("o_orderkey")).alias("v")))
query("math_matrix_power", "SELECT n_nationkey, CAST(1 AS DOUBLE) AS a, CAST(3 * n_nationkey AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c, CAST(1 AS DOUBLE) AS d FROM nation")(
    lambda s, d: table(s, d, "nation").select("n_nationkey", S.matrix_power(F.lit(1.0), F.col("n_nationkey").cast("double"), F.lit(0.0), F.lit(1.0), 3).alias("m")).select("n_nationkey", "m.*")
)
query("math_factorial", "SELECT n_nationkey, CAST(factorial(n_nationkey % 15) AS BIGINT) AS v FROM nation")(_of("nation", "n_nationkey", lambda: F.factorial(F.col("n_nationkey") % 15).alias("v")))
query("list_sum_product", "SELECT p_partkey, CAST(p_size + 3 AS BIGINT) AS total, CAST(p_size * 2 AS BIGINT) AS product FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.array(F.col("p_size").cast("long"), F.lit(1).cast("long"), F.lit(2).cast("long")).alias("l")).select(
        "p_partkey", F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.aggregate("l", F.lit(1).cast("long"), lambda a, x: a * x).alias("product")
    )
)
query("list_edit", "SELECT p_partkey, CASE WHEN p_size = 1 THEN '9,2' ELSE '9,' || p_size || ',2' END AS v FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(F.array_insert(F.array_remove(F.array("p_size", F.lit(1), F.lit(2)), 1), 1, F.lit(9)).cast("array<string>"), ",").alias("v"))
)
query("list_distinct", "SELECT p_partkey, CASE WHEN p_size = 5 THEN '5' ELSE p_size || ',5' END AS v FROM part")(_of("part", "p_partkey", lambda: F.array_join(F.array_distinct(F.array("p_size", F.lit(5), "p_size")).cast("array<string>"), ",").alias("v")))
query("json_encode", "SELECT r_regionkey, '{\"id\":' || r_regionkey || ',\"name\":\"' || r_name || '\"}' AS v FROM region")(_of("region", "r_regionkey", lambda: F.to_json(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))).alias("v")))
query("json_get", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS v FROM events WHERE json_valid(props) AND len(json_keys(props)) = 1")(
    lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m")).filter("size(m) = 1").select("event_id", F.map_values("m")[0].alias("v"))
)
query("json_equal", "SELECT r_regionkey FROM region")(
    lambda s, d: table(s, d, "region").filter(S.json_equal(F.format_string('{"a":%d,"b":"x"}', "r_regionkey"), F.format_string('{"b":"x", "a":%d}', "r_regionkey"))).select("r_regionkey")
)
query("json_edit", "SELECT r_regionkey, '{\"a\":\"1\",\"c\":\"' || r_name || '\"}' AS v FROM region")(_of("region", "r_regionkey", lambda: S.json_with(S.json_without(F.lit('{"a":"1","b":"2"}'), "b"), "c", F.col("r_name")).alias("v")))
_NESTED = """'{"id":' || o_orderkey || ',"tags":[1,"' || o_orderstatus || '",null],"in":{"x":' || o_custkey || ',"y":{"p":true}}}'"""
query("json_nested_equal", "SELECT o_orderkey, o_orderkey % 3 = 0 AS same, false AS typed FROM orders")(
    lambda s, d: table(s, d, "orders").selectExpr("o_orderkey", f"{_NESTED} AS a", """'{"in":{"y":{"p":true},"x":' || if(o_orderkey % 3 = 0, o_custkey, -1) || '}, "tags":[1,"' || o_orderstatus || '",null], "id":' || o_orderkey || '}' AS b""", """'{"id":"' || o_orderkey || '"}' AS t""", """'{"id":' || o_orderkey || '}' AS u""")
    .select("o_orderkey", S.json_equal(F.col("a"), F.col("b")).alias("same"), S.json_equal(F.col("t"), F.col("u")).alias("typed"))
)
query("json_nested_get", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS x, '\"' || o_orderstatus || '\"' AS tag, CAST(NULL AS VARCHAR) AS gone FROM orders")(
    lambda s, d: table(s, d, "orders").selectExpr("o_orderkey", f"{_NESTED} AS a").select("o_orderkey", S.json_get(F.col("a"), "in", "x").alias("x"), S.json_get(F.col("a"), "tags", 1).alias("tag"), S.json_get(F.col("a"), "in", "z").alias("gone"))
)
query("json_edit_typed", "SELECT o_orderkey, '{\"id\":' || o_orderkey || ',\"in\":{\"x\":' || o_custkey || ',\"y\":{\"p\":true}},\"n\":' || o_custkey || '}' AS v FROM orders")(
    lambda s, d: table(s, d, "orders").selectExpr("o_orderkey", "o_custkey", f"{_NESTED} AS a").select("o_orderkey", S.json_with(S.json_without(F.col("a"), "tags"), "n", F.col("o_custkey")).alias("v"))
)
query("url_query_repeated", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS last, '1,' || o_custkey AS every FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.concat(F.lit("a=1&b=x%20y&a="), F.col("o_custkey")).alias("q")).select("o_orderkey", S.query_map(F.col("q"))["a"].alias("last"), F.array_join(S.query_values(F.col("q"), "a"), ",").alias("every"))
)
query("url_cookies", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS sid, 'b=c' AS a FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", S.cookies(F.concat(F.lit("a=b=c;  sid="), F.col("o_orderkey"))).alias("m")).select("o_orderkey", F.col("m")["sid"].alias("sid"), F.col("m")["a"].alias("a"))
)
query("url_byte_range", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) AS first, CAST(least(l_linenumber + 2, l_quantity - 1) AS BIGINT) AS last, CAST(greatest(l_quantity - 5, 0) AS BIGINT) AS tail FROM lineitem WHERE l_linenumber < l_quantity")(
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.byte_range(F.concat(F.lit("bytes="), "l_linenumber", F.lit("-"), F.col("l_linenumber") + 2), F.col("l_quantity").cast("long")).alias("r"), S.byte_range(F.lit("bytes=-5"), F.col("l_quantity").cast("long")).alias("t"))
    .filter("r IS NOT NULL").select("l_orderkey", "l_linenumber", "r.first", "r.last", F.col("t.first").alias("tail"))
)
query("url_parts", r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS protocol, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")(
    lambda s, d: table(s, d, "pages").select("page_id", S.url_parts(F.col("url")).alias("u")).select("page_id", "u.protocol", "u.host")
)
query("url_query", "SELECT r_regionkey, 'a b' AS q, CAST(r_regionkey AS VARCHAR) AS n FROM region")(
    lambda s, d: table(s, d, "region").select("r_regionkey", S.query_map(F.concat(F.lit("q=a+b&n="), F.col("r_regionkey"), F.lit("&flag"))).alias("m")).selectExpr("r_regionkey", "m['q'] AS q", "m['n'] AS n")
)
query("time_http_date", "SELECT o_orderkey, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') AS v FROM orders")(_of("orders", "o_orderkey", lambda: S.http_date(F.col("o_orderdate")).alias("v")))
query("time_seconds", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS v, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy FROM orders")(
    _of("orders", "o_orderkey", lambda: F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("v"), lambda: F.dayofyear("o_orderdate").alias("doy"))
)
query("text_template", "SELECT n_nationkey, '<b>' || n_name || '</b> ' || n_regionkey AS v FROM nation")(
    _of("nation", "n_nationkey", lambda: S.filled("<b><!--{#name/}--></b> <!--{#region/}-->", {"name": F.col("n_name"), "region": F.col("n_regionkey")}).alias("v"))
)
query("agg_load", "SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY s_nationkey")(
    lambda s, d: table(s, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))
)
query("agg_age_buckets", "SELECT CAST(length(bin(o_orderkey + 1)) - 1 AS INTEGER) AS bucket, count(*) AS n FROM orders GROUP BY ALL")(
    lambda s, d: table(s, d, "orders").groupBy(S.integer_log2(F.col("o_orderkey") + 1).alias("bucket")).agg(F.count("*").alias("n"))
)
query("agg_frequencies", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")(lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")))
query("list_fold_until", "SELECT o_orderkey, CASE WHEN o_orderkey >= 100 THEN o_orderkey WHEN o_orderkey + o_custkey >= 100 THEN o_orderkey + o_custkey ELSE o_orderkey + o_custkey + 7 END AS v FROM orders")(
    _of("orders", "o_orderkey", lambda: S.fold_until(F.array("o_orderkey", "o_custkey", F.lit(7).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x, lambda a: a >= 100).alias("v"))
)
query("tuple_columns", "SELECT o_orderkey, o_custkey AS second, o_custkey || ',' || o_orderkey AS swapped, '0,' || o_custkey || ',9' AS changed FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.array("o_orderkey", "o_custkey", F.lit(5).cast("long")).alias("t")).select(
        "o_orderkey", S.get_column(F.col("t"), 2).alias("second"), F.array_join(S.get_column(F.col("t"), [2, 1]).cast("array<string>"), ",").alias("swapped"),
        F.array_join(S.set_column(F.col("t"), [1, 3], [F.lit(0).cast("long"), F.lit(9).cast("long")]).cast("array<string>"), ",").alias("changed"),
    )
)
query("hash_password", "SELECT c_custkey, md5(c_name || ' 7 ' || md5(c_name || ' 200 ' || 'none')) AS v FROM customer")(_of("customer", "c_custkey", lambda: S.password(F.col("c_name"), [200, 7]).alias("v")))
query("hash_double", "SELECT o_orderkey, (o_orderkey % 97 + (o_custkey % 5) * (1 + o_orderkey % 96)) % 97 AS v FROM orders")(_of("orders", "o_orderkey", lambda: S.double_hash(F.col("o_orderkey"), 97, F.col("o_custkey") % 5).alias("v")))
