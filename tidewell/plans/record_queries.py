"""Queries of attribute records: parts and customers play the records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import conditions
from tidewell.operators import records
from tidewell.plans.catalogue import query
from tidewell.sources.tables import table

COLUMNS = "p_partkey AS id, p_brand AS brand, p_size AS size, p_retailprice AS price"
REC = f"SELECT {COLUMNS} FROM part"


def parts(s, d):
    return table(s, d, "part").selectExpr(*COLUMNS.split(", "))


def _sparse(s, d):
    """Parts whose price is absent where the size is a multiple of 5, and a list of the digits of the size."""
    return parts(s, d).withColumn("price", F.when(F.col("size") % 5 != 0, F.col("price"))).withColumn("digits", F.split(F.col("size").cast("string"), ""))


_SPARSE = "SELECT p_partkey AS id, p_brand AS brand, p_size AS size, CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS price FROM part"

for _name, _rule, _sql in (
    ("eq", ("size", 7), "size = 7"),
    ("has", ("price", "has"), "price IS NOT NULL"),
    ("lacks", ("price", "lacks"), "price IS NULL"),
    ("in", ("size", "in", [1, 5, 9]), "size IN (1, 5, 9)"),
    ("out", ("price", "out", [1.0, 2.0]), "price IS NOT NULL"),
    ("gt", ("price", ">", 1000.0), "price > 1000"),
    ("ge", ("size", ">=", 40), "size >= 40"),
    ("lt", ("size", "<", 4), "size < 4"),
    ("le", ("price", "<=", 950.0), "price <= 950"),
    ("ne", ("price", "!=", 950.0), "price <> 950"),
    ("between", ("size", "between", 10, 20), "size BETWEEN 10 AND 20"),
    ("outside", ("size", "outside", 10, 40), "size < 10 OR size > 40"),
    ("member", ("digits", "member", "3"), "contains(CAST(size AS VARCHAR), '3')"),
    ("notmember", ("digits", "notmember", "3"), "NOT contains(CAST(size AS VARCHAR), '3')"),
    ("test", ("brand", "test", lambda c: F.length(c) > 7), "length(brand) > 7"),
    ("all_of", [("size", ">", 10), ("price", "has"), ("price", "<", 1200.0)], "size > 10 AND price < 1200"),
):
    query(f"rec_{_name}", f"SELECT id, brand, size, price FROM ({_SPARSE}) WHERE {_sql}")(lambda s, d, rule=_rule: records.select(_sparse(s, d), rule if isinstance(rule, list) else [rule]).drop("digits"))

query("rec_order_up", f"SELECT * FROM ({_SPARSE}) WHERE price BETWEEN 900 AND 1500 ORDER BY price, id LIMIT 25")(lambda s, d: records.select(_sparse(s, d).drop("digits"), [], ("price", 900.0, 1500.0, 25)))
query("rec_order_down", f"SELECT * FROM ({_SPARSE}) WHERE price BETWEEN 900 AND 1500 AND size > 3 ORDER BY price DESC, id LIMIT 25")(lambda s, d: records.select(_sparse(s, d).drop("digits"), [("size", ">", 3)], ("price", 1500.0, 900.0, 25)))
query("rec_restrict", f"SELECT * FROM ({REC}) WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")(lambda s, d: records.restrict(parts(s, d), table(s, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("id"))))


def _told(df):
    """The diff as text, so that any engine can compare it."""
    one = F.transform("diff", lambda x: F.concat_ws(":", x["key"], x["kind"]))
    return df.withColumn("diff", F.array_join(one, ","))


_UPD = "SELECT id, brand, size, {price} AS price, {diff} AS diff FROM (" + _SPARSE + ")"
for _name, _change, _price, _diff in (
    ("set", ("set", 5.0), "CASE WHEN size < 9 THEN 5.0 ELSE price END", "CASE WHEN size < 9 THEN CASE WHEN price IS NULL THEN 'price:insert' WHEN price <> 5 THEN 'price:modify' ELSE '' END ELSE '' END"),
    ("drop", ("drop",), "CASE WHEN size < 9 THEN NULL ELSE price END", "CASE WHEN size < 9 AND price IS NOT NULL THEN 'price:delete' ELSE '' END"),
    ("add", ("+", 2.5), "CASE WHEN size < 9 THEN price + 2.5 ELSE price END", "CASE WHEN size < 9 AND price IS NOT NULL THEN 'price:modify' ELSE '' END"),
    ("subtract", ("-", 2.5), "CASE WHEN size < 9 THEN price - 2.5 ELSE price END", "CASE WHEN size < 9 AND price IS NOT NULL THEN 'price:modify' ELSE '' END"),
    ("multiply", ("*", 2.0), "CASE WHEN size < 9 THEN price * 2 ELSE price END", "CASE WHEN size < 9 AND price IS NOT NULL THEN 'price:modify' ELSE '' END"),
    ("divide", ("/", 2.0), "CASE WHEN size < 9 THEN price / 2 ELSE price END", "CASE WHEN size < 9 AND price IS NOT NULL THEN 'price:modify' ELSE '' END"),
    ("apply", ("apply", lambda c: F.floor(c).cast("double")), "CASE WHEN size < 9 THEN floor(price) ELSE price END", "CASE WHEN size < 9 AND price <> floor(price) THEN 'price:modify' ELSE '' END"),
):
    query(f"rec_update_{_name}", _UPD.format(price=_price, diff=_diff))(lambda s, d, change=_change: _told(records.update(_sparse(s, d).drop("digits"), [("size", "<", 9)], {"price": change})))

query("rec_delete", f"SELECT * FROM ({REC}) WHERE NOT size > 30")(lambda s, d: records.delete(parts(s, d), [("size", ">", 30)])[0])
query("rec_deleted", f"SELECT * FROM ({REC}) WHERE size > 30")(lambda s, d: records.delete(parts(s, d), [("size", ">", 30)])[1])
def _inserted(s, d):
    new = table(s, d, "supplier").select(F.col("s_name").alias("brand"), F.lit(0).alias("size"), F.col("s_acctbal").alias("price"))
    return records.insert(parts(s, d), new, ["brand", "price"])


query("rec_insert", f"SELECT * FROM ({REC}) UNION ALL SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY s_name, s_acctbal), s_name, 0, s_acctbal FROM supplier")(_inserted)

query("rec_attributes", "SELECT id, unnest(['brand', 'size']) AS attr, unnest([brand, CAST(size AS VARCHAR)]) AS value FROM (" + REC + ")")(lambda s, d: records.to_attributes(parts(s, d), ["brand", "size"]))
query("rec_from_attributes", "SELECT id, brand, CAST(size AS VARCHAR) AS size FROM (" + REC + ")")(lambda s, d: records.from_attributes(records.to_attributes(parts(s, d), ["brand", "size"]), ["brand", "size"]))
query("rec_template_defaults", f"SELECT id, CASE WHEN size < 5 THEN brand ELSE 'any' END AS brand, 'box' AS kind FROM ({REC})")(
    lambda s, d: records.with_defaults(parts(s, d).select("id", F.when(F.col("size") < 5, F.create_map(F.lit("brand"), "brand")).otherwise(F.create_map(F.lit("x"), "brand")).alias("o")), {"brand": "any", "kind": "box"}, "o").drop("o")
)
query("condition_tree", f"SELECT id FROM ({REC}) WHERE (size > 10 AND NOT price / 10 < 95) OR size * 2 = 6")(
    lambda s, d: parts(s, d).filter(conditions.compiled(("or", [("and", [(">", "size", 10), ("not", ("<", ("/", "price", 10), 95))]), ("=", ("*", "size", 2), 6)]))).select("id")
)
query("condition_arithmetic", f"SELECT id, size // 7 AS q, size % 7 AS r, CAST(power(size, 2) AS DOUBLE) AS p FROM ({REC})")(
    lambda s, d: parts(s, d).select("id", conditions.compiled(("div", "size", 7)).cast("int").alias("q"), conditions.compiled(("rem", "size", 7)).alias("r"), conditions.compiled(("^", "size", 2)).alias("p"))
)
query(
    "condition_division",
    "WITH n AS (SELECT o_orderkey, o_custkey - 7000 AS x, 9007199254740993 - o_orderkey AS y FROM orders) SELECT o_orderkey, CASE WHEN x < 0 THEN -((-x) // 7) ELSE x // 7 END AS q, CASE WHEN x < 0 THEN -((-x) % 7) ELSE x % 7 END AS r, y // 1 AS whole FROM n",
)(
    lambda s, d: table(s, d, "orders").selectExpr("o_orderkey", "o_custkey - 7000 AS x", "9007199254740993 - o_orderkey AS y").select(
        "o_orderkey", conditions.compiled(("div", "x", 7)).alias("q"), conditions.compiled(("rem", "x", 7)).alias("r"), conditions.compiled(("div", "y", 1)).alias("whole")
    )
)
query("condition_overload", f"SELECT id FROM ({REC}) WHERE contains(brand, CAST(size AS VARCHAR))")(lambda s, d: parts(s, d).filter(conditions.compiled(("+", "brand", "size"), {"+": lambda a, b: F.contains(a, b.cast("string"))})).select("id"))
query("rec_id_in", f"SELECT * FROM ({REC}) WHERE id IN (3, 5, 99999) OR id = 8")(lambda s, d: records.select(parts(s, d), [("id", "in", [3, 5, 8, 99999])]))
query("rec_id_test", f"SELECT * FROM ({REC}) WHERE id % 7 = 2")(lambda s, d: records.select(parts(s, d), [("id", "test", lambda c: c % 7 == 2)]))
