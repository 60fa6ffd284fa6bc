"""Queries of series, calendars and space."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import series, spatial
from tidewell.plans.catalogue import query
from tidewell.sources.tables import table

def _sums(s, d, when):
    return table(s, d, "events").filter(when).groupBy("user_id").agg(F.sum(F.floor("value")).alias("v"))


_UNTIL = "ts <= TIMESTAMP '2024-01-15 12:00:00'"
_PARTS = ", ".join(f"{name} AS (SELECT user_id, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS v FROM events WHERE {when} GROUP BY user_id)" for name, when in (("f", _UNTIL), ("l", f"NOT ({_UNTIL})")))
query("sample_difference", f"WITH {_PARTS} SELECT user_id, CASE WHEN f.v IS NULL THEN l.v WHEN l.v IS NULL THEN f.v ELSE l.v - f.v END AS v FROM f FULL JOIN l USING (user_id)")(
    lambda s, d: series.sample_difference(_sums(s, d, _UNTIL), _sums(s, d, f"NOT ({_UNTIL})"), "user_id", "v")
)
query("sample_steps", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS change FROM events")(
    lambda s, d: series.steps(table(s, d, "events"), "user_id", "event_id", "value").select("event_id", F.round("change", 6).alias("change"))
)


_LATER = 0.6180339887  # part of a step; at half of one, values often end in a 5 that engines round either way


def _points(s, d):
    return table(s, d, "events").select("user_id", F.col("event_id").cast("double").alias("t"), F.col("value").alias("v"))


def _wanted(s, d):
    return _points(s, d).select("user_id", (F.col("t") + _LATER).alias("t"))


_SEG = f"""WITH p AS (SELECT user_id, CAST(event_id AS DOUBLE) AS t, value AS v FROM events),
seg AS (SELECT user_id, t AS t0, lead(t) OVER w AS t1, v AS v0, lead(v) OVER w AS v1, coalesce(lag(v) OVER w, v) AS b, coalesce(lead(v, 2) OVER w, lead(v) OVER w) AS a FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)),
q AS (SELECT user_id, CAST(event_id AS DOUBLE) + CAST({_LATER} AS DOUBLE) AS t FROM events),
j AS (SELECT q.user_id, q.t, v0, v1, a, b, (q.t - t0) / (t1 - t0) AS x FROM q LEFT JOIN seg ON seg.user_id = q.user_id AND q.t > t0 AND q.t < t1) """
query("interpolate_linear", _SEG + "SELECT user_id, t, round(v0 + (v1 - v0) * x, 5) AS v FROM j")(
    lambda s, d: series.interpolate(_points(s, d), _wanted(s, d), "user_id", "t", "v").withColumn("v", F.round("v", 5))
)
query("interpolate_catmull_rom", _SEG + "SELECT user_id, t, round((2*x*x*x - 3*x*x + 1) * v0 + (x*x*x - 2*x*x + x) * (v1 - b) / 2 + (-2*x*x*x + 3*x*x) * v1 + (x*x*x - x*x) * (a - v0) / 2, 4) AS v FROM j")(
    lambda s, d: series.interpolate(_points(s, d), _wanted(s, d), "user_id", "t", "v", "catmull_rom").withColumn("v", F.round("v", 4))
)
query("timeline", "SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS t_to, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w - CAST(l_quantity AS BIGINT) AS BIGINT) AS t_from FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)")(
    lambda s, d: series.timeline(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("q")), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "q").drop("q", "l_partkey", "l_suppkey", "l_extendedprice")
)
query("timeline_cycle", "SELECT o_orderkey, o_orderkey % 360 AS phase FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", series.in_cycle(F.col("o_orderkey"), F.lit(360)).alias("phase")))
query("calendar_week_of_year", "SELECT o_orderkey, CAST((dayofyear(o_orderdate) - 1 + isodow(date_trunc('year', o_orderdate)) - 1) // 7 + 1 AS INTEGER) AS week FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", series.week_of_year(F.col("o_orderdate").cast("timestamp")).alias("week"))
)
query("calendar_week_of_month", "SELECT o_orderkey, CAST((day(o_orderdate) - 1 + isodow(date_trunc('month', o_orderdate)) - 1) // 7 + 1 AS INTEGER) AS week FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", series.week_of_month(F.col("o_orderdate").cast("timestamp")).alias("week"))
)
for _name, _rules, _sql in (
    ("day", {"d": 8}, "day(o_orderdate) = 8"),
    ("month_days", {"m": 8, "d": [8, 12]}, "month(o_orderdate) = 8 AND day(o_orderdate) IN (8, 12)"),
    ("weekend", {"m": 8, "w": 1, "dw": [6, 7]}, "month(o_orderdate) = 8 AND (day(o_orderdate) - 1 + isodow(date_trunc('month', o_orderdate)) - 1) // 7 + 1 = 1 AND isodow(o_orderdate) IN (6, 7)"),
    ("day_of_year", {"y": 1996, "dy": 108}, "year(o_orderdate) = 1996 AND dayofyear(o_orderdate) = 108"),
):
    query(f"calendar_match_{_name}", f"SELECT o_orderkey FROM orders WHERE {_sql}")(lambda s, d, rules=_rules: table(s, d, "orders").filter(series.matches_calendar(F.col("o_orderdate").cast("timestamp"), rules)).select("o_orderkey"))
query("calendar_strongest", "SELECT event_id FROM (SELECT event_id, user_id % 5 AS level, max(user_id % 5) OVER (PARTITION BY CAST(ts AS DATE)) AS best FROM events) WHERE level = best")(
    lambda s, d: series.strongest_per_day(table(s, d, "events").withColumn("level", F.col("user_id") % 5), "ts", "level").select("event_id")
)

query("spatial_box", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount BETWEEN 0.02 AND 0.05")(
    lambda s, d: table(s, d, "lineitem").filter(spatial.in_box({"l_quantity": (10.0, 12.0), "l_discount": (0.02, 0.05)})).select("l_orderkey", "l_linenumber")
)
_CENTRE = [0.1, -0.2, 0.05]
_DIST = "sqrt(" + " + ".join(f"power(CAST(embedding[{i + 1}] AS DOUBLE) - ({x}), 2)" for i, x in enumerate(_CENTRE)) + ")"
query("spatial_within", f"SELECT vec_id, round({_DIST}, 6) AS distance FROM embeddings WHERE {_DIST} <= 0.25")(
    lambda s, d: spatial.within(table(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("e")), "e", _CENTRE, 0.25).select("vec_id", F.round("distance", 6).alias("distance"))
)
query("spatial_nearest", f"SELECT vec_id, round({_DIST}, 6) AS distance FROM embeddings ORDER BY {_DIST}, vec_id LIMIT 15")(
    lambda s, d: spatial.nearest(table(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("e")), "e", _CENTRE, 15, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))
)


def _boxes(s, d):
    at = F.col("n_nationkey")
    return table(s, d, "nation").select("n_nationkey", at.cast("double").alias("min_x"), (at + 3).cast("double").alias("max_x"), (at % 5).cast("double").alias("min_y"), (at % 5 + 4).cast("double").alias("max_y"))


_BOX = "b AS (SELECT n_nationkey, n_nationkey AS x0, n_nationkey + 3 AS x1, n_nationkey % 5 AS y0, n_nationkey % 5 + 4 AS y1 FROM nation)"
query("spatial_locate", f"WITH {_BOX} SELECT p_partkey, n_nationkey FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice / 200 AS y FROM part) JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")(
    lambda s, d: spatial.locate(table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 200).alias("y")), _boxes(s, d), ["x", "y"], 2.0).select("p_partkey", "n_nationkey")
)
query("spatial_line", f"WITH {_BOX} SELECT n_nationkey FROM b WHERE greatest(0, (x0 - 0) / 20.0, (y0 - 1) / 6.0) <= least(1, (x1 - 0) / 20.0, (y1 - 1) / 6.0)")(
    lambda s, d: spatial.crosses(_boxes(s, d), {"x": 0.0, "y": 1.0}, {"x": 20.0, "y": 7.0}).select("n_nationkey")
)
query("spatial_paths")(
    lambda s, d: spatial.shortest_paths(
        table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("a"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")).selectExpr("a", "a + k AS b", "CAST(k * k + a % 3 AS DOUBLE) AS cost"), 0
    )
)
query("spatial_vectors", "SELECT l_orderkey, l_linenumber, round(q + 2 * x - t, 6) AS dot, round(sqrt(q*q + x*x + t*t), 6) AS length, round(x * -1 - t * 2, 6) + 0.0 AS cx, round(q / sqrt(q*q + x*x + t*t), 6) AS nx FROM (SELECT *, l_quantity AS q, l_discount * 10 AS x, l_tax * 10 AS t FROM lineitem)")(
    lambda s, d: table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(spatial.dot(_vector(), _other()), 6).alias("dot"), F.round(spatial.length(_vector()), 6).alias("length"),
        (F.round(spatial.cross(_vector(), _other())[0], 6) + 0.0).alias("cx"), F.round(spatial.normalize(_vector())[0], 6).alias("nx"),
    )
)


def _vector():
    return [F.col("l_quantity"), F.col("l_discount") * 10, F.col("l_tax") * 10]


def _other():
    return [F.lit(1.0), F.lit(2.0), F.lit(-1.0)]


query("spatial_point_line", "SELECT l_orderkey, l_linenumber, round(abs(3 * (0 - l_discount) - (0 - l_quantity) * 4) / 5, 6) AS far FROM lineitem")(
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(spatial.point_line([F.col("l_quantity"), F.col("l_discount")], [F.lit(0.0), F.lit(0.0)], [F.lit(3.0), F.lit(4.0)]), 6).alias("far"))
)
query("spatial_angle_lerp", "SELECT l_orderkey, l_linenumber, round(acos(least(1.0, l_quantity / sqrt(l_quantity * l_quantity + 1.0))), 6) AS angle, round(l_quantity + (1 - l_quantity) * l_discount, 6) AS x, round(1 - l_discount, 6) + 0.0 AS y FROM lineitem")(
    lambda s, d: table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(spatial.angle([F.col("l_quantity"), F.lit(1.0), F.lit(0.0)], [F.lit(1.0), F.lit(0.0), F.lit(0.0)]), 6).alias("angle"),
        *[(F.round(v, 6) + 0.0).alias(n) for n, v in zip("xy", spatial.lerp([F.col("l_quantity"), F.lit(1.0)], [F.lit(1.0), F.lit(0.0)], F.col("l_discount")), strict=True)],
    )
)
