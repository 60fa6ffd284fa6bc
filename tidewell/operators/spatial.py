"""Points, boxes, lines and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_box(dimensions: dict[str, tuple[float, float]]) -> Column:
    """Closed box over columns; plain comparisons, so that Parquet statistics prune."""
    out = F.lit(True)
    for name, (low, high) in dimensions.items():
        out = out & (F.col(name) >= low) & (F.col(name) <= high)
    return out


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def within(points: DataFrame, vector: str, centre: list[float], radius: float) -> DataFrame:
    at = F.array(*(F.lit(float(x)) for x in centre))
    return points.withColumn("distance", distance(F.col(vector).cast("array<double>"), at)).filter(F.col("distance") <= radius)


def nearest(points: DataFrame, vector: str, centre: list[float], n: int, tie: str) -> DataFrame:
    at = F.array(*(F.lit(float(x)) for x in centre))
    return points.withColumn("distance", distance(F.col(vector).cast("array<double>"), at)).orderBy("distance", tie).limit(n)


def locate(points: DataFrame, boxes: DataFrame, dimensions: list[str], cell: float) -> DataFrame:
    """Points with the boxes (min_<d>, max_<d>) that hold them, by an equality join on grid cells.

    A box meets the cells of its first dimension that it covers, a point its own cell.
    """
    d = dimensions[0]
    covered = F.explode(F.sequence(F.floor(F.col(f"min_{d}") / cell), F.floor(F.col(f"max_{d}") / cell)))
    inside = [F.col(x).between(F.col(f"min_{x}"), F.col(f"max_{x}")) for x in dimensions]
    out = points.withColumn("__cell", F.floor(F.col(d) / cell)).join(boxes.withColumn("__cell", covered), "__cell")
    for c in inside:
        out = out.filter(c)
    return out.drop("__cell")


def crosses(boxes: DataFrame, start: dict[str, float], end: dict[str, float]) -> DataFrame:
    """Boxes that a line segment meets, with the part of the segment (enters, leaves) inside."""
    enters, leaves = F.lit(0.0), F.lit(1.0)
    for d, a in start.items():
        step = end[d] - a
        low, high = F.col(f"min_{d}"), F.col(f"max_{d}")
        if step:
            t0, t1 = (low - a) / step, (high - a) / step
            enters, leaves = F.greatest(enters, F.least(t0, t1)), F.least(leaves, F.greatest(t0, t1))
        else:
            leaves = F.when((low <= a) & (high >= a), leaves).otherwise(-1.0)
    return boxes.withColumns({"enters": enters, "leaves": leaves}).filter("enters <= leaves")


def dot(a: list[Column], b: list[Column]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def length(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: list[Column]) -> list[Column]:
    n = length(a)
    return [F.when(n == 0, F.lit(0.0)).otherwise(x / n) for x in a]


def angle(a: list[Column], b: list[Column]) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (length(a) * length(b)))))


def lerp(a: list[Column], b: list[Column], t: Column) -> list[Column]:
    return [x + (y - x) * t for x, y in zip(a, b, strict=True)]


def point_line(p: list[Column], a: list[Column], b: list[Column]) -> Column:
    """Distance of a point from the line through a and b in the plane."""
    area = F.abs((b[0] - a[0]) * (a[1] - p[1]) - (a[0] - p[0]) * (b[1] - a[1]))
    return area / F.sqrt((b[0] - a[0]) * (b[0] - a[0]) + (b[1] - a[1]) * (b[1] - a[1]))


def shortest_paths(edges: DataFrame, source, rounds: int | None = None) -> DataFrame:
    """(node, cost) of the cheapest path from ``source`` over edges (a, b, cost).

    Costs relax over all edges of the frontier at once; each round joins only nodes
    whose cost fell. At most ``rounds`` rounds if given.
    """
    from tidewell.sources.tables import settle

    spark = edges.sparkSession
    kind = edges.schema["a"].dataType.simpleString()
    best = spark.createDataFrame([(source, 0.0)], f"node {kind}, cost double")
    front = best
    while rounds is None or rounds > 0:
        reached = front.join(edges, front["node"] == edges["a"]).groupBy(F.col("b").alias("node")).agg(F.min(front["cost"] + edges["cost"]).alias("new"))
        both = settle(best.join(reached, "node", "full").select("node", F.least("cost", "new").alias("cost"), (F.col("cost").isNull() | (F.col("new") < F.col("cost"))).alias("fell")), "paths")
        best, front = both.select("node", "cost"), both.filter("fell").select("node", "cost")
        rounds = None if rounds is None else rounds - 1
        if front.isEmpty():
            break
    return best
