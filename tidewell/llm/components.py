"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.sources.tables import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): the least id reachable.

    In each round every id goes over to the least of itself and its neighbours, by
    the ids' own order first and by another hash of them in each later round, and the
    edges are rewritten to where their ends went. Copies of an edge and edges within one
    place go, so that a star is done after one round, and of a path a fixed share of the ids
    goes in each later one: all rounds together read little more than the first. Only counts
    reach the driver; what a round leaves is written to the shared folder. All joins merge:
    a broadcast would take its side through the driver's memory.
    """
    left = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not steps or not left.isEmpty():
        order = _order(len(steps))
        ends = left.select(F.col("a").alias("id"), F.col("b").alias("near")).unionByName(left.select(F.col("b").alias("id"), F.col("a").alias("near")))
        least = ends.groupBy("id").agg(F.min_by("near", order("near")).alias("near"))
        went = settle(least.select("id", F.when(order("near") < order("id"), F.col("near")).otherwise(F.col("id")).alias("component")), "labels")
        steps.append(went)
        moved = left.join(went.hint("merge"), F.col("a") == F.col("id")).select(F.col("component").alias("a"), "b")
        moved = moved.join(went.hint("merge"), F.col("b") == F.col("id")).select("a", F.col("component").alias("b")).filter("a <> b")
        left = settle(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if len(steps) == 1:
        return steps[0]
    labels = steps.pop()
    while steps:
        further = labels.toDF("component", "root")
        labels = settle(steps.pop().join(further.hint("merge"), "component", "left").select("id", F.coalesce("root", "component").alias("component")), "labels")
    # settled, so that a large component's rows need not come to the task that found its least id
    least = settle(labels.groupBy("component").agg(F.min("id").alias("least")), "least")
    return settle(labels.join(least.hint("merge"), "component").select("id", F.col("least").alias("component")), "labels")


def _order(turn: int):
    def order(name: str) -> Column:
        return F.xxhash64(name, F.lit(turn)) if turn else F.col(name)

    return order
