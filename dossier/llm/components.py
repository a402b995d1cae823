"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import written


def _to_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Point the neighbours of every node (all, or the larger ones) at the least of them.

    ``edges`` holds (a, b) with a > b.  Neighbourhoods are only reduced to a minimum, never
    gathered; a node's edges are merged with its one minimum, by hint, since the minima may look
    small enough to be sent through the driver.  The adaptive skew join splits the edges of a hub.
    """
    if larger_only:
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ends = edges
    least = ends.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("m"))
    moved = ends.join(least.hint("merge"), "a")
    if larger_only:
        out = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"),
                                                           F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge, ``component`` being the least node.

    ``edges``: two columns a, b of one orderable type; direction, repeats and loops do
    not matter, rows with a null are dropped.  Large-star and small-star rounds repeat until
    nothing changes; each round's edges are written once.
    """
    ends = edges.toDF("a", "b").filter(F.col("a") != F.col("b"))
    now = written(ends.select(F.greatest("a", "b").alias("a"),
                              F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        now = written(_to_least(_to_least(now, True), False))
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.select(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
