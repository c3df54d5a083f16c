"""Connected components of a graph as DataFrames: nothing is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, weighted_join


def _smallest(edges: DataFrame) -> DataFrame:
    """Per node u of edges (u, v): the least of u and its neighbours, and how many edges it has."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c"))


#: Edges that a task writes once their number is known, so that few edges don't make many files.
TASK_EDGES = 50_000


def connected(edges: DataFrame) -> DataFrame:
    """node, component for every node of edges (u, v): component is the least node it reaches.

    Large-star and small-star steps in turn: every node hands its larger
    neighbours, then its smaller ones and itself, to the least node near it,
    until nothing changes; that takes some log squared of the nodes rounds, a
    few for stars. Each step but the last lowers some end of an edge, so the
    rounds end. Minima are formed before rows are shuffled, and nodes with a
    large share of all edges are joined by broadcast (see weighted_join), so no
    task gets all edges of one. Edges with a null end are left out, self-loops
    and repeats allowed; no edges give no rows.
    """
    edges = edges.toDF("u", "v").where("u IS NOT NULL AND v IS NOT NULL")
    nodes = stored(edges.select("u").union(edges.select("v")).distinct(), "nodes")
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen, n = None, now.count()
    while True:
        both = now.union(now.select("v", "u"))
        met = weighted_join(both, _smallest(both), ["u"], "c", 2 * n)
        large = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large.coalesce(1 + n // TASK_EDGES), "edges")
        least = _smallest(large)
        met = weighted_join(large, least, ["u"], "c", n)
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, now = now, stored(small.coalesce(1 + n // TASK_EDGES), "edges")
        discard(before)
        discard(large)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(state) == seen:
            break
        seen, n = tuple(state), state["n"]
    return nodes.join(now.select(F.col("u").alias("u"), F.col("v").alias("component")), "u", "left").select(F.col("u").alias("node"), F.coalesce("component", "u").alias("component"))
