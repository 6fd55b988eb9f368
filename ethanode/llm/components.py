"""Connected components of an edge list, by alternating star steps over joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethanode.llm.common import discard, materialize


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): for each id in `edges` (a, b long) the smallest id reachable.

    Every round links each neighbour of a node to the smallest id in its neighbourhood
    (large star, then small star); nothing is gathered per node, so hot nodes are only long
    groups of an aggregation. Self loops, repeated and reversed edges change nothing.
    """
    given = edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        last, edges = edges, materialize(small, "stars")
        if last is not given:
            discard(last)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    ids = given.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    out = ids.join(edges.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    out = materialize(out, "components")
    discard(given, edges)
    return out
