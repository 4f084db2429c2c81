"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations and two joins over the edges; a hot node's edges are combined before the shuffle, and its
least neighbour is written before it meets them, so that Spark can split the join.  Each round's edges go to the shared
folder, so lineage stays short and a lost executor costs one round; the last round's are deleted when they are used up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node on an edge, the smallest node it can reach.  Nulls and loops are ignored."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    e = materialize(edges.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "components")
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "components-low")
        large = materialize(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "components-large")
        discard(e, low)
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "components-low")
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        e = materialize(small, "components")
        discard(large, low)
        if (now := _state(e)) == state:
            break
        state = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct().toDF("node", "component"))
