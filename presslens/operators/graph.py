"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.storage import discard, materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``; the component is the least node in it.

    Alternating large-star and small-star steps: O(log n) rounds on any graph,
    each an aggregation with map-side combine and a join on the node. The edges of
    one node are gathered nowhere; those of a node with very many meet its one row
    in a join that adaptive execution splits. Each round is written to shared
    storage, so a lost executor repeats one round at most, and the one before is
    deleted. Edges with a null
    end and loops are ignored; repeated edges are harmless; an empty input
    gives an empty result. Nodes without an edge are not in the result.
    """
    cur = materialize(
        edges.select("a", "b").where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "cc-edges",
    )
    before = _state(cur)
    for _ in range(max_rounds):
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # now every edge points from the larger end a to the smaller end b
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.select(F.col("b").alias("x"), "m").union(small.select(F.col("a").alias("x"), "m")).where("x <> m")
        last, cur = cur, materialize(small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "cc-round")
        discard(last)
        after = _state(cur)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    stars = cur.groupBy("a").agg(F.min("b").alias("component"))
    return stars.select(F.col("a").alias("node"), "component").union(stars.select(F.col("component").alias("node"), "component").distinct())
