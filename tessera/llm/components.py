"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import discard, materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(pairs: DataFrame, up: bool) -> DataFrame:
    """One star round over ``pairs`` (u, v).  Large star ties each larger neighbour to the least of the neighbourhood, small star the others."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))  # combined before the shuffle, so a hub costs one row a task
    tied = pairs.join(least, "u")
    out = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")) if up else tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least reachable node) of every node with an edge (columns a, b).

    Rounds grow with the logarithm of the longest path; each round's table is written
    to the shared folder, so lineage stays short.  Loops and repeated edges are ignored;
    no edges give no rows.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = materialise(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, True)
        before, now = now, materialise(_star(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), False), "edges")
        discard(before)
        after = _state(now)
        if after == state:
            break
        state = after
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
