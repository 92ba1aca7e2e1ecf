"""Walks over edge tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import workers


def walk(spark: SparkSession, edges: DataFrame, roots: DataFrame, depth: int, levels: int | None = None) -> DataFrame:
    """All walks from ``roots`` (node) along ``edges`` (src, dst): root, node, depth, trail, cycle.

    A walk ends where it would enter a node of its own trail (marked ``cycle``) or at ``depth``.
    """
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # walks end by themselves; by default a million rows are an error
    name = uuid.uuid4().hex  # walks of one session don't share their views
    edges.createOrReplaceTempView(f"__walk_edges_{name}")
    roots.createOrReplaceTempView(f"__walk_roots_{name}")
    walked = spark.sql(
        f"""
        WITH RECURSIVE walk(root, node, depth, trail, cycle) MAX RECURSION LEVEL {levels or depth + 2} AS (
          SELECT CAST(node AS BIGINT), CAST(node AS BIGINT), 0, array(CAST(node AS BIGINT)), false FROM __walk_roots_{name}
          UNION ALL
          SELECT w.root, CAST(e.dst AS BIGINT), w.depth + 1, concat(w.trail, array(CAST(e.dst AS BIGINT))), array_contains(w.trail, CAST(e.dst AS BIGINT))
          FROM walk w JOIN __walk_edges_{name} e ON e.src = w.node
          WHERE NOT w.cycle AND w.depth < {depth})
        SELECT root, node, depth, trail, cycle FROM walk"""
    )
    spark.catalog.dropTempView(f"__walk_edges_{name}")  # the plan holds what they stood for
    spark.catalog.dropTempView(f"__walk_roots_{name}")
    return walked


def closure(edges: DataFrame, roots: DataFrame, rounds: int = 64) -> DataFrame:
    """Nodes reachable from ``roots`` and their least distance: a frontier that grows by anti-joins, each round checkpointed.

    Unlike ``walk`` this holds a row a node, whatever the number of paths.
    """
    from pyspark.sql import functions as F

    spark = edges.sparkSession
    workers.checkpoint_dir(spark)
    seen = roots.select("node").distinct().withColumn("depth", F.lit(0)).checkpoint()
    frontier = seen
    for level in range(1, rounds + 1):
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)).checkpoint()
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier).checkpoint()
    raise ValueError(f"no fixpoint after {rounds} rounds")
