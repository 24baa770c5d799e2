"""Connected components by alternating large-star and small-star.

Each round re-points edges to the smallest neighbour with aggregates and joins only; no neighbourhood is ever
gathered. Rounds end when the edge set stops changing. Every round is written to the shared folder, and the
round before the last is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import drop_written, written


def _least(edges: DataFrame) -> DataFrame:
    """Smallest of a node and its neighbours, per node ``u``."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v); the component is its smallest node."""
    spark = edges.sparkSession
    now = written(edges.where("u <> v").select("u", "v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        after = written(_small_star(_large_star(now)), "edges", state[0])
        reached = _state(after)
        drop_written(spark, [now.scratch])
        now = after
        if reached == state:
            break
        state = reached
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionAll(pairs.select(F.col("component").alias("node"), "component").distinct())
