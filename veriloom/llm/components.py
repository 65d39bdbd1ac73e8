"""Connected components of an edge table by alternating large-star and small-star steps.

Everything stays in DataFrames: each step is an aggregation of minima (combined before its shuffle, so
a hub's edges meet as one row a task) and a join whose skewed partitions Spark can split.  Steps are
written to the shared folder, which cuts lineage; their number grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize

#: A path doubles its reach in each round; this is far beyond any table that fits in 64-bit ids.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).withColumnRenamed("a", "u")
    return both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    joined = down.join(least, F.col("a") == F.col("u"))
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long), in any order, with repeats and loops allowed -> (id, component).

    One row for each id that stands in an edge to another id; component is the smallest id reachable.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        step = materialize(_small_star(_large_star(now).distinct()).distinct(), "edges")
        mark = step.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(now)  # the next step reads this one's table alone
        now = step
        if mark == seen or not mark[0]:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    # Settled: every edge points from an id to the least one of its component.
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
