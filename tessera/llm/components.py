"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import parallelism, release, staged

#: Edges of a task, about: rounds on few edges are not dealt to many tasks and files.
EDGES_A_TASK = 20_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, label): each node of the edges (a, b) with the least node of its component.

    A round links every larger neighbour of a node, then the node and its smaller ones, to the least of them; rounds
    grow with the logarithm of the number of nodes. Minima are aggregated before the shuffle, so hubs don't gather
    lists, and written before they are joined, so adaptive execution can split the rows of a hub; each round is written
    to the shared folder. Loops are dropped; without edges there are no rows.
    """
    order = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    held = staged(edges.where("a <> b").select(*order).distinct(), "cc")
    seen = _state(held)
    spark = edges.sparkSession
    for _ in range(most):
        tasks = max(1, min(parallelism(spark), seen[0] // EDGES_A_TASK))
        stage = lambda df, name: staged(df.coalesce(tasks), name)  # noqa: B023, E731
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc-low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage(large, "cc-large")
        release(low)
        low = stage(large.groupBy("a").agg(F.min("b").alias("m")), "cc-low")
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        small = stage(small, "cc-small")
        now = _state(small)
        release(held)
        release(large)
        release(low)
        held = small
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {most} rounds")
    return held.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(held.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
