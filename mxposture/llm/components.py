"""Connected components of an edge table, by alternating large and small stars.

Every step is a grouping by vertex and a join back to the edges, written to the shared folder; no
vertex's neighbours are listed in one place and nothing but two numbers a step reaches the driver. Of at
most EDGES_PER_TASK edges a step is a single task without exchanges.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mxposture.llm.common import settled


EDGES_PER_TASK = 50_000


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Edges (a, b), a > b, moved to the least neighbour of the vertex that joins them."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = edges
    if tasks == 1:
        # A step of few edges is one task: no exchange, which would cost the driver a job and a thread each.
        least = F.least("a", F.min("b").over(Window.partitionBy("a")))
        moved = both.coalesce(1).withColumn("m", least)
        if large:
            out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            ends = F.array(*[F.struct(F.col(x).alias("a"), F.col("m").alias("b")) for x in ("b", "a")])
            out = moved.select(F.inline(ends))
        return out.where(F.col("a") != F.col("b")).distinct()
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    moved = both.join(least, "a")
    if large:
        out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where(F.col("a") != F.col("b")).coalesce(tasks).distinct().coalesce(tasks)


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every vertex of ``edges`` that is not the least of its component, and the least."""
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = settled(edges.where(F.col("a") != F.col("b")).select(larger, smaller).distinct())
    # Steps write as many files as the edges need, not as many as the largest table does.
    tasks = max(1, math.ceil(now.count() / EDGES_PER_TASK))
    now, seen = now.coalesce(tasks), None
    while True:
        now = settled(_star(_star(now, True, tasks), False, tasks))
        state = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
        ).first()
        if seen == state:
            return now
        seen = state
