"""Connected components of an edge table, without gathering it anywhere.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014):
every step keeps the components and moves edges towards the smallest id, until each node points straight at it.
Minima are aggregated before the shuffle; the join back is an ordinary equi-join whose skewed partitions
Spark may split, so that a hub with a third of all edges is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources import scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges: two long columns, in either direction, repeats and loops allowed; rows with a null are ignored.

    Returns (node, component): each node of an edge between two different nodes once, with the smallest id of its
    component. No edges give an empty table.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = scratch.save(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where(x != y).distinct(), "edges")
    mark, before = _mark(now), None
    while mark != before:
        large = _large_star(now)
        small = scratch.save(_small_star(large), "edges")
        scratch.drop(now)
        now, before, mark = small, mark, _mark(small)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
