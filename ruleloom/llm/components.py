"""Connected components as DataFrame rounds (alternating large and small stars); nothing is gathered on the driver.

Each round replaces edges by edges to smaller ids until every node points at the smallest id of its component. Groups are
aggregated with map-side combine and joined back, so a node with many edges is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, dealt_join

ROUNDS = 60


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), both not null; component is the smallest node."""
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(ROUNDS):
        # every node's larger neighbours move to its smallest neighbour
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = dealt_join(both, least, ["u"], "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every node's smaller neighbours, and the node, move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = dealt_join(large, least, ["u"], "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.keep(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(now)
        now = new
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"no end after {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
