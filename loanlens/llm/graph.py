"""Connected components of an edge table, by alternating stars.

Each round points every node at the smallest node it knows (large star, then
small star) until the edge table stops changing; it is then one edge from every
node to the smallest node of its component. Minima are combined map-side; the
join of a hub's many edges with its one minimum is an ordinary shuffle join that
adaptive execution can split. Only a row count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) longs -> (node, root) for every node with an edge but the
    roots themselves; root is the smallest node reachable."""
    now = table(edges.where(F.col("a") != F.col("b"))
                .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        both = now.select(F.explode(F.array(
            F.struct(F.col("u").alias("x"), F.col("v").alias("y")),
            F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.*")
        low = both.groupBy("x").agg(F.min(F.least("x", "y")).alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.explode(F.array(
                    F.struct("u", F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.*").where("u <> v").distinct())
        now, before = table(small), state
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
