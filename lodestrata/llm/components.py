"""Connected components of an edge table, by alternating large- and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.staging import stage


def connected_components(edges: DataFrame, low: str = "a", high: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of ``edges``; a component is named by its least id.

    Every round hangs each node on the least id among its neighbours (large
    star on greater neighbours, small star on lesser ones), which needs a
    number of rounds that grows with the logarithm of the longest chain. A
    round is two aggregations with map-side combining, no neighbour list is
    ever collected, and each round's edges are staged. Self-loops and repeated
    edges are harmless; an empty edge table gives no rows.
    """
    now = stage(
        edges.select(F.greatest(low, high).alias("u"), F.least(low, high).alias("v")).where("u <> v").distinct(), "edges"
    )
    before = None
    for _ in range(most_rounds):
        # large star: greater neighbours of u go to the least of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # small star: u and its lesser neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = stage(small, "edges")
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("id")).distinct().join(now.select(F.col("u").alias("id")), "id", "left_anti")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )
