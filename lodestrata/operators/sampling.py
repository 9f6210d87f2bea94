"""Reproducible sampling and ordering: everything is ordered by a keyed hash.

A prefix of a hash order is a sample, so pools keep their prefix when they
grow. Ranks within a group use a window only where a cap bounds the result:
Spark then keeps the group's first rows per partition before the exchange
(window group limit), so a hot group does not meet in one task whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def per_group(df: DataFrame, groups: list[str], order: list[Column | str], cap: int | Column) -> DataFrame:
    """At most ``cap`` rows of each group, the first in ``order``; the columns of ``df``.

    With a constant cap Spark limits each partition's part of a group before
    the exchange; a cap from a column is checked after it.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col("_rank") <= cap).drop("_rank")


def quota_by_group(df: DataFrame, groups: list[str], quotas: DataFrame, order: Column, quota: str = "quota") -> DataFrame:
    """The first ``quota`` rows of each group, quotas from a small table; groups without one give none."""
    ranked = df.join(quotas, groups).withColumn("_rank", F.row_number().over(Window.partitionBy(*groups).orderBy(order)))
    return ranked.where(F.col("_rank") <= F.col(quota)).drop("_rank", quota)


def round_robin(df: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """The first rows of all groups in turn until ``limit`` rows: balanced coverage.

    The groups take turns in the order of their first row. A row beyond a
    group's first ``limit`` can never be taken, which bounds each group before
    the final order.
    """
    ranked = df.withColumn("_turn", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_turn") <= limit)
    first = df.groupBy(group).agg(F.min(order).alias("_first"))
    return (
        ranked.join(first, group)
        .orderBy("_turn", "_first")
        .limit(limit)
        .drop("_first")
        .withColumnRenamed("_turn", "turn")
    )


def interleave_slot(rank: Column, scarce: Column) -> Column:
    """Slot of the ``rank``-th row (from 0) of its side when every prefix holds 30 % of the scarce side.

    Scarce row j stands at floor(10 j / 3), other row i at the i-th slot that
    is left: closed forms, so nothing is looped over.
    """
    free = F.element_at(F.array(*map(F.lit, (1, 2, 4, 5, 7, 8, 9))), (rank % 7 + 1).cast("int"))
    return F.when(scarce, F.floor(rank * 10 / 3)).otherwise(F.floor(rank / 7) * 10 + free).cast("bigint")


def weighted_with_replacement(weights: DataFrame, key: str, weight: str, draws: DataFrame, uniform: str) -> DataFrame:
    """``draws`` with the key that each draw hits, by inverse distribution.

    ``weights`` is a table of strata (few rows): its cumulative shares go into
    one array on each draw, and the hit is the first share above the draw's
    number, so there is no range join and the number of draws is exact.
    """
    total = Window.partitionBy(F.lit(0))
    up_to = total.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    shares = weights.where(F.col(weight) > 0).select(
        key, (F.sum(weight).over(up_to) / F.sum(weight).over(total)).alias("upto"), F.row_number().over(total.orderBy(key)).alias("n")
    )
    table = shares.agg(F.array_sort(F.collect_list(F.struct("n", "upto", key))).alias("strata"))
    hit = F.get(F.filter("strata", lambda s: s["upto"] > F.col(uniform)), 0)[key]
    last = F.try_element_at(F.col("strata"), F.lit(-1))[key]
    return draws.withColumn("strata", table.scalar()).withColumn(key, F.coalesce(hit, last)).drop("strata")


def budget_prefix(df: DataFrame, order: str, size: str, budget: int, buckets: int = 1024, most_rows: int = 100_000) -> DataFrame:
    """Rows in ``order`` as long as their running ``size`` stays within ``budget``.

    Sizes are summed by range of ``order``; the range in which the budget ends
    is cut into ranges again, until it has at most ``most_rows`` rows (or one
    value of ``order``). Only these are ordered row by row. ``order`` is an
    integer; rows of a null order are left out, a null size counts as 0.
    """
    size_of = F.coalesce(F.col(size), F.lit(0))
    ends = df.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    if ends["low"] is None:
        return df.limit(0)
    low, high, before = int(ends["low"]), int(ends["high"]), 0
    while True:
        width = -(-(high - low + 1) // buckets)
        inside = df.where(F.col(order).between(low, high)).withColumn("_range", F.floor((F.col(order) - low) / width))
        ranges = inside.groupBy("_range").agg(F.sum(size_of).alias("size"), F.count("*").alias("rows")).orderBy("_range").collect()  # at most ``buckets``
        edge = None
        for r in ranges:
            if before + r["size"] > budget:
                edge = r
                break
            before += r["size"]
        if edge is None:
            return df.where(F.col(order) <= high)
        low, high = low + int(edge["_range"]) * width, min(high, low + (int(edge["_range"]) + 1) * width - 1)
        if edge["rows"] <= most_rows or low == high:
            break
    run = F.lit(before) + F.sum(size_of).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    last = df.where(F.col(order).between(low, high)).withColumn("_run", run).where(F.col("_run") <= budget).drop("_run")
    return df.where(F.col(order) < low).unionByName(last)
