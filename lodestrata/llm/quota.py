"""Exact, reproducible row quotas per group without sorting whole groups.

Every row has a uniform number from a keyed hash of its id. The rows of a
group with the smallest numbers fill its quota. A histogram of the numbers
over at most ``MOST_BUCKETS`` buckets a group shows in which bucket the quota
ends: lower buckets are taken whole, higher ones dropped, and only the rows of
that one bucket are ranked, so no group is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PER_BUCKET, MOST_BUCKETS = 256, 1 << 16


def uniform(seed: int, *ids: str | Column) -> Column:
    """A number in [0, 1) from the seed and the ids: 52 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 12).cast("double") / F.lit(float(1 << 52))


def take_quota(rows: DataFrame, groups: list[str], unit: str = "u", size: str = "group_rows", quota: str = "quota", tie: str = "id") -> DataFrame:
    """The ``quota`` rows of each group with the least ``unit``.

    ``rows`` has the group columns, ``tie`` (unique within a group), ``unit``
    in [0, 1), the group's number of rows ``size`` and its ``quota``. A quota
    of null or below 1 takes nothing, one above the group's size all rows;
    ties of ``unit`` go by ``tie``. Returns the columns of ``rows``.
    """
    buckets = F.greatest(F.lit(1), F.least(F.lit(MOST_BUCKETS), (F.col(size) / PER_BUCKET).cast("int")))
    spread = rows.withColumn("_bucket", F.floor(F.col(unit) * buckets).cast("int"))
    up_to = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    counted = (
        spread.groupBy(*groups, "_bucket")
        .agg(F.count("*").alias("_n"), F.first(quota).alias("_quota"))
        .withColumn("_before", F.sum("_n").over(up_to) - F.col("_n"))
        .where(F.col("_before") < F.col("_quota"))
    )
    keys = [*groups, "_bucket"]
    kept = spread.join(
        counted.select(*keys, (F.col("_quota") - F.col("_before")).alias("_room"), (F.col("_n") <= F.col("_quota") - F.col("_before")).alias("_whole")),
        keys,
    )
    ranked = kept.where("not _whole").withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(unit, tie))
    )
    return kept.where("_whole").select(*rows.columns).unionByName(
        ranked.where("_rank <= _room").select(*rows.columns)
    )
