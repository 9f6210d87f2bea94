"""Duplicates, contradictions, evaluation leaks and hardening.

Every operator here needs one exchange on its key. Keys are hashes, and what a
group needs is a minimum, a count or a flag, so partial aggregation happens
before the exchange and a key that holds a third of all rows costs one row a
partition; group members are never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 6000


def first_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows that are the first of their key in ``order`` (which must be unique within a key).

    Null keys are one key. The result has the columns of ``df``.
    """
    least = (
        df.groupBy(key)
        .agg(F.min(F.struct(*order)).alias("_least"))
        .select(F.col(key).alias("_key"), *[F.col(f"_least.{c}").alias(f"_{i}") for i, c in enumerate(order)])
    )
    same = [F.col(key).eqNullSafe(F.col("_key")), *[F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(order)]]
    return df.join(least, same, "left_semi")


def contradictory_keys(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys that stand with the label safe and with the label vuln."""
    return (
        df.groupBy(key)
        .agg(F.bool_or(F.col(label) == "safe").alias("_safe"), F.bool_or(F.col(label) == "vuln").alias("_vuln"))
        .where("_safe and _vuln")
        .select(key)
    )


def without_contradictions(df: DataFrame, key: str, label: str) -> DataFrame:
    """Rows whose key is not labelled both ways; all rows of the others go."""
    return df.join(contradictory_keys(df, key, label), key, "left_anti")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that stand more than once, with their number of rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def leaked(train: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """Training rows whose key occurs in the held-out rows."""
    return train.join(held_out.select(key).distinct(), key, "left_semi")


def not_leaked(train: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    return train.join(held_out.select(key).distinct(), key, "left_anti")


def harden(train: DataFrame, held_out: DataFrame, key: str, order: str, chars: str, max_chars: int = MAX_CHARS) -> DataFrame:
    """``train`` with ``bucket``: leak, neardup, overlength or keep.

    In the order of ``order``: a row whose key is held out is a leak; else one
    with an earlier *kept* row of its key is a near-duplicate; else one of
    more than ``max_chars`` characters is over-length; else it is kept. An
    over-length first copy therefore does not suppress a later short one. The
    greedy rule has a closed form: the kept row of a key is its first row that
    is no leak and short enough. A null key matches nothing and is kept or
    over-length on its own.
    """
    leaks = held_out.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_leak", F.lit(True))
    short = F.when(F.coalesce(F.col(chars), F.lit(0)) <= max_chars, F.col(order))
    first = train.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(short).alias("_first"))
    return (
        train.join(leaks, key, "left")
        .join(first, key, "left")
        .withColumn(
            "bucket",
            F.when(F.col("_leak"), "leak")
            .when(F.col(order) > F.col("_first"), "neardup")
            .when(F.col(chars) > max_chars, "overlength")
            .otherwise("keep"),
        )
        .drop("_leak", "_first")
    )


def fingerprint(*columns: Column, length: int = 16) -> Column:
    """The first hexadecimal digits of the hash of all columns in a row."""
    return F.substring(F.sha2(F.concat(*[F.coalesce(c, F.lit("")) for c in columns]), 256), 1, length)
