"""The corpus tables as typed relations: one row for each id, keys tidied.

Rows are delivered at least once, so an id may stand twice with equal content.
There are two ways to count it once, and neither exchanges what a query does
not need:

* ``records``, ``pairs``, ``tasks``, ``findings`` keep one row of an id by an
  aggregation; columns that a query does not use are pruned before it. They
  are for queries on labels, sources, paths and the like.
* ``mapped`` first maps the rows as they were delivered, texts included, to
  what a query needs of them (hashes, labels, reasons) and then merges equal
  results, so texts are never exchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import tidy
from lodestrata.session import read_table, ship_package


def first_of_role(role: str) -> Column:
    return F.get(F.filter("messages", lambda m: m["role"] == role), 0)["content"]


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    ship_package(spark)
    return read_table(spark, directory, name)


def _once(df: DataFrame, key: str) -> DataFrame:
    """One row for each key; equal rows, so any of them, chosen as a minimum to allow partial aggregation."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(*[F.any_value(c).alias(c) for c in others])


def _delivered_records(spark: SparkSession, directory: str) -> DataFrame:
    raw = _table(spark, directory, "pilot_records")
    meta = {
        "cwes": "cwes", "gt_cwe": "ground_truth_cwe", "oracle": "oracle", "improved": "improved", "multi_hop": "multi_hop", "helper_fn": "helper_fn",
        "disposition": "disposition", "num_findings": "num_findings", "quarantine_reasons": "quarantine_reasons", "specificity": "specificity",
    }
    return raw.select(
        "record_id",
        "split",
        "messages",
        first_of_role("user").alias("usr"),
        first_of_role("assistant").alias("answer"),
        F.col("_meta.shape").alias("shape"),
        *[tidy(F.col(f"_meta.{c}")).alias(c) for c in ("source", "language", "label")],
        *[F.col(f"_meta.{c}").alias(name) for name, c in meta.items()],
    ).withColumn("cwe", F.coalesce(F.get("cwes", 0), "gt_cwe"))


def _delivered_pairs(spark: SparkSession, directory: str) -> DataFrame:
    raw = _table(spark, directory, "fix_pairs")
    return raw.select(
        "pair_id", "vuln_code", "fixed_code", "cwe", tidy(F.col("language")).alias("language"), tidy(F.col("vuln_type")).alias("vuln_type"), "source", "owner_repo"
    )


def _delivered_tasks(spark: SparkSession, directory: str) -> DataFrame:
    raw = _table(spark, directory, "shape1")
    return raw.select("task_no", "task_id", "code", tidy(F.col("language")).alias("language"), tidy(F.col("label")).alias("label"), "cwe", "source")


def _delivered_findings(spark: SparkSession, directory: str) -> DataFrame:
    raw = _table(spark, directory, "findings")
    tidied = {c: tidy(F.col(c)).alias(c) for c in ("source", "status", "severity")}
    names = ("source", "owner_repo", "file", "unit", "line", "status", "cwe", "severity", "trace", "fix", "think")
    return raw.select("finding_id", *[tidied.get(c, c) for c in names])


_RELATIONS = {
    "records": ("record_id", _delivered_records),
    "pairs": ("pair_id", _delivered_pairs),
    "tasks": ("task_no", _delivered_tasks),
    "findings": ("finding_id", _delivered_findings),
}
_as_delivered: ContextVar[bool] = ContextVar("as_delivered", default=False)


def _relation(spark: SparkSession, directory: str, name: str) -> DataFrame:
    key, read = _RELATIONS[name]
    delivered = read(spark, directory)
    return delivered if _as_delivered.get() else _once(delivered, key)


def records(spark: SparkSession, directory: str) -> DataFrame:
    return _relation(spark, directory, "records")


def pairs(spark: SparkSession, directory: str) -> DataFrame:
    return _relation(spark, directory, "pairs")


def tasks(spark: SparkSession, directory: str) -> DataFrame:
    return _relation(spark, directory, "tasks")


def findings(spark: SparkSession, directory: str) -> DataFrame:
    return _relation(spark, directory, "findings")


def mapped(spark: SparkSession, directory: str, name: str, keep: str | Column, *columns: str | Column) -> DataFrame:
    """The id and ``columns`` of the rows of a relation that fit ``keep``, each id once.

    ``columns`` are functions of a row, so that rows of an id give one result.
    """
    key, read = _RELATIONS[name]
    return read(spark, directory).where(keep).select(key, *columns).distinct()


def per_row(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that maps rows to rows and keeps their id, run on the rows as delivered.

    Equal results of a redelivered row are merged at its end.
    """

    @wraps(query)
    def run(spark: SparkSession, directory: str) -> DataFrame:
        token = _as_delivered.set(True)
        try:
            return query(spark, directory).distinct()
        finally:
            _as_delivered.reset(token)

    return run


def documents(spark: SparkSession, directory: str) -> DataFrame:
    return _table(spark, directory, "documents")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return _table(spark, directory, name)
