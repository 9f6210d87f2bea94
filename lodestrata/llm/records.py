"""Views of the corpus tables that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.session import read_table, ship_package


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table of ``directory``; the package goes to the workers first."""
    ship_package(spark)
    return read_table(spark, directory, name)


def first_content(role: str, messages: str = "messages") -> Column:
    """Content of the first message of ``role``; null where there is none."""
    return F.get(F.filter(F.col(messages), lambda m: m["role"] == role), 0)["content"]


def clean_key(column: str | Column) -> Column:
    """Trimmed lower-case form of a label, language, source or type (all outer white space goes)."""
    return F.regexp_replace(F.lower(F.col(column) if isinstance(column, str) else column), r"^\s+|\s+$", "")


def user_texts(spark: SparkSession, directory: str) -> DataFrame:
    """record_id, split and user content of pilot_records; redelivered rows still stand twice."""
    return table(spark, directory, "pilot_records").select("record_id", "split", first_content("user").alias("text"))


def all_texts(spark: SparkSession, directory: str) -> DataFrame:
    """origin, row_id, part, source, text of every trace, user content and answer.

    ``source`` is trimmed and in lower case; redelivered rows still stand twice,
    as they are equal and every user of this view keeps distinct ids.
    """
    findings = table(spark, directory, "findings").select(
        F.lit("findings").alias("origin"),
        F.col("finding_id").alias("row_id"),
        F.array(F.struct(F.lit("trace").alias("part"), F.col("trace").alias("text"))).alias("texts"),
        clean_key("source").alias("source"),
    )
    records = table(spark, directory, "pilot_records").select(
        F.lit("pilot_records").alias("origin"),
        F.col("record_id").alias("row_id"),
        F.array(
            F.struct(F.lit("user").alias("part"), first_content("user").alias("text")),
            F.struct(F.lit("answer").alias("part"), first_content("assistant").alias("text")),
        ).alias("texts"),
        clean_key("_meta.source").alias("source"),
    )
    return findings.unionByName(records).select("origin", "row_id", "source", F.inline("texts"))
