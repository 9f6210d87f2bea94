"""Queries of problems 2, 3 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.pair_defects import defective_pairs
from lodestrata.llm.records import all_texts, clean_key, first_content, table
from lodestrata.llm.residue import residue_segments
from lodestrata.llm.truncation import truncated_texts


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """Texts that were cut off, but for those of problem 3."""
    return truncated_texts(all_texts(spark, directory)).select("origin", "row_id").distinct()


def p2_evidence(spark: SparkSession, directory: str) -> DataFrame:
    """Cut texts by the evidence that shows them."""
    return truncated_texts(all_texts(spark, directory)).distinct().groupBy("origin", "part", "evidence").agg(F.count("*").alias("texts"))


def p2_rates(spark: SparkSession, directory: str) -> DataFrame:
    """Rows, cut rows and their share by origin and source; null sources are one group."""
    rows = all_texts(spark, directory).select("origin", "row_id", "source").distinct()
    cut = p2_found(spark, directory).withColumn("cut", F.lit(1))
    return (
        rows.join(cut, ["origin", "row_id"], "left")
        .groupBy("origin", "source")
        .agg(F.count("*").alias("rows"), F.count("cut").alias("cut_rows"))
        .withColumn("cut_share", F.col("cut_rows") / F.col("rows"))
    )


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return residue_segments(all_texts(spark, directory)).select("origin", "row_id").distinct()


def p3_labels(spark: SparkSession, directory: str) -> DataFrame:
    """Kinds of residue in each part of each row that has any."""
    return residue_segments(all_texts(spark, directory)).select("origin", "row_id", "part", "label").distinct()


def p3_spread(spark: SparkSession, directory: str) -> DataFrame:
    """Rows of residue by what shows them: trusted seeds, nearness to an exemplar, or spread within components (the first of these)."""
    order = F.array_position(F.array(*map(F.lit, ("seed", "exemplar", "spread"))), F.col("how"))
    rows = residue_segments(all_texts(spark, directory)).groupBy("origin", "row_id").agg(F.min_by("how", order).alias("how"), F.min_by("label", order).alias("label"))
    return rows.groupBy("how", "label").agg(F.count("*").alias("rows"))


def p3_clean(spark: SparkSession, directory: str) -> DataFrame:
    """The rows without residue."""
    rows = all_texts(spark, directory)
    return rows.select("origin", "row_id").distinct().join(p3_found(spark, directory), ["origin", "row_id"], "left_anti")


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    pairs = table(spark, directory, "pilot_records").select(
        "record_id", first_content("user").alias("question"), first_content("assistant").alias("answer"), clean_key("_meta.source").alias("source")
    )
    return defective_pairs(pairs, corpus=all_texts(spark, directory))


def p4_report(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs by source and kind of defect; null kind: sound pairs."""
    sources = table(spark, directory, "pilot_records").select("record_id", clean_key("_meta.source").alias("source")).distinct()
    return sources.join(p4_found(spark, directory), "record_id", "left").groupBy("source", "defect").agg(F.count("*").alias("pairs"))


QUERIES = {"p2_found": p2_found, "p2_rates": p2_rates, "p2_evidence": p2_evidence, "p3_found": p3_found, "p3_labels": p3_labels, "p3_spread": p3_spread, "p3_clean": p3_clean, "p4_found": p4_found, "p4_report": p4_report}
ORACLES: dict[str, str] = {}
