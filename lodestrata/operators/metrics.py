"""Scores of predictions against ground truth, in one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import ratio

CLASSES = ("TP", "FP", "FN", "TN", "MISS")


def outcome(vulnerable: Column, status: Column) -> Column:
    """TP, FP, FN, TN, or MISS where the prediction has no verdict."""
    return (
        F.when(status == "confirmed", F.when(vulnerable, "TP").otherwise("FP"))
        .when(status == "safe", F.when(vulnerable, "FN").otherwise("TN"))
        .otherwise("MISS")
    )


def confusion(df: DataFrame, outcome_col: str = "outcome", *groups: str) -> DataFrame:
    """Counts of the five outcomes, with false-positive rate, recall, precision and F1 (0 for empty denominators)."""
    counted = (df.groupBy(*groups) if groups else df.groupBy()).agg(*[F.count_if(F.col(outcome_col) == c).alias(c.lower()) for c in CLASSES])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, precision = ratio(tp, tp + fn), ratio(tp, tp + fp)
    return counted.select(
        *groups, "tp", "fp", "fn", "tn", "miss", ratio(fp, fp + tn).alias("fpr"), recall.alias("recall"), precision.alias("precision"), ratio(2 * precision * recall, precision + recall).alias("f1")
    )


def long_form(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Metric columns as rows: keys, metric, value."""
    values = [c for c in metrics.columns if c not in keys]
    return metrics.select(*keys, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(keys, values, "metric", "value")


def compare(before: DataFrame, after: DataFrame, keys: list[str], lower_is_better: tuple[str, ...], tolerance: float = 1e-9) -> DataFrame:
    """Full outer join of two metric tables with the change and its direction: +, - or ~.

    A metric that only one run has keeps a null on the other side and the
    direction ~. Metrics whose name contains a part of ``lower_is_better``
    improve by falling.
    """
    joined = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), [*keys, "metric"], "full_outer")
    delta = F.col("after") - F.col("before")
    lower = F.lit(False)
    for part in lower_is_better:
        lower = lower | F.contains("metric", F.lit(part))
    better = F.when(lower, -delta).otherwise(delta)
    return joined.select(
        *keys, "metric", "before", "after", delta.alias("delta"), F.when(better > tolerance, "+").when(better < -tolerance, "-").otherwise("~").alias("direction")
    )
