"""Problem 1: a sample that matches target category proportions.

Per category an acceptance probability comes from the ratio of its quota to
its observed rows, a little above it; every row is kept independently if its
keyed uniform number lies below that. The kept rows are then cut back to the
exact quota. Should chance have kept too few rows of a category, all of its
rows are accepted, so counts are exact in any case. What
cannot be met, because a category has fewer rows than asked for, is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.quota import take_quota, uniform
from lodestrata.staging import stage

SLACK_SHARE, SLACK_ROWS, SEED = 0.05, 20.0, 20240601


def needed_rows() -> Column:
    """Rows a category should have: its share of the sample, its minimum at least."""
    return F.greatest(F.col("min_rows").cast("double"), F.col("target_share") * F.col("sample_rows"))


def category_report(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target with its observed rows, quota and deficit.

    ``rows``: request, id, category; an id counts once in a request and
    category, null categories match no target. ``targets``: request,
    category, target_share, min_rows, sample_rows. Adds observed, needed,
    quota (rows to draw: the needed ones rounded up to whole rows, or all
    there are), deficit (needed rows that are missing). A category that does
    not occur has observed 0; an empty ``rows`` table gives deficits only.
    """
    seen = rows.where("category is not null").groupBy("request", "category").agg(F.count_distinct("id").alias("observed"))
    return (
        targets.join(seen, ["request", "category"], "left")
        .withColumn("observed", F.coalesce("observed", F.lit(0)).cast("bigint"))
        .withColumn("needed", needed_rows())
        .withColumn("quota", F.least("observed", F.ceil(F.round("needed", 6)).cast("bigint")))
        .withColumn("short", F.col("observed") < F.col("needed"))
        .withColumn("deficit", F.greatest(F.lit(0.0), F.col("needed") - F.col("observed")))
    )


def fitted_quotas(report: DataFrame) -> DataFrame:
    """``report`` with quotas that keep each request's sample at its size.

    Minimums and rounding up may ask for more than ``sample_rows``; the
    surplus is taken from the categories above their minimum, in proportion
    to what they hold above it, whole rows by largest remainder.
    """
    from pyspark.sql.window import Window

    request = Window.partitionBy("request")
    floor = F.least("observed", F.greatest(F.col("min_rows"), F.lit(0)))
    spare = (F.col("quota") - F.col("_floor")).cast("double")
    fitted = (
        report.withColumn("_floor", floor)
        .withColumn("_over", F.greatest(F.lit(0), F.sum("quota").over(request) - F.col("sample_rows")))
        .withColumn("_spare", F.sum(spare).over(request))
        .withColumn("_cut", F.when(F.col("_spare") > 0, F.least(F.lit(1.0), F.col("_over") / F.col("_spare")) * spare).otherwise(0.0))
        .withColumn("_whole", F.floor("_cut").cast("bigint"))
        .withColumn("_left", F.least(F.col("_over"), F.round(F.sum("_cut").over(request)).cast("bigint")) - F.sum("_whole").over(request))
        .withColumn("_turn", F.row_number().over(Window.partitionBy("request").orderBy(F.desc(F.col("_cut") - F.col("_whole")), "category")))
        .withColumn("quota", F.col("quota") - F.col("_whole") - F.when(F.col("_turn") <= F.col("_left"), 1).otherwise(0))
    )
    return fitted.select(*report.columns)


def draw(rows: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(request, category, id): the sample of every request.

    Every category of a request has exactly its fitted quota, so shares are
    exact to a row wherever the category has the rows. Repeated rows of an id
    are one row; rows of other or null categories are never drawn.
    """
    one = rows.where("category is not null").select("request", "category", "id").distinct()
    report = stage(fitted_quotas(category_report(rows, targets)), "quotas")  # as many rows as targets
    wanted = report.where("quota > 0").select("request", "category", "observed", "quota")
    slack = F.greatest(F.col("quota") * SLACK_SHARE, F.sqrt("quota") * 4) + SLACK_ROWS
    accepted = F.least(F.lit(1.0), (F.col("quota") + slack) / F.col("observed"))
    offered = one.join(wanted, ["request", "category"]).withColumn("u", uniform(seed, "request", "id"))
    got = offered.where(F.col("u") < accepted).groupBy("request", "category").agg(F.count("*").alias("got"))
    # where chance took too few, every row of the category is accepted; the least numbers are the same ones
    low = wanted.join(got, ["request", "category"], "left").where(F.coalesce("got", F.lit(0)) < F.col("quota")).select("request", "category", F.lit(True).alias("low"))
    limit = F.when(F.col("low"), F.lit(1.0)).otherwise(accepted)
    kept = offered.join(low, ["request", "category"], "left").withColumn("limit", limit).where(F.col("u") < F.col("limit"))
    # the acceptance probability cuts the histogram's range to the kept part
    kept = kept.withColumn("u", F.col("u") / F.col("limit")).withColumn("group_rows", F.least(F.col("observed"), F.when(F.col("low"), F.col("observed")).otherwise(F.ceil(F.col("quota") + slack))))
    return take_quota(kept, ["request", "category"]).select("request", "category", "id")


def sample_report(rows: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """``category_report`` with the rows that the sample has of each category as ``drawn``.

    A category falls short if its sample stays below what it needs and the
    category has no more rows to give; below by less than a row, or because
    the request's size was kept, is not short.
    """
    drawn = draw(rows, targets, seed).groupBy("request", "category").agg(F.count("*").alias("drawn"))
    report = category_report(rows, targets).join(drawn, ["request", "category"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)).cast("bigint"))
    return report.withColumn("short", (F.col("drawn") < F.col("needed")) & F.col("short"))
