"""Queries of problems 1 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.encoding import count_tokens
from lodestrata.llm.mixing import Source, actual_shares, fit, mix, permuted, short_sources, tempered
from lodestrata.llm.records import clean_key, table
from lodestrata.llm.target_sample import category_report, draw, fitted_quotas, sample_report
from lodestrata.staging import stage


def _category_rows(spark: SparkSession, directory: str) -> DataFrame:
    records, pairs = table(spark, directory, "pilot_records"), table(spark, directory, "fix_pairs")

    def rows(df: DataFrame, request: str, key: str, field: str) -> DataFrame:
        return df.select(F.lit(request).alias("request"), F.col(key).alias("id"), clean_key(field).alias("category"))

    return (
        rows(records, "labels", "record_id", "_meta.label")
        .unionByName(rows(records, "languages", "record_id", "_meta.language"))
        .unionByName(rows(pairs, "vuln_types", "pair_id", "vuln_type"))
    )


def _category_targets(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "category_targets").drop("field")


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """Categories of which the sample that was drawn has too few rows, and the table no more."""
    return sample_report(_category_rows(spark, directory), _category_targets(spark, directory)).where("short").select("request", "category")


def p1_sample(spark: SparkSession, directory: str) -> DataFrame:
    return draw(_category_rows(spark, directory), _category_targets(spark, directory))


def p1_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Rows that the sample has of each category, those of no rows left out."""
    return p1_sample(spark, directory).groupBy("request", "category").agg(F.count("*").alias("drawn"), F.count_distinct("id").alias("ids"))


def p1_report(spark: SparkSession, directory: str) -> DataFrame:
    """Targets, quotas and deficits of every request."""
    return fitted_quotas(category_report(_category_rows(spark, directory), _category_targets(spark, directory)))


#: Rows that a request table (mix_targets) may have: it is read by the driver to fit exponents.
MOST_TARGETS = 10_000


def _in_mixes(spark: SparkSession, directory: str, records: DataFrame) -> DataFrame:
    """``records`` (source, record_shape) in every mix that has a target for their source and admits their shape."""
    asked = table(spark, directory, "mix_targets").select("mix", "source", "shape").distinct()
    names = [c for c in records.columns if c not in ("record_shape", "source")]
    admitted = F.col("shape").isNull() | (F.col("shape") == F.col("record_shape"))
    return records.join(asked, "source").where(admitted).select("mix", "source", *names)


def _mix_rows(spark: SparkSession, directory: str) -> DataFrame:
    records = table(spark, directory, "pilot_records").select(
        F.col("record_id").alias("id"), clean_key("_meta.source").alias("source"), F.col("_meta.shape").alias("record_shape")
    )
    return _in_mixes(spark, directory, records)


def _mix_sizes(spark: SparkSession, directory: str) -> DataFrame:
    """mix, source, tokens, rows: what each source has for a mix, in the records that the mix admits.

    The tokens are those of the contents of all messages; a redelivered record counts once.
    """
    messages = table(spark, directory, "pilot_records").select(
        "record_id", clean_key("_meta.source").alias("source"), F.col("_meta.shape").alias("record_shape"), F.posexplode_outer("messages").alias("at", "message")
    )
    keys = ("record_id", "source", "record_shape", "at")
    sized = count_tokens(messages.where("source is not null").select(*keys, F.col("message.content").alias("text")), *keys).distinct()
    first = F.coalesce("at", F.lit(0)) == 0  # each record has one such row, without messages too
    return _in_mixes(spark, directory, sized).groupBy("mix", "source").agg(F.sum("n_tokens").alias("tokens"), F.count_if(first).alias("rows"))


def _mix_targets(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "mix_targets").drop("shape")


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    """Targets that the mix which was made could not give their share."""
    return short_sources(_mix_rows(spark, directory), _mix_targets(spark, directory)).select("mix", "source")


def p7_mix(spark: SparkSession, directory: str) -> DataFrame:
    return mix(_mix_rows(spark, directory), _mix_targets(spark, directory))


def p7_report(spark: SparkSession, directory: str) -> DataFrame:
    """Actual beside target shares of every mix."""
    return actual_shares(p7_mix(spark, directory), _mix_targets(spark, directory)).drop("total_rows")


def p7_temperature(spark: SparkSession, directory: str) -> DataFrame:
    """Tempered weights of the sources by their tokens in the records that a mix admits, and the rows they come to.

    For each mix: the exponent that gives the entropy of its target shares, the
    flattest one within the repetition limits, and the weights of the one that
    is used (``mixing.fit``). rows_wanted is what the weight comes to in rows
    of the source's mean size, out of the mix's rows of mean size.
    """
    asked = _mix_targets(spark, directory).join(_mix_sizes(spark, directory), ["mix", "source"], "left").na.fill(0, ["tokens", "rows"])
    found = asked.limit(MOST_TARGETS + 1).collect()  # one row for each target, of which there are few
    if len(found) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} mix targets")
    mixes: dict[str, dict[str, Source]] = {}
    totals: dict[str, float] = {}
    for r in found:
        mixes.setdefault(r["mix"], {})[r["source"]] = Source(r["target_share"], float(r["max_repeats"]), float(r["tokens"]), float(r["rows"]))
        totals[r["mix"]] = float(r["total_rows"])
    rows = []
    for name, sources in sorted(mixes.items()):
        alpha, beta, gamma, shares, weights = fit(sources, totals[name])
        mean = sum(v.tokens for v in sources.values()) / max(sum(v.rows for v in sources.values()), 1.0)
        by_entropy, by_limit = tempered(shares, alpha), tempered(shares, beta)
        for s, v in sorted(sources.items()):
            wanted = weights[s] * mean * totals[name] / (v.tokens / v.rows) if v.tokens else 0.0
            rows.append((name, s, shares[s], alpha, by_entropy[s], beta, by_limit[s], gamma, weights[s], wanted, int(v.rows), int(v.most_repeats)))
    schema = (
        "mix string, source string, token_share double, entropy_exponent double, entropy_weight double, limit_exponent double, limit_weight double, "
        "exponent double, weight double, rows_wanted double, available bigint, max_repeats bigint"
    )
    return spark.createDataFrame(rows, schema)


def _tempered(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """The weights with the rows that each source gives (as many as targets), and the mixes that come of them."""
    budget = F.least(F.col("available") * F.col("max_repeats"), F.round("rows_wanted").cast("bigint"))
    report = stage(p7_temperature(spark, directory).withColumn("budget", budget), "budgets")
    return report, permuted(_mix_rows(spark, directory).distinct(), report)


def p7_tempered(spark: SparkSession, directory: str) -> DataFrame:
    """The mixes by their tempered weights, as budgeted block permutations."""
    return _tempered(spark, directory)[1]


def p7_tempered_report(spark: SparkSession, directory: str) -> DataFrame:
    """Rows, records and most uses of each source in the tempered mixes, beside what its weight comes to."""
    report, mixed = _tempered(spark, directory)
    got = mixed.groupBy("mix", "source").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("records"), (F.max("used") + 1).alias("most_uses"))
    wanted = report.select("mix", "source", "weight", "rows_wanted", "available", "max_repeats")
    return wanted.join(got, ["mix", "source"], "left").na.fill(0, ["rows", "records", "most_uses"])


QUERIES = {
    "p1_found": p1_found,
    "p1_sample": p1_sample,
    "p1_counts": p1_counts,
    "p1_report": p1_report,
    "p7_found": p7_found,
    "p7_mix": p7_mix,
    "p7_report": p7_report,
    "p7_temperature": p7_temperature,
    "p7_tempered": p7_tempered,
    "p7_tempered_report": p7_tempered_report,
}

_CATEGORY_ROWS = """
rows AS (
  SELECT 'labels' AS request, record_id AS id, lower(regexp_replace(_meta.label, '^\\s+|\\s+$', '', 'g')) AS category FROM pilot_records
  UNION ALL SELECT 'languages', record_id, lower(regexp_replace(_meta.language, '^\\s+|\\s+$', '', 'g')) FROM pilot_records
  UNION ALL SELECT 'vuln_types', pair_id, lower(regexp_replace(vuln_type, '^\\s+|\\s+$', '', 'g')) FROM fix_pairs
),
seen AS (SELECT request, category, CAST(count(DISTINCT id) AS BIGINT) AS observed FROM rows WHERE category IS NOT NULL GROUP BY 1, 2)
"""
ORACLES = {
    "p1_found": f"""WITH {_CATEGORY_ROWS}
SELECT t.request, t.category FROM category_targets t LEFT JOIN seen USING (request, category)
WHERE coalesce(observed, 0) < greatest(min_rows, target_share * sample_rows)""",
    "p1_counts": f"""WITH {_CATEGORY_ROWS},
asked AS (SELECT t.*, coalesce(observed, 0) AS seen, greatest(min_rows, target_share * sample_rows) AS needed FROM category_targets t LEFT JOIN seen USING (request, category)),
quotas AS (SELECT *, least(seen, CAST(ceil(round(needed, 6)) AS BIGINT)) AS quota, least(seen, greatest(min_rows, 0)) AS least_rows FROM asked),
over AS (SELECT *, greatest(0, sum(quota) OVER r - sample_rows) AS surplus, CAST(quota - least_rows AS DOUBLE) AS spare, CAST(sum(quota - least_rows) OVER r AS DOUBLE) AS spares FROM quotas WINDOW r AS (PARTITION BY request)),
cut AS (SELECT *, CASE WHEN spares > 0 THEN least(1.0, surplus / spares) * spare ELSE 0.0 END AS less FROM over),
rounded AS (SELECT *, CAST(floor(less) AS BIGINT) AS whole, least(surplus, CAST(round(sum(less) OVER r) AS BIGINT)) - sum(CAST(floor(less) AS BIGINT)) OVER r AS more,
  row_number() OVER (PARTITION BY request ORDER BY less - floor(less) DESC, category) AS turn FROM cut WINDOW r AS (PARTITION BY request)),
fitted AS (SELECT request, category, CAST(quota - whole - CASE WHEN turn <= more THEN 1 ELSE 0 END AS BIGINT) AS drawn FROM rounded)
SELECT request, category, drawn, drawn AS ids FROM fitted WHERE drawn > 0""",
    "p7_found": """
SELECT t.mix, t.source FROM mix_targets t LEFT JOIN (
  SELECT DISTINCT record_id, lower(regexp_replace(_meta.source, '^\\s+|\\s+$', '', 'g')) AS s, _meta.shape AS shape FROM pilot_records
) r ON r.s = t.source AND (t.shape IS NULL OR t.shape = r.shape)
GROUP BY t.mix, t.source, t.target_share, t.total_rows, t.max_repeats
HAVING count(DISTINCT record_id) * t.max_repeats < t.target_share * t.total_rows""",
    "p7_report": """
WITH seen AS (
  SELECT t.mix, t.source, t.target_share, t.max_repeats, t.total_rows, CAST(count(DISTINCT record_id) AS BIGINT) AS available
  FROM mix_targets t LEFT JOIN (
    SELECT DISTINCT record_id, lower(regexp_replace(_meta.source, '^\\s+|\\s+$', '', 'g')) AS s, _meta.shape AS shape FROM pilot_records
  ) r ON r.s = t.source AND (t.shape IS NULL OR t.shape = r.shape)
  GROUP BY ALL
), budgets AS (SELECT *, least(available * max_repeats, CAST(round(target_share * total_rows) AS BIGINT)) AS rows FROM seen)
SELECT mix, source, target_share, max_repeats, rows, least(rows, available) AS records, CASE WHEN rows > 0 THEN CAST(ceil(rows / available) AS BIGINT) ELSE 0 END AS most_uses,
  greatest(0, CAST(round(target_share * total_rows) AS BIGINT) - rows) AS missing, CAST(rows AS DOUBLE) / greatest(sum(rows) OVER (PARTITION BY mix), 1) AS share
FROM budgets""",
}
