"""Queries of problems 5 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.near_duplicates import expand, near_duplicate_groups, near_duplicate_pairs
from lodestrata.llm.records import clean_key, first_content, table, user_texts
from lodestrata.llm.split_overlap import cross_split_pairs

#: TESTDATA.md: runs of three words, overlap of at least 0.6.
WORDS, OVERLAP = 3, 0.6


def _sides(spark: SparkSession, directory: str) -> DataFrame:
    return (
        user_texts(spark, directory)
        .where("split in ('train', 'val', 'eval')")
        .select(F.col("record_id").alias("id"), (F.col("split") != "train").alias("indexed"), "text")
    )


def _cross_pairs(spark: SparkSession, directory: str) -> DataFrame:
    pairs, members = cross_split_pairs(_sides(spark, directory), WORDS, OVERLAP)
    return (
        pairs.join(members.where("indexed").select(F.col("rep").alias("rep_a"), F.col("id").alias("eval_id")), "rep_a")
        .join(members.where("not indexed").select(F.col("rep").alias("rep_b"), F.col("id").alias("train_id")), "rep_b")
        .select("eval_id", "train_id", "overlap")
    )


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return _cross_pairs(spark, directory).select(
        F.least("eval_id", "train_id").alias("record_lo"), F.greatest("eval_id", "train_id").alias("record_hi")
    )


def p5_report(spark: SparkSession, directory: str) -> DataFrame:
    """Leaked evaluation records by split, shape and source, exact and near."""
    facts = (
        table(spark, directory, "pilot_records")
        .select(F.col("record_id").alias("eval_id"), "split", F.col("_meta.shape").alias("shape"), clean_key("_meta.source").alias("source"))
        .where("split in ('val', 'eval')")
        .dropDuplicates(["eval_id"])
    )
    pairs, members = cross_split_pairs(_sides(spark, directory), WORDS, OVERLAP)
    # by class: pairs of records are counted, not listed
    train = members.where("not indexed").groupBy(F.col("rep").alias("rep_b")).agg(F.count("*").alias("records"))
    by_class = pairs.join(train, "rep_b").groupBy(F.col("rep_a").alias("rep")).agg(F.sum("records").alias("train_records"), F.max("overlap").alias("overlap"))
    leaked = members.where("indexed").join(by_class, "rep").select(F.col("id").alias("eval_id"), "train_records", "overlap")
    return (
        facts.join(leaked, "eval_id", "left")
        .groupBy("split", "shape", "source")
        .agg(
            F.count("*").alias("records"),
            F.count("overlap").alias("leaked"),
            F.count_if(F.col("overlap") >= 1).alias("leaked_exactly"),
            F.coalesce(F.sum("train_records"), F.lit(0)).alias("train_links"),
        )
    )


def _codes(spark: SparkSession, directory: str, origin: str) -> DataFrame:
    key, code = {"fix_pairs": ("pair_id", "vuln_code"), "shape1": ("task_no", "code")}[origin]
    return table(spark, directory, origin).select(F.col(key).alias("id"), F.col(code).alias("text"))


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    found = None
    for origin in ("fix_pairs", "shape1"):
        pairs, members = near_duplicate_pairs(_codes(spark, directory, origin), WORDS, OVERLAP)
        rows = expand(pairs, members).select(F.lit(origin).alias("origin"), "row_lo", "row_hi")
        found = rows if found is None else found.unionByName(rows)
    return found


def p6_groups(spark: SparkSession, directory: str) -> DataFrame:
    """One row per record: its class of alike code and its number of links."""
    parts = [
        near_duplicate_groups(_codes(spark, directory, origin), k=WORDS, threshold=OVERLAP).select(
            F.lit(origin).alias("origin"), F.col("id").alias("row_id"), "class_id", "links"
        )
        for origin in ("fix_pairs", "shape1")
    ]
    return parts[0].unionByName(parts[1])


QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p6_found": p6_found, "p6_groups": p6_groups}


def _overlap_sql(source: str, key: str, text: str, extra: str, match: str, columns: str) -> str:
    """All pairs of overlap 0.6 or more by joining every shingle with every other: the definition itself."""
    return f"""WITH w AS (SELECT DISTINCT {key} AS id, {extra} AS side, regexp_extract_all(lower({text}), '[a-z0-9_]+') AS w FROM {source} WHERE {text} IS NOT NULL),
s AS (SELECT id, side, unnest(list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w WHERE len(w) > 2),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND {match} GROUP BY ALL)
SELECT {columns} FROM p JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE k * 10 >= 6 * (a.n + b.n - k)"""


_LEAKS_SQL = _overlap_sql(
    "pilot_records",
    "record_id",
    "list_filter(messages, lambda m: m.role = 'user')[1].content",
    "split",
    "a.side = 'train' AND b.side IN ('val', 'eval')",
    "y AS eval_id, CAST(k AS DOUBLE) / (a.n + b.n - k) AS overlap",
)


def _groups_sql(origin: str, key: str, text: str) -> str:
    """Classes of equal shingle sets, links between them, and their components by reachability."""
    return f"""SELECT '{origin}' AS origin, id AS row_id, class_id, coalesce(links, 0) AS links FROM (
WITH RECURSIVE w AS (SELECT DISTINCT {key} AS id, regexp_extract_all(lower({text}), '[a-z0-9_]+') AS w FROM {origin} WHERE {text} IS NOT NULL),
s AS (SELECT id, unnest(list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w WHERE len(w) > 2),
c AS (SELECT id, count(*) AS n, min(id) OVER (PARTITION BY list_sort(list(g))) AS rep FROM s GROUP BY id),
r AS (SELECT s.id, s.g, c.n FROM s JOIN c ON c.id = s.id AND c.rep = c.id),
e AS (SELECT a.id AS x, b.id AS y FROM r a JOIN r b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) * 10 >= 6 * (a.n + b.n - count(*))),
reach AS (SELECT rep AS x, rep AS y FROM c UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
m AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x), l AS (SELECT x, count(*) AS links FROM e GROUP BY x)
SELECT c.id, m.class_id, l.links FROM c JOIN m ON m.x = c.rep LEFT JOIN l ON l.x = c.rep)"""


_CODE_SQL = "SELECT '{origin}' AS origin, row_lo, row_hi FROM ({inner})"
ORACLES: dict[str, str] = {
    "p5_found": _overlap_sql(
        "pilot_records",
        "record_id",
        "list_filter(messages, lambda m: m.role = 'user')[1].content",
        "split",
        "a.side = 'train' AND b.side IN ('val', 'eval')",
        "least(x, y) AS record_lo, greatest(x, y) AS record_hi",
    ),
    "p5_report": f"""
SELECT split, shape, source, count(*) AS records, count(overlap) AS leaked, CAST(coalesce(count_if(overlap >= 1), 0) AS BIGINT) AS leaked_exactly, CAST(coalesce(sum(train_records), 0) AS BIGINT) AS train_links FROM (
  SELECT DISTINCT ON (record_id) record_id AS eval_id, split, _meta.shape AS shape, lower(regexp_replace(_meta.source, '^\\s+|\\s+$', '', 'g')) AS source FROM pilot_records WHERE split IN ('val', 'eval')
) f LEFT JOIN (SELECT eval_id, count(*) AS train_records, max(overlap) AS overlap FROM ({_LEAKS_SQL}) GROUP BY eval_id) USING (eval_id) GROUP BY ALL""",
    "p6_groups": " UNION ALL ".join(_groups_sql(*origin) for origin in (("fix_pairs", "pair_id", "vuln_code"), ("shape1", "task_no", "code"))),
    "p6_found": " UNION ALL ".join(
        _CODE_SQL.format(origin=origin, inner=_overlap_sql(origin, key, text, "NULL", "a.id < b.id", "x AS row_lo, y AS row_hi"))
        for origin, key, text in (("fix_pairs", "pair_id", "vuln_code"), ("shape1", "task_no", "code"))
    ),
}
