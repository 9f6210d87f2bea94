"""Queries that write with the sinks and read back with the readers.

Each of them writes to this application's part of the shared folder, so what
comes back has been through files as any consumer's input has.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.plans import duck as D
from lodestrata.plans.registry import query
from lodestrata.sources import corpus, readers, sinks
from lodestrata.staging import own_folder


def _path(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(D.query(D.FINDS, body="SELECT finding_id, sha256(trace) AS trace_hash, severity, line FROM finds"))
def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Findings written as JSON lines and read back with a schema."""
    path = _path(spark, "findings")
    sinks.write_jsonl(corpus.findings(spark, d).select("finding_id", "trace", "severity", "line"), path)
    rows, _ = readers.jsonl(spark, path, "finding_id bigint, trace string, severity string, line int")
    return rows.select("finding_id", F.sha2("trace", 256).alias("trace_hash"), "severity", "line")


@query(D.query(D.TASKS, body="SELECT task_no, CAST(2 AS BIGINT) AS copies FROM tasks"))
def jsonl_append(spark: SparkSession, d: str) -> DataFrame:
    """Tasks written once and appended once: every line stands twice."""
    path = _path(spark, "tasks")
    t = corpus.tasks(spark, d).select("task_no")
    sinks.write_jsonl(t, path)
    sinks.write_jsonl(t, path, append=True)
    return readers.jsonl(spark, path, "task_no bigint", strict=True)[0].groupBy("task_no").agg(F.count("*").alias("copies"))


@query(D.query(D.REC, body="SELECT CASE WHEN record_id % 5 = 0 THEN 'rejected' ELSE 'read' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM rec GROUP BY 1"))
def jsonl_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are no JSON object are kept apart, blank ones are skipped."""
    path = _path(spark, "lines")
    line = F.when(F.col("record_id") % 5 == 0, F.concat(F.lit('{"record_id": '), F.col("record_id"))).otherwise(F.to_json(F.struct("record_id")))
    corpus.records(spark, d).select("record_id").select(F.explode(F.array(line, F.lit("  "))).alias("value")).write.text(path)
    rows, rejects = readers.jsonl(spark, path, "record_id bigint")
    return rows.select(F.lit("read").alias("outcome")).unionByName(rejects.select(F.lit("rejected").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query(D.query(D.PAIRS, body="SELECT pair_id, sha256(vuln_code) AS vuln_hash, sha256(fixed_code) AS fixed_hash FROM pairs WHERE vuln_code IS NOT NULL AND fixed_code IS NOT NULL AND vuln_code NOT LIKE '%' || chr(13) || '%' AND fixed_code NOT LIKE '%' || chr(13) || '%' AND vuln_code <> '' AND fixed_code <> ''"))
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Code with quotes and line breaks through a CSV file with a header."""
    path = _path(spark, "csv")
    p = corpus.pairs(spark, d).select("pair_id", "vuln_code", "fixed_code").where("vuln_code <> '' and fixed_code <> ''")
    for c in ("vuln_code", "fixed_code"):
        p = p.where(~F.contains(c, F.lit("\r")))  # a CSV reader makes one kind of line end of all
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    p.write.options(header=True, quoteAll=True, escape='"', **blanks).csv(path)
    rows = readers.csv_rows(spark, path, "pair_id bigint, vuln_code string, fixed_code string")
    return rows.select("pair_id", F.sha2("vuln_code", 256).alias("vuln_hash"), F.sha2("fixed_code", 256).alias("fixed_hash"))


@query("SELECT owner_repo, lang FROM harvest_targets WHERE lang IN ('python', 'javascript') AND patch_file IS NOT NULL")
def target_list(spark: SparkSession, d: str) -> DataFrame:
    """Harvest targets as a tab-separated list, read back for two languages."""
    path = _path(spark, "targets")
    t = corpus.table(spark, d, "harvest_targets")
    sinks.write_targets(t.select("owner_repo", "lang", "commit_sha", "patch_file"), path)
    rows = readers.targets(spark, path, ("python", "javascript"))
    return rows.select(F.col(rows.columns[0]).alias("owner_repo"), "lang")


_DISPOSITION = "CASE WHEN answer IS NULL THEN 'quarantine' ELSE 'clean' END"


@query(D.query(D.REC, body=f"SELECT shape, {_DISPOSITION} AS disposition, CAST(count(*) AS BIGINT) AS n FROM rec WHERE shape IS NOT NULL GROUP BY ALL"))
def routed_tables(spark: SparkSession, d: str) -> DataFrame:
    """Records written to a table of one partition for each shape and disposition, counted by partition."""
    path = _path(spark, "routed")
    r = corpus.records(spark, d).where("shape is not null").select("record_id", "shape", F.when(F.col("answer").isNull(), "quarantine").otherwise("clean").alias("disposition"))
    sinks.route(r, path, "shape", "disposition")
    return spark.read.parquet(path).groupBy("shape", "disposition").agg(F.count("*").alias("n"))


@query(D.query(D.TASKS, body="SELECT CAST(n AS BIGINT) AS run, CASE n WHEN 1 THEN (SELECT count(*) FROM tasks WHERE task_no % 2 = 0) WHEN 2 THEN (SELECT count(*) FROM tasks WHERE task_no % 2 = 1) ELSE 0 END AS added, (SELECT count(*) FROM tasks) AS stored FROM (VALUES (1), (2), (3)) v(n)"))
def idempotent_append(spark: SparkSession, d: str) -> DataFrame:
    """Rows that three appends add to one table: a half, the other half, nothing."""
    path = _path(spark, "appended")
    t = corpus.tasks(spark, d).select("task_no", "source")
    added = [sinks.append_new(rows, path, "task_no") for rows in (t.where("task_no % 2 = 0"), t, t)]
    stored = spark.read.parquet(path).agg(F.count("*").alias("stored"))
    runs = spark.createDataFrame([(i + 1, n) for i, n in enumerate(added)], "run bigint, added bigint")
    return runs.withColumn("stored", stored.scalar())


@query(D.query(D.PAIRS, body="SELECT 1 AS version, CAST(count(*) AS BIGINT) AS n FROM pairs UNION ALL SELECT 2, count(*) FROM pairs WHERE language IS NOT NULL"))
def rewritten_versions(spark: SparkSession, d: str) -> DataFrame:
    """A table and the survivors of a rewrite, which is a version of its own: the first one stays as it was."""
    folder = _path(spark, "versions")
    first = sinks.new_version(corpus.pairs(spark, d).select("pair_id", "language"), folder)
    second = sinks.new_version(spark.read.parquet(first).where("language is not null"), folder)
    counted = lambda path, n: spark.read.parquet(path).agg(F.lit(n).alias("version"), F.count("*").alias("n"))
    return counted(first, 1).unionByName(counted(second, 2))


@query(D.query(D.FINDS, body="SELECT coalesce(severity, 'none') AS issue, CAST(count(*) AS BIGINT) AS n, to_json(list_sort(list(finding_id ORDER BY finding_id)[1:200])) AS ids FROM finds GROUP BY 1"))
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    """Findings by severity as an audit report: their number and up to 200 ids."""
    issues = corpus.findings(spark, d).select(F.coalesce("severity", F.lit("none")).alias("issue"), "finding_id")
    return sinks.audit_report(issues, "finding_id").select("issue", "n", F.col("ids"))


@query("SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(len(string_split(text, chr(10))) + 2) AS BIGINT) AS lines FROM documents WHERE kind = 'code' AND text IS NOT NULL AND path IS NOT NULL AND text NOT LIKE '%' || chr(13) || '%'")
def text_dump(spark: SparkSession, d: str) -> DataFrame:
    """Code documents in one text with a header line for each, its files and lines counted."""
    path = _path(spark, "dump")
    docs = corpus.documents(spark, d).where("kind = 'code' and text is not null and path is not null").where(~F.contains("text", F.lit("\r")))
    sinks.text_dump(docs.select("path", F.col("text").alias("code")), path)
    lines = spark.read.text(path)
    return lines.agg(F.count_if(F.startswith("value", F.lit("# FILE: "))).alias("files"), F.count("*").alias("lines"))


@query(D.query(D.REC, body=f"SELECT record_id, {D.strip(D.field('status', 'answer'))} AS status, sha256(usr) AS user_hash FROM rec WHERE answer IS NOT NULL AND usr IS NOT NULL"))
def prediction_dump(spark: SparkSession, d: str) -> DataFrame:
    """Answers with what was parsed of them, dumped as JSON lines and read back."""
    path = _path(spark, "predictions")
    r = corpus.records(spark, d).where("answer is not null and usr is not null")
    parsed = F.struct(T.field("status", F.col("answer")).alias("status"))
    dump = sinks.prediction_rows(F.col("shape"), F.struct("label", "cwe"), F.col("answer"), parsed, F.col("usr"))
    sinks.write_jsonl(r.select("record_id", dump.alias("p")), path)
    rows, _ = readers.jsonl(spark, path, "record_id bigint, p struct<shape:string, gt:struct<label:string, cwe:string>, raw:string, parsed:struct<status:string>, user:string>")
    return rows.select("record_id", T.strip(F.col("p.parsed.status")).alias("status"), F.sha2("p.user", 256).alias("user_hash"))


@query(D.query(D.REC, body="SELECT sha256(usr) AS key, max(answer) AS raw_text FROM rec WHERE usr IS NOT NULL AND answer IS NOT NULL AND split = 'eval' GROUP BY 1"))
def resume_cache(spark: SparkSession, d: str) -> DataFrame:
    """A cache of answers by the hash of their question, with a broken last line, read for a resumed run."""
    path = _path(spark, "cache")
    r = corpus.records(spark, d).where("usr is not null and answer is not null and split = 'eval'")
    sinks.write_jsonl(r.select(F.sha2("usr", 256).alias("key"), F.col("answer").alias("raw_text")), path)
    spark.createDataFrame([('{"key": "broken", "raw_te',)], "value string").write.mode("append").text(path)
    return readers.cache(spark, path)
