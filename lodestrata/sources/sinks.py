"""Writers: JSON lines, routed tables, versioned rewrites, reports.

Writers never overwrite what they read: a rewrite goes to a new version, and
an append leaves out ids that are already there, so a repeated run adds
nothing.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def route(df: DataFrame, path: str, *by: str) -> None:
    """One table with a partition for each route (disposition, shape, bucket ...)."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def _exists(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(target)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append rows whose key is not in the table yet, one row a key; the number of rows is returned."""
    new = df.dropDuplicates([key])
    if _exists(df, path):
        new = new.join(df.sparkSession.read.parquet(path).select(key), key, "left_anti")
    new = new.cache()
    try:
        n = new.count()
        if n:
            new.write.mode("append").parquet(path)
        return n
    finally:
        new.unpersist()


def new_version(df: DataFrame, folder: str) -> str:
    """Write the survivors of a rewrite as the next version under ``folder``; the input stays as its backup."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    taken = [p.getPath().getName() for p in fs.listStatus(root)] if fs.exists(root) else []
    numbers = [int(n[1:]) for n in taken if n[:1] == "v" and n[1:].isdigit()]
    path = f"{folder}/v{max(numbers, default=0) + 1:05d}"
    df.write.parquet(path)
    return path


def audit_report(issues: DataFrame, ids: str, most: int = 200) -> DataFrame:
    """One row for each issue: n and up to ``most`` ids as JSON; the rest stays in the issues' own table."""
    from lodestrata.operators.sampling import per_group

    some = per_group(issues, ["issue"], [ids], most).groupBy("issue").agg(F.to_json(F.array_sort(F.collect_list(ids))).alias("ids"))
    return issues.groupBy("issue").agg(F.count("*").alias("n")).join(some, "issue")


def run_document(metrics: DataFrame, label: str, commit: str | None = None, config: dict | None = None, stamp: datetime | None = None) -> str:
    """Run file of a metric table (shape, metric, value): a document of as many values as shapes and metrics."""
    layer: dict[str, dict[str, float]] = {}
    for row in metrics.select("shape", "metric", "value").collect():
        layer.setdefault(row["shape"], {})[row["metric"]] = row["value"]
    when = (stamp or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return json.dumps({"label": label, "timestamp": when, "git_commit": commit, "config": config or {}, "layer1": layer}, sort_keys=True)


def dashboard(metrics: DataFrame, title: str) -> str:
    """The metrics of a run as text, by shape."""
    lines = [title, "=" * len(title)]
    shape = None
    for row in metrics.orderBy("shape", "metric").collect():
        if row["shape"] != shape:
            shape = row["shape"]
            lines.append(f"\n{shape}")
        lines.append(f"  {row['metric']:<28}{'-' if row['value'] is None else format(row['value'], '>12.4f')}")
    return "\n".join(lines)


def pretty_findings(findings: DataFrame, explain: bool = False) -> str:
    """Findings as text by file, read row by row from the cluster."""
    lines, file = [], None
    for f in findings.orderBy("file", F.expr("case upper(severity) when 'HIGH' then 0 when 'LOW' then 2 else 1 end"), "line").toLocalIterator():
        if f["file"] != file:
            file = f["file"]
            lines.append(f"\n{file}")
        lines.append(f"  {f['line']}: {f['severity']} {f['cwe']} in {f['unit']}: {f['trace']}")
        if f["fix"] and f["fix"].lower() != "none":
            lines.append(f"      fix: {f['fix']}")
        if explain and f["think"]:
            lines.append(f"      why: {f['think']}")
    return "\n".join(lines).lstrip("\n")


def text_dump(files: DataFrame, path: str) -> None:
    """All files as text under a header line with their path."""
    files.select(F.concat(F.lit("# FILE: "), F.col("path"), F.lit("\n"), F.col("code"), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def write_targets(targets: DataFrame, path: str) -> None:
    targets.write.mode("overwrite").option("sep", "\t").csv(path)


def prediction_rows(shape: Column, truth: Column, raw: Column, parsed: Column, user: Column) -> Column:
    """The struct of a prediction dump."""
    return F.struct(shape.alias("shape"), truth.alias("gt"), raw.alias("raw"), parsed.alias("parsed"), user.alias("user"))
