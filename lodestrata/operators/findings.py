"""Findings: chunks, clusters, ranks, SARIF in and out, cost figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import dims

#: Order of exploitation within a severity. Fixed values.
CWE_ORDER = {"CWE-798": 0, "CWE-502": 1, "CWE-78": 1, "CWE-89": 2, "CWE-918": 3, "CWE-22": 4, "CWE-79": 5, "CWE-338": 6}


def balance_bar(vuln: Column, safe: Column, width: int = 20) -> Column:
    """A bar of V and S in the proportion of both counts; all S where both are 0."""
    v = F.when(vuln + safe == 0, 0).otherwise(F.floor(vuln * width / (vuln + safe))).cast("int")
    return F.concat(F.repeat(F.lit("V"), v), F.repeat(F.lit("S"), F.lit(width) - v))


def skewed(vuln: Column, safe: Column) -> Column:
    return (safe == 0) | (vuln == 0) | (vuln > 5 * F.greatest(safe, F.lit(1))) | (safe > 5 * F.greatest(vuln, F.lit(1)))


def cost_estimate(sample: DataFrame, tokens: str, calls: int, output_tokens: int, input_price: float, output_price: float) -> DataFrame:
    """Tokens and cost of ``calls`` calls with prompts like the sample's; 1500 tokens each without a sample."""
    mean = sample.agg(F.coalesce(F.floor(F.sum(tokens) / F.count("*")), F.lit(1500)).cast("bigint").alias("mean_tokens"))
    put_in, put_out = F.col("mean_tokens") * calls, F.lit(output_tokens * calls).cast("bigint")
    return mean.select("mean_tokens", put_in.alias("input_tokens"), put_out.alias("output_tokens"), (put_in / 1e6 * input_price + put_out / 1e6 * output_price).alias("cost"))


def clusters(findings: DataFrame) -> DataFrame:
    """One row for each repository and CWE, with the severity of its first finding."""
    first = F.min_by(F.coalesce(F.upper("severity"), F.lit("MEDIUM")), "finding_id")
    return findings.groupBy("owner_repo", "cwe").agg(first.alias("severity"), F.count("*").alias("n"), F.min("finding_id").alias("first_id"))


def tally(findings: DataFrame) -> DataFrame:
    """Severity tally of each repository's clusters and whether an information leak helps other findings."""
    c = clusters(findings)
    return c.groupBy("owner_repo").agg(
        F.count("*").alias("logical"),
        (F.sum("n") - F.count("*")).alias("duplicates"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in dims.SEVERITY_RANK],
        (F.bool_or(F.col("cwe") == "CWE-209") & F.bool_or(F.col("cwe").isin("CWE-89", "CWE-22", "CWE-918"))).alias("leak_amplifies"),
    )


def ranked(findings: DataFrame) -> DataFrame:
    """Rank of every cluster within its repository; a repository has as many clusters as CWE ids, so a window is bounded."""
    severity = F.coalesce(dims.lookup({"HIGH": "0", "MEDIUM": "1", "LOW": "2"}, F.col("severity")).cast("int"), F.lit(9))
    cost = F.coalesce(dims.lookup({k: str(v) for k, v in CWE_ORDER.items()}, F.col("cwe")).cast("int"), F.lit(99))
    order = Window.partitionBy("owner_repo").orderBy(severity, cost, "cwe")
    return clusters(findings).select("owner_repo", "cwe", F.row_number().over(order).cast("bigint").alias("rank"))


SARIF_SCHEMA = (
    "runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string,properties:struct<tags:array<string>>>>>>,"
    "results:array<struct<ruleId:string,message:struct<text:string>,codeFlows:array<struct<threadFlows:array<struct<locations:array<struct<"
    "message:struct<text:string>,location:struct<message:struct<text:string>,physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>>>>>>"
)


def sarif_flows(documents: DataFrame, text: str = "text") -> DataFrame:
    """Taint flows over two files or more: cwe, message, steps (uri, line, message).

    The CWE comes from the tags of the result's rule, CWE-20 without one.
    Steps without a file are left out; text that is no SARIF gives no rows.
    """
    runs = documents.select(F.from_json(text, SARIF_SCHEMA).alias("d")).select(F.explode("d.runs").alias("run"))
    flows = (
        runs.select("run.tool.driver.rules", F.explode("run.results").alias("r"))
        .select("rules", F.col("r.ruleId").alias("rule"), F.col("r.message.text").alias("message"), F.explode("r.codeFlows").alias("c"))
        .select("rules", "rule", "message", F.explode("c.threadFlows").alias("t"))
    )
    step = F.transform(
        "t.locations",
        lambda x: F.struct(
            x["location"]["physicalLocation"]["artifactLocation"]["uri"].alias("uri"),
            x["location"]["physicalLocation"]["region"]["startLine"].alias("line"),
            F.trim(F.coalesce(x["location"]["message"]["text"], x["message"]["text"], F.lit(""))).alias("message"),
        ),
    )
    own = F.get(F.filter("rules", lambda r: r["id"] == F.col("rule")), 0)["properties"]["tags"]
    tags = F.array_join(F.coalesce(own, F.array().cast("array<string>")), " ")
    number = F.regexp_extract(tags, r"(?i)cwe[-/]0*(\d+)", 1)
    return (
        flows.select(
            F.when(number != "", F.concat(F.lit("CWE-"), number)).otherwise("CWE-20").alias("cwe"),
            F.coalesce("message", F.lit("")).alias("message"),
            F.filter(step, lambda s: s["uri"].isNotNull()).alias("steps"),
        )
        .where(F.size(F.array_distinct(F.transform("steps", lambda s: s["uri"]))) >= 2)
        .where(F.size("steps") >= 2)
    )


def flow_trace(flows: DataFrame) -> DataFrame:
    """Flows as trace text: the chain of up to eight steps and the role of each."""
    base = lambda uri: F.regexp_extract(uri, r"([^/]+)$", 1)
    first = F.slice("steps", 1, 8)
    chain = F.array_join(F.transform(first, lambda s: F.concat_ws(":", base(s["uri"]), s["line"].cast("string"))), " -> ")
    last = F.size("steps") - 1
    role = lambda i: F.when(i == 0, "Source").when(i == last, "Sink").otherwise("Step")
    told = lambda s, i: F.when(s["message"] != "", s["message"]).when(i == 0, "untrusted input enters here").when(i == last, "the tainted value reaches a dangerous operation").otherwise("the value propagates unchanged")
    lines = F.transform(
        first,
        lambda s, i: F.concat((i + 1).cast("string"), F.lit(". ["), role(i), F.lit(" — "), base(s["uri"]), F.lit(":"), s["line"].cast("string"), F.lit("] "), told(s, i)),
    )
    return flows.select("cwe", chain.alias("trace"), F.array_join(lines, "\n").alias("think"), F.size(F.array_distinct(F.transform("steps", lambda s: s["uri"]))).alias("files"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """SARIF results, one JSON object a row: a report is a concatenation of rows and never gathered in one task."""
    text = F.concat(
        F.trim(F.concat_ws(" ", "cwe", F.concat(F.coalesce(dims.lookup(dims.CWE_NAMES, F.col("cwe")), F.lit("")), F.lit(":")), "trace")),
        F.when(F.lower(F.coalesce("fix", F.lit("none"))) != "none", F.concat(F.lit("  Fix: "), F.col("fix"))).otherwise(""),
    )
    result = F.struct(
        F.col("cwe").alias("ruleId"),
        F.coalesce(dims.lookup(dims.SARIF_LEVEL, F.upper("severity")), F.lit("warning")).alias("level"),
        F.struct(text.alias("text")).alias("message"),
        F.array(
            F.struct(
                F.struct(
                    F.struct(F.replace("file", F.lit("\\"), F.lit("/")).alias("uri")).alias("artifactLocation"),
                    F.struct(F.greatest(F.lit(1), F.coalesce("line", F.lit(1))).alias("startLine")).alias("region"),
                ).alias("physicalLocation")
            )
        ).alias("locations"),
        F.struct(F.substring(F.sha2(F.concat_ws("", "file", "cwe", "unit"), 256), 1, 16).alias("primary")).alias("partialFingerprints"),
    )
    return findings.select("finding_id", F.to_json(result).alias("result"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One SARIF rule for each CWE, with the score of its first finding's severity."""
    number = F.regexp_extract("cwe", r"(\d+)$", 1)
    name = F.coalesce(dims.lookup(dims.CWE_NAMES, F.col("cwe")), F.col("cwe"))
    score = F.coalesce(dims.lookup(dims.SARIF_SCORE, F.upper(F.col("severity"))), F.lit("5.5"))
    first = findings.groupBy("cwe").agg(F.min_by("severity", "finding_id").alias("severity"))
    rule = F.struct(
        F.col("cwe").alias("id"),
        name.alias("name"),
        F.struct(name.alias("text")).alias("shortDescription"),
        F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), number, F.lit(".html")).alias("helpUri"),
        F.struct(F.array(F.lit("security"), F.concat(F.lit("external/cwe/cwe-"), F.lpad(number, 3, "0"))).alias("tags"), score.alias("security-severity")).alias("properties"),
    )
    return first.select("cwe", F.to_json(rule).alias("rule"))


def sarif_document(findings: DataFrame, tool: str = "lodestrata", most: int = 100_000) -> DataFrame:
    """The whole SARIF report as one row, for ``most`` findings at most; more are an error, as they would not fit in one."""
    if findings.limit(most + 1).count() > most:
        raise ValueError(f"a report of one document takes {most} findings at most; write sarif_results instead")
    rules = sarif_rules(findings).agg(F.array_sort(F.collect_list("rule"))).scalar()
    results = sarif_results(findings).agg(F.array_sort(F.collect_list(F.struct("finding_id", "result"))).alias("r")).withColumn("u", rules)
    body = F.concat(
        F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"' + tool + '","version":"0.1","rules":['),
        F.array_join("u", ","), F.lit("]}},\"results\":["), F.array_join(F.transform("r", lambda x: x["result"]), ","), F.lit("]}]}"),
    )
    return results.select(body.alias("document"))
