"""Queries on reports: balances, histograms, grouping sets, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import dims
from lodestrata.functions import text as T
from lodestrata.operators import findings as O
from lodestrata.plans import duck as D
from lodestrata.plans.registry import query
from lodestrata.sources import corpus

_V, _S = "count_if(label IN ('vuln', 'confirmed'))", "count_if(label = 'safe')"


@query(
    D.query(
        D.REC,
        f"b AS (SELECT coalesce(language, 'unknown') AS language, CAST({_V} AS BIGINT) AS vuln, CAST({_S} AS BIGINT) AS safe FROM rec GROUP BY 1)",
        body="""SELECT language, vuln, safe, CASE WHEN safe = 0 THEN 'all-V' ELSE CAST(CAST(floor(vuln * 10 / safe + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.' || CAST(CAST(floor(vuln * 10 / safe + 0.5) AS BIGINT) % 10 AS VARCHAR) || ':1' END AS ratio,
  repeat('V', CAST(CASE WHEN vuln + safe = 0 THEN 0 ELSE floor(vuln * 20 / (vuln + safe)) END AS INT)) || repeat('S', 20 - CAST(CASE WHEN vuln + safe = 0 THEN 0 ELSE floor(vuln * 20 / (vuln + safe)) END AS INT)) AS bar,
  safe = 0 OR vuln = 0 OR vuln > 5 * greatest(safe, 1) OR safe > 5 * greatest(vuln, 1) AS skewed FROM b""",
    )
)
def balance_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Vulnerable against safe records by language, with a bar and a skew flag."""
    vuln, safe = F.count_if(T.norm_label(F.col("label")) == "vuln"), F.count_if(F.col("label") == "safe")
    b = corpus.records(spark, d).groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(vuln.alias("vuln"), safe.alias("safe"))
    tenths = F.floor(F.col("vuln") * 10 / F.col("safe") + 0.5)
    ratio = F.when(F.col("safe") == 0, "all-V").otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(":1")))
    return b.select("language", "vuln", "safe", ratio.alias("ratio"), O.balance_bar(F.col("vuln"), F.col("safe")).alias("bar"), O.skewed(F.col("vuln"), F.col("safe")).alias("skewed"))


@query(D.query(D.REC, body=f"SELECT coalesce({D.family('gt_cwe')}, 'other') AS family, CAST(count(*) AS BIGINT) AS n, count(*) < 30 AS thin FROM rec WHERE {D.norm_label('label')} = 'vuln' GROUP BY 1"))
def balance_by_family(spark: SparkSession, d: str) -> DataFrame:
    """Vulnerable records by family; under 30 is thin."""
    r = corpus.records(spark, d).where(T.norm_label(F.col("label")) == "vuln")
    return r.groupBy(F.coalesce(T.family(F.col("gt_cwe")), F.lit("other")).alias("family")).agg(F.count("*").alias("n"), (F.count("*") < 30).alias("thin"))


@query(D.query(D.REC, body=f"SELECT coalesce({D.family('gt_cwe')}, 'other') AS family, coalesce(language, 'unknown') AS language, CAST(count(*) AS BIGINT) AS n FROM rec WHERE {D.norm_label('label')} = 'vuln' GROUP BY 1, 2"))
def family_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Vulnerable records by family and language."""
    r = corpus.records(spark, d).where(T.norm_label(F.col("label")) == "vuln")
    return r.groupBy(F.coalesce(T.family(F.col("gt_cwe")), F.lit("other")).alias("family"), F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("n"))


@query(D.query(D.REC, body=f"SELECT shape, CAST(count_if(k = 'vuln') AS BIGINT) AS vuln, CAST(count_if(k = 'safe') AS BIGINT) AS safe, CAST(count_if(k = 'context') AS BIGINT) AS context FROM (SELECT shape, {D.norm_label('label')} AS k FROM rec) GROUP BY 1"))
def balance_by_shape(spark: SparkSession, d: str) -> DataFrame:
    """Labels of each shape side by side."""
    r = corpus.records(spark, d).select("shape", T.norm_label(F.col("label")).alias("k"))
    return r.groupBy("shape").pivot("k", ["vuln", "safe", "context"]).agg(F.count(F.lit(1))).na.fill(0, ["vuln", "safe", "context"])


@query(D.query(D.REC, body=f"SELECT CAST({_V} AS BIGINT) AS vuln, CAST({_S} AS BIGINT) AS safe, {D.percent(_V, f'{_V} + {_S}')} AS vuln_percent FROM rec"))
def balance_overall(spark: SparkSession, d: str) -> DataFrame:
    """Vulnerable share of all labelled records; 0 where there are none."""
    vuln, safe = F.count_if(T.norm_label(F.col("label")) == "vuln"), F.count_if(F.col("label") == "safe")
    return corpus.records(spark, d).agg(vuln.alias("vuln"), safe.alias("safe")).withColumn("vuln_percent", T.percent(F.col("vuln"), F.col("vuln") + F.col("safe")))


@query(
    D.query(
        D.REC,
        f"t AS (SELECT shape, label, coalesce({D.lookup(dims.TIERS, 'shape')}, 'other') AS tier, language FROM rec)",
        body="SELECT CASE WHEN grouping(shape) = 0 THEN 'shape' WHEN grouping(label) = 0 THEN 'label' WHEN grouping(tier) = 0 THEN 'tier' ELSE 'language' END AS dimension, coalesce(shape, label, tier, language) AS value, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY GROUPING SETS ((shape), (label), (tier), (language))",
    )
)
def label_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Records by shape, label, tier and language in one pass."""
    t = corpus.records(spark, d).select("shape", "label", F.coalesce(dims.lookup(dims.TIERS, F.col("shape")), F.lit("other")).alias("tier"), "language")
    sets = ["shape", "label", "tier", "language"]
    counted = t.groupingSets([[F.col(c)] for c in sets], *[F.col(c) for c in sets]).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"g_{c}") for c in sets])
    dimension = F.when(F.col("g_shape") == 0, "shape").when(F.col("g_label") == 0, "label").when(F.col("g_tier") == 0, "tier").otherwise("language")
    return counted.select(dimension.alias("dimension"), F.coalesce(*sets).alias("value"), "n")


@query(
    D.query(
        D.REC,
        f"k AS (SELECT gt_cwe, {D.classify('usr', 'cwe')} AS code_cwe FROM rec WHERE {D.norm_label('label')} = 'vuln' AND usr IS NOT NULL)",
        body=f"SELECT gt_cwe || '->' || code_cwe AS pair, CAST(count(*) AS BIGINT) AS n FROM k WHERE {D.family('gt_cwe')} <> {D.family('code_cwe')} GROUP BY 1 ORDER BY n DESC, pair LIMIT 10",
    )
)
def cwe_mismatch_top10(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent pairs of stated CWE and another family's CWE read from the code."""
    known = (T.norm_label(F.col("label")) == "vuln") & F.col("usr").isNotNull()
    r = corpus.mapped(spark, d, "records", known, "gt_cwe", T.classify(F.col("usr"))["cwe"].alias("code_cwe"))
    k = r.where(T.family(F.col("gt_cwe")) != T.family(F.col("code_cwe")))
    return k.groupBy(F.concat_ws("->", "gt_cwe", "code_cwe").alias("pair")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pair").limit(10)


@query("SELECT owner_repo, CAST(count(*) AS BIGINT) AS patches, CAST(count(DISTINCT path) AS BIGINT) AS paths FROM documents WHERE kind = 'patch' AND owner_repo IS NOT NULL GROUP BY 1 ORDER BY patches DESC, owner_repo LIMIT 20")
def repo_patch_counts(spark: SparkSession, d: str) -> DataFrame:
    """The twenty repositories with the most patches."""
    p = corpus.documents(spark, d).where("kind = 'patch' and owner_repo is not null")
    return p.groupBy("owner_repo").agg(F.count("*").alias("patches"), F.count_distinct("path").alias("paths")).orderBy(F.desc("patches"), "owner_repo").limit(20)


@query("SELECT owner_repo, CASE WHEN count(*) FILTER (WHERE lang = 'python') >= count(*) FILTER (WHERE lang = 'javascript') THEN 'python' ELSE 'javascript' END AS language FROM documents WHERE kind = 'patch' AND owner_repo IS NOT NULL GROUP BY 1")
def repo_language(spark: SparkSession, d: str) -> DataFrame:
    """Dominant language of each repository over all of its patches."""
    p = corpus.documents(spark, d).where("kind = 'patch' and owner_repo is not null")
    main = F.when(F.count_if(F.col("lang") == "python") >= F.count_if(F.col("lang") == "javascript"), "python").otherwise("javascript")
    return p.groupBy("owner_repo").agg(main.alias("language"))


@query(
    D.query(
        D.FINDS,
        "c AS (SELECT owner_repo, cwe, count(*) AS n, list_sort(list(DISTINCT file)) AS files, min(finding_id) AS first_id FROM finds WHERE owner_repo IS NOT NULL AND cwe IS NOT NULL AND file IS NOT NULL GROUP BY ALL)",
        body="SELECT owner_repo, cwe, CAST(n AS BIGINT) AS findings, CAST(len(files) AS BIGINT) AS files, first_id, n > 1 AS clustered FROM c",
    )
)
def cluster_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of a repository clustered by CWE, with their first one and number of files."""
    f = corpus.findings(spark, d).where("owner_repo is not null and cwe is not null and file is not null")
    return f.groupBy("owner_repo", "cwe").agg(
        F.count("*").alias("findings"), F.count_distinct("file").alias("files"), F.min("finding_id").alias("first_id"), (F.count("*") > 1).alias("clustered")
    )


@query(
    D.query(
        D.FINDS,
        "c AS (SELECT owner_repo, cwe, min(finding_id) AS first_id, count(*) AS n FROM finds WHERE owner_repo IS NOT NULL AND cwe IS NOT NULL GROUP BY ALL)",
        "s AS (SELECT c.*, coalesce(upper(f.severity), 'MEDIUM') AS severity FROM c JOIN finds f ON f.finding_id = c.first_id)",
        body="""SELECT owner_repo, CAST(count(*) AS BIGINT) AS logical, CAST(sum(n) - count(*) AS BIGINT) AS duplicates, CAST(count_if(severity = 'HIGH') AS BIGINT) AS high,
  CAST(count_if(severity = 'MEDIUM') AS BIGINT) AS medium, CAST(count_if(severity = 'LOW') AS BIGINT) AS low, bool_or(cwe = 'CWE-209') AND bool_or(cwe IN ('CWE-89', 'CWE-22', 'CWE-918')) AS leak_amplifies FROM s GROUP BY 1""",
    )
)
def synthesis_tally(spark: SparkSession, d: str) -> DataFrame:
    """Logical findings, duplicates, severities and a systemic rule of each repository."""
    return O.tally(corpus.findings(spark, d).where("owner_repo is not null and cwe is not null"))


@query(
    D.query(
        D.FINDS,
        "c AS (SELECT owner_repo, cwe, min(finding_id) AS first_id FROM finds WHERE owner_repo IS NOT NULL AND cwe IS NOT NULL GROUP BY ALL)",
        "s AS (SELECT c.*, coalesce(upper(f.severity), 'MEDIUM') AS severity FROM c JOIN finds f ON f.finding_id = c.first_id)",
        body="""SELECT owner_repo, cwe, CAST(row_number() OVER (PARTITION BY owner_repo ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 9 END,
  CASE cwe WHEN 'CWE-798' THEN 0 WHEN 'CWE-502' THEN 1 WHEN 'CWE-78' THEN 1 WHEN 'CWE-89' THEN 2 WHEN 'CWE-918' THEN 3 WHEN 'CWE-22' THEN 4 WHEN 'CWE-79' THEN 5 WHEN 'CWE-338' THEN 6 ELSE 99 END, cwe) AS BIGINT) AS rank FROM s""",
    )
)
def rank_findings(spark: SparkSession, d: str) -> DataFrame:
    """Rank of each cluster of a repository by severity, cost of exploitation and name."""
    return O.ranked(corpus.findings(spark, d).where("owner_repo is not null and cwe is not null"))


@query(D.query(D.FINDS, body="SELECT owner_repo, file, CAST(count(*) AS BIGINT) AS findings FROM finds WHERE owner_repo IS NOT NULL AND file IS NOT NULL GROUP BY ALL"))
def project_map(spark: SparkSession, d: str) -> DataFrame:
    """Distinct files of each repository with their findings, one row a file: a repository may have any number of them."""
    f = corpus.findings(spark, d).where("owner_repo is not null and file is not null")
    return f.groupBy("owner_repo", "file").agg(F.count("*").alias("findings"))


@query(D.query(D.PAIRS, body="SELECT source, language, cwe, CAST(count(*) AS BIGINT) AS n, CAST(grouping(source) * 4 + grouping(language) * 2 + grouping(cwe) AS BIGINT) AS level FROM pairs GROUP BY GROUPING SETS ((source), (language), (cwe))"))
def converter_stats(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by source, by language and by CWE in one pass."""
    p = corpus.pairs(spark, d).select("source", "language", "cwe")
    sets = ["source", "language", "cwe"]
    counted = p.groupingSets([[F.col(c)] for c in sets], *[F.col(c) for c in sets])
    return counted.agg(F.count("*").alias("n"), F.grouping_id(*sets).alias("level")).select("source", "language", "cwe", "n", F.col("level").cast("bigint").alias("level"))


@query(D.query(D.REC, D.PAIRS, D.TASKS, D.FINDS, body="SELECT 'records' AS relation, CAST(count(*) AS BIGINT) AS n FROM rec UNION ALL SELECT 'pairs', count(*) FROM pairs UNION ALL SELECT 'tasks', count(*) FROM tasks UNION ALL SELECT 'findings', count(*) FROM finds"))
def record_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every relation, redelivered ones once."""
    parts = {"records": corpus.records, "pairs": corpus.pairs, "tasks": corpus.tasks, "findings": corpus.findings}
    out = None
    for name, read in parts.items():
        one = read(spark, d).agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    D.query(
        D.REC,
        f"s AS (SELECT {D.approx_tokens('usr')} AS t FROM rec WHERE usr IS NOT NULL)",
        body="SELECT CAST(sum(t) // count(*) AS BIGINT) AS mean_tokens, CAST((sum(t) // count(*)) * 1000 AS BIGINT) AS input_tokens, CAST(1500 * 1000 AS BIGINT) AS output_tokens, (sum(t) // count(*)) * 1000 / 1e6 * 3.0 + 1500 * 1000 / 1e6 * 15.0 AS cost FROM s",
    )
)
def token_cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Estimated cost of 1000 calls with prompts like the corpus' questions, 3 and 15 a million tokens."""
    sample = corpus.mapped(spark, d, "records", "usr is not null", T.approx_tokens(F.col("usr")).alias("t"))
    return O.cost_estimate(sample, "t", calls=1000, output_tokens=1500, input_price=3.0, output_price=15.0)


@query(
    D.query(
        D.REC,
        body=f"""SELECT shape, CAST(count(*) AS BIGINT) AS attempted, CAST(count_if(answer IS NULL) AS BIGINT) AS errors, CAST(count_if(answer IS NOT NULL AND {D.think('answer')} IS NULL) AS BIGINT) AS discarded,
  {D.ratio(f"count_if(answer IS NOT NULL AND {D.think('answer')} IS NULL)", "count_if(answer IS NOT NULL)")} AS discard_rate FROM rec GROUP BY 1""",
    )
)
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    """Attempts, errors and discards of a generation run by shape; errors do not count for the rate."""
    answer = F.col("answer")
    r = corpus.mapped(spark, d, "records", F.lit(True), "shape", answer.isNotNull().alias("made"), (answer.isNotNull() & T.think(answer).isNull()).alias("bad"))
    discarded, tried = F.count_if("bad"), F.count_if("made")
    return r.groupBy("shape").agg(F.count("*").alias("attempted"), F.count_if(~F.col("made")).alias("errors"), discarded.alias("discarded"), T.ratio(discarded, tried).alias("discard_rate"))


@query(
    D.query(
        D.FINDS,
        body="SELECT CAST(finding_id % 3 + 1 AS BIGINT) AS attempt, CAST(count_if(status = 'confirmed') AS BIGINT) AS kept, CAST(count_if(status IS DISTINCT FROM 'confirmed') AS BIGINT) AS dropped FROM finds GROUP BY 1",
    )
)
def attempt_stats(spark: SparkSession, d: str) -> DataFrame:
    """Kept and dropped rows by attempt number (made from the id)."""
    f = corpus.findings(spark, d)
    kept = F.coalesce(F.col("status") == "confirmed", F.lit(False))
    return f.groupBy((F.col("finding_id") % 3 + 1).cast("bigint").alias("attempt")).agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))


@query(D.query(D.REC, "q AS (SELECT unnest(quarantine_reasons) AS r FROM rec)", body="SELECT string_split(r, ':')[1] AS reason, CAST(count(*) AS BIGINT) AS n FROM q GROUP BY 1"))
def drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Quarantine reasons by their name."""
    q = corpus.records(spark, d).select(F.explode("quarantine_reasons").alias("r"))
    return q.groupBy(F.substring_index("r", ":", 1).alias("reason")).agg(F.count("*").alias("n"))
