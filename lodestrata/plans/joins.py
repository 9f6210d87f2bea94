"""Queries on duplicates, leaks, lookups and other joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import dims
from lodestrata.functions import text as T
from lodestrata.operators import dedup
from lodestrata.plans import duck as D
from lodestrata.plans.registry import query
from lodestrata.sources import corpus

_KEYED = f"keyed AS (SELECT record_id, split, label, {D.norm_label('label')} AS kind, usr, {D.exact_hash('usr')} AS exact, {D.normal_hash('usr')} AS normal, CAST(length(usr) AS BIGINT) AS chars FROM rec WHERE usr IS NOT NULL)"


def keyed(spark: SparkSession, d: str) -> DataFrame:
    """Records with the exact and the normalised hash of their question."""
    return corpus.mapped(
        spark,
        d,
        "records",
        "usr is not null",
        "split",
        T.norm_label(F.col("label")).alias("kind"),
        T.exact_hash(F.col("usr")).alias("exact"),
        T.normal_hash(F.col("usr")).alias("normal"),
        F.length("usr").cast("bigint").alias("chars"),
    )


@query(D.query(D.REC, _KEYED, body="SELECT record_id FROM keyed WHERE split = 'train' AND exact NOT IN (SELECT exact FROM keyed WHERE split = 'eval')"))
def leak_exact_anti(spark: SparkSession, d: str) -> DataFrame:
    """Training records whose question is in no evaluation record."""
    k = keyed(spark, d)
    return dedup.not_leaked(k.where("split = 'train'"), k.where("split = 'eval'"), "exact").select("record_id")


@query(D.query(D.REC, _KEYED, body="SELECT record_id FROM keyed WHERE split = 'train' AND normal IN (SELECT normal FROM keyed WHERE split = 'eval')"))
def leak_norm_semi(spark: SparkSession, d: str) -> DataFrame:
    """Training records whose question is, but for comments, blanks and case, an evaluation record's."""
    k = keyed(spark, d)
    return dedup.leaked(k.where("split = 'train'"), k.where("split = 'eval'"), "normal").select("record_id")


_BOTH = "SELECT exact FROM keyed GROUP BY 1 HAVING bool_or(kind = 'safe') AND bool_or(kind = 'vuln')"


@query(D.query(D.REC, _KEYED, body=_BOTH))
def contradiction_groups(spark: SparkSession, d: str) -> DataFrame:
    """Questions that are labelled safe and vulnerable."""
    return dedup.contradictory_keys(keyed(spark, d), "exact", "kind")


@query(D.query(D.REC, _KEYED, body=f"SELECT record_id FROM keyed WHERE exact NOT IN ({_BOTH})"))
def contradiction_free(spark: SparkSession, d: str) -> DataFrame:
    """Records whose question is labelled one way."""
    return dedup.without_contradictions(keyed(spark, d), "exact", "kind").select("record_id")


@query(D.query(D.REC, _KEYED, body="SELECT min(record_id) AS record_id, exact FROM keyed GROUP BY exact"))
def exact_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """The first record of every question."""
    return dedup.first_by_key(keyed(spark, d).select("record_id", "exact"), "exact", ["record_id"])


@query(D.query(D.REC, _KEYED, body="SELECT CAST(count(*) AS BIGINT) AS blocks FROM (SELECT exact FROM keyed GROUP BY 1 HAVING count(*) > 1)"))
def duplicate_block_count(spark: SparkSession, d: str) -> DataFrame:
    """Number of questions that stand more than once."""
    return dedup.duplicate_keys(keyed(spark, d), "exact").agg(F.count("*").alias("blocks"))


_HARDEN = """first_ok AS (SELECT normal, min(CASE WHEN chars <= 1200 THEN record_id END) AS first_id FROM keyed WHERE split = 'train' GROUP BY 1),
buckets AS (SELECT k.record_id, k.kind, CASE WHEN k.normal IN (SELECT normal FROM keyed WHERE split = 'eval') THEN 'leak'
  WHEN k.record_id > f.first_id THEN 'neardup' WHEN k.chars > 1200 THEN 'overlength' ELSE 'keep' END AS bucket
  FROM keyed k JOIN first_ok f USING (normal) WHERE k.split = 'train')"""


def hardened(spark: SparkSession, d: str) -> DataFrame:
    """Training records with their bucket; 1200 characters stand for the training window."""
    k = keyed(spark, d)
    return dedup.harden(k.where("split = 'train'"), k.where("split = 'eval'"), "normal", "record_id", "chars", 1200)


@query(D.query(D.REC, _KEYED, _HARDEN, body="SELECT bucket, CAST(count(*) AS BIGINT) AS n FROM buckets GROUP BY 1"))
def harden_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Training records by hardening bucket."""
    return hardened(spark, d).groupBy("bucket").agg(F.count("*").alias("n"))


@query(D.query(D.REC, _KEYED, _HARDEN, body="SELECT record_id, bucket FROM buckets"))
def harden_rows(spark: SparkSession, d: str) -> DataFrame:
    """The bucket of every training record."""
    return hardened(spark, d).select("record_id", "bucket")


@query(D.query(D.REC, _KEYED, _HARDEN, body="SELECT kind, CAST(count(*) AS BIGINT) AS n FROM buckets WHERE bucket = 'keep' GROUP BY 1"))
def survivor_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the records that hardening keeps."""
    return hardened(spark, d).where("bucket = 'keep'").groupBy("kind").agg(F.count("*").alias("n"))


@query(
    """SELECT doc_id, bucket FROM (SELECT t.doc_id, CASE WHEN t.h IN (SELECT """
    + D.normal_hash("text")
    + """ FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL) THEN 'leak' WHEN t.doc_id > f.first_id THEN 'neardup' WHEN t.chars > 6000 THEN 'overlength' ELSE 'keep' END AS bucket
FROM (SELECT doc_id, """
    + D.normal_hash("text")
    + """ AS h, length(text) AS chars FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL) t
JOIN (SELECT """
    + D.normal_hash("text")
    + """ AS h, min(CASE WHEN length(text) <= 6000 THEN doc_id END) AS first_id FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL GROUP BY 1) f USING (h))"""
)
def harden_documents(spark: SparkSession, d: str) -> DataFrame:
    """Hardening of the documents, every fifth one held out as the evaluation side."""
    docs = corpus.documents(spark, d).where("text is not null").select("doc_id", T.normal_hash(F.col("text")).alias("h"), F.length("text").alias("chars"))
    return dedup.harden(docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0"), "h", "doc_id", "chars").select("doc_id", "bucket")


@query(D.query(D.FINDS, body="SELECT finding_id FROM finds WHERE finding_id NOT IN (SELECT finding_id FROM finds WHERE status = 'confirmed')"))
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Work that is not done yet: ids without an output row."""
    f = corpus.findings(spark, d).select("finding_id", "status")
    return f.join(f.where("status = 'confirmed'").select("finding_id"), "finding_id", "left_anti").select("finding_id")


@query(
    D.query(
        D.REC,
        "keys AS (SELECT record_id, sha256(shape || chr(1) || usr) AS k, answer, split FROM rec WHERE usr IS NOT NULL AND shape IS NOT NULL)",
        body="SELECT a.record_id, coalesce(c.cached, 'computed') AS output FROM keys a LEFT JOIN (SELECT k, min(sha256(answer)) AS cached FROM keys WHERE split = 'train' GROUP BY 1) c USING (k)",
    )
)
def resume_cache_join(spark: SparkSession, d: str) -> DataFrame:
    """Cached outputs by shape and question; what is not cached is to be computed."""
    key = F.sha2(F.concat("shape", F.lit("\x01"), "usr"), 256)
    keys = corpus.mapped(spark, d, "records", "usr is not null and shape is not null", "split", F.sha2("answer", 256).alias("output"), key.alias("k"))
    cache = keys.where("split = 'train'").groupBy("k").agg(F.min("output").alias("cached"))
    return keys.join(cache, "k", "left").select("record_id", F.coalesce("cached", F.lit("computed")).alias("output"))


@query(
    D.query(
        D.REC,
        f"gold AS (SELECT {D.exact_hash('usr')} AS h, min(sha256(answer)) AS gold FROM rec WHERE split = 'eval' AND usr IS NOT NULL GROUP BY 1)",
        body=f"SELECT record_id, coalesce(gold, '') AS gold FROM (SELECT record_id, {D.exact_hash('usr')} AS h FROM rec WHERE usr IS NOT NULL) LEFT JOIN gold USING (h)",
    )
)
def gold_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Gold answers by question, '' where there is none."""
    rec = corpus.mapped(spark, d, "records", "usr is not null", "split", F.sha2("answer", 256).alias("answer"), T.exact_hash(F.col("usr")).alias("h"))
    gold = rec.where("split = 'eval'").groupBy("h").agg(F.min("answer").alias("gold"))
    return rec.join(gold, "h", "left").select("record_id", F.coalesce("gold", F.lit("")).alias("gold"))


@query(
    """SELECT b.finding_id, b.status AS before_status, a.status AS after_status, date_diff('hour', b.ingested_at, a.ingested_at) AS hours
FROM findings b JOIN findings a ON a.finding_id = b.finding_id AND a.ingested_at > b.ingested_at"""
)
def before_after_inner_join(spark: SparkSession, d: str) -> DataFrame:
    """Findings that were delivered twice: the row before beside the row after."""
    f = corpus.table(spark, d, "findings").select("finding_id", "status", "ingested_at")
    before = f.select("finding_id", F.col("status").alias("before_status"), F.col("ingested_at").alias("before_at"))
    after = f.select("finding_id", F.col("status").alias("after_status"), F.col("ingested_at").alias("after_at"))
    hours = F.timestamp_diff("HOUR", F.date_trunc("hour", "before_at"), F.date_trunc("hour", "after_at"))
    return before.join(after, "finding_id").where("after_at > before_at").select("finding_id", "before_status", "after_status", hours.alias("hours"))


@query(
    D.query(
        D.FINDS,
        "exact AS (SELECT file, unit, min(severity) AS s FROM finds WHERE severity IS NOT NULL GROUP BY ALL), loose AS (SELECT file, max(severity) AS s FROM finds WHERE severity IS NOT NULL GROUP BY ALL)",
        body="SELECT f.finding_id, coalesce(f.severity, e.s, l.s) AS severity, CASE WHEN f.severity IS NOT NULL THEN 'own' WHEN e.s IS NOT NULL THEN 'unit' WHEN l.s IS NOT NULL THEN 'file' ELSE 'none' END AS origin FROM finds f LEFT JOIN exact e ON f.file = e.file AND f.unit = e.unit LEFT JOIN loose l ON f.file = l.file",
    )
)
def two_level_fallback_join(spark: SparkSession, d: str) -> DataFrame:
    """Severity of a finding, else of its unit, else of its file."""
    f = corpus.findings(spark, d).select("finding_id", "file", "unit", "severity")
    known = f.where("severity is not null")
    unit = known.groupBy("file", "unit").agg(F.min("severity").alias("unit_severity"))
    file = known.groupBy("file").agg(F.max("severity").alias("file_severity"))
    # both lookup sides have one row a key, so a file of a third of all rows only makes a long probe, which AQE splits
    joined = f.join(unit, ["file", "unit"], "left").join(file, "file", "left")
    return joined.select(
        "finding_id",
        F.coalesce("severity", "unit_severity", "file_severity").alias("severity"),
        F.when(F.col("severity").isNotNull(), "own").when(F.col("unit_severity").isNotNull(), "unit").when(F.col("file_severity").isNotNull(), "file").otherwise("none").alias("origin"),
    )


_TYPES = " UNION ALL ".join(f"SELECT {D.lit(t[0])} AS vuln_type, {D.lit(t[1])} AS cwe" for t in dims.TAXONOMY)


@query(
    D.query(
        D.PAIRS, D.TASKS, f"types AS ({_TYPES})",
        body="""SELECT t.vuln_type, CAST(coalesce(h.n, 0) AS BIGINT) AS have, CAST(coalesce(a.n, 0) AS BIGINT) AS available FROM types t
LEFT JOIN (SELECT vuln_type, count(*) AS n FROM pairs GROUP BY 1) h USING (vuln_type) LEFT JOIN (SELECT cwe, count(*) AS n FROM tasks GROUP BY 1) a USING (cwe)""",
    )
)
def coverage_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Every vulnerability type with its pairs and its tasks, zeros filled."""
    types = spark.createDataFrame([(t[0], t[1]) for t in dims.TAXONOMY], "vuln_type string, cwe string")
    have = corpus.pairs(spark, d).groupBy("vuln_type").agg(F.count("*").alias("have"))
    available = corpus.tasks(spark, d).groupBy("cwe").agg(F.count("*").alias("available"))
    return types.join(have, "vuln_type", "left").join(available, "cwe", "left").na.fill(0, ["have", "available"]).select("vuln_type", "have", "available")


@query(
    D.query(
        D.PAIRS,
        body=f"SELECT cwe, coalesce({D.lookup(dims.SEVERITY_BY_CWE, 'cwe')}, 'MEDIUM') AS by_cwe, coalesce({D.lookup(dims.SEVERITY_BY_FAMILY, '(' + D.family('cwe') + ')')}, 'MEDIUM') AS by_family, CAST(count(*) AS BIGINT) AS n FROM pairs GROUP BY ALL",
    )
)
def severity_lookup_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Default severities of a CWE under the CWE table and the family table."""
    cwe = F.col("cwe")
    return (
        corpus.pairs(spark, d)
        .groupBy("cwe")
        .agg(F.count("*").alias("n"))
        .select(
            "cwe",
            F.coalesce(dims.lookup(dims.SEVERITY_BY_CWE, cwe), F.lit("MEDIUM")).alias("by_cwe"),
            F.coalesce(dims.lookup(dims.SEVERITY_BY_FAMILY, T.family(cwe)), F.lit("MEDIUM")).alias("by_family"),
            "n",
        )
    )


@query(D.query(D.FINDS, body=f"SELECT test_id, coalesce({D.lookup(dims.ANALYZER_TESTS, 'test_id')}, {D.lit(dims.ANALYZER_DEFAULT)}) AS description, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'B' || (101 + finding_id % 20) AS test_id FROM finds) GROUP BY ALL"))
def analyzer_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Analyser test ids (made from the finding's id) with their description, a default where there is none."""
    test = F.concat(F.lit("B"), (F.col("finding_id") % 20 + 101).cast("string"))
    tests = corpus.findings(spark, d).groupBy(test.alias("test_id")).agg(F.count("*").alias("n"))
    return tests.select("test_id", F.coalesce(dims.lookup(dims.ANALYZER_TESTS, F.col("test_id")), F.lit(dims.ANALYZER_DEFAULT)).alias("description"), "n")


@query("SELECT r.r_name AS category, n.n_name AS scenario, l.label FROM region r, nation n, (VALUES ('vuln'), ('safe')) l(label)")
def scenario_cross_join(spark: SparkSession, d: str) -> DataFrame:
    """Generation grid of category, scenario and label: two seed tables of fixed size and an array."""
    category = corpus.table(spark, d, "region").select(F.col("r_name").alias("category"))
    scenario = corpus.table(spark, d, "nation").select(F.col("n_name").alias("scenario"))
    grid = category.crossJoin(scenario)  # seed tables of 5 and 25 rows at every scale
    return grid.select("category", "scenario", F.explode(F.array(F.lit("vuln"), F.lit("safe"))).alias("label"))


@query(
    D.query(
        D.FINDS,
        body="""SELECT finding_id, len(list_filter(string_split(coalesce(trace, ''), ' -> '), lambda t: length(t) > 0 AND contains(lower(coalesce(think, '')), lower(t)))) AS named
FROM finds""",
    ).replace("len(list_filter", "CAST(len(list_filter").replace("lower(t)))) AS named", "lower(t)))) AS BIGINT) AS named"), per_row=True)
def title_containment(spark: SparkSession, d: str) -> DataFrame:
    """Steps of a trace that the thought names (containment within a row)."""
    steps = F.split(F.coalesce("trace", F.lit("")), " -> ")
    told = F.lower(F.coalesce("think", F.lit("")))
    named = F.filter(steps, lambda t: (F.length(t) > 0) & F.contains(told, F.lower(t)))
    return corpus.findings(spark, d).select("finding_id", F.size(named).cast("bigint").alias("named"))


@query(
    D.query(
        D.REC,
        "asked AS (SELECT record_id, lower(unnest(regexp_extract_all(usr, '(?m)^- \\[[A-Z]+\\] \\S+ \\S+: (.+)$', 1))) AS title FROM rec WHERE usr LIKE '%<SYNTHESIZE>%')",
        f"told AS (SELECT DISTINCT record_id, lower(unnest(list_filter(string_split({D.think('answer')}, chr(10)), lambda x: length(x) >= 20))) AS title FROM rec WHERE usr LIKE '%<SYNTHESIZE>%')",
        body="""SELECT t.record_id, CAST(count(*) AS BIGINT) AS titles, CAST(count_if(EXISTS (SELECT 1 FROM asked a WHERE a.record_id = t.record_id AND (contains(t.title, a.title) OR contains(a.title, t.title)))) AS BIGINT) AS known
FROM told t GROUP BY 1""",
    ),
    per_row=True,
)
def title_theta(spark: SparkSession, d: str) -> DataFrame:
    """Titles that a synthesis tells and how many of them contain, or lie in, a title it was asked about."""
    r = corpus.records(spark, d).where("usr like '%<SYNTHESIZE>%'")
    asked = F.transform(F.regexp_extract_all("usr", F.lit(r"(?md)^- \[[A-Z]+\] \S+ \S+: (.+)$"), 1), F.lower)
    told = F.array_distinct(F.transform(F.filter(F.split(T.think(F.col("answer")), "\n"), lambda x: F.length(x) >= 20), F.lower))
    both = r.select("record_id", asked.alias("asked"), told.alias("told")).where("size(told) > 0")
    known = F.filter("told", lambda t: F.exists("asked", lambda a: F.contains(t, a) | F.contains(a, t)))
    return both.select("record_id", F.size("told").cast("bigint").alias("titles"), F.size(known).cast("bigint").alias("known"))


@query(
    D.query(
        D.FINDS,
        body="""SELECT a.finding_id, CAST(count(b.finding_id) AS BIGINT) AS near FROM finds a LEFT JOIN finds b ON a.file = b.file AND a.unit = b.unit AND b.line BETWEEN a.line - 2 AND a.line + 2 AND a.finding_id <> b.finding_id GROUP BY 1""",
    )
)
def line_band_counts(spark: SparkSession, d: str) -> DataFrame:
    """Other findings of the same unit within two lines, counted without pairing rows.

    Counts by line are aggregated first and each line looks at the five lines
    around it, so a hot unit costs its distinct lines, not its square.
    """
    f = corpus.findings(spark, d).select("finding_id", "file", "unit", "line")
    keys = ["file", "unit", "line"]
    per_line = f.where("line is not null and file is not null and unit is not null").groupBy(*keys).agg(F.count("*").alias("n"))
    around = (
        per_line.select("file", "unit", F.explode(F.sequence(F.col("line") - 2, F.col("line") + 2)).alias("line"), "n").groupBy(*keys).agg(F.sum("n").alias("n"))
    )
    return f.join(around, keys, "left").select("finding_id", F.coalesce(F.col("n") - 1, F.lit(0)).alias("near"))


@query(D.query(D.PAIRS, D.TASKS, body="SELECT origin, CAST(count(*) AS BIGINT) AS n, CAST(count(code) AS BIGINT) AS with_code FROM (SELECT 'pairs' AS origin, vuln_code AS code FROM pairs UNION ALL SELECT 'tasks', code FROM tasks) GROUP BY 1"))
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    """Bag union of the code sources."""
    p = corpus.mapped(spark, d, "pairs", F.lit(True), F.lit("pairs").alias("origin"), F.col("vuln_code").isNotNull().alias("code"))
    t = corpus.mapped(spark, d, "tasks", F.lit(True), F.lit("tasks").alias("origin"), F.col("code").isNotNull().alias("code"))
    return p.select("origin", "code").unionByName(t.select("origin", "code")).groupBy("origin").agg(F.count("*").alias("n"), F.count_if("code").alias("with_code"))


@query(D.query(D.PAIRS, D.TASKS, body=f"SELECT DISTINCT h FROM (SELECT {D.normal_hash('vuln_code')} AS h FROM pairs WHERE vuln_code IS NOT NULL UNION SELECT {D.normal_hash('code')} FROM tasks WHERE code IS NOT NULL)"))
def norm_distinct_union(spark: SparkSession, d: str) -> DataFrame:
    """Distinct normalised code of both code sources."""
    p = corpus.mapped(spark, d, "pairs", "vuln_code is not null", T.normal_hash(F.col("vuln_code")).alias("h"))
    t = corpus.mapped(spark, d, "tasks", "code is not null", T.normal_hash(F.col("code")).alias("h"))
    return p.select("h").unionByName(t.select("h")).distinct()


@query("SELECT DISTINCT owner_repo FROM harvest_targets EXCEPT SELECT owner_repo FROM documents WHERE owner_repo IS NOT NULL")
def id_difference(spark: SparkSession, d: str) -> DataFrame:
    """Target repositories without a document."""
    targets = corpus.table(spark, d, "harvest_targets").select("owner_repo").distinct()
    return targets.join(corpus.documents(spark, d).select("owner_repo").distinct(), "owner_repo", "left_anti")
