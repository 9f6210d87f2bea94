"""Queries on filters, verification, audit and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import dims
from lodestrata.functions import text as T
from lodestrata.operators import quality as Q
from lodestrata.operators import traces
from lodestrata.plans import duck as D
from lodestrata.plans.registry import query
from lodestrata.sources import corpus


@query(D.query(D.TASKS, body="SELECT task_no FROM tasks WHERE length(code) BETWEEN 80 AND 1500"), per_row=True)
def length_window_filter(spark: SparkSession, d: str) -> DataFrame:
    """Tasks whose code has 80 to 1500 characters."""
    return corpus.tasks(spark, d).where(F.length("code").between(80, 1500)).select("task_no")


@query(D.query(D.TASKS, body=f"SELECT task_no, CAST({D.nonblank_lines('code')} AS BIGINT) AS lines FROM tasks WHERE {D.nonblank_lines('code')} >= 3"), per_row=True)
def line_count_filter(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of three lines or more that are not blank."""
    return corpus.tasks(spark, d).select("task_no", T.nonblank_lines(F.col("code")).cast("bigint").alias("lines")).where("lines >= 3")


@query(D.query(D.PAIRS, body="SELECT language, CAST(count(*) AS BIGINT) AS n FROM pairs WHERE language IN ('python', 'javascript') GROUP BY 1"))
def language_allow_list(spark: SparkSession, d: str) -> DataFrame:
    """Fix pairs of the allowed languages."""
    return corpus.pairs(spark, d).where(F.col("language").isin("python", "javascript")).groupBy("language").agg(F.count("*").alias("n"))


_PATHS = f"regexp_matches(path, {D.lit('(?i)' + dims.TEST_PATH)}) AS test_path, regexp_matches(path, {D.lit('(?i)' + dims.COLLATERAL_PATH)}) AS collateral_path"


@query(f"SELECT doc_id, {_PATHS} FROM documents WHERE path IS NOT NULL")
def path_filters(spark: SparkSession, d: str) -> DataFrame:
    """Test paths and collateral paths of the documents."""
    p = F.col("path")
    return corpus.documents(spark, d).where("path is not null").select(
        "doc_id", p.rlike("(?i)" + dims.TEST_PATH).alias("test_path"), p.rlike("(?i)" + dims.COLLATERAL_PATH).alias("collateral_path")
    )


_REL = D.lit("(?i)" + dims.RELEVANT_HUNK)


@query(D.query(D.PAIRS, body=f"SELECT pair_id FROM pairs WHERE regexp_matches(vuln_code, {_REL}) OR regexp_matches(fixed_code, {_REL})"), per_row=True)
def relevance_filter(spark: SparkSession, d: str) -> DataFrame:
    """Fix pairs one of whose sides touches a sensitive operation."""
    pattern = "(?i)" + dims.RELEVANT_HUNK
    return corpus.pairs(spark, d).where(F.col("vuln_code").rlike(pattern) | F.col("fixed_code").rlike(pattern)).select("pair_id")


_PYTHON_WORDS = ("def ", "import ", "class ", "return ", "self.", "python")


@query(f"SELECT doc_id FROM documents WHERE {D.any_contains('lower(text)', _PYTHON_WORDS)}")
def keyword_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents that look like Python by their words."""
    return corpus.documents(spark, d).where(T.any_contains(F.lower("text"), _PYTHON_WORDS)).select("doc_id")


@query(
    D.query(
        D.FINDS,
        body=r"SELECT finding_id FROM finds WHERE length(think) BETWEEN 30 AND 2000 AND len(list_filter(regexp_split_to_array(think, '\s+'), lambda w: w <> '')) >= 5 AND NOT regexp_matches(think, '(?i)^\s*(todo|fixme)')",
    ),
    per_row=True,
)
def explanation_filter(spark: SparkSession, d: str) -> DataFrame:
    """Explanations of some length, five words at least, that are no to-do notes."""
    return corpus.findings(spark, d).where(T.is_explanation(F.col("think"))).select("finding_id")


@query(
    D.query(
        D.REC,
        body=r"""SELECT record_id, CASE WHEN contains(a, 'status: safe') OR contains(a, 'no vulnerability') OR contains(a, 'is safe') THEN 'safe'
  WHEN contains(a, 'status: confirmed') OR contains(a, 'vulnerability detected') OR contains(a, 'cwe-') THEN 'vuln' END AS answered FROM (SELECT record_id, lower(answer) AS a FROM rec)""",
    ), per_row=True)
def label_from_answer(spark: SparkSession, d: str) -> DataFrame:
    """Label that an answer states, the safe phrases first."""
    a = F.lower("answer")
    safe = T.any_contains(a, ("status: safe", "no vulnerability", "is safe"))
    vuln = T.any_contains(a, ("status: confirmed", "vulnerability detected", "cwe-"))
    return corpus.records(spark, d).select("record_id", F.when(safe, "safe").when(vuln, "vuln").alias("answered"))


_FIELDS = ", ".join(f"{D.field(n, 'answer')} AS f_{n}" for n in ("status", "cwe", "severity", "trace", "fix"))
_FAMS = ", ".join(f"{D.marker_hits('answer', m)} AS h_{name}" for name, m in ((n, f.markers) for n, f in dims.FAMILIES.items()))
_NAMES = list(dims.FAMILIES)
_OWN = "CASE fam " + " ".join(f"WHEN '{n}' THEN h_{n}" for n in _NAMES) + " END"
_OTHER = "greatest(" + ", ".join(f"CASE WHEN fam <> '{n}' THEN h_{n} ELSE -1 END" for n in _NAMES) + ")"
_BEST = "CASE " + " ".join(f"WHEN fam <> '{n}' AND h_{n} = other THEN '{n}'" for n in _NAMES) + " END"
_HITS = f"""hits AS (SELECT *, {D.family('cwe')} AS fam, {_FAMS}, {_FIELDS}, {D.norm_label('label')} AS kind FROM rec WHERE answer IS NOT NULL),
bleed AS (SELECT *, CASE WHEN fam IS NOT NULL THEN {_OWN} END AS own, CASE WHEN fam IS NOT NULL THEN {_OTHER} END AS other FROM hits),
mixed AS (SELECT *, CASE WHEN other > 0 THEN {_BEST} END AS other_family, coalesce(NOT (own = 0 AND other >= 3), TRUE) AS ok FROM bleed)"""


@query(D.query(D.REC, _HITS, body="SELECT record_id, fam AS family, CAST(own AS BIGINT) AS own, CAST(other AS BIGINT) AS other, other_family, ok FROM mixed"), per_row=True)
def family_bleed(spark: SparkSession, d: str) -> DataFrame:
    """Marker hits of a trace's own family and of the strongest other one."""
    rec = corpus.records(spark, d).where("answer is not null")
    b = rec.select("record_id", Q.bleed(F.col("answer"), F.col("cwe")).alias("b"))
    return b.select("record_id", "b.family", F.col("b.own").cast("bigint").alias("own"), F.col("b.other").cast("bigint").alias("other"), "b.other_family", "b.ok")


_CONTROL = D.lit("(?i)" + dims.CONTROL_WORDS)
_VERIFY = f"""verified AS (SELECT record_id, shape, kind, list_filter([
  CASE WHEN kind IN ('vuln', 'safe') AND length(coalesce({D.strip("nullif(regexp_extract(answer, '(?s)<think>(.*?)</think>', 1), '')")}, '')) < 40 THEN 'stub: <think> missing/too short' END,
  CASE WHEN kind = 'vuln' AND lower(f_status) NOT IN ('vuln', 'confirmed') THEN 'status ''' || lower(f_status) || ''' != vuln-label' END,
  CASE WHEN kind = 'vuln' AND NOT regexp_matches(f_cwe, '(?i)CWE-\\d+') THEN 'vuln_no_cwe (unclassifiable)' END,
  CASE WHEN kind = 'vuln' AND (length(f_trace) < 12 OR lower(f_trace) = 'none') THEN 'weak_trace' END,
  CASE WHEN kind = 'vuln' AND lower(f_fix) IN ('', 'none') THEN 'vuln_missing_fix' END,
  CASE WHEN kind = 'vuln' AND lower(f_severity) NOT IN ('low', 'medium', 'high') THEN 'vuln_bad_severity' END,
  CASE WHEN kind = 'vuln' AND NOT ok THEN 'bleed:reads like ''' || other_family || ''' not ''' || fam || ''' (own=0, other=' || other || ')' END,
  CASE WHEN kind = 'safe' AND lower(f_status) <> 'safe' THEN 'status ''' || lower(f_status) || ''' != safe-label' END,
  CASE WHEN kind = 'safe' AND lower(f_cwe) NOT IN ('none', 'n/a', '-', '') THEN 'safe-trace names cwe ''' || lower(f_cwe) || '''' END,
  CASE WHEN kind = 'safe' AND NOT regexp_matches(answer, {_CONTROL}) THEN 'safe-trace cites no concrete control' END
], lambda x: x IS NOT NULL) AS reasons FROM mixed)"""


def verified(spark: SparkSession, d: str) -> DataFrame:
    reasons = Q.verify(F.col("answer"), F.col("label"), F.col("cwe"))
    return corpus.mapped(spark, d, "records", "answer is not null", "shape", T.norm_label(F.col("label")).alias("kind"), reasons.alias("reasons"))


@query(D.query(D.REC, _HITS, _VERIFY, body="SELECT record_id, kind, reasons FROM verified"), per_row=True)
def verify_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Reasons why a record fails verification, an empty list where it passes."""
    return verified(spark, d).select("record_id", "kind", "reasons")


@query(D.query(D.REC, _HITS, _VERIFY, body="SELECT string_split(r, ':')[1] AS reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(reasons) AS r FROM verified) GROUP BY 1"))
def verify_reasons_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Failed checks by their name before the first colon."""
    return verified(spark, d).select(F.explode("reasons").alias("r")).groupBy(F.substring_index("r", ":", 1).alias("reason")).agg(F.count("*").alias("n"))


@query(
    D.query(
        D.REC, _HITS, _VERIFY,
        body=f"""SELECT coalesce(shape, 'TOTAL') AS shape, CAST(count_if(len(reasons) = 0) AS BIGINT) AS passed, CAST(count_if(len(reasons) > 0) AS BIGINT) AS failed,
  {D.percent('count_if(len(reasons) > 0)', 'count(*)')} AS drop_percent FROM verified WHERE shape IS NOT NULL GROUP BY ROLLUP(shape)""",
    )
)
def disposition_by_shape(spark: SparkSession, d: str) -> DataFrame:
    """Passed and failed records by shape, with a row of totals."""
    ok, bad = F.count_if(F.size("reasons") == 0), F.count_if(F.size("reasons") > 0)
    return (
        verified(spark, d)
        .where("shape is not null")
        .rollup("shape")
        .agg(ok.alias("passed"), bad.alias("failed"), T.percent(bad, F.count("*")).alias("drop_percent"))
        .withColumn("shape", F.coalesce("shape", F.lit("TOTAL")))
    )


_AUDIT = """audited AS (SELECT record_id, list_filter([
  CASE WHEN (kind = 'vuln' AND lower(f_status) NOT IN ('vuln', 'confirmed')) OR (kind = 'safe' AND lower(f_status) <> 'safe') THEN 'status_mismatch' END,
  CASE WHEN kind = 'vuln' AND NOT regexp_matches(f_cwe, '(?i)CWE-\\d+') THEN 'vuln_missing_cwe' END,
  CASE WHEN kind = 'vuln' AND regexp_matches(f_cwe, '(?i)CWE-\\d+') AND gt_cwe <> '' AND upper(f_cwe) <> upper(gt_cwe) THEN 'cwe_field_ne_label' END,
  CASE WHEN kind = 'vuln' AND lower(f_fix) IN ('', 'none') THEN 'vuln_missing_fix' END,
  CASE WHEN kind = 'vuln' AND (length(f_trace) < 12 OR lower(f_trace) = 'none') THEN 'vuln_weak_trace' END,
  CASE WHEN kind = 'vuln' AND lower(f_severity) NOT IN ('low', 'medium', 'high') THEN 'vuln_bad_severity' END,
  CASE WHEN kind = 'safe' AND lower(f_cwe) NOT IN ('', 'none', 'n/a', '-') THEN 'safe_has_cwe' END,
  CASE WHEN kind = 'safe' AND lower(f_fix) NOT IN ('', 'none') THEN 'safe_has_fix' END,
  CASE WHEN kind = 'safe' AND regexp_matches(f_trace, '(?i)CWE-\\d+') THEN 'safe_cwe_in_trace' END,
  CASE WHEN kind = 'safe' AND lower(f_severity) NOT IN ('', 'none') THEN 'safe_has_severity' END
], lambda x: x IS NOT NULL) AS issues FROM hits)"""


def audited(spark: SparkSession, d: str) -> DataFrame:
    issues = Q.audit(F.col("answer"), F.col("label"), F.col("gt_cwe"))
    return corpus.mapped(spark, d, "records", "answer is not null", issues.alias("issues"))


@query(D.query(D.REC, _HITS, _AUDIT, body="SELECT issue, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(issues) AS issue FROM audited) GROUP BY 1"))
def audit_issue_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records by consistency issue."""
    return audited(spark, d).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query(D.query(D.REC, _HITS, _AUDIT, body="SELECT unnest(issues) AS issue, record_id FROM audited"))
def audit_issue_rows(spark: SparkSession, d: str) -> DataFrame:
    """The records behind every issue, one row each (no list is collected in one place)."""
    return audited(spark, d).select(F.explode("issues").alias("issue"), "record_id")


_TRACE = D.strip(r"regexp_extract(answer, '(?im)^\s*trace:\s*(.+)$', 1)")
_GATES = f"""g0 AS (SELECT *, coalesce({D.scan_code('usr')}, usr) AS code, {D.identifiers(_TRACE)} AS named, {D.after_think('answer')} AS body FROM rec WHERE answer IS NOT NULL AND usr IS NOT NULL),
g1 AS (SELECT *, list_filter(named, lambda t: NOT list_contains({D.identifiers('code')}, t) AND NOT contains(code, t)) AS missing,
  TRY_CAST({D.last_field('line', 'body')} AS INT) AS at_line, {D.first_cwe(D.last_field('cwe', 'body'))} AS said_cwe,
  coalesce({D.think('answer')}, answer) || chr(10) || {_TRACE} AS blob,
  [CAST(record_id % 40 AS INT), CAST(record_id % 40 + 3 AS INT)] AS region_lines, list_slice(named, 1, CAST(record_id % 3 AS INT)) AS region_names FROM g0),
g2 AS (SELECT record_id, len(named) > 0 AND len(missing) <= greatest(1, len(named) // 2) AS correspondence,
  coalesce(len(list_filter(region_lines, lambda x: abs(x - at_line) <= 2)) > 0, FALSE) OR list_has_any(named, region_names) AS localization,
  gt_cwe IS NULL OR gt_cwe = '' OR coalesce(regexp_extract(said_cwe, '(\\d+)', 1) = regexp_extract(gt_cwe, '(\\d+)', 1), FALSE) AS cwe_ok,
  NOT regexp_matches(blob, {D.lit('(?i)' + dims.HEDGE)}) AND regexp_matches(blob, {D.lit('(?i)' + dims.FLOW)}) AS substantive FROM g1)"""


def _gated(spark: SparkSession, d: str) -> DataFrame:
    """Records with their code and a region that depends on the id (no analyser runs here)."""
    rec = corpus.records(spark, d).where("answer is not null and usr is not null")
    named = T.identifiers(Q.trace_line(F.col("answer")))
    n = F.col("record_id")
    return rec.select(
        "record_id",
        "answer",
        "gt_cwe",
        F.coalesce(T.scan_code(F.col("usr")), F.col("usr")).alias("code"),
        F.array((n % 40).cast("int"), (n % 40 + 3).cast("int")).alias("region_lines"),
        F.slice(named, F.lit(1), (n % 3).cast("int")).alias("region_names"),
    )


@query(D.query(D.REC, _GATES, body="SELECT record_id, correspondence AS ok FROM g2"), per_row=True)
def identifiers_overlap_gate(spark: SparkSession, d: str) -> DataFrame:
    """Traces whose identifiers occur in the code."""
    return _gated(spark, d).select("record_id", Q.correspondence(F.col("answer"), F.col("code")).alias("ok"))


@query(D.query(D.REC, _GATES, body="SELECT record_id, localization AS ok FROM g2"), per_row=True)
def localization_gate(spark: SparkSession, d: str) -> DataFrame:
    """Traces that point at the changed region."""
    return _gated(spark, d).select("record_id", Q.localization(F.col("answer"), F.col("region_lines"), F.col("region_names")).alias("ok"))


@query(D.query(D.REC, _GATES, body="SELECT record_id, cwe_ok AS ok FROM g2"), per_row=True)
def cwe_gate(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts that name the true CWE."""
    return _gated(spark, d).select("record_id", Q.cwe_consistency(F.col("answer"), F.col("gt_cwe")).alias("ok"))


@query(D.query(D.REC, _GATES, body="SELECT record_id, substantive AS ok FROM g2"), per_row=True)
def substantiveness_gate(spark: SparkSession, d: str) -> DataFrame:
    """Traces that tell a flow and do not hedge."""
    return _gated(spark, d).select("record_id", Q.substantive(F.col("answer")).alias("ok"))


@query(
    D.query(
        D.REC, _GATES,
        body="""SELECT record_id, list_filter([CASE WHEN NOT correspondence THEN 'correspondence' END, CASE WHEN NOT localization THEN 'localization' END,
  CASE WHEN NOT cwe_ok THEN 'cwe' END, CASE WHEN NOT substantive THEN 'substantiveness' END], lambda x: x IS NOT NULL) AS failed FROM g2""",
    ), per_row=True)
def all_gates(spark: SparkSession, d: str) -> DataFrame:
    """Failed gates of every record."""
    g = _gated(spark, d)
    return g.select("record_id", Q.gate_failures(F.col("answer"), F.col("code"), F.col("region_lines"), F.col("region_names"), F.col("gt_cwe")).alias("failed"))


@query()
def accept_by_shape(spark: SparkSession, d: str) -> DataFrame:
    """Answers that fit the contract of their shape, by shape."""
    ok = Q.accept(*[F.col(c) for c in ("answer", "shape", "label", "helper_fn", "disposition", "multi_hop")], F.array(F.coalesce("usr", F.lit(""))))
    return corpus.mapped(spark, d, "records", "answer is not null", "shape", ok.alias("ok")).groupBy("shape").agg(F.count("*").alias("records"), F.count_if("ok").alias("accepted"))


_REASONING = "(SELECT record_id, coalesce(think, '') || chr(10) || coalesce(trace, '') AS t, code FROM s0)"
_SPECIFIC = f"""s0 AS (SELECT record_id, {D.think('answer')} AS think, {_TRACE} AS trace, coalesce({D.scan_code('usr')}, usr, '') AS code FROM rec WHERE answer IS NOT NULL),
s1 AS (SELECT *, {D.identifiers('code')} AS names FROM {_REASONING}),
s2 AS (SELECT record_id, t, CASE WHEN len(names) > 0 THEN len(list_filter(names, lambda n: length(n) >= 3 AND list_contains(regexp_split_to_array(t, '[^A-Za-z0-9_]+'), n))) / len(names) ELSE 0.0 END AS cover,
  least(len(regexp_extract_all(t, '(?i)\\bCWE[-‑]?\\d+\\b')) / 3.0, 1.0) AS cwe_refs, least(len(regexp_extract_all(t, '\\b[\\w_]+/[\\w_]+\\.(?:py|js|ts|tsx|jsx)\\b')) / 2.0, 1.0) AS file_refs,
  least({D.phrase_count('t', dims.SPECIFIC_PHRASES)} / 3.0, 1.0) AS specific, least({D.phrase_count('t', dims.GENERIC_PHRASES)} / 6.0, 1.0) AS generic FROM s1)"""


@query(
    D.query(
        D.REC, _SPECIFIC,
        body="SELECT record_id, CAST(CASE WHEN length(t) < 100 THEN 0.0 ELSE greatest(0.0, least(1.0, 0.40 * cover + 0.20 * cwe_refs + 0.15 * file_refs + 0.15 * specific - 0.30 * generic)) END AS DOUBLE) AS score FROM s2",
    ), per_row=True)
def specificity_score(spark: SparkSession, d: str) -> DataFrame:
    """How much each reasoning deals with its code."""
    rec = corpus.records(spark, d).where("answer is not null")
    told = F.concat(F.coalesce(T.think(F.col("answer")), F.lit("")), F.lit("\n"), F.coalesce(Q.trace_line(F.col("answer")), F.lit("")))
    code = F.coalesce(T.scan_code(F.col("usr")), F.col("usr"), F.lit(""))
    return rec.select("record_id", traces.specificity(told, T.identifiers(code))["score"].alias("score"))
