"""Queries on code: diffs, repair, syntax trees, patches, SARIF, sniffed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import dims
from lodestrata.functions import text as T
from lodestrata.operators import findings as O
from lodestrata.operators import hints as H
from lodestrata.operators import quality as Q
from lodestrata.operators import regions as R
from lodestrata.operators import repair as repairs
from lodestrata.operators import traces
from lodestrata.operators.alignment import lines_of, regions
from lodestrata.operators.repair import normalize_safe as normalize
from lodestrata.operators.repair import repair
from lodestrata.plans import duck as D
from lodestrata.plans.registry import query
from lodestrata.sources import corpus, patches
from lodestrata.sources.sniff import resolve


_LINES_SQL = r"regexp_split_to_array({0}, '\r\n|[\n\r\v\f]')"


@query(
    D.query(
        D.PAIRS,
        f"sides AS (SELECT pair_id, {_LINES_SQL.format('vuln_code')} AS a, {_LINES_SQL.format('fixed_code')} AS b FROM pairs)",
        "trimmed AS (SELECT pair_id, CASE WHEN a[-1] = '' THEN a[1:-2] ELSE a END AS a, CASE WHEN b[-1] = '' THEN b[1:-2] ELSE b END AS b FROM sides)",
        body="SELECT pair_id, TRUE AS inside, TRUE AS named, coalesce(a = b, TRUE) AS untouched FROM trimmed",
    ),
    per_row=True,
)
def diff_region_checks(spark: SparkSession, d: str) -> DataFrame:
    """What has to hold of every region: its lines are lines of the code, its identifiers stand on one of the sides, equal or missing sides have none."""
    p = corpus.pairs(spark, d).select("pair_id", "vuln_code", "fixed_code")
    r = regions(p, "pair_id", "vuln_code", "fixed_code").join(p, "pair_id")
    inside = F.forall("lines", lambda i: i.between(1, F.size(lines_of(F.col("vuln_code")))))
    words = F.concat(T.identifiers(F.col("vuln_code")), T.identifiers(F.col("fixed_code")))
    known = F.coalesce(F.size(F.array_except("identifiers", words)) == 0, F.size("identifiers") == 0)
    nothing = (F.col("source") == "none") & (F.size("identifiers") == 0)
    return r.select("pair_id", inside.alias("inside"), known.alias("named"), nothing.alias("untouched")).distinct()


@query(per_row=True)
def diff_region(spark: SparkSession, d: str) -> DataFrame:
    """Changed lines and identifiers of every fix (checked against the standard library's matcher in the tests)."""
    return regions(corpus.pairs(spark, d), "pair_id", "vuln_code", "fixed_code")


@query()
def located_gates(spark: SparkSession, d: str) -> DataFrame:
    """Grounded traces of all fixes against the gates, by CWE: what the assembler writes has to pass them."""
    p = corpus.pairs(spark, d)
    t = R.vulnerable_traces(p, "pair_id").where("ok")
    both = t.join(p.select("pair_id", "vuln_code", "cwe"), "pair_id").join(regions(p, "pair_id", "vuln_code", "fixed_code").drop("source"), "pair_id")
    failed = Q.gate_failures(F.col("trace"), F.col("vuln_code"), F.col("lines"), F.col("identifiers"), F.col("cwe"))
    return both.select("cwe", F.size(failed).alias("failed")).groupBy("cwe").agg(F.count("*").alias("traces"), F.count_if(F.col("failed") == 0).alias("passed"))


def _first_before(x: str, starts: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {D.lit(s)}) THEN {D.strip(f'string_split({x}, {D.lit(s)})[1]')}" for s in starts) + " END"


def _gaps(x: str, marks: str, blanks: str, every: bool = True) -> str:
    """Parts of ``x`` between blanks behind one of ``marks``."""
    return rf"string_split(regexp_replace({x}, '([{marks}]){blanks}', '\1' || chr(1){', $$g$$' if every else ''}), chr(1))"


def _capped_sql(x: str) -> str:
    return f"substring(regexp_replace({x}, ',+$', ''), 1, {repairs.TRACE_LENGTH})"


_FIELD = r"'(?i)^\s*(status|cwe|severity|line|trace|fix)\s*:\s*(.*)$'"
_PLAIN = lambda x: D.strip(f"trim({D.strip(f'replace({x}, $$**$$, $$$$)')}, '`')")
_REPAIRED_SQL = D.query(
    D.REC,
    body=rf"""SELECT * FROM (
WITH parts AS (
  SELECT record_id, answer AS raw, {D.strip("regexp_extract(answer, '(?s)<think>(.*?)</think>', 1)")} AS th,
    CASE WHEN regexp_matches(answer, '(?s)<think>.*?</think>') THEN substring(answer, length(regexp_extract(answer, '(?s)^(.*?<think>.*?</think>)', 1)) + 1) ELSE answer END AS body FROM rec),
lines AS (SELECT record_id, unnest(s) AS s, unnest(range(len(s))) AS i FROM (SELECT record_id, regexp_split_to_array(body, '\r\n|[\n\r\v\f]') AS s FROM parts)),
heads AS (SELECT *, lower(regexp_extract(s, {_FIELD}, 1)) AS name, count(*) FILTER (regexp_matches(s, {_FIELD})) OVER (PARTITION BY record_id ORDER BY i) AS block FROM lines),
fields AS (
  SELECT record_id, block, max(name) AS name, {D.strip(f"string_agg(CASE WHEN name <> '' THEN regexp_extract(s, {_FIELD}, 2) ELSE {D.strip('s')} END, ' ' ORDER BY i)")} AS value
  FROM heads WHERE block > 0 GROUP BY record_id, block),
last AS (SELECT record_id, name, arg_max(value, block) AS value FROM fields GROUP BY ALL),
flat AS (SELECT p.*, {", ".join(f"(SELECT value FROM last l WHERE l.record_id = p.record_id AND l.name = '{n}') AS f_{n}" for n in T.FIELD_NAMES)} FROM parts p),
named AS (
  SELECT *, coalesce(lower(f_status) = 'safe', false) AS safe, {D.strip("regexp_replace(f_cwe, '[‐-―−]', '-', 'g')")} AS c,
    CASE WHEN regexp_matches(th, '(?i)\bCVE-\d{{4}}-\d{{3,7}}\b') THEN list_filter({_gaps('th', '.!?', r'\s+')}, lambda x: NOT regexp_matches(x, '(?i)\bCVE-\d{{4}}-\d{{3,7}}\b')) END AS kept FROM flat),
clean AS (
  SELECT *, CASE WHEN safe THEN 'none' WHEN regexp_matches(c, '^\d{{1,4}}$') THEN 'CWE-' || c WHEN regexp_matches(c, '(?i)CWE-\d+') THEN upper(regexp_extract(c, '(?i)CWE-\d+')) ELSE c END AS cwe,
    CASE WHEN kept IS NULL THEN th WHEN len(kept) > 0 THEN {D.strip("array_to_string(kept, ' ')")} ELSE regexp_replace(th, '(?i)\bCVE-\d{{4}}-\d{{3,7}}\b', 'the relevant weakness', 'g') END AS thought,
    {D.strip(f"replace({_PLAIN('f_trace')}, '`', '')")} AS t,
    {_PLAIN("CASE WHEN safe AND f_fix IS NOT NULL THEN 'none' ELSE f_fix END")} AS x, CASE WHEN safe AND f_fix IS NOT NULL THEN 'none' ELSE f_fix END AS fx FROM named),
traced AS (
  SELECT *, {_first_before('t', repairs.PROSE_STARTS)} AS head, list_distinct(regexp_extract_all(t, {D.lit(repairs.CODE_TOKEN)})) AS dt, regexp_extract_all(t, {D.lit(repairs.CODE_TOKEN)}) AS alltok FROM clean),
ranked AS (SELECT *, list_filter(alltok, lambda a, i: list_position(alltok, a) = i)[1:{repairs.TRACE_TOKENS}] AS toks FROM traced),
done AS (
  SELECT *, CASE
      WHEN contains(t, '->') OR contains(t, '→') THEN {_capped_sql(f"coalesce({_first_before('t', repairs.CHAIN_PROSE_STARTS)}, t)")}
      WHEN regexp_matches(head, '[=(]') THEN {_capped_sql('head')}
      WHEN (regexp_matches(t, {D.lit(repairs.PROSE)}) OR length(t) > {repairs.PLAIN_TRACE}) AND len(toks) > 0 THEN substring(array_to_string(toks, ' -> '), 1, {repairs.TRACE_LENGTH})
      WHEN regexp_matches(t, {D.lit(repairs.PROSE)}) OR length(t) > {repairs.PLAIN_TRACE} THEN substring({D.strip("string_split(t, '.')[1]")}, 1, {repairs.CLAUSE_LENGTH})
      ELSE {_capped_sql(D.strip(_gaps('t', '.;', r'\s', False) + '[1]'))} END AS trace,
    CASE WHEN fx = '' OR contains(fx, '**') OR regexp_matches({D.strip('fx')}, {D.lit(repairs.ECHO)}) OR suffix({D.strip('fx')}, '...') OR suffix({D.strip('fx')}, '—')
        OR (regexp_matches({D.strip('fx')}, '\b\w{{1,3}}$') AND length({D.strip('fx')}) > {repairs.RUN_ON})
      THEN coalesce({D.lookup(dims.FIX_BY_CWE, "upper(coalesce(cwe, 'none'))")}, {D.lit(dims.FIX_DEFAULT)})
      ELSE {D.strip(f"array_to_string({_gaps('x', '.', r'\s')}[1:2], ' ')")} END AS fix FROM ranked),
told AS (
  SELECT record_id, raw, CASE WHEN f_status IS NULL AND f_cwe IS NULL AND NOT safe THEN raw ELSE concat_ws(chr(10),
    '<think>' || chr(10) || nullif(thought, '') || chr(10) || '</think>' || chr(10),
    'status: ' || {_PLAIN('f_status')}, 'cwe: ' || {_PLAIN('cwe')}, 'severity: ' || {_PLAIN("CASE WHEN safe AND f_severity IS NOT NULL THEN 'none' ELSE f_severity END")},
    'line: ' || {_PLAIN("CASE WHEN safe AND f_line IS NOT NULL THEN 'none' ELSE f_line END")}, 'trace: ' || CASE WHEN f_trace IS NOT NULL THEN trace END, 'fix: ' || CASE WHEN f_fix IS NOT NULL THEN fix END) END AS text FROM done)
SELECT record_id, sha256(text) AS repaired_hash, {D.strip('text')} <> {D.strip('raw')} AS changed FROM told)""",
)


@query(_REPAIRED_SQL, per_row=True)
def repair_output(spark: SparkSession, d: str) -> DataFrame:
    """Answers with repaired fields, and whether that changed them."""
    rec = corpus.records(spark, d).select("record_id", F.col("answer").alias("text"))
    return repair(rec, "record_id").select("record_id", F.sha2("text", 256).alias("repaired_hash"), (T.strip(F.col("text")) != T.strip(F.col("before"))).alias("changed"))


_NORMALIZED_SQL = D.query(
    D.REC,
    body=rf"""SELECT * FROM (
WITH parts AS (SELECT record_id, answer, regexp_extract(answer, '(?is)^(.*?<think>.*?</think>)', 1) AS th FROM rec WHERE label = 'safe'),
lines AS (SELECT record_id, unnest(s) AS s, unnest(range(len(s))) AS i FROM (SELECT record_id, regexp_split_to_array(substring(answer, length(th) + 1), '\r\n|[\n\r\v\f]') AS s FROM parts)),
owned AS (
  SELECT *, nullif(CASE WHEN regexp_matches(s, {D.lit(repairs.REFERENCE_LIST)}) THEN 'refs' ELSE lower(regexp_extract(s, {D.lit(repairs.SAFE_FIELD)}, 2)) END, '') AS owner,
    lower(regexp_extract(s, {D.lit(repairs.SAFE_FIELD)}, 2)) AS name, {D.strip(f"regexp_extract(s, {D.lit(repairs.SAFE_FIELD)}, 4)")} AS v,
    row_number() OVER (PARTITION BY record_id ORDER BY i DESC) = 1 AND s = '' AS ending FROM lines),
kept AS (SELECT *, last_value(owner IGNORE NULLS) OVER (PARTITION BY record_id ORDER BY i) AS above FROM owned WHERE NOT ending
  QUALIFY NOT (owner IS NULL AND {D.strip('s')} <> '' AND coalesce(above = 'trace', false))),
new AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(v, {D.lit(repairs.ANY_CWE)}, '', 'g'), {D.lit(repairs.STAND_IN_CWE)}, '', 'g'), '^[ \-|:]+|[ \-|:]+$', '', 'g') AS rest FROM kept),
done AS (
  SELECT record_id, string_agg(CASE WHEN name = '' THEN s ELSE regexp_extract(s, {D.lit(repairs.SAFE_FIELD)}, 1) || name || regexp_extract(s, {D.lit(repairs.SAFE_FIELD)}, 3) || CASE
    WHEN name = 'status' THEN 'safe' WHEN name IN ('cwe', 'severity', 'line') THEN 'none' WHEN name <> 'trace' THEN v
    WHEN v = '' THEN 'no untrusted input reaches a dangerous sink; code is safe'
    WHEN regexp_matches(v, {D.lit(repairs.NAMED_TRACE)}) THEN 'no untrusted-input-to-sink data flow involving ' || regexp_extract(v, {D.lit(repairs.NAMED_TRACE)}, 1) || '; code is safe'
    WHEN regexp_matches(v, {D.lit(repairs.ANY_CWE)}) OR regexp_matches(v, {D.lit(repairs.STAND_IN_CWE)}) THEN CASE WHEN length(rest) >= 8 THEN rest ELSE 'no untrusted input reaches a dangerous sink; code is safe' END
    ELSE v END END, chr(10) ORDER BY i) AS tail FROM new GROUP BY record_id)
SELECT p.record_id, CASE WHEN answer IS NOT NULL THEN th || coalesce(tail, '') END AS text FROM parts p LEFT JOIN done USING (record_id))""",
)


@query(_NORMALIZED_SQL, per_row=True)
def normalize_safe(spark: SparkSession, d: str) -> DataFrame:
    """Safe answers with fields that fit their verdict."""
    rec = corpus.records(spark, d).where("label = 'safe'").select("record_id", F.col("answer").alias("text"))
    return normalize(rec, "record_id").drop("before")


@query(per_row=True)
def python_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions of the Python tasks."""
    t = corpus.tasks(spark, d).where("language = 'python' and code is not null").select("task_no", "code")
    return R.python_functions(t, "task_no").select("task_no", "name", "first_line", "last_line")


@query(per_row=True)
def clean_functions(spark: SparkSession, d: str) -> DataFrame:
    """Python functions of 3 to 30 lines without risky calls or suspicious words."""
    t = corpus.tasks(spark, d).where("language = 'python' and code is not null").select("task_no", "code")
    f = R.python_functions(t, "task_no", whole_module=False)
    risky = T.any_contains(F.col("source"), RISKY_CALLS)
    words = T.any_contains(F.lower(F.concat_ws("\n", "docstring", F.array_join(F.regexp_extract_all("source", F.lit(r"(#[^\n]*)"), 1), "\n"))), SUSPICIOUS_WORDS)
    lines = T.nonblank_lines(F.col("source"))
    return f.where(lines.between(3, 30) & ~risky & ~words).select("task_no", "name", "first_line", "last_line")


#: Calls and words that keep a function from standing as a clean example. Fixed values.
RISKY_CALLS = (
    "eval(", "exec(", "os.system(", "os.popen(", "subprocess.Popen", "subprocess.call", "subprocess.run", "subprocess.check_output", "subprocess.check_call",
    "pickle.load", "pickle.loads", "marshal.loads", "marshal.load", "__import__(", "compile(", "yaml.load(", "input(", "shell=True", "verify=False", "ssl.CERT_NONE",
    "MD5", "md5(", "sha1(", "SHA1", "DES(", "RC4", "random.random(", "random.randint(", "random.choice(", "// nosec", "# nosec",
)
SUSPICIOUS_WORDS = (
    "vulnerable", "vulnerability", "exploit", "attack", "attacker", "insecure", "unsafe", "dangerous", "deprecated", "do not use", "todo: security", "fixme: security",
    "xss", "csrf", "sql injection", "command injection", "path traversal", "rce", "buffer overflow",
)


# The SQL states its patterns by itself, so that a slip in the tables of ``operators.hints`` shows.
_TAINTS_SQL = {
    "python": [
        r"\brequest\.(?:args|form|json|data|files|values|cookies|headers|GET|POST|method)\b[\.\[\w_'\"]*",
        r"\breq\.(?:body|query|params|headers|cookies|file[s]?)\b[\.\[\w_'\"]*",
        r"\bos\.environ(?:\.get)?(?:\([^)]*\)|\[[^\]]*\])?",
        r"\binput\(\)",
        r"\bsys\.argv\b\[?\d*\]?",
        r"\bself\.[a-z_]+ = .*request",
    ],
    "script": [
        r"\breq\.(?:body|query|params|headers|cookies|files?)\b[\.\[\w_'\"]*",
        r"\bdocument\.(?:cookie|location)\b",
        r"\bwindow\.location\b",
        r"\bprocess\.env\.[A-Z_]+\b",
        r"\bparams\.(?:get\([^)]+\)|[\w_]+)\b",
    ],
}
_SINKS_SQL = {
    "python": [
        ("subprocess.exec", r"\b(?:subprocess\.(?:run|call|Popen|check_output|check_call)|os\.(?:system|popen))\s*\("),
        ("shell_true", r"\bshell\s*=\s*True\b"),
        ("exec_eval", r"\b(?:exec|eval|compile|__import__)\s*\("),
        ("sql_execute", r"\b(?:cur(?:sor)?|conn(?:ection)?|db)\.execute(?:many)?\s*\("),
        ("sql_raw", r"\.raw\s*\("),
        ("fs_open", r"\b(?:open|os\.path\.join|Path|send_file|FileResponse|sendfile)\s*\("),
        ("fs_read", r"\b(?:fs\.readFile|fs\.readFileSync|f\.read)\s*\("),
        ("pickle_yaml", r"\b(?:pickle\.(?:loads?|load)|yaml\.load|marshal\.loads?)\s*\("),
        ("xml_parse", r"\b(?:xml\.etree|lxml\.etree|minidom)\.[\w]+\s*\("),
        ("render_template", r"\b(?:render_template_string|render_template|jinja2\.Template|mark_safe|Markup)\s*\("),
        ("http_outbound", r"\b(?:requests\.(?:get|post|put|delete)|urlopen|urllib\.request)\s*\("),
        ("redirect", r"\b(?:redirect|HttpResponseRedirect)\s*\("),
        ("hash_weak", r"\bhashlib\.(?:md5|sha1)\s*\("),
        ("random_weak", r"\brandom\.(?:random|randint|choice|sample|shuffle)\b"),
        ("string_format_sql", r"f[\"\'].*(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE).*[\"\']"),
        ("fstring_sql", r"\.(?:execute|raw)\s*\(\s*f[\"\']"),
        ("shell_concat", r"(?:os\.system|subprocess\.\w+)\s*\([^)]*\+"),
    ],
    "script": [
        ("child_process", r"\bchild_process\.(?:exec|execSync|spawn|spawnSync|fork)\s*\("),
        ("exec_eval", r"\b(?:eval|new\s+Function|Function\s*\()\s*\(?"),
        ("dangerouslySIH", r"\bdangerouslySetInnerHTML\b"),
        ("innerHTML", r"\.(?:innerHTML|outerHTML)\s*="),
        ("document_write", r"\bdocument\.write(?:ln)?\s*\("),
        ("shell_true", r"\bshell\s*:\s*true\b"),
        ("fs_read", r"\bfs\.(?:readFile|readFileSync|createReadStream)\s*\("),
        ("send_file", r"\bres\.(?:sendFile|download)\s*\("),
        ("sql_query", r"\b(?:pool|conn(?:ection)?|client|db)\.(?:query|execute)\s*\("),
        ("mongoose_where", r"\$where\b"),
        ("redirect", r"\bres\.redirect\s*\("),
        ("template_literal_sql", r"`[^`]*(?:SELECT|INSERT|UPDATE|DELETE)[^`]*\$\{"),
        ("require_dynamic", r"\brequire\s*\([^)]*req\.\w+"),
        ("fetch_outbound", r"\b(?:fetch|axios\.\w+|undici\.fetch)\s*\("),
    ],
}
_SCRIPT_SQL = "language IN ('javascript', 'typescript', 'react')"


def _in_order(lists: list[str]) -> str:
    """Distinct items of several lists in the order of their first place."""
    return f"list_filter(flatten([{', '.join(lists)}]), lambda a, i: list_position(flatten([{', '.join(lists)}]), a) = i)"


def _elements_sql(kind: str) -> str:
    taints = [f"list_transform(regexp_extract_all(code, {D.lit(p)}), lambda t: substring(t, 1, 80))" for p in _TAINTS_SQL[kind]]
    sinks = ", ".join(f"CASE WHEN regexp_matches(code, {D.lit(p)}) THEN {D.lit(n)} END" for n, p in _SINKS_SQL[kind])
    names, imports = "CAST([] AS VARCHAR[])", "CAST([] AS VARCHAR[])"
    if kind == "script":
        names = _in_order([
            rf"regexp_extract_all(code, '{p}', 1)" for p in (
                r"\bfunction\s+([A-Za-z_$][\w$]*)\s*\(",
                r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>)",
                r"\bclass\s+([A-Za-z_$][\w$]*)\b",
                r"\bexport\s+(?:default\s+)?(?:function\s+|class\s+|const\s+)([A-Za-z_$][\w$]*)",
            )
        ])
        imports = _in_order([f"regexp_extract_all(code, {D.lit(p)}, 1)" for p in (r"""\brequire\s*\(\s*["']([^"']+)["']\s*\)""", r"""\bimport\s+(?:[\w*\s{},]+\s+from\s+)?["']([^"']+)["']""")])
    where = "language = 'python'" if kind == "python" else _SCRIPT_SQL
    return f"SELECT task_no, {_in_order(taints)} AS taints, list_filter([{sinks}], lambda n: n IS NOT NULL) AS sinks, {names} AS names, {imports} AS imports FROM tasks WHERE length(code) >= 20 AND {where}"


@query(D.query(D.TASKS, body=f"{_elements_sql('python')} UNION ALL {_elements_sql('script')}"), per_row=True)
def code_elements(spark: SparkSession, d: str) -> DataFrame:
    """Tainted inputs, kinds of sinks, and of scripts the names and imports, in every task's code."""
    code, language = F.col("code"), F.col("language")
    t = corpus.tasks(spark, d).where((F.length(code) >= 20) & (H.is_python(language) | H.is_script(language)))
    empty = F.array().cast("array<string>")
    found = F.transform(H.sinks(code, language), lambda s: s["name"])
    return t.select(
        "task_no", H.taint_sources(code, language).alias("taints"), found.alias("sinks"),
        F.when(H.is_script(language), H.script_names(code)).otherwise(empty).alias("names"), F.when(H.is_script(language), H.script_imports(code)).otherwise(empty).alias("imports"),
    )


@query()
def code_hints(spark: SparkSession, d: str) -> DataFrame:
    """Concrete elements of every task's code, rendered for a prompt."""
    t = corpus.tasks(spark, d).where("length(code) >= 20").select("task_no", "code", "language")
    named = R.python_names(t.where("language = 'python'"), "task_no")
    code, language = F.col("code"), F.col("language")
    joined = t.join(named, "task_no", "left")
    empty = F.array().cast("array<string>")
    script = H.is_script(language)
    names = F.coalesce(F.col("names"), F.when(script, H.script_names(code)), empty)
    imports = F.coalesce(F.col("imports"), F.when(script, H.script_imports(code)), empty)
    parts = joined.select("task_no", H.taint_sources(code, language).alias("taints"), H.sinks(code, language).alias("found"), names.alias("names"), imports.alias("imports"))
    return parts.select("task_no", F.size("taints").alias("taints"), F.size("found").alias("sinks"), H.render(F.col("taints"), F.col("found"), F.col("names"), F.col("imports")).alias("hints"))


@query()
def template_traces(spark: SparkSession, d: str) -> DataFrame:
    """Vulnerable traces assembled from the fixes, declined ones without text."""
    return R.vulnerable_traces(corpus.pairs(spark, d), "pair_id")


_CONTROL_SQL = f"coalesce({D.lookup({n: f.control for n, f in dims.FAMILIES.items()}, '(' + D.family('cwe') + ')')}, 'the untrusted input is validated/neutralized before any sink')"


@query(
    D.query(
        D.PAIRS,
        body=f"""SELECT pair_id, '<think>' || chr(10) || '1. Untrusted input is present but reaches no dangerous sink unguarded.' || chr(10) || '2. The code applies a control: ' || c || '.' || chr(10)
  || '3. That control neutralizes the risk, so the code is safe.' || chr(10) || '</think>' || chr(10) || 'status: safe' || chr(10) || 'cwe: none' || chr(10) || 'severity: none' || chr(10) || 'line: none' || chr(10)
  || 'trace: input is neutralized by ' || trim(string_split(c, ';')[1]) || ' before any sink' || chr(10) || 'fix: none' AS trace FROM (SELECT *, {_CONTROL_SQL} AS c FROM pairs WHERE {D.nonblank_lines('fixed_code')} >= 3)""",
    ),
    per_row=True,
)
def safe_traces(spark: SparkSession, d: str) -> DataFrame:
    """Safe traces of fixed code of three lines or more."""
    p = corpus.pairs(spark, d).where(T.nonblank_lines(F.col("fixed_code")) >= 3)
    return p.select("pair_id", R.render_safe(F.col("cwe")).alias("trace"))


@query(per_row=True)
def rich_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Trace and fix summaries of every reasoning, plain and rich."""
    rec = corpus.records(spark, d).select("record_id", "cwe", "language", (T.norm_label(F.col("label")) == "vuln").alias("v"), T.strip(T.think(F.col("answer"))).alias("t"))
    args = [F.col(c) for c in ("t", "cwe", "language", "v")]
    return rec.select("record_id", traces.trace_summary(*args).alias("trace"), traces.fix_summary(args[0], args[3]).alias("fix"), traces.rich_trace(*args).alias("rich_trace"))


@query(per_row=True)
def rewritten_traces(spark: SparkSession, d: str) -> DataFrame:
    """Answers whose trace field is replaced by the summary of their thought."""
    rec = corpus.records(spark, d).where("answer is not null")
    summary = traces.trace_summary(T.strip(T.think(F.col("answer"))), F.col("cwe"), F.col("language"), T.norm_label(F.col("label")) == "vuln")
    return rec.select("record_id", F.sha2(traces.rewrite_field(F.col("answer"), "trace", summary), 256).alias("answer_hash"))


@query(D.query(D.REC, body=r"SELECT record_id, regexp_matches(answer, '(?i)(^|\n)trace\s*:') AS has_trace FROM rec WHERE answer IS NOT NULL"), per_row=True)
def has_trace_line(spark: SparkSession, d: str) -> DataFrame:
    """Answers with a trace line at the start of a line."""
    return corpus.records(spark, d).where("answer is not null").select("record_id", F.col("answer").rlike(r"(?i)(^|\n)trace\s*:").alias("has_trace"))


def _patches(spark: SparkSession, d: str) -> DataFrame:
    return corpus.documents(spark, d).where("kind = 'patch' and text is not null").select("doc_id", "text")


@query()
def patch_hunks(spark: SparkSession, d: str) -> DataFrame:
    """Hunks of the patch documents."""
    return patches.patch_hunks(patches.patch_files(_patches(spark, d)))


@query()
def patch_fix_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Fix pairs from the patch documents, filtered and classified."""
    return patches.fix_pairs(_patches(spark, d))


_FILES_SQL = r"""files AS (SELECT doc_id, regexp_extract(regexp_extract(body, '^([^\n]*)', 1), '^a/(.+?) b/(.+?)\s*$', 1) AS old_path, regexp_extract(regexp_extract(body, '^([^\n]*)', 1), '^a/(.+?) b/(.+?)\s*$', 2) AS new_path, body
  FROM (SELECT doc_id, unnest(string_split(chr(10) || text, chr(10) || 'diff --git ')[2:]) AS body FROM documents WHERE kind = 'patch' AND text IS NOT NULL))"""
_SIDES_SQL = rf"""WITH {_FILES_SQL},
lines AS (SELECT *, list_filter(string_split(body, chr(10)), lambda x: NOT regexp_matches(x, '^(?:\+\+\+|---|@@|index |a/|new file|deleted file|similarity|rename|\\)')) AS l FROM files WHERE new_path <> ''),
parts AS (SELECT *, list_transform(list_filter(l, lambda x: starts_with(x, ' ')), lambda x: x[2:]) AS c FROM lines),
ends AS (SELECT *, list_slice(c, greatest(1, len(c) - 7), greatest(1, len(c) - 7) + 4) AS head, list_slice(c, greatest(1, len(c) - 2), greatest(1, len(c) - 2) + 2) AS tail FROM parts),
sides AS (SELECT *, unnest(['vuln', 'safe']) AS label, unnest(['-', '+']) AS mark FROM ends)
SELECT doc_id, old_path, new_path, label, array_to_string(list_concat(list_concat(head, list_transform(list_filter(l, lambda x: starts_with(x, mark)), lambda x: x[2:])), tail), chr(10)) AS code
FROM sides WHERE len(list_filter(l, lambda x: starts_with(x, mark))) > 0"""


@query(rf"WITH {_FILES_SQL} SELECT doc_id, new_path, CAST(len(regexp_extract_all(body, '(?m)^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@[^\n]*\n.')) AS BIGINT) AS hunks FROM files WHERE new_path <> '' AND regexp_matches(body, '(?m)^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@[^\n]*\n.')")
def patch_hunk_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of hunks that are read of every file of a patch: as many as it has headers with lines behind them."""
    read = patches.patch_hunks(patches.patch_files(_patches(spark, d)))
    return read.groupBy("doc_id", "new_path").agg(F.count("*").alias("hunks"))


@query(_SIDES_SQL)
def patch_sides(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows of both sides of the patch documents' files."""
    return patches.flattened_sides(patches.patch_files(_patches(spark, d)))


@query(
    "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?m)^diff --git a/.+ b/.+$')) AS BIGINT) AS files FROM documents WHERE kind = 'patch' AND text IS NOT NULL"
)
def patch_file_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of files in every patch document."""
    return _patches(spark, d).select("doc_id", F.regexp_count("text", F.lit(r"(?md)^diff --git a/.+ b/.+$")).cast("bigint").alias("files"))


@query(
    "SELECT doc_id FROM documents WHERE kind = 'patch' AND len(regexp_extract_all(text, '(?m)^diff --git a/.+ b/.+\\.(?:py|js|ts|jsx|tsx|php|rb)\\s*$')) >= 2"
)
def multi_file_patches(spark: SparkSession, d: str) -> DataFrame:
    """Patches over two files or more of languages that need no build."""
    return _patches(spark, d).where(F.regexp_count("text", F.lit(r"(?md)^diff --git a/.+ b/.+\.(?:py|js|ts|jsx|tsx|php|rb)\s*$")) >= 2).select("doc_id")


_NAMED = f"coalesce({D.lookup(dims.CWE_NAMES, 'cwe')}, cwe)"


@query(
    D.query(
        D.FINDS,
        body=f"""SELECT finding_id, to_json({{'ruleId': cwe, 'level': coalesce({D.lookup(dims.SARIF_LEVEL, 'upper(severity)')}, 'warning'),
  'message': {{'text': trim(concat_ws(' ', cwe, coalesce({D.lookup(dims.CWE_NAMES, 'cwe')}, '') || ':', trace)) || CASE WHEN lower(coalesce(fix, 'none')) <> 'none' THEN '  Fix: ' || fix ELSE '' END}},
  'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': replace(file, chr(92), '/')}}, 'region': {{'startLine': greatest(1, coalesce(line, 1))}}}}}}],
  'partialFingerprints': {{'primary': substring(sha256(concat_ws('', file, cwe, unit)), 1, 16)}}}}) AS result FROM finds WHERE file IS NOT NULL AND cwe IS NOT NULL""",
    ),
    per_row=True,
)
def sarif_report(spark: SparkSession, d: str) -> DataFrame:
    """SARIF results of the findings, one JSON object a row."""
    return O.sarif_results(corpus.findings(spark, d).where("file is not null and cwe is not null"))


@query(
    D.query(
        D.FINDS,
        "firsts AS (SELECT cwe, arg_min(severity, finding_id) FILTER (severity IS NOT NULL) AS severity FROM finds WHERE cwe IS NOT NULL GROUP BY 1)",
        body=f"""SELECT cwe, to_json({{'id': cwe, 'name': {_NAMED}, 'shortDescription': {{'text': {_NAMED}}}, 'helpUri': 'https://cwe.mitre.org/data/definitions/' || regexp_extract(cwe, '(\\d+)$', 1) || '.html',
  'properties': {{'tags': ['security', 'external/cwe/cwe-' || lpad(regexp_extract(cwe, '(\\d+)$', 1), greatest(3, 3), '0')], 'security-severity': coalesce({D.lookup(dims.SARIF_SCORE, 'upper(severity)')}, '5.5')}}}}) AS rule FROM firsts""",
    )
)
def sarif_rules(spark: SparkSession, d: str) -> DataFrame:
    """SARIF rules of the findings' CWEs."""
    return O.sarif_rules(corpus.findings(spark, d).where("cwe is not null"))


@query(
    D.query(
        D.FINDS,
        r"flows AS (SELECT finding_id, cwe, file, coalesce(line, 1) AS line, string_split(trace, ' -> ') AS s FROM finds WHERE trace LIKE '%->%' AND file IS NOT NULL AND cwe IS NOT NULL)",
        r"""steps AS (SELECT *, unnest(s) AS step, unnest(range(len(s))) AS i, len(s) - 1 AS last FROM flows WHERE len(s) >= 2)""",
        r"""told AS (SELECT *, regexp_extract(CASE WHEN i % 2 = 0 THEN file ELSE file || '.helper' END, '([^/]+)$', 1) || ':' || CAST(line + i AS INT) AS place,
  CASE WHEN i = 0 THEN 'Source' WHEN i = last THEN 'Sink' ELSE 'Step' END AS role, trim(step) AS said FROM steps WHERE i < 8)""",
        body=r"""SELECT coalesce('CWE-' || nullif(regexp_extract(any_value(cwe), '0*(\d+)', 1), ''), 'CWE-20') AS cwe, string_agg(place, ' -> ' ORDER BY i) AS trace,
  string_agg((i + 1) || '. [' || role || ' — ' || place || '] ' || CASE WHEN said <> '' THEN said WHEN i = 0 THEN 'untrusted input enters here' WHEN i = last THEN 'the tainted value reaches a dangerous operation' ELSE 'the value propagates unchanged' END, chr(10) ORDER BY i) AS think,
  2 AS files FROM told GROUP BY finding_id""",
    )
)
def sarif_flows(spark: SparkSession, d: str) -> DataFrame:
    """Cross-file flows read back from SARIF that the findings of each repository make up."""
    return O.flow_trace(O.sarif_flows(_sarif_of_repositories(spark, d)))


def _sarif_of_repositories(spark: SparkSession, d: str) -> DataFrame:
    """One SARIF document for each finding whose trace is a chain; its steps lie in two files."""
    f = corpus.findings(spark, d).where("trace like '%->%' and file is not null and cwe is not null")
    steps = F.split("trace", " -> ")
    at = F.transform(
        steps,
        lambda s, i: F.struct(
            F.struct(
                F.struct(s.alias("text")).alias("message"),
                F.struct(
                    F.struct(F.when(i % 2 == 0, F.col("file")).otherwise(F.concat(F.col("file"), F.lit(".helper"))).alias("uri")).alias("artifactLocation"),
                    F.struct((i + F.coalesce("line", F.lit(1))).cast("int").alias("startLine")).alias("region"),
                ).alias("physicalLocation"),
            ).alias("location")
        ),
    )
    rule = F.struct(F.lit("r").alias("id"), F.struct(F.array(F.concat(F.lit("external/cwe/cwe-"), F.regexp_extract("cwe", r"(\d+)", 1))).alias("tags")).alias("properties"))
    result = F.struct(F.lit("r").alias("ruleId"), F.struct(F.lit("flow").alias("text")).alias("message"), F.array(F.struct(F.array(F.struct(at.alias("locations"))).alias("threadFlows"))).alias("codeFlows"))
    run = F.struct(F.struct(F.struct(F.array(rule).alias("rules")).alias("driver")).alias("tool"), F.array(result).alias("results"))
    return f.select(F.to_json(F.struct(F.array(run).alias("runs"))).alias("text"))


@query("SELECT p_partkey AS id, p_name AS vuln, p_type AS description FROM part WHERE length(p_name) > 5")
def weak_schema_sniff(spark: SparkSession, d: str) -> DataFrame:
    """Columns assigned to roles by parts of their names, on a renamed table."""
    part = corpus.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("Vulnerable_Code"), F.col("p_type").alias("msg_description"), F.col("p_brand").alias("brand")
    )
    return resolve(part, {"vuln": ("vuln", "before", "bad"), "fixed": ("fix", "after", "good"), "description": ("desc", "message")}, keep=("id",)).where(F.length("vuln") > 5).select("id", "vuln", "description")
