"""SQL text for the independent oracle, in DuckDB's dialect.

Each function mirrors one definition of ``functions.text``; the SQL is written
separately so that a wrong expression on one side shows as a difference.
"""

from __future__ import annotations

from lodestrata.functions import dims


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def tidy(x: str) -> str:
    return f"lower({strip(x)})"


def normal_hash(x: str) -> str:
    inner = rf"regexp_replace(regexp_replace({x}, '</?SCAN>', '', 'g'), '#.*|//.*', '', 'g')"
    return rf"sha256(lower(regexp_replace({inner}, '\s+', '', 'g')))"


def exact_hash(x: str) -> str:
    return f"sha256({strip(x)})"


def norm_label(x: str) -> str:
    return f"CASE WHEN {x} IN ('vuln', 'confirmed') THEN 'vuln' WHEN {x} = 'safe' THEN 'safe' ELSE 'context' END"


def field(name: str, x: str) -> str:
    return strip(rf"regexp_extract({x}, '(?im)^\s*{name}\s*:\s*(.+)$', 1)")


def think(x: str) -> str:
    return f"nullif(regexp_extract({x}, '(?is)<think>(.*?)</think>', 1), '')"


def after_think(x: str) -> str:
    return f"regexp_replace({x}, '(?is)^.*?<think>.*?</think>', '')"


_ALL = r"(?im)^\s*(status|cwe|severity|line|trace|fix)\s*:\s*(.+?)\s*$"


def last_field(name: str, x: str) -> str:
    keys, values = f"regexp_extract_all({x}, '{_ALL}', 1)", f"regexp_extract_all({x}, '{_ALL}', 2)"
    own = f"list_filter(list_zip({keys}, {values}), lambda p: lower(p[1]) = '{name}')"
    value = f"{own}[-1][2]"
    return f"CASE WHEN lower({value}) NOT IN ('none', 'n/a', '-', '') THEN {value} END"


def verdict_status(raw: str) -> str:
    word = rf"regexp_extract(lower({raw}), '^(\S+)', 1)"
    return f"CASE WHEN {word} IN ('confirmed', 'vuln', 'vulnerable') THEN 'confirmed' WHEN {word} IN ('safe', 'clean') THEN 'safe' END"


def prediction_status(raw: str) -> str:
    word = rf"regexp_replace(regexp_extract({tidy(raw)}, '^(\S+)', 1), '^[.,;]+|[.,;]+$', '', 'g')"
    return (
        f"CASE WHEN {word} IN ('confirmed', 'vuln', 'vulnerable') THEN 'confirmed' WHEN {word} IN ('safe', 'clean') THEN 'safe' "
        f"WHEN contains({word}, 'needs') THEN 'needs_context' WHEN {word} = 'synthesis' THEN 'synthesis' END"
    )


def first_cwe(x: str) -> str:
    return rf"'CWE-' || nullif(regexp_extract({x}, '\bCWE-(\d{{1,4}})\b', 1), '')"


def loose_cwe(x: str) -> str:
    return rf"'CWE-' || nullif(regexp_extract({x}, '(?i)CWE-?(\d+)', 1), '')"


def scan_code(x: str) -> str:
    return rf"nullif(regexp_extract({x}, '(?s)<SCAN>\s*\n?(.*?)\n?</SCAN>', 1), '')"


def identifiers(x: str) -> str:
    stop = ", ".join(lit(w) for w in dims.STOP_IDENTIFIERS)
    found = f"regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_]*')"
    return f"list_sort(list_distinct(list_filter({found}, lambda t: length(t) > 2 AND lower(t) NOT IN ({stop}))))"


def any_contains(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(n)})" for n in needles) + ")"


def detect_language(x: str) -> str:
    h = {k: any_contains(x, v) for k, v in dims.LANGUAGE_HINTS.items()}
    markup = f"((contains({x}, '<') AND contains({x}, '/>')) OR contains(lower({x}), 'jsx'))"
    return (
        f"CASE WHEN {h['react']} AND {markup} THEN 'react' WHEN {h['typescript']} AND {h['javascript']} THEN 'typescript' "
        f"WHEN {h['javascript']} THEN 'javascript' WHEN {h['python']} THEN 'python' ELSE 'other' END"
    )


def lookup(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + " END"


def extension_language(x: str, table: dict[str, str]) -> str:
    return lookup(table, rf"regexp_extract({x}, '(\.[^./]+)$', 1)")


def family(x: str) -> str:
    return lookup(dims.family_by_cwe(), f"upper({strip(x)})")


def marker_hits(x: str, markers) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({x}), {lit(m)}) AS INT)" for m in markers) + ")"


def classify(x: str, what: str = "vuln_type") -> str:
    """``what`` is vuln_type or cwe."""
    at = 0 if what == "vuln_type" else 1
    whens = " ".join(f"WHEN regexp_matches({x}, {lit('(?i)' + t[2])}) THEN {lit(t[at])}" for t in dims.TAXONOMY)
    return f"CASE {whens} ELSE {lit('other') if at == 0 else 'NULL'} END"


def type_to_cwe(x: str) -> str:
    whens = " ".join(f"WHEN contains({tidy(x)}, {lit(k)}) THEN {lit(v)}" for k, v in dims.TYPE_SUBSTRING_CWE.items())
    return f"CASE {whens} ELSE {loose_cwe(x)} END"


def phrase_count(x: str, phrases) -> str:
    low = f"lower({x})"
    return "(" + " + ".join(f"CAST((length({low}) - length(replace({low}, {lit(p)}, ''))) // {len(p)} AS INT)" for p in phrases) + ")"


def nonblank_lines(x: str) -> str:
    return f"len(list_filter(string_split({x}, chr(10)), lambda s: {strip('s')} <> ''))"


def approx_tokens(x: str) -> str:
    return f"CAST(CASE WHEN coalesce(length({x}), 0) = 0 THEN 0 ELSE greatest(1, length({x}) // 4) END AS BIGINT)"


def percent(n: str, d: str) -> str:
    return f"CAST(floor(({n}) * 100 / greatest({d}, 1)) AS BIGINT)"


def ratio(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) > 0 THEN CAST({n} AS DOUBLE) / ({d}) ELSE 0.0 END"


def hash_order(seed: str, *ids: str) -> str:
    return f"sha256(concat_ws('|', {lit(seed)}, " + ", ".join(f"CAST({i} AS VARCHAR)" for i in ids) + "))"


def hash_uniform(seed: str, *ids: str) -> str:
    return f"CAST(CAST('0x' || substring({hash_order(seed, *ids)}, 1, 12) AS BIGINT) AS DOUBLE) / {float(1 << 48)}"


_USER = "list_filter(messages, lambda m: m.role = 'user')[1].content"
_ANSWER = "list_filter(messages, lambda m: m.role = 'assistant')[1].content"

#: One row for each record, pair, task and finding: redelivered rows count once.
REC = f"""rec AS (
  SELECT record_id, split, messages, {_USER} AS usr, {_ANSWER} AS answer, _meta.shape AS shape, {tidy('_meta.source')} AS source,
    {tidy('_meta.language')} AS language, {tidy('_meta.label')} AS label, _meta.cwes AS cwes, _meta.ground_truth_cwe AS gt_cwe,
    coalesce(_meta.cwes[1], _meta.ground_truth_cwe) AS cwe, _meta.oracle AS oracle, _meta.improved AS improved, _meta.multi_hop AS multi_hop,
    _meta.helper_fn AS helper_fn, _meta.disposition AS disposition, _meta.num_findings AS num_findings, _meta.quarantine_reasons AS quarantine_reasons,
    _meta.specificity AS specificity
  FROM (SELECT DISTINCT ON (record_id) * FROM pilot_records))"""
PAIRS = f"""pairs AS (
  SELECT pair_id, vuln_code, fixed_code, cwe, {tidy('language')} AS language, {tidy('vuln_type')} AS vuln_type, source, owner_repo
  FROM (SELECT DISTINCT ON (pair_id) * FROM fix_pairs))"""
TASKS = f"""tasks AS (
  SELECT task_no, task_id, code, {tidy('language')} AS language, {tidy('label')} AS label, cwe, source
  FROM (SELECT DISTINCT ON (task_no) * FROM shape1))"""
FINDS = f"""finds AS (
  SELECT finding_id, {tidy('source')} AS source, owner_repo, file, unit, line, {tidy('status')} AS status, cwe, {tidy('severity')} AS severity, trace, fix, think
  FROM (SELECT DISTINCT ON (finding_id) * FROM findings))"""


def query(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
