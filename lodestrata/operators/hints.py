"""Concrete elements of code for a prompt: tainted inputs, sinks, imports, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Untrusted inputs and dangerous calls by language, in their fixed order. Fixed values.
PY_TAINT = (
    r"\brequest\.(?:args|form|json|data|files|values|cookies|headers|GET|POST|method)\b[\.\[\w_'\"]*",
    r"\breq\.(?:body|query|params|headers|cookies|file[s]?)\b[\.\[\w_'\"]*",
    r"\bos\.environ(?:\.get)?(?:\([^)]*\)|\[[^\]]*\])?",
    r"\binput\(\)",
    r"\bsys\.argv\b\[?\d*\]?",
    r"\bself\.[a-z_]+ = .*request",
)
JS_TAINT = (
    r"\breq\.(?:body|query|params|headers|cookies|files?)\b[\.\[\w_'\"]*",
    r"\bdocument\.(?:cookie|location)\b",
    r"\bwindow\.location\b",
    r"\bprocess\.env\.[A-Z_]+\b",
    r"\bparams\.(?:get\([^)]+\)|[\w_]+)\b",
)
PY_SINKS = {
    "subprocess.exec": r"\b(?:subprocess\.(?:run|call|Popen|check_output|check_call)|os\.(?:system|popen))\s*\(",
    "shell_true": r"\bshell\s*=\s*True\b",
    "exec_eval": r"\b(?:exec|eval|compile|__import__)\s*\(",
    "sql_execute": r"\b(?:cur(?:sor)?|conn(?:ection)?|db)\.execute(?:many)?\s*\(",
    "sql_raw": r"\.raw\s*\(",
    "fs_open": r"\b(?:open|os\.path\.join|Path|send_file|FileResponse|sendfile)\s*\(",
    "fs_read": r"\b(?:fs\.readFile|fs\.readFileSync|f\.read)\s*\(",
    "pickle_yaml": r"\b(?:pickle\.(?:loads?|load)|yaml\.load|marshal\.loads?)\s*\(",
    "xml_parse": r"\b(?:xml\.etree|lxml\.etree|minidom)\.[\w]+\s*\(",
    "render_template": r"\b(?:render_template_string|render_template|jinja2\.Template|mark_safe|Markup)\s*\(",
    "http_outbound": r"\b(?:requests\.(?:get|post|put|delete)|urlopen|urllib\.request)\s*\(",
    "redirect": r"\b(?:redirect|HttpResponseRedirect)\s*\(",
    "hash_weak": r"\bhashlib\.(?:md5|sha1)\s*\(",
    "random_weak": r"\brandom\.(?:random|randint|choice|sample|shuffle)\b",
    "string_format_sql": r"f[\"\'].*(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE).*[\"\']",
    "fstring_sql": r"\.(?:execute|raw)\s*\(\s*f[\"\']",
    "shell_concat": r"(?:os\.system|subprocess\.\w+)\s*\([^)]*\+",
}
JS_SINKS = {
    "child_process": r"\bchild_process\.(?:exec|execSync|spawn|spawnSync|fork)\s*\(",
    "exec_eval": r"\b(?:eval|new\s+Function|Function\s*\()\s*\(?",
    "dangerouslySIH": r"\bdangerouslySetInnerHTML\b",
    "innerHTML": r"\.(?:innerHTML|outerHTML)\s*=",
    "document_write": r"\bdocument\.write(?:ln)?\s*\(",
    "shell_true": r"\bshell\s*:\s*true\b",
    "fs_read": r"\bfs\.(?:readFile|readFileSync|createReadStream)\s*\(",
    "send_file": r"\bres\.(?:sendFile|download)\s*\(",
    "sql_query": r"\b(?:pool|conn(?:ection)?|client|db)\.(?:query|execute)\s*\(",
    "mongoose_where": r"\$where\b",
    "redirect": r"\bres\.redirect\s*\(",
    "template_literal_sql": r"`[^`]*(?:SELECT|INSERT|UPDATE|DELETE)[^`]*\$\{",
    "require_dynamic": r"\brequire\s*\([^)]*req\.\w+",
    "fetch_outbound": r"\b(?:fetch|axios\.\w+|undici\.fetch)\s*\(",
}


def is_python(language: Column) -> Column:
    return language == "python"


def is_script(language: Column) -> Column:
    return language.isin("javascript", "typescript", "react")


def taint_sources(code: Column, language: Column) -> Column:
    """Distinct tainted inputs in the order of their pattern and place, 80 characters at most."""
    every = lambda patterns: F.flatten(F.array(*[F.regexp_extract_all(code, F.lit(f"(?d)({p})"), 1) for p in patterns]))
    found = F.when(is_python(language), every(PY_TAINT)).when(is_script(language), every(JS_TAINT)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(found, lambda s: F.substring(s, 1, 80)))


def sinks(code: Column, language: Column) -> Column:
    """Array of (name, text): the first call of each dangerous kind, in their order."""
    every = lambda table: F.filter(
        F.array(*[F.struct(F.lit(n).alias("name"), F.regexp_extract(code, f"(?d)({p})", 1).alias("text")) for n, p in table.items()]), lambda s: s["text"] != ""
    )
    return F.when(is_python(language), every(PY_SINKS)).when(is_script(language), every(JS_SINKS)).otherwise(F.array().cast("array<struct<name:string,text:string>>"))


def script_names(code: Column) -> Column:
    """Function and class names of script code, each once."""
    patterns = (
        r"\bfunction\s+([A-Za-z_$][\w$]*)\s*\(",
        r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>)",
        r"\bclass\s+([A-Za-z_$][\w$]*)\b",
        r"\bexport\s+(?:default\s+)?(?:function\s+|class\s+|const\s+)([A-Za-z_$][\w$]*)",
    )
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(code, F.lit(p), 1) for p in patterns])))


def script_imports(code: Column) -> Column:
    patterns = (r"""\brequire\s*\(\s*["']([^"']+)["']\s*\)""", r"""\bimport\s+(?:[\w*\s{},]+\s+from\s+)?["']([^"']+)["']""")
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(code, F.lit(p), 1) for p in patterns])))


def render(taints: Column, found: Column, names: Column, imports: Column, most: int = 6) -> Column:
    """Hint block of a prompt, '' where nothing concrete was found."""
    quoted = lambda items: F.array_join(F.transform(F.slice(items, 1, most), lambda s: F.concat(F.lit("`"), s, F.lit("`"))), ", ")
    line = lambda title, items, body: F.when(F.size(items) > 0, F.concat(F.lit(f"  - {title}: "), body))
    calls = F.array_join(F.transform(F.slice(found, 1, most), lambda s: F.concat(F.lit("`"), F.trim(F.substring(s["text"], 1, 60)), F.lit("` ("), s["name"], F.lit(")"))), ", ")
    block = F.concat_ws(
        "\n",
        F.lit("CODE ELEMENTS to name in the reasoning:"),
        line("Tainted inputs", taints, quoted(taints)),
        line("Dangerous sinks", found, calls),
        line("Functions/classes defined", names, quoted(names)),
        line("Imports", imports, F.array_join(F.slice(imports, 1, most), ", ")),
    )
    return F.when((F.size(taints) > 0) | (F.size(found) > 0) | (F.size(names) > 0), block).otherwise("")
