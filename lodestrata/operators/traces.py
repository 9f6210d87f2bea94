"""Building, flattening and summarising reasoning traces with native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import dims
from lodestrata.functions import text as T


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def record_messages(user: Column, assistant: Column) -> Column:
    return F.array(message("user", user), message("assistant", assistant))


def flatten(records: DataFrame) -> DataFrame:
    """One flat trace for each record of two messages or more."""
    return records.where(F.size("messages") >= 2).select(
        F.concat(F.lit("r"), F.col("record_id")).alias("id"),
        "shape",
        F.coalesce(dims.lookup(dims.TIERS, F.col("shape")), F.lit("other")).alias("tier"),
        "source",
        "language",
        "label",
        "cwe",
        "oracle",
        "improved",
        F.get("messages", 0)["content"].alias("prompt"),
        F.get("messages", 1)["content"].alias("current_reasoning"),
    )


def rebuild(flat: DataFrame) -> DataFrame:
    """Records from flat traces; the improved reasoning counts where it is not empty."""
    better = T.nonempty(F.col("improved_reasoning"))
    return flat.select(
        "id",
        record_messages(F.col("prompt"), F.coalesce(better, F.col("current_reasoning"))).alias("messages"),
        F.struct(
            F.regexp_replace("shape", "^shape1.*", "shape1").alias("shape"),
            "source",
            "language",
            "label",
            F.when(F.col("cwe").isNotNull(), F.array("cwe")).otherwise(F.array().cast("array<string>")).alias("cwes"),
            F.col("cwe").alias("ground_truth_cwe"),
            better.isNotNull().alias("improved"),
        ).alias("_meta"),
    )


def normal_language(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(F.contains(low, F.lit("javascript")) | (low == "js"), "javascript")
        .when(F.contains(low, F.lit("python")) | (low == "py"), "python")
        .otherwise(low)
    )


def is_vulnerable(c: Column) -> Column:
    return T.tidy(c.cast("string")).isin("1", "vulnerable", "vuln", "yes", "true")


def short_title(answer: Column, cwes: Column) -> Column:
    trace = T.field("trace", answer)
    usable = F.when(T.any_contains(F.lower(trace), dims.PLACEHOLDER_TITLES), F.lit("")).otherwise(trace)
    first = F.get(cwes, 0)
    return (
        F.when(F.length(usable) >= 20, F.substring(usable, 1, 80))
        .when(first.isNotNull(), F.concat(first, F.lit(" finding")))
        .otherwise("Vulnerability finding")
    )


def severity_of(answer: Column) -> Column:
    return F.coalesce(T.nonempty(F.upper(F.regexp_extract(answer, r"(?imd)^\s*severity\s*:\s*(HIGH|MEDIUM|LOW)\s*$", 1))), F.lit("MEDIUM"))


def context_lines(code: Column, line: Column, before: int, after: int) -> Column:
    """Lines around line ``line`` (from 1), within the code."""
    lines = F.split(code, "\n")
    start = F.greatest(F.lit(1), line - before)
    return F.array_join(F.slice(lines, start, F.greatest(F.lit(0), line + after - start + 1)), "\n")


def clean_reasoning(c: Column) -> Column:
    """Text without the tags that generators wrap around reasoning and without its lead-in word."""
    led = F.regexp_replace(c, r"(?i)</?\s*(?:thinking|think|reasoning|analysis)\s*>", "")
    return F.regexp_replace(led, r"(?i)^\s*(?:reasoning|analysis|answer)\s*:\s*", "")


def strip_artifacts(c: Column) -> Column:
    """Text without model artefacts: channel marks, special tokens and an unopened end tag's head."""
    plain = F.regexp_replace(c, r"<\|[^|>]*\|>", "")
    return T.strip(F.regexp_replace(plain, r"(?s)^(?:(?!<think>).)*?</think>", ""))


def plain_cwe(c: Column) -> Column:
    """CWE field with plain hyphens; a bare number becomes an id, an id in a longer text stands alone."""
    value = T.strip(F.regexp_replace(c, "[‐-―−]", "-"))
    return (
        F.when(value.rlike(r"^\d{1,4}$"), F.concat(F.lit("CWE-"), value))
        .when(value.rlike(r"(?i)CWE-\d+"), F.upper(F.regexp_extract(value, r"(?i)(CWE-\d+)", 1)))
        .otherwise(value)
    )


def candidate_score(answer: Column) -> Column:
    quoted = F.size(F.regexp_extract_all(answer, F.lit("(`[^`]{3,40}`)"), 1))
    score = quoted * F.lit(1.5) - T.phrase_count(answer, dims.CANDIDATE_GENERIC) * F.lit(2.0)
    return F.when((F.length(answer) < 300) | T.think(answer).isNull(), F.lit(0.0)).otherwise(score)


def rescue_json(c: Column) -> Column:
    """From the first opening to the last closing brace; null where there is no such pair."""
    return T.nonempty(F.regexp_extract(c, r"(?s)(\{.*\})", 1))


def _fallback(cwe: Column, language: Column, vulnerable: Column) -> Column:
    named = F.concat(F.coalesce(cwe, F.lit("CWE-UNK")), F.lit(" in "), F.coalesce(language, F.lit("code")))
    return F.when(vulnerable, named).otherwise("safe code pattern")


def trace_summary(reasoning: Column, cwe: Column, language: Column, vulnerable: Column) -> Column:
    """First sentence of the reasoning without list marks, 120 characters at most; a stub where it is too short."""
    plain = T.strip(F.regexp_replace(reasoning, "^[\\s\\d.)*\\-•]+", ""))
    head = T.strip(F.get(F.split(plain, r"[.!?]\s+", 2), 0))
    cut = F.when(F.length(head) > 120, F.concat(F.regexp_replace(F.substring(head, 1, 117), r"\s+$", ""), F.lit("..."))).otherwise(head)
    return F.when(F.length(F.coalesce(cut, F.lit(""))) < 20, _fallback(cwe, language, vulnerable)).otherwise(cut)


def fix_summary(reasoning: Column, vulnerable: Column) -> Column:
    """First sentence that tells how to fix, 200 characters at most."""
    sentence = T.strip(
        F.regexp_extract(reasoning, r"([A-Z][^.!?]*?\b(fix|patch|sanitize|replace|use(?:s|d)?\s+\w+|should|must)\b[^.!?]*[.!?])", 1)
    )
    cut = F.when(F.length(sentence) <= 200, sentence).otherwise(F.concat(F.regexp_replace(F.substring(sentence, 1, 197), r"\s+$", ""), F.lit("...")))
    return (
        F.when(~vulnerable, "none")
        .when(F.coalesce(reasoning, F.lit("")) == "", "consult security guidance for this CWE class")
        .when(sentence != "", cut)
        .otherwise("remediate at the dangerous sink (see reasoning for details)")
    )


#: Words of attack and of repair, and constructs by priority. Fixed values.
ATTACK = r"(?i)(?:attacker|adversary|malicious user|exploit(?:ed|ation)?)|(?:inject(?:s|ed|ion)?|execute(?:s|d)?|gain access|bypass(?:es|ed)?)|(?:leak(?:s|ed)?|exfiltrat(?:e|ion)|expose(?:s|d)?)|(?:overwrit(?:e|ten|es)?|escalate|tamper(?:ed)?)"
REPAIR = r"(?i)(?:use|replace|sanitize|validate|escape|parameteriz|encode|enforce)\w*|(?:should|must|recommend(?:ed)?|fix is|patch is)|(?:bcrypt|argon|hmac\.|secrets\.|parameteriz|prepared statement|allowlist|whitelist)"
CONSTRUCTS = (
    r"(`[^`]+`)",
    r"(\b\w+\.\w+\s*\([^)]*\))",
    r"(\b(?:f-?string|template literal|string concatenation|interpolation)\b)",
    r"(\b(?:eval|exec|subprocess|os\.system|child_process|innerHTML|dangerouslySet)\w*)",
    r"(\b(?:pickle|yaml\.load|marshal)\b)",
)


def first_sentence(reasoning: Column, pattern: str) -> Column:
    """First sentence of 30 to 240 characters that matches, without list marks."""
    sentences = F.filter(F.split(reasoning, r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: s.rlike(pattern))
    plain = F.transform(sentences, lambda s: T.strip(F.regexp_replace(s, "^[\\s\\d.)*\\-•]+", "")))
    return F.get(F.filter(plain, lambda s: F.length(s).between(30, 240)), 0)


def construct(reasoning: Column) -> Column:
    return F.coalesce(*[T.nonempty(F.regexp_extract(reasoning, p, 1)) for p in CONSTRUCTS])


def rich_trace(reasoning: Column, cwe: Column, language: Column, vulnerable: Column) -> Column:
    """A trace that names a construct and the attack, with plainer forms where one is missing."""
    what, attack = construct(reasoning), F.when(vulnerable, first_sentence(reasoning, ATTACK))
    head = T.strip(F.get(F.split(T.strip(F.regexp_replace(reasoning, "^[\\s\\d.)*\\-•]+", "")), r"[.!?]\s+", 2), 0))
    fallback = _fallback(cwe, language, vulnerable)
    return (
        F.when(F.length(F.coalesce(reasoning, F.lit(""))) < 80, fallback)
        .when(what.isNotNull() & attack.isNotNull(), F.concat(what, F.lit(" — "), F.substring(attack, 1, 130)))
        .when(attack.isNotNull(), F.substring(attack, 1, 170))
        .when(what.isNotNull(), F.concat(F.coalesce(cwe, F.lit("CWE-UNK")), F.lit(" in "), what))
        .when(F.length(head).between(30, 200), head)
        .otherwise(fallback)
    )


def rewrite_field(answer: Column, name: str, value: Column) -> Column:
    """``answer`` with the value of its first ``name:`` line replaced; unchanged without such a line."""
    head = F.regexp_extract(answer, rf"(?imsd)\A(.*?^{name}\s*:)[^\n]*$", 1)
    tail = F.regexp_extract(answer, rf"(?imsd)\A.*?^{name}\s*:[^\n]*(.*)\z", 1)
    return F.when(head != "", F.concat(head, F.lit(" "), value, tail)).otherwise(answer)


def specificity(reasoning: Column, code_names: Column) -> Column:
    """Struct score and its five parts: how much a reasoning deals with the code at hand."""
    return T.let(F.struct(reasoning.alias("text"), code_names.alias("names")), lambda known: _specificity(known["text"], known["names"]))


def _specificity(reasoning: Column, code_names: Column) -> Column:
    n = F.size(code_names)
    named = F.size(F.array_intersect(F.filter(code_names, lambda t: F.length(t) >= 3), F.split(reasoning, r"[^A-Za-z0-9_]+")))
    parts = {
        "ident_coverage": F.least(F.when(n > 0, named / n).otherwise(F.lit(0.0)), F.lit(1.0)),
        "cwe_refs": F.least(F.regexp_count(reasoning, F.lit(r"(?i)\bCWE[-‑]?\d+\b")) / 3.0, F.lit(1.0)),
        "file_refs": F.least(F.regexp_count(reasoning, F.lit(r"\b[\w_]+/[\w_]+\.(?:py|js|ts|tsx|jsx)\b")) / 2.0, F.lit(1.0)),
        "specific": F.least(T.phrase_count(reasoning, dims.SPECIFIC_PHRASES) / 3.0, F.lit(1.0)),
        "generic_penalty": F.least(T.phrase_count(reasoning, dims.GENERIC_PHRASES) / 6.0, F.lit(1.0)),
    }

    def score(p: Column) -> Column:
        raw = p["ident_coverage"] * 0.40 + p["cwe_refs"] * 0.20 + p["file_refs"] * 0.15 + p["specific"] * 0.15 - p["generic_penalty"] * 0.30
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
        total = F.when(F.length(F.coalesce(reasoning, F.lit(""))) < 100, F.lit(0.0)).otherwise(clamped)
        return F.struct(total.alias("score"), *[p[name].alias(name) for name in parts])

    return T.let(F.struct(*[c.alias(name) for name, c in parts.items()]), score)
