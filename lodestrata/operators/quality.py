"""Verification, audit and gates of reasoning traces: failed checks as arrays of reasons.

A check is a conditional literal; the array of all checks without its nulls is
what failed. Reports explode that array, filters test its size. Everything is
native and stays in one stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions import dims
from lodestrata.functions import text as T


def reasons(*checks: tuple[Column, str | Column]) -> Column:
    """Messages of the checks that hold (a null condition does not hold)."""
    return F.array_compact(F.array(*[F.when(c, F.lit(m) if isinstance(m, str) else m) for c, m in checks]))


def family_hits(text: Column) -> Column:
    """Array of (n, turn, name): the marker hits of each family, turn falling in the order of the table."""

    def hits(low: Column) -> Column:
        return F.array(
            *[
                F.struct(F.size(F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m))).alias("n"), F.lit(-i).alias("turn"), F.lit(name).alias("name"))
                for i, (name, markers) in enumerate((n, f.markers) for n, f in dims.FAMILIES.items())
            ]
        )

    return T.let(F.lower(text), hits)


def bleed(text: Column, cwe: Column) -> Column:
    """Struct family, own, other, other_family, ok: does a trace read like another family than its label's?

    It does where no marker of its own family and at least three of another
    one occur; among equals the first family of the table counts. A CWE of no
    family passes.
    """
    family = T.family(cwe)

    def judge(hits: Column) -> Column:
        own = F.get(F.filter(hits, lambda h: h["name"] == family), 0)["n"]
        best = F.array_max(F.filter(hits, lambda h: h["name"] != family))
        return F.struct(
            family.alias("family"),
            own.alias("own"),
            best["n"].alias("other"),
            F.when(best["n"] > 0, best["name"]).alias("other_family"),
            F.coalesce(~((own == 0) & (best["n"] >= 3)), F.lit(True)).alias("ok"),
        )

    return T.let(family_hits(text), judge)


def bleed_reason(text: Column, cwe: Column) -> Column:
    """What a trace reads like, null where that is no other family."""

    def told(b: Column) -> Column:
        parts = (F.lit("bleed:reads like '"), b["other_family"], F.lit("' not '"), b["family"], F.lit("' (own=0, other="), b["other"].cast("string"), F.lit(")"))
        return F.when(~b["ok"], F.concat(*parts))

    return T.let(bleed(text, cwe), told)


def verify(text: Column, label: Column, cwe: Column, strict_control: bool = False) -> Column:
    """Reasons why a trace contradicts its label; context records always pass.

    ``strict_control`` looks for the cited control outside the field lines;
    otherwise ``status: safe`` counts as one, as the format has always done.
    """
    kind = T.norm_label(label)
    status = F.lower(T.field("status", text))
    body = F.regexp_replace(text, r"(?im)^\s*(?:status|cwe|severity|line)\s*:.*$", "") if strict_control else text
    thought = T.strip(F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1), F.lit("")), F.lit("")))
    cwe_field, trace, fix = T.field("cwe", text), T.field("trace", text), F.lower(T.field("fix", text))
    vuln, safe = kind == "vuln", kind == "safe"
    return reasons(
        ((vuln | safe) & (F.length(thought) < 40), "stub: <think> missing/too short"),
        (vuln & ~status.isin(*dims.VULN_LABELS), F.concat(F.lit("status '"), status, F.lit("' != vuln-label"))),
        (vuln & ~cwe_field.rlike(r"(?i)CWE-\d+"), "vuln_no_cwe (unclassifiable)"),
        (vuln & ((F.length(trace) < 12) | (F.lower(trace) == "none")), "weak_trace"),
        (vuln & fix.isin("", "none"), "vuln_missing_fix"),
        (vuln & ~F.lower(T.field("severity", text)).isin("low", "medium", "high"), "vuln_bad_severity"),
        (vuln, bleed_reason(text, cwe)),
        (safe & (status != "safe"), F.concat(F.lit("status '"), status, F.lit("' != safe-label"))),
        (
            safe & ~F.lower(cwe_field).isin("none", "n/a", "-", ""),
            F.concat(F.lit("safe-trace names cwe '"), F.lower(cwe_field), F.lit("'")),
        ),
        (safe & ~body.rlike("(?i)" + dims.CONTROL_WORDS), "safe-trace cites no concrete control"),
    )


def audit(text: Column, label: Column, gt_cwe: Column) -> Column:
    """Names of the consistency issues of a record."""
    kind = T.norm_label(label)
    vuln, safe = kind == "vuln", kind == "safe"
    status, cwe, fix, severity = (F.lower(T.field(n, text)) for n in ("status", "cwe", "fix", "severity"))
    trace = T.field("trace", text)
    has_cwe = cwe.rlike(r"(?i)CWE-\d+")
    return reasons(
        ((vuln & ~status.isin(*dims.VULN_LABELS)) | (safe & (status != "safe")), "status_mismatch"),
        (vuln & ~has_cwe, "vuln_missing_cwe"),
        (vuln & has_cwe & (gt_cwe != "") & (F.upper(cwe) != F.upper(gt_cwe)), "cwe_field_ne_label"),
        (vuln & fix.isin("", "none"), "vuln_missing_fix"),
        (vuln & ((F.length(trace) < 12) | (F.lower(trace) == "none")), "vuln_weak_trace"),
        (vuln & ~severity.isin("low", "medium", "high"), "vuln_bad_severity"),
        (safe & ~cwe.isin("", "none", "n/a", "-"), "safe_has_cwe"),
        (safe & ~fix.isin("", "none"), "safe_has_fix"),
        (safe & trace.rlike(r"(?i)CWE-\d+"), "safe_cwe_in_trace"),
        (safe & ~severity.isin("", "none"), "safe_has_severity"),
    )


def trace_line(text: Column) -> Column:
    return T.strip(F.regexp_extract(text, r"(?imd)^\s*trace:\s*(.+)$", 1))


def _corresponds(named: Column, code: Column, code_names: Column) -> Column:
    missing = F.filter(F.array_except(named, code_names), lambda t: ~F.contains(code, t))
    return (F.size(named) > 0) & (F.size(missing) <= F.greatest(F.lit(1), F.floor(F.size(named) / 2)))


def _localized(line: Column, named: Column, lines: Column, names: Column, slack: int) -> Column:
    near = F.exists(lines, lambda x: F.abs(x - line) <= slack)
    unknown = (F.size(lines) == 0) & (F.size(names) == 0)
    return unknown | F.coalesce(near, F.lit(False)) | F.coalesce(F.arrays_overlap(named, names), F.lit(False))


def _same_cwe(said: Column, cwe: Column) -> Column:
    predicted = F.regexp_extract(said, r"(\d+)", 1)
    return cwe.isNull() | (cwe == "") | F.coalesce((predicted != "") & (predicted == F.regexp_extract(cwe, r"(\d+)", 1)), F.lit(False))


def _line_number(verdict: Column) -> Column:
    return F.try_to_number(verdict["line"], F.lit("999999")).cast("int")


def correspondence(text: Column, code: Column) -> Column:
    """Whether the identifiers of the trace occur in the code, up to half of them (one at least)."""
    facts = F.struct(T.identifiers(trace_line(text)).alias("named"), code.alias("code"), T.identifiers(code).alias("code_names"))
    return T.let(facts, lambda f: _corresponds(f["named"], f["code"], f["code_names"]))


def localization(text: Column, lines: Column, names: Column, slack: int = 2) -> Column:
    """Whether the verdict's line is near a changed line or its trace names a changed identifier.

    Without any known line or identifier it passes.
    """
    facts = F.struct(_line_number(T.parse_verdict(text)).alias("line"), T.identifiers(trace_line(text)).alias("named"), lines.alias("lines"), names.alias("names"))
    return T.let(facts, lambda f: _localized(f["line"], f["named"], f["lines"], f["names"], slack))


def cwe_consistency(text: Column, cwe: Column) -> Column:
    """Whether the predicted CWE number is the true one; passes where none is known."""
    return _same_cwe(T.parse_verdict(text)["cwe"], cwe)


def substantive(text: Column) -> Column:
    """No hedging, and a flow from source to sink is told."""
    blob = F.concat(F.coalesce(T.think(text), text), F.lit("\n"), trace_line(text))
    return T.let(blob, lambda b: ~b.rlike("(?i)" + dims.HEDGE) & b.rlike("(?i)" + dims.FLOW))


def gate_failures(text: Column, code: Column, lines: Column, names: Column, cwe: Column, slack: int = 2) -> Column:
    """Names of the failed gates in their fixed order."""
    facts = F.struct(
        T.identifiers(trace_line(text)).alias("named"),
        code.alias("code"),
        T.identifiers(code).alias("code_names"),
        T.parse_verdict(text).alias("verdict"),
        lines.alias("lines"),
        names.alias("names"),
        cwe.alias("true_cwe"),
        substantive(text).alias("substantive"),
    )
    return T.let(
        facts,
        lambda f: reasons(
            (~_corresponds(f["named"], f["code"], f["code_names"]), "correspondence"),
            (~_localized(_line_number(f["verdict"]), f["named"], f["lines"], f["names"], slack), "localization"),
            (~_same_cwe(f["verdict"]["cwe"], f["true_cwe"]), "cwe"),
            (~f["substantive"], "substantiveness"),
        ),
    )


def block(text: Column, tag: str) -> Column:
    """Content of a <<<TAG>>> block, null where it is missing or blank."""
    return T.nonempty(T.strip(F.regexp_extract(text, rf"(?s)<<<{tag}(?:\s[^>]*)?>>>\s*\n(.*?)\n<<<END_{tag}>>>", 1)))


def list_items(text: Column, header: str) -> Column:
    """Items of the dashed list after ``header:``."""
    lines = F.split(F.regexp_extract(text, rf"(?i){header}\s*:\s*\n((?:\s*-\s*[^\n]+\n?)+)", 1), "\n")
    dashed = F.filter(F.transform(lines, lambda x: T.strip(x)), lambda x: x.startswith("-"))
    return F.transform(dashed, lambda x: T.strip(F.regexp_replace(x, r"^-+", "")))


def accept(text: Column, shape: Column, label: Column, helper: Column, disposition: Column, multi_hop: Column, titles: Column) -> Column:
    """Whether a generated answer fits the contract of its shape.

    shape2 asks for context and names the helper; shape3 has the status of its
    disposition, both code blocks and, over several hops, follow-up refs;
    shape4 ranks known titles in falling severity; safe shapes have a long
    thought and a trace; all others have the status of their label and a
    thought.
    """
    verdict = T.parse_verdict(text)
    status_raw = F.lower(T.field("status", text))
    thought = F.coalesce(verdict["think"], F.lit(""))
    asks = F.contains(status_raw, F.lit("needs_context"))
    names_helper = F.exists(list_items(text, "open_refs"), lambda r: F.contains(F.lower(r), F.lower(helper)))
    shape2 = asks & names_helper & (F.length(block(text, "CALLER_CODE")) >= 60)
    wanted = F.when(disposition == "confirm", "confirmed").otherwise("safe")
    shape3 = (
        (thought != "")
        & (verdict["status"] == wanted)
        & (F.length(block(text, "CALLER_CODE")) >= 60)
        & (F.length(block(text, "HELPER_CODE")) >= 40)
        & (~F.coalesce(multi_hop, F.lit(False)) | (F.size(list_items(text, "follow_up_refs")) > 0))
    )
    ranked = ranked_findings(text)
    known = F.forall(ranked, lambda r: F.exists(titles, lambda t: F.contains(F.lower(r["title"]), F.lower(t)) | F.contains(F.lower(t), F.lower(r["title"]))))
    shape4 = (
        T.think(text).isNotNull()
        & text.rlike(r"(?i)executive_summary\s*:")
        & (F.size(ranked) >= F.least(F.lit(3), F.size(titles)))
        & known
        & severities_fall(F.transform(ranked, lambda r: r["severity"]))
    )
    safe_only = (verdict["status"] == "safe") & (F.length(thought) >= 80) & verdict["trace"].isNotNull()
    plain = (thought != "") & (verdict["status"] == F.when(T.norm_label(label) == "vuln", "confirmed").otherwise("safe"))
    chosen = (
        F.when(shape == "shape2", shape2)
        .when(shape == "shape3", shape3)
        .when(shape == "shape4", shape4)
        .when(shape.rlike("_safe$"), safe_only)
        .otherwise(plain)
    )
    return F.coalesce(chosen, F.lit(False))


def ranked_findings(text: Column) -> Column:
    """Array of (rank, title, severity) of the ranked_findings block; a missing severity is MEDIUM."""
    body = F.regexp_extract(text, r"(?is)ranked_findings\s*:\s*\n(.*?)(?=\n\s*(?:systemic_observations|dedup_notes)\b|\z)", 1)
    items = F.split(F.concat(F.lit("\n"), body), r"\n\s*-\s*rank\s*:\s*")
    parsed = F.transform(
        items,
        lambda x: F.struct(
            F.try_to_number(F.nullif(F.regexp_extract(T.strip(x), r"^(\d{1,6})", 1), F.lit("")), F.lit("999999")).cast("int").alias("rank"),
            F.regexp_replace(T.strip(F.regexp_extract(x, r"(?im)title\s*:\s*(.+?)\s*$", 1)), r"""^["'](.*)["']$""", "$1").alias("title"),
            F.coalesce(T.nonempty(F.upper(F.regexp_extract(x, r"(?i)severity\s*:\s*(HIGH|MEDIUM|LOW)", 1))), F.lit("MEDIUM")).alias("severity"),
        ),
    )
    return F.filter(parsed, lambda r: r["rank"].isNotNull() & (r["title"] != ""))


def severities_fall(levels: Column) -> Column:
    """Whether no severity in the array is above the one before it."""
    ranks = F.transform(levels, lambda s: F.coalesce(dims.lookup({k: str(v) for k, v in dims.SEVERITY_RANK.items()}, s).cast("int"), F.lit(0)))
    return F.when(
        F.size(ranks) > 1,
        F.forall(F.sequence(F.lit(1), F.size(ranks) - 1), lambda i: F.element_at(ranks, i) >= F.element_at(ranks, i + 1)),
    ).otherwise(F.lit(True))
