import pytest
from pyspark.sql import functions as F

from lodestrata.operators import quality as Q
from tests.test_text import GOOD, value

CODE = "def view(name):\n    path = os.path.join(base, name)\n    check(path)\n    return send_file(path)"


def test_good_trace_passes_every_gate(spark):
    failed = Q.gate_failures(F.col("t"), F.col("c"), F.array(F.lit(4)), F.array(F.lit("send_file")), F.lit("CWE-22"))
    assert value(spark, failed, t=GOOD, c=CODE) == []


@pytest.mark.parametrize(
    "change,lines,names,cwe,gate",
    [
        (("The value flows", "This could be exploited if the input flows"), [4], ["send_file"], "CWE-22", "substantiveness"),
        (("name -> send_file(path)", "url -> urlopen(target, proxy)"), [4], ["send_file"], "CWE-22", "correspondence"),
        (("", ""), [90], ["other"], "CWE-22", "localization"),
        (("", ""), [4], ["send_file"], "CWE-89", "cwe"),
    ],
)
def test_each_gate_fails_alone(spark, change, lines, names, cwe, gate):
    text = GOOD.replace(*change) if change[0] else GOOD
    got = value(spark, Q.gate_failures(F.col("t"), F.col("c"), F.array(*map(F.lit, lines)), F.array(*map(F.lit, names)), F.lit(cwe)), t=text, c=CODE)
    assert got == [gate]


def test_unknown_region_and_cwe_pass(spark):
    none = F.array().cast("array<int>"), F.array().cast("array<string>")
    assert value(spark, Q.localization(F.col("t"), *none), t=GOOD) is True
    assert value(spark, Q.cwe_consistency(F.col("t"), F.lit(None).cast("string")), t=GOOD) is True


@pytest.mark.parametrize("text,cwe,ok", [("the cursor runs the sql query with select id", "CWE-89", True), ("innerhtml gets document.write and xss", "CWE-89", False), ("innerhtml document.write xss", "CWE-9999", True)])
def test_bleed(spark, text, cwe, ok):
    assert value(spark, Q.bleed(F.col("t"), F.col("c")), t=text, c=cwe)["ok"] is ok


def test_verify_by_label(spark):
    long_think = GOOD.replace("The value flows into `send_file`.", "The value flows from the request into `send_file` without a check.")
    check = lambda text, label: value(spark, Q.verify(F.col("t"), F.col("l"), F.lit("CWE-22")), t=text, l=label)
    assert check(long_think, "vuln") == []
    assert check(GOOD, "vuln") == ["stub: <think> missing/too short"]
    assert "status 'confirmed' != safe-label" in check(long_think, "safe")
    assert check("anything", "needs_context") == []
    assert "vuln_missing_fix" in check(long_think.replace("Confine the path.", "none"), "vuln")


def test_strict_control_ignores_the_status_line(spark):
    text = "<think>" + "x" * 50 + "</think>\nstatus: safe\ncwe: none"
    flag = lambda strict: value(spark, Q.verify(F.col("t"), F.lit("safe"), F.lit(None).cast("string"), strict), t=text)
    assert flag(False) == [] and flag(True) == ["safe-trace cites no concrete control"]


def test_audit_names(spark):
    got = value(spark, Q.audit(F.col("t"), F.lit("safe"), F.lit(None).cast("string")), t="status: confirmed\ncwe: CWE-1\nseverity: HIGH\ntrace: CWE-79 here\nfix: do it")
    assert got == ["status_mismatch", "safe_has_cwe", "safe_has_fix", "safe_cwe_in_trace", "safe_has_severity"]


SYNTHESIS = """<think>t</think>
executive_summary: two issues
ranked_findings:
  - rank: 1
    title: "SQL injection in login"
    severity: HIGH
  - rank: 2
    title: Weak hash
    severity: LOW
systemic_observations:
  - one
dedup_notes: none"""


def test_ranked_findings_and_order(spark):
    ranked = value(spark, Q.ranked_findings(F.col("t")), t=SYNTHESIS)
    assert [(r["rank"], r["title"], r["severity"]) for r in ranked] == [(1, "SQL injection in login", "HIGH"), (2, "Weak hash", "LOW")]
    falls = lambda *s: value(spark, Q.severities_fall(F.array(*map(F.lit, s))), t="")
    assert falls("HIGH", "LOW") and not falls("LOW", "HIGH") and falls("LOW")


def test_accept_by_shape(spark):
    caller = "<<<CALLER_CODE>>>\n" + "x" * 70 + "\n<<<END_CALLER_CODE>>>"
    asks = caller + "\nstatus: needs_context\nopen_refs:\n  - load_user in db.py"

    def ok(text, shape, label="vuln", helper="load_user", disposition="confirm", hop="false", titles=("SQL injection in login", "Weak hash")):
        column = Q.accept(F.col("t"), F.lit(shape), F.lit(label), F.lit(helper), F.lit(disposition), F.lit(hop).cast("boolean"), F.array(*map(F.lit, titles)))
        return value(spark, column, t=text)

    assert ok(asks, "shape2") and not ok(asks, "shape2", helper="other_name")
    helper = "<<<HELPER_CODE path>>>\n" + "y" * 50 + "\n<<<END_HELPER_CODE>>>"
    cross = f"{caller}\n{helper}\n<think>t</think>\nstatus: confirmed"
    assert ok(cross, "shape3") and not ok(cross, "shape3", disposition="dismiss") and not ok(cross, "shape3", hop="true")
    assert ok(cross + "\nfollow_up_refs:\n  - more", "shape3", hop="true")
    assert ok(SYNTHESIS, "shape4") and not ok(SYNTHESIS, "shape4", titles=("Other thing", "Weak hash"))
    assert ok(GOOD, "shape1") and not ok(GOOD, "shape1", label="safe")
    assert not ok(GOOD, "shape1_verified_safe", label="safe")
