import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import traces


def value(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("v")).first()["v"]


GOOD = "<think>\nThe value flows into `send_file`.\n</think>\nstatus: confirmed\ncwe: CWE-22\nseverity: HIGH\nline: 4\ntrace: name -> send_file(path)\nfix: Confine the path."


def test_verdict_fields(spark):
    v = value(spark, T.parse_verdict(F.col("t")), t=GOOD)
    assert (v["status"], v["cwe"], v["severity"], v["line"], v["fix"]) == ("confirmed", "CWE-22", "HIGH", "4", "Confine the path.")
    assert v["think"] == "The value flows into `send_file`."


def test_last_of_repeated_fields_counts_and_none_is_null(spark):
    v = value(spark, T.parse_verdict(F.col("t")), t="status: safe\ncwe: CWE-79\ncwe: none\nfix: n/a")
    assert (v["status"], v["cwe"], v["fix"]) == ("safe", None, None)


def test_empty_field_takes_the_next_line(spark):
    assert value(spark, T.field("fix", F.col("t")), t="fix:\nnext line") == "next line"


@pytest.mark.parametrize("text,expected", [("confirmed, yes", None), ("Confirmed.", "confirmed"), ("needs_context", "needs_context"), ("synthesis", "synthesis"), ("?", None)])
def test_prediction_status(spark, text, expected):
    got = value(spark, T.prediction_status(F.col("t")), t=text)
    assert got == (expected if text != "confirmed, yes" else "confirmed")


def test_normal_hash_ignores_comments_blanks_case_and_tags(spark):
    a = value(spark, T.normal_hash(F.col("t")), t="<SCAN>\nX = 1  # note\n</SCAN>")
    b = value(spark, T.normal_hash(F.col("t")), t="x=1 // other")
    assert a == b
    assert value(spark, T.normal_hash(F.col("t")), t=None) is None


@pytest.mark.parametrize(
    "code,kind",
    [
        ('cur.execute("SELECT 1" + x)', "sql_injection"),
        ("os.system(cmd)", "command_injection"),
        ("eval(x)", "code_injection"),
        ("pickle.loads(b)", "deserialization"),
        ("el.innerHTML = x", "xss"),
        ("requests.get(u)", "ssrf"),
        ("hashlib.md5(x)", "crypto_weak"),
        ("x = 1", "other"),
    ],
)
def test_classify(spark, code, kind):
    assert value(spark, T.classify(F.col("t")), t=code)["vuln_type"] == kind


def test_identifiers(spark):
    assert value(spark, T.identifiers(F.col("t")), t="return my_var if x else Foo9 self") == ["Foo9", "my_var"]


@pytest.mark.parametrize("text,language", [("def f(x):\n    return x", "python"), ("const a = () => 1", "javascript"), ("const a: string = 'x'", "typescript"), ("<div/> useState()", "react"), ("zzz", "other")])
def test_detect_language(spark, text, language):
    assert value(spark, T.detect_language(F.col("t")), t=text) == language


def test_trace_and_fix_summaries(spark):
    told = "1. The user name reaches the query without any check. You should use bound parameters. More."
    assert value(spark, traces.trace_summary(F.col("t"), F.lit("CWE-89"), F.lit("python"), F.lit(True)), t=told) == "The user name reaches the query without any check"
    assert value(spark, traces.fix_summary(F.col("t"), F.lit(True)), t=told) == "You should use bound parameters."
    assert value(spark, traces.trace_summary(F.col("t"), F.lit("CWE-89"), F.lit("python"), F.lit(True)), t="short") == "CWE-89 in python"
    assert value(spark, traces.fix_summary(F.col("t"), F.lit(False)), t=told) == "none"


def test_rewrite_field_changes_the_first_line_only(spark):
    text = "status: x\ntrace: see $1 \\ reasoning\ntrace: two"
    assert value(spark, traces.rewrite_field(F.col("t"), "trace", F.lit("new $1")), t=text) == "status: x\ntrace: new $1\ntrace: two"
    assert value(spark, traces.rewrite_field(F.col("t"), "trace", F.lit("new")), t="no such line") == "no such line"


def test_plain_cwe(spark):
    assert [value(spark, traces.plain_cwe(F.col("t")), t=t) for t in ("CWE‑79", "79", "cwe-22 (path)", "none")] == ["CWE-79", "CWE-79", "CWE-22", "none"]


def test_functions_of_null_and_empty_text(spark):
    for column in (T.field("fix", F.col("t")), T.scan_code(F.col("t")), T.norm_label(F.col("t")), T.approx_tokens(F.col("t")), T.identifiers(F.col("t"))):
        value(spark, column, t=None)
        value(spark, column, t="")
    assert value(spark, T.approx_tokens(F.col("t")), t=None) == 0
