import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.operators import regions as R
from lodestrata.operators.alignment import align, located, regions
from lodestrata.operators.repair import concise_trace, normalize_safe, repair
from lodestrata.sources import patches

VULN = "def view(name):\n    path = join(base, name)\n    log(path)\n    return send_file(path)"
FIXED = "def view(name):\n    path = join(base, name)\n    log(path)\n    safe = confine(path)\n    return send_file(safe)"


def changed(spark, before, after):
    df = spark.createDataFrame([(1, before, after, "x", 2)], "k long, a string, b string, lines string, removed int")
    r = regions(df, "k", "a", "b").first()
    return r["lines"], r["identifiers"], r["source"]


def test_changed_line_and_identifier(spark):
    lines, names, source = changed(spark, VULN, FIXED)
    assert 4 in lines and "send_file" in names and source == "diff"


def test_pure_insertion_marks_its_neighbours(spark):
    lines, names, _ = changed(spark, "a = one\nb = two", "a = one\ncheck(value)\nb = two")
    assert lines == [1, 2] and "check" in names and "value" in names
    assert changed(spark, "a = one", "check(value)\na = one")[0] == [1]
    assert changed(spark, "a = one\r\nb = two\r\n", "a = one\nb = two\nlast(word)")[0] == [2]


def test_snippet_fix_falls_back_to_identifiers(spark):
    lines, names, _ = changed(spark, "alpha(beta)\ngamma(delta)\nepsilon(zeta)", "only(beta)")
    assert names == sorted({"alpha", "gamma", "delta", "epsilon", "zeta", "only"}) and lines == [1, 2, 3]


def test_equal_and_null_sides(spark):
    assert changed(spark, "a\nb", "a\nb") == ([], [], "none")
    assert changed(spark, None, "a") == ([], [], "none") == changed(spark, "a", None)
    assert changed(spark, "", "") == ([], [], "none") and changed(spark, "", "word(value)") == ([], ["value", "word"], "none")
    empty = spark.createDataFrame([], "k long, a string, b string")
    assert regions(empty, "k", "a", "b").count() == 0


def test_an_analyser_finds_what_a_fix_does_not_show(spark):
    rows = [(1, "alpha(beta)\ngamma()", "alpha(beta)\ngamma()", None, "python"), (2, "a(first)", "b(second)", "CWE-1", "python"), (3, "x()", None, "CWE-2", "go"), (4, "y()", None, None, None), (5, None, None, None, "python")]
    df = spark.createDataFrame(rows, "k long, a string, b string, cwe string, language string")
    got = {r["k"]: (r["lines"], r["source"], r["cwe"]) for r in located(df, "k", "a", "b", "cwe", "language", lambda codes: [[(1, "CWE-9"), (7, None)] for _ in codes]).collect()}
    assert got == {1: ([1], "analyser", "CWE-9"), 2: ([1], "diff", "CWE-1"), 3: ([], "none", "CWE-2"), 4: ([], "none", None), 5: ([], "none", None)}
    assert located(df, "k", "a", "b", "cwe", "language").where("source = 'none'").count() == 4


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
def test_alignment_rebuilds_the_new_side(old, new):
    removed, seams, added = align(old, new)
    kept = [line for i, line in enumerate(old, 1) if i not in removed]
    left = iter(new)
    assert all(line in left for line in kept)  # what has a partner stands in the new side in order
    assert seams == sorted(set(seams)) and all(0 <= s <= len(old) for s in seams) and (added or not seams)
    if not removed:
        assert len(new) == len(old) + len(added)


def repairs(spark, raws):
    df = spark.createDataFrame(list(enumerate(raws)), "k int, text string")
    return [r["text"] for r in repair(df, "k").orderBy("k").collect()]


def test_repair(spark):
    raw = "<think>See CVE-2020-1234 here. Then it flows.</think>\nstatus: safe\ncwe: 79\nseverity: HIGH\nline: 3\ntrace: a -> b. Since more\nfix: do"
    cases = {
        raw: "<think>\nThen it flows.\n</think>\n\nstatus: safe\ncwe: none\nseverity: none\nline: none\ntrace: a -> b\nfix: none",
        "status: confirmed\ncwe: 79": "status: confirmed\ncwe: CWE-79",
        "status: confirmed\ncwe: cwe‑89 (injection)": "status: confirmed\ncwe: CWE-89",
        "just prose": "just prose",
        None: None,
        "": "",
        "status: confirmed\ncwe: CWE-89\nfix: **Analysis** of it": "status: confirmed\ncwe: CWE-89\nfix: Use parameterized queries / prepared statements; never interpolate input into SQL.",
        "status: confirmed\ncwe: CWE-1\nfix:": "status: confirmed\ncwe: CWE-1\nfix: Validate/neutralize the untrusted input before it reaches the sink.",
        "status: confirmed\nfix: One.\nTwo.  Three.\nstatus: maybe": "status: maybe\nfix: One. Two.",
        "status: safe\ntrace: x": "status: safe\ncwe: none\ntrace: x",
        "<think>CVE-2020-1234</think>status: confirmed": "<think>\nthe relevant weakness\n</think>\n\nstatus: confirmed",
        "<think> </think>\nstatus: confirmed\ncwe: `CWE-7`": "status: confirmed\ncwe: CWE-7",
        "trace: only a trace": "trace: only a trace",
    }
    got = repairs(spark, list(cases))
    # a kept thought ends its block with a blank line only where the format has one
    assert [g and g.replace("</think>\n\n", "</think>\n") for g in got] == [c and c.replace("</think>\n\n", "</think>\n") for c in cases.values()]


def test_repair_is_idempotent_on_its_own_output(spark):
    thoughts = ["plain", "a. b. c", "", "CVE-2021-44228 alone", "x CVE-2021-44228. y", "ünï ´` *"]
    once = repairs(spark, [f"<think>{t}</think>\nstatus: confirmed\ncwe: CWE-89\ntrace: a -> b\nfix: Use bound parameters." for t in thoughts])
    assert repairs(spark, once) == once


def test_concise_trace(spark):
    from pyspark.sql import functions as F

    cases = {
        "the vulnerability is in `load(x)` because of a.b": "load(x) -> a.b",
        "a -> b, because it is bad": "a -> b",
        "uid → f-string → q → db.execute(q)": "uid → f-string → q → db.execute(q)",
        "--label` The vulnerability is primarily related to the handling of the `--label` argument in the `argparse.ParserArgument": "--label -> argparse.ParserArgument",
        "open(path) — which is bad": "open(path)",
        "due to nothing that is code. And so on": "due to nothing that is code",
        "short words; and more": "short words;",
        "": "",
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string").select(concise_trace(F.col("t")).alias("t"))
    assert [r["t"] for r in df.collect()] == list(cases.values())


def test_normalized_safe(spark):
    head = "<think>t\nstatus: x</think>"
    cases = {
        head + "\nstatus: confirmed\ncwe: CWE-79\nseverity: HIGH\ntrace: CWE-79 in `foo`\ndangling words\n\nmore\nfix: keep me\nfollow_up_refs:\n  - x": head
        + "\nstatus: safe\ncwe: none\nseverity: none\ntrace: no untrusted-input-to-sink data flow involving `foo`; code is safe\n\nfix: keep me\nfollow_up_refs:\n  - x",
        "trace: CWE-1 | a longer rest": "trace: a longer rest",
        "  Trace : CWE-XX": "  trace : no untrusted input reaches a dangerous sink; code is safe",
        "trace:": "trace:no untrusted input reaches a dangerous sink; code is safe",
        "trace: fine\ntail\nopen_refs:\n- y\nline: 3": "trace: fine\nopen_refs:\n- y\nline: none",
        "": "",
        None: None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "k int, text string")
    assert [r["text"] for r in normalize_safe(df, "k").orderBy("k").collect()] == list(cases.values())


def test_python_functions():
    code = "class A:\n    def outer(self):\n        '''Doc.'''\n        def inner():\n            return 1\n        return inner"
    found = R.functions_of(code)
    assert [(f[0], f[1], f[2], f[4]) for f in found] == [("outer", 2, 6, "Doc."), ("inner", 4, 5, None)]
    assert R.functions_of("def broken(:")[0][0] == "<module>"
    assert R.functions_of("def broken(:", whole_module=False) == [] and R.functions_of(None) == []


def test_defined_names_of_partial_code():
    assert R.defined_names("import os\ndef f(): pass") == (["f"], ["os"])
    assert R.defined_names("return 1") == ([], [])


PATCH = """From x
diff --git a/src/app.py b/src/app.py
index 1..2 100644
--- a/src/app.py
+++ b/src/app.py
@@ -1,4 +1,5 @@ def view
 def view(name):

-    return os.system(name)
+    check(name)
+    return run([name])
     # end
\\ No newline at end of file
-- 
2.1
diff --git a/tests/test_app.py b/tests/test_app.py
@@ -1 +1 @@
-a
+b
"""


def test_hunks_stop_at_their_line_counts():
    body = PATCH.split("diff --git ")[1]
    (old, new), = patches.hunks_of(body)
    assert old == "def view(name):\n\n    return os.system(name)\n    # end"
    assert new == "def view(name):\n\n    check(name)\n    return run([name])\n    # end"
    assert patches.hunks_of(None) == [] and patches.hunks_of("") == []


def test_patch_files_and_pairs(spark):
    df = spark.createDataFrame([("p", PATCH), ("q", None), ("r", "no diff")], "patch string, text string")
    files = patches.patch_files(df).collect()
    assert [f["new_path"] for f in files] == ["src/app.py", "tests/test_app.py"]
    padded = PATCH.replace("    # end", "    # " + "end " * 20)
    pairs = patches.fix_pairs(spark.createDataFrame([("p", padded)], "patch string, text string")).collect()
    assert [(p["new_path"], p["vuln_type"], p["language"]) for p in pairs] == [("src/app.py", "command_injection", "python")]
    sides = patches.flattened_sides(patches.patch_files(df)).where("new_path = 'src/app.py'").collect()
    assert {s["label"] for s in sides} == {"vuln", "safe"}


def test_hunks_rebuild_both_sides():
    random.seed(5)
    for _ in range(20):
        old = [f"line {random.randint(0, 9)}" for _ in range(random.randint(1, 9))]
        cut = random.randint(0, len(old))
        new = old[:cut] + ["added"] + old[cut:]
        body = f"@@ -1,{len(old)} +1,{len(new)} @@\n" + "\n".join([" " + x for x in old[:cut]] + ["+added"] + [" " + x for x in old[cut:]])
        assert patches.hunks_of(body) == [("\n".join(old), "\n".join(new))]


def test_grounded_trace(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "def f(user_id):\n    cursor.execute('SELECT ' + user_id)\n    return 1", "def f(user_id):\n    run(user_id)\n    return 1", "CWE-89"), (2, "x = 1", "x = 2", "CWE-89"), (3, None, None, None)], "k long, vuln_code string, fixed_code string, cwe string")
    got = {r["k"]: r for r in R.vulnerable_traces(df, "k").collect()}
    assert got[1]["ok"] and got[1]["sink"] == "cursor.execute" and got[1]["line"] == 2 and got[1]["source"] == "user_id"
    assert not got[2]["ok"] and not got[3]["ok"] and got[2]["trace"] is None
    assert "status: safe" in df.select(R.render_safe(F.col("cwe")).alias("t")).first()["t"]
