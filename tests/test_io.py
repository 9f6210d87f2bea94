import json
import os

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import findings as O
from lodestrata.operators import prediction as P
from lodestrata.sources import readers, sinks, sniff
from lodestrata.streaming import incremental


def record(user, answer, **meta):
    return {"messages": [{"role": "user", "content": user}, {"role": "assistant", "content": answer}], "_meta": meta}


def test_jsonl_keeps_rejects_and_file_stem(spark, tmp_path):
    (tmp_path / "shape1_ts.jsonl").write_text(json.dumps(record("u", "a", shape="shape1")) + "\n\n{broken\n")
    rows, rejects = readers.records(spark, str(tmp_path / "*.jsonl"))
    assert [(r["shape"], r["_meta"]["shape"]) for r in rows.collect()] == [("shape1_ts", "shape1")]
    assert rejects.count() == 1
    strict, _ = readers.records(spark, str(tmp_path / "*.jsonl"), strict=True)
    with pytest.raises(Exception):
        strict.collect()


def test_either_format(spark, tmp_path):
    (tmp_path / "shape2.jsonl").write_text(json.dumps(record("u", "a", shape="shape2", cwes=["CWE-1"])) + "\n")
    (tmp_path / "flat.json").write_text(json.dumps({"id": "x", "shape": "shape2", "prompt": "u", "current_reasoning": "a"}) + "\n")
    a = readers.either_format(spark, pilot=str(tmp_path / "shape2.jsonl"))
    b = readers.either_format(spark, flat=str(tmp_path / "flat.json"))
    assert sorted(a.columns) == sorted(b.columns) and a.first()["cwe"] == "CWE-1" and b.first()["prompt"] == "u"
    with pytest.raises(ValueError):
        readers.either_format(spark)


def test_csv_with_quoted_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('vulnerable_code,fixed_code,language,vulnerability_type\n"' + "x = ""1""\n" * 12 + '","y = 2",Python,SQL Injection (blind)\n,z,c,none\n')
    got = readers.fix_pair_csv(spark, str(tmp_path / "a.csv")).collect()
    assert len(got) == 1 and got[0]["cwe"] == "CWE-89" and got[0]["language"] == "python" and "\n" in got[0]["vuln_code"]


def test_source_trees(spark, tmp_path):
    for name in ("src/a.py", "src/tests/b.py", "src/test_c.py", "src/d.js"):
        path = tmp_path / "lib" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("def f():\n    return 1\n" * 10)
    tree = readers.source_tree(spark, str(tmp_path / "lib"))
    assert [os.path.basename(r["path"]) for r in tree.collect()] == ["a.py"]
    assert {r["language"] for r in readers.scan_targets(spark, str(tmp_path / "lib")).collect()} == {"python", "javascript"}


def test_paired_files(spark, tmp_path):
    for side, name in (("before", "x.js"), ("after", "x.js"), ("before", "only.js")):
        path = tmp_path / "bucket1" / side / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(side)
    assert [tuple(r) for r in readers.paired_files(spark, str(tmp_path)).collect()] == [("bucket1", "x.js", "before", "after")]


def test_answers_with_fixed_code_and_tagged_union(spark):
    code = "cursor.execute('SELECT ' + x)  " + "#" * 60
    rows = spark.createDataFrame(
        [([("user", f"<SCAN>\n{code}\n</SCAN>"), ("assistant", "Vulnerability detected.\nFixed code:\nsafe(x)")],), ([("user", "u"), ("assistant", "fine")],)],
        "messages array<struct<role:string,content:string>>",
    )
    pairs = readers.fixed_code_answers(rows)
    assert [(r["fixed_code"]) for r in pairs.collect()] == ["safe(x)"]
    tagged = readers.tagged_union(pairs).first()
    assert (tagged["vuln_type"], tagged["cwe"]) == ("sql_injection", "CWE-89")


def test_reasoning_dataset(spark):
    df = spark.createDataFrame(
        [("f()", "py", 1, ["cwe79"], None, "<thinking>The value reaches the page without any escape.</thinking>", "bad"), ("g()", "js", 0, [], None, None, None)],
        "function string, lang string, vulnerable bigint, cwe_id array<string>, cve_id string, positive_reasoning string, negative_reasoning string",
    )
    vuln, safe = readers.reasoning_dataset(df).orderBy("code").collect()
    assert "cwe: CWE-79" in vuln["answer"] and "severity: HIGH" in vuln["answer"] and vuln["language"] == "python" and vuln["bad_reasoning"] == "bad"
    assert "status: safe" in safe["answer"] and safe["bad_reasoning"] is None


def test_append_new_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string")
    path = str(tmp_path / "out")
    assert sinks.append_new(df, path, "id") == 2
    assert sinks.append_new(df.union(spark.createDataFrame([(3, "c")], df.schema)), path, "id") == 1
    assert spark.read.parquet(path).count() == 3


def test_versions_and_routes(spark, tmp_path):
    df = spark.createDataFrame([(1, "clean"), (2, "quarantine")], "id long, disposition string")
    first, second = sinks.new_version(df, str(tmp_path / "t")), sinks.new_version(df, str(tmp_path / "t"))
    assert first.endswith("v00001") and second.endswith("v00002")
    sinks.route(df, str(tmp_path / "r"), "disposition")
    assert {p for p in os.listdir(tmp_path / "r") if "=" in p} == {"disposition=clean", "disposition=quarantine"}


def test_run_document_and_texts(spark):
    metrics = spark.createDataFrame([("shape1", "recall", 0.5)], "shape string, metric string, value double")
    assert json.loads(sinks.run_document(metrics, "x"))["layer1"] == {"shape1": {"recall": 0.5}}
    assert "recall" in sinks.dashboard(metrics, "run")
    issues = spark.createDataFrame([("a", i) for i in range(5)], "issue string, id long")
    report = sinks.audit_report(issues, "id", most=3).first()
    assert report["n"] == 5 and json.loads(report["ids"]) == [0, 1, 2]


FINDINGS = "finding_id long, file string, unit string, line int, status string, cwe string, severity string, trace string, fix string, think string, owner_repo string"


def test_sarif_round_trip(spark):
    df = spark.createDataFrame(
        [(1, "a\\b.py", "f", 0, "confirmed", "CWE-89", "HIGH", "x -> y", "bind it", "why", "o"), (2, "c.py", None, None, "confirmed", "CWE-89", None, None, "none", None, "o")], FINDINGS
    )
    document = json.loads(O.sarif_document(df).first()["document"])
    run = document["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["CWE-89"] and len(run["results"]) == 2
    first = run["results"][0]
    assert first["level"] == "error" and first["message"]["text"].endswith("Fix: bind it")
    assert first["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "a/b.py"}, "region": {"startLine": 1}}
    assert "a\\b.py" not in json.dumps(run["results"][0]) and "x -> y" in sinks.pretty_findings(df, explain=True)


def test_sarif_flows(spark):
    step = lambda uri, line: {"location": {"message": {"text": "m"}, "physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": line}}}}
    flow = lambda *steps: {"codeFlows": [{"threadFlows": [{"locations": list(steps)}]}]}
    document = {
        "runs": [
            {
                "tool": {"driver": {"rules": [{"id": "r1", "properties": {"tags": ["external/cwe/cwe-022"]}}]}},
                "results": [{"ruleId": "r1", **flow(step("x/a.py", 1), step("b.py", 2))}, {"ruleId": "r1", **flow(step("a.py", 1), step("a.py", 2))}, {"ruleId": "none", **flow(step("a.py", 1), step("c.py", 9))}],
            }
        ]
    }
    df = spark.createDataFrame([(json.dumps(document),), ("not json",), (None,)], "text string")
    flows = O.sarif_flows(df)
    assert sorted(r["cwe"] for r in flows.collect()) == ["CWE-20", "CWE-22"]
    trace = O.flow_trace(flows).where("cwe = 'CWE-22'").first()
    assert trace["trace"] == "a.py:1 -> b.py:2" and "[Source — a.py:1]" in trace["think"] and trace["files"] == 2


def test_sniffed_roles(spark):
    df = spark.createDataFrame([(1, "v1", "", "f", "d" * 60)], "id long, vulnerable_code string, bad_input string, fixed string, message string")
    got = sniff.resolve(df, {"vuln": ("vuln", "bad"), "fixed": ("fix",), "none": ("zzz",)}, keep=("id",)).first()
    assert tuple(got) == (1, "v1", "f", None)
    assert df.select(sniff.long_text_columns(df).alias("v")).first()["v"] == ["d" * 60]


def test_predict_uses_the_cache_of_its_own_predictor(spark):
    prompts = spark.createDataFrame([("k1", "p1"), ("k2", "p2")], "key string, prompt string")
    cached = spark.createDataFrame([("k1", "old"), ("other", "x")], "key string, raw_text string")
    got = dict(map(tuple, P.predict(prompts, lambda texts: [t.upper() for t in texts], cached).collect()))
    assert got == {"k1": "old", "k2": "P2"}
    keys = spark.range(1).select(P.cache_key("a", F.lit("s"), F.lit("u")).alias("a"), P.cache_key("b", F.lit("s"), F.lit("u")).alias("b")).first()
    assert keys["a"] != keys["b"]


def test_parsers_by_shape(spark):
    from tests.test_quality import SYNTHESIS

    df = spark.createDataFrame([("shape2", "status: needs_context\nopen_refs:\n  - a\n  - b"), ("shape4", SYNTHESIS), ("shape3_new", "status: safe.")], "shape string, t string")
    got = {r["shape"]: r["p"] for r in df.select("shape", P.parsed(F.col("shape"), F.col("t")).alias("p")).collect()}
    assert got["shape2"]["shape2"]["open_refs"] == ["a", "b"] and got["shape2"]["shape1"] is None
    assert got["shape4"]["shape4"]["executive_summary"] == "two issues" and got["shape4"]["shape4"]["systemic"] == ["one"]
    assert got["shape3_new"]["shape1"]["status"] == "safe"
    score = df.where("shape = 'shape4'").select(P.synthesis_scores(F.col("t"), F.lit("SQL injection in login; Weak hash in a_v2.py")).alias("s")).first()["s"]
    assert score["well_formed"] and score["severity_falls"] and score["titles_known"] and not score["duplicates_noted"]


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    schema = "id long, k string"
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], schema).write.parquet(source)
    read = lambda: spark.readStream.schema(schema).parquet(source)
    assert incremental.first_seen(read(), "k", folder).count() == 2
    spark.createDataFrame([(4, "b"), (5, "c")], schema).write.mode("append").parquet(source)
    assert sorted(r["k"] for r in incremental.first_seen(read(), "k", folder).collect()) == ["a", "b", "c"]
