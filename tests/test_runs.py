"""Runs that stop and go on: done-logs, resumable predictions, attempts, judges, templates."""

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import generation, prediction
from lodestrata.streaming import incremental

TARGETS = "k string, n int, batch int"


def test_targets_are_taken_once_even_if_they_fail(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0), ("a", 1, 0), ("b", 2, 0), (None, 3, 0)], TARGETS)
    log = f"{tmp_path}/log"

    def fails(todo):
        raise RuntimeError("the fetcher broke")

    with pytest.raises(RuntimeError):
        incremental.once_per_target(df.where("k = 'a'"), "k", log, fails)
    taken = incremental.once_per_target(df, "k", log, lambda todo: todo).collect()
    assert [(r["k"], r["n"]) for r in taken] == [("b", 2)]
    assert incremental.once_per_target(df, "k", log, lambda todo: todo).count() == 0
    assert incremental.once_per_target(df.limit(0), "k", f"{tmp_path}/other", lambda todo: todo).count() == 0


def test_predictions_go_on_where_they_stopped(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", f"p{i}") for i in range(40)] + [("k1", "p1"), (None, "p")], "key string, prompt string")
    path, stop = f"{tmp_path}/answers", f"{tmp_path}/stop"
    open(stop, "w").close()

    def model(prompts):
        import os

        if os.path.exists(stop) and "p7" in prompts:
            raise RuntimeError("out of memory")
        return [p.upper() for p in prompts]

    with pytest.raises(Exception, match="out of memory"):
        prediction.predict_resumable(df, model, path, parts=8).count()
    kept = spark.read.parquet(path).count()
    assert 0 < kept < 40  # the parts before the broken one are kept
    (tmp_path / "stop").unlink()
    got = {r["key"]: r["raw_text"] for r in prediction.predict_resumable(df, model, path, parts=8).collect()}
    assert got == {f"k{i}": f"P{i}" for i in range(40)} and spark.read.parquet(path).count() == 40


def test_judge_means(spark):
    rows = [("s1", 1, 'ok {"a": 4, "b": 1}'), ("s1", 2, '{"a": 2}'), ("s1", 3, '{"a": 100}'), ("s2", 1, "no object"), ("s2", 2, None), ("s3", 1, '{"a": null}')]
    df = spark.createDataFrame(rows, "shape string, ord int, reply string")
    got = {tuple(r) for r in prediction.judge_means(df, 2).collect()}
    assert got == {("s1", "a", 2, 3.0), ("s1", "b", 1, 1.0)}
    assert prediction.judge_means(df.limit(0), 2).count() == 0


def test_attempts(spark):
    tasks = spark.createDataFrame([(i, f"task {i}") for i in range(5)], "key int, prompt string")
    made = generation.attempts(
        tasks,
        lambda prompts: [str(p.count("was rejected")) for p in prompts],
        lambda df: df.withColumn("failed", F.when(F.col("raw_text").cast("int") >= F.col("key"), F.array().cast("array<string>")).otherwise(F.array(F.lit("localization")))),
        3,
    )
    got = {r["key"]: (r["attempt"], len(r["failed"])) for r in made.collect()}
    assert got == {0: (1, 0), 1: (2, 0), 2: (3, 0), 3: (3, 1), 4: (3, 1)}
    assert generation.inflated(300, 3, 50) == 950


def test_templates_and_examples(spark):
    one = spark.range(1)
    files = {"CALLER": (F.lit("a.py"), F.lit("call()")), "HELPER": (F.lit("b.py"), F.lit("def call(): pass"))}
    fields = {"status": F.lit("safe"), "cwe": F.lit(None).cast("string"), "fix": F.lit("")}
    text = one.select(generation.cross_file_answer(files, F.lit("why"), fields, F.array(F.lit("c.py"))).alias("t")).first()["t"]
    assert text.startswith('<<<CALLER_CODE file="a.py">>>\ncall()\n<<<END_CALLER_CODE>>>\n\n<<<HELPER_CODE file="b.py">>>')
    assert text.endswith("<think>\nwhy\n</think>\n\nstatus: safe\ncwe: none\nfix: none\nfollow_up_refs:\n  - c.py\n")
    examples = [{"note": "python, label=safe", "CODE": "x = 1", "OUTPUT": "status: safe"}]
    assert generation.exemplar_block("shape1", examples) == "" == generation.exemplar_block("shape1", [], True)
    block = generation.exemplar_block("shape1", examples, True)
    assert "this style of specificity" in block and "--- Example 1 (python, label=safe) ---" in block and "CODE:\nx = 1" in block and block.endswith("=== END EXEMPLARS ===\n")


def test_gauntlet_over_several_batches(spark, tmp_path):
    schema = "record_id long, messages array<struct<role string, content string>>, _meta struct<shape string, label string, cwes array<string>, ground_truth_cwe string>"
    folder = f"{tmp_path}/in"
    for ids in ((1, 2), (2, 3), (3,)):
        rows = [(i, [("assistant", "status: safe")], ("shape1", "context", [], None)) for i in ids]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(schema).parquet(folder)
        got = incremental.gauntlet(source, f"{tmp_path}/run")
    assert sorted(r["record_id"] for r in got.collect()) == [1, 2, 3]
