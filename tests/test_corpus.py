import datetime

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.sources import corpus

SCHEMA = "task_no long, task_id string, code string, language string, label string, cwe string, source string, created_at timestamp, ingested_at timestamp"


@pytest.fixture()
def tables(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    late = datetime.datetime(2024, 3, 1)
    rows = [(1, "t1", "code a", " Python ", "SAFE\t", None, "s", day, day), (1, "t1", "code a", " Python ", "SAFE\t", None, "s", day, late), (2, "t2", None, None, None, None, None, day, day)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "shape1.parquet"))
    return str(tmp_path)


def test_redelivered_rows_count_once_and_keys_are_tidy(spark, tables):
    got = {r["task_no"]: r for r in corpus.tasks(spark, tables).collect()}
    assert len(got) == 2 and got[1]["language"] == "python" and got[1]["label"] == "safe" and got[2]["code"] is None


def test_mapped_and_per_row_merge_equal_results(spark, tables):
    mapped = corpus.mapped(spark, tables, "tasks", F.lit(True), F.length("code").alias("n"))
    assert sorted(map(tuple, mapped.collect()), key=str) == [(1, 6), (2, None)]
    query = corpus.per_row(lambda s, d: corpus.tasks(s, d).select("task_no", F.length("code").alias("n")))
    assert query(spark, tables).count() == 2
    assert corpus.tasks(spark, tables).count() == 2


def test_texts_are_not_exchanged_by_mapped(spark, tables):
    plan = corpus.mapped(spark, tables, "tasks", F.lit(True), T.normal_hash(F.col("code")).alias("h"))._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("\n")[0]
    assert top.startswith("Aggregate") and "code" not in top


def test_let_computes_its_value_for_the_body(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert [r["v"] for r in df.select(T.let(F.upper("t"), lambda x: F.concat(x, x)).alias("v")).collect()] == ["AA", None]


def test_staged_tables_are_read_back_and_cleared(spark):
    from lodestrata import staging

    df = staging.stage(spark.createDataFrame([(1, "a"), (2, None)], "id long, t string"))
    assert sorted(map(tuple, df.collect()), key=str) == [(1, "a"), (2, None)]
    empty = staging.stage(spark.createDataFrame([], "id long, t array<string>"))
    assert empty.count() == 0 and empty.schema.simpleString() == "struct<id:bigint,t:array<string>>"
    assert staging.clear(spark) and not staging.clear(spark)
