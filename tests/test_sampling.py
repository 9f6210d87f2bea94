from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import generation, metrics, sampling


def test_per_group_keeps_everything_small_and_caps_the_hot(spark):
    df = spark.createDataFrame([(i, "hot" if i < 300 else f"g{i}") for i in range(310)], "id long, g string")
    got = sampling.per_group(df, ["g"], ["id"], 3)
    assert got.where("g = 'hot'").count() == 3 and got.count() == 13 and got.columns == ["id", "g"]


def test_round_robin_takes_turns(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "c")], "id long, g string")
    assert [r["id"] for r in sampling.round_robin(df, "g", "id", 4).orderBy("turn", "id").collect()] == [1, 4, 5, 2]


def test_interleave_equals_the_greedy_rule(spark):
    order, safe, vuln = [], 0, 0
    for _ in range(400):
        if safe < 0.3 * (len(order) + 1) - 1e-12:
            order.append(("s", safe))
            safe += 1
        else:
            order.append(("v", vuln))
            vuln += 1
    df = spark.createDataFrame([(k, n) for k, n in order], "k string, n long")
    slots = df.select("k", "n", sampling.interleave_slot(F.col("n"), F.col("k") == "s").alias("slot")).collect()
    assert sorted((r["slot"], r["k"], r["n"]) for r in slots) == [(i, k, n) for i, (k, n) in enumerate(order)]


def test_budget_prefix_equals_running_sum(spark):
    sizes = [(i * 3, (i * 37) % 11 + 1) for i in range(500)]
    df = spark.createDataFrame(sizes, "id long, n long")
    for budget in (0, 1, 77, 1500, 10**6):
        run, expected = 0, set()
        for i, n in sizes:
            run += n
            if run <= budget:
                expected.add(i)
        assert {r["id"] for r in sampling.budget_prefix(df, "id", "n", budget, 16).collect()} == expected
        assert {r["id"] for r in sampling.budget_prefix(df, "id", "n", budget, 4, most_rows=2).collect()} == expected


def test_budget_prefix_with_nulls_and_one_value(spark):
    df = spark.createDataFrame([(7, 3, "x"), (None, 1, "y"), (8, None, "z"), (9, 5, None)], "id long, n long, _range string")
    assert {r["id"] for r in sampling.budget_prefix(df, "id", "n", 3, 2, most_rows=1).collect()} == {7, 8}
    same = spark.createDataFrame([(5, 1)] * 4, "id long, n long")
    assert sampling.budget_prefix(same, "id", "n", 4, 2, most_rows=1).count() == 4


def test_weighted_draws_are_exact_in_number_and_near_in_share(spark):
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("zero", 0.0)], "k string, w double")
    draws = spark.range(4000).select("id", T.hash_uniform("d", F.col("id")).alias("u"))
    got = {r["k"]: r["count"] for r in sampling.weighted_with_replacement(weights, "k", "w", draws, "u").groupBy("k").count().collect()}
    assert sum(got.values()) == 4000 and set(got) == {"a", "b"} and abs(got["b"] / 4000 - 0.75) < 0.03


def test_seeded_order_is_stable_under_growth(spark):
    order = lambda n: [r["id"] for r in spark.range(n).orderBy(T.hash_order("s", F.col("id"))).collect()]
    big = [i for i in order(200) if i < 100]
    assert big == order(100)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, g string, n long")
    assert sampling.per_group(df, ["g"], ["id"], 3).count() == 0
    assert sampling.round_robin(df, "g", "id", 4).count() == 0
    assert sampling.budget_prefix(df, "id", "n", 5).count() == 0


def test_metrics_identities(spark):
    df = spark.createDataFrame([("TP",), ("FP",), ("FN",), ("TN",), ("TN",), ("MISS",)], "outcome string")
    m = metrics.confusion(df).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"], m["miss"]) == (1, 1, 1, 2, 1)
    assert m["fpr"] == 1 / 3 and m["recall"] == m["precision"] == m["f1"] == 0.5
    none = metrics.confusion(df.limit(0)).first()
    assert none["recall"] == none["f1"] == 0.0


def test_compare_flags_regressions(spark):
    a = spark.createDataFrame([("s", "recall", 0.9), ("s", "fpr", 0.1), ("s", "gone", 1.0)], "shape string, metric string, value double")
    b = spark.createDataFrame([("s", "recall", 0.8), ("s", "fpr", 0.05), ("s", "new", 1.0)], "shape string, metric string, value double")
    got = {r["metric"]: r["direction"] for r in metrics.compare(a, b, ["shape"], ("fpr",)).collect()}
    assert got == {"recall": "-", "fpr": "+", "gone": "~", "new": "~"}


def test_gold_scores_perfectly_and_flipped_regresses(spark, small):
    from lodestrata.plans.catalog import QUERIES

    runs = {r["run"]: r for r in QUERIES["confusion_overall"](spark, small).collect()}
    assert runs["flipped"]["f1"] < runs["gold"]["f1"]


def test_best_candidate_and_correction(spark):
    df = spark.createDataFrame([(1, 0, "ab", 5.0), (1, 1, "cd", 5.0), (2, 0, "x", 1.0)], "task long, n int, text string, s double")
    assert sorted(map(tuple, generation.best_candidate(df, "task", F.col("s")).collect())) == [(1, "ab"), (2, "x")]
    text = spark.range(1).select(generation.correction_prompt(F.lit("p"), F.array(F.lit("cwe"), F.lit("odd"))).alias("t")).first()["t"]
    assert "give the true CWE" in text and "- odd" in text


def test_severities_are_compared_over_all_findings(spark, tmp_path):
    from lodestrata.plans.catalog import QUERIES
    from lodestrata.schemas import FINDING

    # ids of no third; a rise within a range, one between ranges, none at all, and a delivery twice
    ranks = [(1, "a", "HIGH"), (2, "a", "LOW"), (4, "a", "HIGH"), (4000, "b", "LOW"), (9001, "b", "HIGH"), (5, "c", "HIGH"), (4099, "c", " medium "), (8201, "c", "LOW"), (7, "d", None), (8, None, "LOW"), (4, "a", "HIGH")]
    rows = [(i, "s", "r", f, "u", 1, "confirmed", "CWE-1", s, "t", "f", "k") for i, f, s in ranks]
    spark.createDataFrame(rows, f"finding_id long, source string, owner_repo string, {FINDING}").write.parquet(f"{tmp_path}/findings.parquet")
    got = {r["file"]: (r["n"], r["falls"]) for r in QUERIES["severity_monotonic"](spark, str(tmp_path)).collect()}
    assert got == {"a": (3, False), "b": (2, False), "c": (3, True), "d": (1, True)}
