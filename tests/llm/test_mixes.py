import random
from math import isclose, log

from pyspark.sql import functions as F

from lodestrata.llm import mixing, quota, target_sample
from lodestrata.llm.catalog import ORACLES, QUERIES
from tests.helpers import both

import pytest


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_oracle(name, spark, small, duck):
    columns, expected_columns, got, expected = both(QUERIES[name], ORACLES[name], spark, small, duck)
    assert columns == expected_columns and got == expected


@pytest.mark.parametrize("wanted", [0, 1, 7, 499, 500, 900])
def test_quota_is_exact_and_takes_the_least(spark, wanted):
    rows = [(i, "g" if i < 500 else None, (i * 7919 % 1000) / 1000.0) for i in range(520)]
    df = spark.createDataFrame(rows, "id long, k string, u double").where("k is not null").withColumn("group_rows", F.lit(500)).withColumn("quota", F.lit(wanted))
    per, quota.PER_BUCKET = quota.PER_BUCKET, 16
    try:
        got = quota.take_quota(df, ["k"]).collect()
    finally:
        quota.PER_BUCKET = per
    expected = sorted((u, i) for i, k, u in rows if k)[:wanted]
    assert sorted((r["u"], r["id"]) for r in got) == expected


def requests(spark):
    rows = [("r", i, "big") for i in range(3000)] + [("r", i, "small") for i in range(3000, 3005)] + [("r", 9000, None), ("r", 5, "big"), ("r", 9001, "other")]
    targets = [("r", "big", 0.7, 10, 200), ("r", "small", 0.2, 10, 200), ("r", "gone", 0.1, 3, 200)]
    return (
        spark.createDataFrame(rows, "request string, id long, category string"),
        spark.createDataFrame(targets, "request string, category string, target_share double, min_rows long, sample_rows long"),
    )


def test_target_sample(spark):
    rows, targets = requests(spark)
    report = {r["category"]: r for r in target_sample.category_report(rows, targets).collect()}
    assert report["big"]["observed"] == 3000 and not report["big"]["short"] and report["big"]["quota"] == 140
    assert report["small"]["short"] and report["small"]["deficit"] == 35 and report["small"]["quota"] == 5
    assert report["gone"]["observed"] == 0 and report["gone"]["short"]
    got = target_sample.draw(rows, targets).collect()
    count = {c: sum(r["category"] == c for r in got) for c in ("big", "small", "gone", "other")}
    assert count == {"big": 140, "small": 5, "gone": 0, "other": 0} and len({r["id"] for r in got}) == 145
    assert sorted(map(tuple, got)) == sorted(map(tuple, target_sample.draw(rows, targets).collect()))
    assert target_sample.draw(rows.limit(0), targets).count() == 0 and target_sample.draw(rows, targets.limit(0)).count() == 0


def test_quotas_do_not_exceed_the_sample(spark):
    rows = spark.createDataFrame([("r", i, f"c{i % 10}") for i in range(2000)], "request string, id long, category string")
    shares = [0.82] + [0.02] * 9
    targets = spark.createDataFrame([("r", f"c{i}", s, 12, 100) for i, s in enumerate(shares)], "request string, category string, target_share double, min_rows long, sample_rows long")
    fitted = {r["category"]: r["quota"] for r in target_sample.fitted_quotas(target_sample.category_report(rows, targets)).collect()}
    assert all(q >= 12 for q in fitted.values()) and sum(fitted.values()) == 120  # minimums alone need 120
    roomy = spark.createDataFrame([("r", f"c{i}", s, 1, 100) for i, s in enumerate([0.55] + [0.05] * 9)], "request string, category string, target_share double, min_rows long, sample_rows long")
    assert sum(r["quota"] for r in target_sample.fitted_quotas(target_sample.category_report(rows, roomy)).collect()) == 100


def test_chance_shortage_is_made_good(spark):
    slack = target_sample.SLACK_SHARE, target_sample.SLACK_ROWS
    rows, targets = requests(spark)
    try:
        target_sample.SLACK_SHARE, target_sample.SLACK_ROWS = 0.0, -120.0  # far too few are accepted at first
        assert target_sample.draw(rows, targets).count() == 145
    finally:
        target_sample.SLACK_SHARE, target_sample.SLACK_ROWS = slack


def test_temperature():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    assert mixing.tempered(shares, 1.0) == pytest.approx(shares)
    assert mixing.tempered(shares, 0.0) == pytest.approx({s: 1 / 3 for s in shares})
    goal = 0.9
    x = mixing.bisect_exponent(shares, target_entropy=goal)
    assert isclose(mixing.entropy(mixing.tempered(shares, x)), goal, abs_tol=1e-6)
    sizes = {"a": 700.0, "b": 200.0, "c": 100.0}
    y = mixing.bisect_exponent(shares, budget=1000.0, sizes=sizes, most_repeats={"a": 1, "b": 2, "c": 2})
    weights = mixing.tempered(shares, y)
    assert all(weights[s] * 1000 <= sizes[s] * {"a": 1, "b": 2, "c": 2}[s] + 1e-6 for s in sizes) and 0 < y < 1
    assert mixing.bisect_exponent({}, target_entropy=log(2)) == 1.0 and mixing.tempered({"a": 0.0}, 1.0) == {"a": 0.0}


def test_exponents_beyond_any_fixed_bracket():
    shares = {"a": 0.3334, "b": 0.3333, "c": 0.3333}
    x = mixing.bisect_exponent(shares, target_entropy=0.5)
    assert x > 1000 and isclose(mixing.entropy(mixing.tempered(shares, x)), 0.5, abs_tol=1e-6)
    ties = {"a": 0.5, "b": 0.5}
    assert mixing.entropy(mixing.tempered(ties, mixing.bisect_exponent(ties, target_entropy=0.1))) == pytest.approx(log(2))  # cannot be met


def test_fitted_weights_keep_the_limits():
    sources = {"a": mixing.Source(0.4, 2, 8000, 80), "b": mixing.Source(0.3, 2, 1500, 15), "c": mixing.Source(0.3, 2, 500, 5)}
    alpha, beta, gamma, shares, weights = mixing.fit(sources, 60)
    assert gamma == max(alpha, beta) and all(weights[s] * 6000 <= v.tokens * v.most_repeats + 1e-6 for s, v in sources.items())
    roomy = {s: mixing.Source(v.share, 100, v.tokens, v.rows) for s, v in sources.items()}
    alpha, beta, gamma, shares, weights = mixing.fit(roomy, 60)
    assert gamma == alpha and isclose(mixing.entropy(weights), mixing.entropy({s: v.share for s, v in roomy.items()}), abs_tol=1e-6)


def test_short_sources_are_those_of_the_definition(spark):
    rng = random.Random(3)
    rows, targets = [], []
    for m in range(12):
        for s in "abcd":
            have, share, repeats = rng.randint(0, 12), rng.choice([0.0, 0.1, 0.25, 0.26, 0.4]), rng.randint(1, 4)
            rows += [(f"m{m}", 100 * ord(s) + i, s) for i in range(have)] * rng.randint(1, 2)
            targets.append((f"m{m}", s, share, repeats, rng.choice([40, 41, 100])))
    df = spark.createDataFrame(rows, "mix string, id long, source string")
    asked = spark.createDataFrame(targets, "mix string, source string, target_share double, max_repeats long, total_rows long")
    expected = {(m, s) for m, s, share, repeats, total in targets if len({r for r in rows if r[0] == m and r[2] == s}) * repeats < share * total}
    assert {(r["mix"], r["source"]) for r in mixing.short_sources(df, asked).collect()} == expected
    assert mixing.short_sources(df.limit(0), asked.limit(0)).count() == 0


def test_mix_budgets_and_repeats(spark):
    rows = [("m", i, "big") for i in range(500)] + [("m", 1000 + i, "few") for i in range(10)] + [("m", 3, "big"), ("m", 77, None), ("m", 78, "unasked")]
    df = spark.createDataFrame(rows, "mix string, id long, source string")
    targets = spark.createDataFrame(
        [("m", "big", 0.5, 3, 400), ("m", "few", 0.45, 4, 400), ("m", "none", 0.05, 2, 400), ("m", "zero", 0.0, 2, 400)],
        "mix string, source string, target_share double, max_repeats long, total_rows long",
    )
    report = {r["source"]: r for r in mixing.mix_report(df, targets).collect()}
    assert report["few"]["short"] and report["none"]["short"] and not report["big"]["short"] and not report["zero"]["short"]
    got = mixing.mix(df, targets).collect()
    uses = {}
    for r in got:
        uses[r["source"], r["id"]] = uses.get((r["source"], r["id"]), 0) + 1
        assert 0 <= r["position"] <= 1
    assert sum(v for (s, _), v in uses.items() if s == "big") == 200 and max(v for (s, _), v in uses.items() if s == "big") == 1
    assert sorted(v for (s, _), v in uses.items() if s == "few") == [4] * 10
    shares = {r["source"]: r for r in mixing.actual_shares(mixing.mix(df, targets), targets).collect()}
    assert shares["big"]["rows"] == 200 and shares["none"]["rows"] == 0 and isclose(shares["big"]["share"], 200 / 240)
    assert mixing.mix(df.limit(0), targets).count() == 0


def test_partial_blocks_use_rows_evenly(spark):
    df = spark.createDataFrame([("m", i, "s") for i in range(30)], "mix string, id long, source string")
    targets = spark.createDataFrame([("m", "s", 1.0, 5, 100)], "mix string, source string, target_share double, max_repeats long, total_rows long")
    uses = {}
    for r in mixing.mix(df, targets).collect():
        uses[r["id"]] = uses.get(r["id"], 0) + 1
    assert sum(uses.values()) == 100 and sorted(set(uses.values())) == [3, 4] and len(uses) == 30


def test_mix_queries(spark, small):
    wanted = {(r["mix"], r["source"]): r for r in QUERIES["p7_report"](spark, small).collect()}
    assert wanted and all(r["most_uses"] <= r["max_repeats"] for r in wanted.values())
    assert QUERIES["p7_temperature"](spark, small).count() == len(wanted)
    for r in QUERIES["p7_tempered_report"](spark, small).collect():
        assert abs(r["rows"] - min(r["rows_wanted"], r["available"] * r["max_repeats"])) <= 1 and r["most_uses"] <= r["max_repeats"]
    short = {(r["request"], r["category"]) for r in QUERIES["p1_found"](spark, small).collect()}
    assert short == {(r["request"], r["category"]) for r in QUERIES["p1_report"](spark, small).where("short").collect()}
    report = {(r["request"], r["category"]): r["quota"] for r in QUERIES["p1_report"](spark, small).collect()}
    sample = {(r["request"], r["category"]): r["count"] for r in QUERIES["p1_sample"](spark, small).groupBy("request", "category").count().collect()}
    assert sample == {k: v for k, v in report.items() if v}


def test_temperature_counts_what_a_mix_admits(spark, tmp_path):
    text = lambda n: " ".join(["word"] * n)
    said = lambda *ns: [("system user assistant".split()[i % 3], text(n)) for i, n in enumerate(ns)]
    rows = [(1, said(5, 20, 5), ("one", " A ")), (1, said(5, 20, 5), ("one", " A ")), (2, said(10), ("one", "b")), (3, said(500, 500), ("two", "b")), (4, None, ("one", "b")), (5, said(70), ("one", None))]
    spark.createDataFrame(rows, "record_id long, messages array<struct<role string, content string>>, _meta struct<shape string, source string>").write.parquet(f"{tmp_path}/pilot_records.parquet")
    targets = [("m", "one", "a", 0.5, 1, 2), ("m", "one", "b", 0.5, 1, 2), ("all", None, "a", 0.5, 1, 2), ("all", None, "b", 0.5, 1, 2)]
    spark.createDataFrame(targets, "mix string, shape string, source string, target_share double, max_repeats long, total_rows long").write.parquet(f"{tmp_path}/mix_targets.parquet")
    got = {(r["mix"], r["source"]): r for r in QUERIES["p7_temperature"](spark, str(tmp_path)).collect()}
    assert {k: round(r["token_share"], 6) for k, r in got.items()} == {("m", "a"): 0.75, ("m", "b"): 0.25, ("all", "a"): round(30 / 1040, 6), ("all", "b"): round(1010 / 1040, 6)}
    # mix m: 40 tokens in 3 records, so 2 rows need 80 / 3; source b gives at most 10 of them
    assert isclose(got["m", "b"]["limit_weight"] * 80 / 3, 10, rel_tol=1e-6)
