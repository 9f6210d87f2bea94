import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestrata.operators import dedup


def greedy(train, held_out, limit):
    """The rule stated as a loop over rows in order."""
    kept, out = set(), {}
    for i, h, n in sorted(train):
        if h in held_out:
            out[i] = "leak"
        elif h in kept:
            out[i] = "neardup"
        elif n > limit:
            out[i] = "overlength"
        else:
            kept.add(h)
            out[i] = "keep"
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.integers(1, 20)), max_size=25), st.sets(st.sampled_from("abcdef"), max_size=2))
def test_harden_equals_greedy_loop(spark, rows, held):
    train = [(i, h, n) for i, (h, n) in enumerate(rows)]
    df = spark.createDataFrame(train, "id long, h string, chars int")
    other = spark.createDataFrame([(h,) for h in held], "h string")
    got = {r["id"]: r["bucket"] for r in dedup.harden(df, other, "h", "id", "chars", 10).collect()}
    assert got == greedy(train, held, 10)


def test_harden_null_key_empty_and_repeated_columns(spark):
    df = spark.createDataFrame([(1, None, 5, "x"), (2, None, 50, "y")], "id long, h string, chars int, bucket2 string")
    empty = spark.createDataFrame([], "h string")
    got = {r["id"]: r["bucket"] for r in dedup.harden(df, empty, "h", "id", "chars", 10).collect()}
    assert got == {1: "keep", 2: "overlength"}
    assert dedup.harden(df.limit(0), empty, "h", "id", "chars", 10).count() == 0


def test_hardening_twice_changes_nothing(spark):
    random.seed(3)
    df = spark.createDataFrame([(i, random.choice("abc"), random.randint(1, 20)) for i in range(60)], "id long, h string, chars int")
    empty = spark.createDataFrame([], "h string")
    once = dedup.harden(df, empty, "h", "id", "chars", 10).where("bucket = 'keep'").drop("bucket")
    twice = dedup.harden(once, empty, "h", "id", "chars", 10)
    assert {r["bucket"] for r in twice.collect()} == {"keep"}


def test_first_by_key_ties_nulls_and_hot_key(spark, rows):
    data = [(i, "hot" if i % 3 else None) for i in range(90)] + [(100, "one")]
    df = spark.createDataFrame(data, "id long, k string")
    assert sorted(rows(dedup.first_by_key(df, "k", ["id"]))) == [(0, None), (1, "hot"), (100, "one")]


def test_contradictions_and_duplicates(spark, rows):
    df = spark.createDataFrame([(1, "a", "safe"), (2, "a", "vuln"), (3, "b", "safe"), (4, "b", "safe"), (5, "c", "context")], "id long, k string, label string")
    assert rows(dedup.contradictory_keys(df, "k", "label")) == [("a",)]
    assert sorted(r[1] for r in rows(dedup.without_contradictions(df, "k", "label"))) == [3, 4, 5]
    assert sorted(rows(dedup.duplicate_keys(df, "k"))) == [("a", 2), ("b", 2)]


def test_leak_and_its_complement_cover_the_training_rows(spark):
    train = spark.createDataFrame([(i, f"h{i % 7}") for i in range(50)], "id long, h string")
    held = spark.createDataFrame([("h1",), ("h1",), ("h3",)], "h string")
    assert dedup.leaked(train, held, "h").count() + dedup.not_leaked(train, held, "h").count() == 50
