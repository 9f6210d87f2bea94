import random
from collections import defaultdict

import pytest

from lodestrata.llm.catalog import QUERIES
from lodestrata.llm.components import connected_components
from lodestrata.llm.near_duplicates import expand, least_matches, miss_rate, near_duplicate_groups, near_duplicate_pairs
from lodestrata.llm.split_overlap import cross_split_pairs, shingle_order
from tests.llm.test_shingles import brute


def near(sets, keys, numerator=6, denominator=10):
    out = set()
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if common * denominator >= numerator * len(sets[a] | sets[b]):
                    out.add((a, b))
    return out


def edited(rng, n):
    words = [f"w{rng.randint(0, 300)}" for _ in range(40)]
    base, out = list(words), []
    for i in range(n):
        if i % 4 == 0:
            base = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(3, 60))]
        text = list(base)
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(len(text))] = f"w{rng.randint(0, 300)}"
        out.append(" ".join(text))
    return out


ODD = [None, "", "   ", "two words", "A b C", "a B c"]


def test_near_duplicates_equal_brute_force(spark):
    texts = edited(random.Random(7), 120) + ODD
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "again")]
    df = spark.createDataFrame(rows, "id long, text string, rep string")
    pairs, members = near_duplicate_pairs(df, k=3, threshold=0.6)
    got = sorted(map(tuple, expand(pairs, members).collect()))
    sets = {i: brute((t or "").lower(), 3) for i, t in enumerate(texts)}
    assert got == sorted(near(sets, list(sets)))


@pytest.mark.parametrize("hot", [3, 10**6])
def test_hot_bands_lose_nothing(spark, hot):
    rng = random.Random(11)
    head = " ".join(f"licence{i}" for i in range(40))
    texts = [head + " " + " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 60))) for _ in range(60)]
    texts += [t.replace("w1", "v1", 2) for t in texts[:20]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pairs, members = near_duplicate_pairs(df, k=3, threshold=0.6, hot=hot)
    sets = {i: brute(t, 3) for i, t in enumerate(texts)}
    assert sorted(map(tuple, expand(pairs, members).collect())) == sorted(near(sets, list(sets)))


def test_pruning_misses_what_is_said():
    assert round(miss_rate(0.6, least_matches(0.6, 128, 32, 1e-4)), 6) <= 3e-4 and miss_rate(0.8, least_matches(0.6, 128, 32, 1e-4)) < 1e-8


def test_hot_group_of_copies_and_groups(spark):
    rows = [(i, "one two three four five six") for i in range(200)] + [(300 + i, t) for i, t in enumerate(edited(random.Random(1), 40))]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: r for r in near_duplicate_groups(df, k=3, threshold=0.6).collect()}
    assert len(got) == 240 and {got[i]["class_id"] for i in range(200)} == {0} and got[5]["links"] == 0
    sets = {i: brute(t, 3) for i, t in rows}
    for a, b in near(sets, [i for i in sets if i >= 300]):
        assert got[a]["class_id"] == got[b]["class_id"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, text string, indexed boolean")
    pairs, members = near_duplicate_pairs(empty)
    assert pairs.count() == 0 and members.count() == 0
    pairs, members = cross_split_pairs(empty)
    assert pairs.count() == 0 and members.count() == 0
    assert near_duplicate_groups(empty).count() == 0


def test_bayesian_limits_keep_true_pairs():
    for n, least in least_matches(0.6, 128, 32, 1e-4):
        assert 0 < least < 0.6 * n
    with pytest.raises(ValueError):
        near_duplicate_pairs(None, bands=50, rows=3, hashes=128)


@pytest.mark.parametrize("most,bits", [(4, 8), (0, 6), (1 << 20, 26)])
def test_cross_split_pairs_equal_brute_force(spark, most, bits):
    texts = edited(random.Random(3), 100) + ODD
    side = [i % 3 == 0 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, s, 1) for i, (t, s) in enumerate(zip(texts, side, strict=True))] + [(0, texts[0], True, 2)], "id long, text string, indexed boolean, size int")
    pairs, members = cross_split_pairs(df, 3, 0.6, most, bits)
    of = defaultdict(set)
    for r in members.collect():
        of[r["rep"], r["indexed"]].add(r["id"])
    got = {tuple(sorted((a, b))) for r in pairs.collect() for a in of[r["rep_a"], True] for b in of[r["rep_b"], False]}
    sets = {i: brute((t or "").lower(), 3) for i, t in enumerate(texts)}
    assert got == {p for p in near(sets, list(sets)) if side[p[0]] != side[p[1]]}


def test_order_counts_exactly(spark):
    import numpy as np

    texts = ["a b c d", "a b c d", "a b c", "x y z", None, "b c d"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    from lodestrata.llm.shingles import shingle_sets
    import pyarrow as pa

    order = shingle_order(df, 3, 2, 10)
    values = [shingle_sets(pa.array([t]), 3)[0][0] for t in ("a b c", "b c d", "x y z")]
    assert list(order.of(np.array(values, dtype=np.uint64))) == [3, 3, 1] and len(order.frequent) == 2
    assert not len(shingle_order(df, 3, 1, 10).frequent) and not shingle_order(df.limit(0), 3).bitmap.any()


def test_components_of_chains_cycles_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    df = spark.createDataFrame(chain + [(1, 2), (2, 3), (3, 1), (1, 2), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(df).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in (1, 2, 3)} == {1} and 7 not in got
    assert connected_components(df.limit(0)).count() == 0


def test_queries_on_the_small_tables(spark, small):
    found = {tuple(r) for r in QUERIES["p6_found"](spark, small).collect()}
    groups = {(r["origin"], r["row_id"]): r["class_id"] for r in QUERIES["p6_groups"](spark, small).collect()}
    assert all(groups[o, a] == groups[o, b] for o, a, b in found)
    pairs = {tuple(r) for r in QUERIES["p5_found"](spark, small).collect()}
    report = QUERIES["p5_report"](spark, small).agg({"train_links": "sum"}).first()[0]
    assert report == len(pairs)
