import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import shingles as S


def brute(text, k):
    words = re.findall(r"[a-z0-9_]+", text or "")
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab_1 .é\n", max_size=60)), max_size=8), st.integers(1, 5))
def test_set_sizes_equal_brute_force(texts, k):
    values, starts = S.shingle_sets(pa.array(texts, pa.string()), k)
    assert np.diff(starts).tolist() == [len(brute(t, k)) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abc ", max_size=40), st.text(alphabet="abc ", max_size=40)), min_size=1, max_size=6))
def test_overlaps_equal_brute_force(pairs):
    left, right = zip(*pairs, strict=True)
    common, union = S.pair_overlaps(pa.array(left), pa.array(right), 2)
    for i, (a, b) in enumerate(pairs):
        x, y = brute(a, 2), brute(b, 2)
        assert (common[i], union[i]) == (len(x & y), len(x | y))


def test_words_longer_than_a_block_and_sliced_arrays():
    long = "x" * (S._BLOCK + 5000) + " tail one two"
    array = pa.array(["skip me", long, None, "", long])[1:]
    values, starts = S.shingle_sets(array, 2)
    assert np.diff(starts).tolist() == [3, 0, 0, 3]
    assert values[:3].tolist() == values[3:].tolist()


def test_blocks_do_not_change_hashes():
    text = " ".join(f"word{i % 977}" for i in range(300_000))
    one, _ = S.shingle_sets(pa.array([text]), 3)
    half = S._BLOCK
    try:
        S._BLOCK = 1000
        two, _ = S.shingle_sets(pa.array([text]), 3)
    finally:
        S._BLOCK = half
    assert one.tolist() == two.tolist()


def test_fingerprints_tell_sets_apart():
    values, starts = S.shingle_sets(pa.array(["a b c", "c b a", "a b c a b c", "a b c", "", "a b"]), 2)
    a, b = S.fingerprints(values, starts)
    marks = list(zip(a.tolist(), b.tolist(), np.diff(starts).tolist(), strict=True))
    assert marks[0] == marks[3] and len(set(marks)) == 5


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:300]), " ".join(words[60:360])]
    values, starts = S.shingle_sets(pa.array(texts), 1)
    sig = S.minhash(values, starts, 512)
    assert abs((sig[0] == sig[1]).mean() - 240 / 360) < 0.08 and rng is not None


@pytest.mark.parametrize("limit", [1, 10, 10**6])
def test_slices_cover_the_batch(limit):
    batch = pa.record_batch({"text": pa.array(["aaaa", None, "bb", "", "cccccccc"]), "id": pa.array(range(5))})
    ids = [i for part in S.slices(batch, "text", limit) for i in part.column("id").to_pylist()]
    assert ids == list(range(5))
