"""Problem 6: near-duplicate records with small edits.

Sequential Bayesian verification of banded min-hash candidates: every class of
equal shingle sets gets one signature; classes that agree in a band are
candidates; a candidate's signatures are compared batch by batch and it is
dropped as soon as the posterior probability that its similarity reaches the
threshold falls under the chosen miss probability; survivors are verified
exactly on their texts.

A band key that very many classes share (a licence text at the head of every
file) would make all of them candidates of each other. The classes under such
hot keys leave the bands of these keys and meet in an exact prefix-filter join
instead, ordered so that what they have in common comes last: a pair that
shares a hot key is found there for certain if it reaches the threshold.

Misses: a pair of similarity s shares no band with probability
(1 - s**rows)**bands, which for the defaults is under 0.001 at s = 0.6 and
1e-9 at 0.8. Pruning drops a pair when, after a batch, the posterior
probability that it reaches the threshold is below ``miss``; over the
sequence of batches a pair of similarity exactly at the threshold is dropped
with the probability that ``miss_rate`` gives (2.7e-4 for 0.6).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.components import connected_components
from lodestrata.llm.shingles import fingerprints, minhash, mix, shingle_sets, slices
from lodestrata.llm.split_overlap import prefix_candidates, prefix_tokens, prefixes, shingle_order, sizes_fit, verified
from lodestrata.staging import stage

HASHES, BANDS, ROWS, BATCH, MISS = 128, 32, 3, 32, 1e-4
#: Classes under a band key beyond which the key is hot, and the number of such keys that are looked for.
HOT, HOT_KEYS = 2000, 2000


def least_matches(threshold: float, hashes: int, batch: int, miss: float) -> list[tuple[int, int]]:
    """(n, m) for each batch: under m matches among the first n hashes a pair is dropped.

    With a uniform prior, P(similarity >= t | m of n match) is the upper tail
    of Beta(m + 1, n - m + 1), a binomial sum.
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        tail = 0.0
        for m in range(n + 1):  # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                out.append((n, m))
                break
    return out


def miss_rate(threshold: float, tests: list[tuple[int, int]]) -> float:
    """Probability that the batches drop a pair of exactly this similarity, for independent hashes."""
    alive, done, dropped = {0: 1.0}, 0, 0.0
    for n, least in tests:
        step: dict[int, float] = {}
        for m, p in alive.items():
            for more in range(n - done + 1):
                step[m + more] = step.get(m + more, 0.0) + p * comb(n - done, more) * threshold**more * (1 - threshold) ** (n - done - more)
        dropped += sum(p for m, p in step.items() if m < least)
        alive, done = {m: p for m, p in step.items() if m >= least}, n
    return dropped


def _signatures(k: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                values, starts = shingle_sets(part.column("text"), k)
                sizes = np.diff(starts)
                full = np.flatnonzero(sizes > 0)
                a, b = fingerprints(values, starts)
                # 16 bits a hash: a chance match of 1 in 65536 only keeps a pair a little longer
                short = (minhash(values, starts, hashes) & np.uint32(0xFFFF)).astype(np.uint16)
                yield pa.record_batch(
                    {
                        "id": part.column("id").take(pa.array(full)),
                        "size": pa.array(sizes[full].astype(np.int32)),
                        "mark_a": pa.array(a[full]),
                        "mark_b": pa.array(b[full]),
                        "signature": pa.array([row.tobytes() for row in short], type=pa.binary()),
                    }
                )

    return run


def _matrix(column: pa.Array, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, hashes)


def _band_keys(hashes: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                grid = _matrix(part.column("signature"), hashes).astype(np.uint64)
                keys = np.empty((len(grid), bands), dtype=np.int64)
                for band in range(bands):
                    key = np.full(len(grid), band + 1, dtype=np.uint64)
                    for j in range(band * rows, band * rows + rows):
                        key = key * np.uint64(0x9E3779B97F4A7C15) + grid[:, j]
                    keys[:, band] = mix(key).view(np.int64)
                yield pa.record_batch(
                    {
                        "key": pa.array(keys.ravel()),
                        "rep": pa.array(np.repeat(part.column("rep").to_numpy(), bands)),
                        "size": pa.array(np.repeat(part.column("size").to_numpy(), bands)),
                    }
                )

    return run


def _prune(hashes: int, tests: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _matrix(batch.column("sig_a"), hashes), _matrix(batch.column("sig_b"), hashes)
            alive, matches, done = np.arange(len(left)), np.zeros(len(left), dtype=np.int32), 0
            for n, least in tests:
                matches[alive] += (left[alive, done:n] == right[alive, done:n]).sum(axis=1, dtype=np.int32)
                alive, done = alive[matches[alive] >= least], n
            yield batch.select(["rep_a", "rep_b"]).take(pa.array(alive))

    return run


def near_duplicate_pairs(
    texts: DataFrame,
    k: int = 5,
    threshold: float = 0.8,
    hashes: int = HASHES,
    bands: int = BANDS,
    rows: int = ROWS,
    miss: float = MISS,
    hot: int = HOT,
) -> tuple[DataFrame, DataFrame]:
    """Pairs of near-duplicate classes and the members of every class.

    ``texts``: id BIGINT, text STRING; other columns are ignored and an id may
    stand several times with one text. Returns (pairs, members): pairs has
    rep_a < rep_b and overlap for classes of equal shingle sets that reach
    ``threshold``; members has rep, id, each id once. Null texts and texts of
    fewer than k words have no shingle, no class and no row; empty tables
    give no rows. A class is named by its least id. ``hot`` chooses which
    pairs are found by prefixes and changes no result.
    """
    if bands * rows > hashes:
        raise ValueError("bands * rows must not exceed hashes")
    lower = texts.select("id", F.lower("text").alias("text")).where("text is not null")
    signed = stage(
        lower.mapInArrow(
            _signatures(k, hashes), "id bigint, size int, mark_a bigint, mark_b bigint, signature binary"
        ),
        "signatures",
    )
    sets = ["mark_a", "mark_b", "size"]
    classes = signed.groupBy(*sets).agg(F.min("id").alias("rep"))
    members = signed.select("id", *sets).distinct().join(classes, sets).select("rep", "id")
    reps = stage(
        signed.select(F.col("id").alias("rep"), "size", "signature")
        .join(classes.select("rep"), "rep", "left_semi")
        .dropDuplicates(["rep"]),
        "representatives",
    )
    keys = reps.mapInArrow(_band_keys(hashes, bands, rows), "key bigint, rep bigint, size int")
    hot_keys = _hot_keys(keys, hot)
    if hot_keys:
        flagged = keys.withColumn("hot", F.col("key").isin(hot_keys))  # at most HOT_KEYS
        crowded = stage(flagged.where("hot").select("rep").distinct(), "crowded")
        keys = flagged.where("not hot").drop("hot")
    candidates = (
        keys.withColumnsRenamed({"rep": "rep_a", "size": "size_a"})
        .join(keys.withColumnsRenamed({"rep": "rep_b", "size": "size_b"}), "key")
        .where((F.col("rep_a") < F.col("rep_b")) & sizes_fit(threshold))
        .select("rep_a", "rep_b")
        .distinct()
    )
    signed_pairs = candidates.join(
        reps.select(F.col("rep").alias("rep_a"), F.col("signature").alias("sig_a")), "rep_a"
    ).join(reps.select(F.col("rep").alias("rep_b"), F.col("signature").alias("sig_b")), "rep_b")
    survivors = signed_pairs.select("rep_a", "rep_b", "sig_a", "sig_b").mapInArrow(
        _prune(hashes, least_matches(threshold, hashes, BATCH, miss)), "rep_a bigint, rep_b bigint"
    )
    survivors = stage(survivors, "survivors")
    if hot_keys:
        survivors = survivors.unionByName(_crowded_pairs(crowded, lower, k, threshold)).distinct()
    return verified(survivors, lower, k, threshold), members


def _hot_keys(keys: DataFrame, hot: int) -> list[int]:
    """Band keys that more than ``hot`` classes share, by a sketch of fixed size.

    The sketch counts within its error; which keys are told hot changes the
    way a pair is found, not whether it is found.
    """
    row = keys.agg(F.expr(f"approx_top_k(key, {HOT_KEYS}, {HOT_KEYS * 5})").alias("top")).first()
    return [r["item"] for r in row["top"] or [] if r["count"] > hot]


def _crowded_pairs(crowded: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Candidates among the classes of hot keys: those that share a rare shingle of their prefixes."""
    rows = texts.join(crowded.withColumnRenamed("rep", "id"), "id", "left_semi").dropDuplicates(["id"]).withColumn("indexed", F.lit(True))
    rows = stage(rows.select("id", "indexed", "text"), "crowded_texts")
    found = stage(prefixes(rows, k, threshold, shingle_order(rows, k)), "crowded_prefixes")
    pairs = prefix_candidates(prefix_tokens(found, "a"), prefix_tokens(found, "b"), threshold)
    return stage(pairs.where("rep_a < rep_b"), "crowded_pairs")


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of ids (row_lo < row_hi) behind pairs of classes and within classes."""
    across = (
        pairs.join(members.select(F.col("rep").alias("rep_a"), F.col("id").alias("x")), "rep_a")
        .join(members.select(F.col("rep").alias("rep_b"), F.col("id").alias("y")), "rep_b")
        .select(F.least("x", "y").alias("row_lo"), F.greatest("x", "y").alias("row_hi"))
    )
    within = (
        members.select("rep", F.col("id").alias("row_lo"))
        .join(members.select("rep", F.col("id").alias("row_hi")), "rep")
        .where("row_lo < row_hi")
        .select("row_lo", "row_hi")
    )
    return across.unionByName(within)


def near_duplicate_groups(texts: DataFrame, **options) -> DataFrame:
    """(id, class_id, links): one row for each id that has shingles.

    ``class_id`` is the least id of the connected component; ``links`` counts
    the other classes of equal shingle sets that reach the threshold. Copies
    are never expanded into pairs.
    """
    pairs, members = near_duplicate_pairs(texts, **options)
    pairs = stage(pairs.select("rep_a", "rep_b"), "pairs")
    components = connected_components(pairs, "rep_a", "rep_b")
    links = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return (
        members.join(components.withColumnRenamed("id", "rep"), "rep", "left")
        .join(links, "rep", "left")
        .select(
            "id",
            F.coalesce("component", "rep").alias("class_id"),
            F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
        )
    )
