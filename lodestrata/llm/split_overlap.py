"""Problem 5: the same or nearly the same records across splits.

Exact prefix-filter join between the evaluation splits and the training split.
Shingles are ordered rarest first; two sets of overlap t share one of their
first |x| - ceil(t |x|) + 1 shingles, whatever that order is, so indexing the
evaluation prefixes and probing with the training prefixes loses no pair.
Length and position filters drop pairs that cannot reach t, and what is left
is verified on the texts themselves.

How often a shingle occurs in the evaluation texts is counted exactly, by an
aggregation over all of them. What is broadcast of it has a fixed size at any
scale: the counts of the ``MOST_FREQUENT`` most frequent shingles (12 bytes
each), which the order puts last, and a bitmap of ``BITMAP_BITS`` address bits
(8 MB) that tells most shingles of no evaluation text; these are never probed,
but keep their place in the order. All other shingles are rare, and are
ordered by their hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.shingles import fingerprints, pair_overlaps, shingle_sets, slices
from lodestrata.staging import stage

MOST_FREQUENT, BITMAP_BITS = 1 << 20, 26


class Order(NamedTuple):
    """What both sides need to order their shingles alike: frequent ones with counts, ascending, and the bitmap."""

    frequent: np.ndarray
    counts: np.ndarray
    bitmap: np.ndarray
    bits: int

    def of(self, values: np.ndarray) -> np.ndarray:
        """Rank of each shingle: 0 occurs nowhere, 1 is rare, else its count."""
        word, bit = _address(values, self.bits)
        rank = ((self.bitmap[word] >> bit) & np.uint64(1)).astype(np.int64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, values), len(self.frequent) - 1)
            rank = np.where(self.frequent[at] == values, self.counts[at], rank)
        return rank


def _address(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    place = values >> np.uint64(64 - bits)
    return (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)


def _counted(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, counts = np.unique(shingle_sets(part.column("text"), k)[0], return_counts=True)
                yield pa.record_batch({"shingle": pa.array(values.view(np.int64)), "n": pa.array(counts.astype(np.int64))})

    return run


def shingle_order(texts: DataFrame, k: int, most: int = MOST_FREQUENT, bits: int = BITMAP_BITS) -> Order:
    """The order of the shingles of ``text``, by exact counts over all of them."""
    counted = stage(
        texts.select("text").mapInArrow(_counted(k), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")), "frequencies"
    )
    # the least power of two such that at most ``most`` shingles occur so often; there are at most 64 powers
    powers = counted.where("n > 1").groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect()
    least, room = None, most
    for r in powers:
        room -= r["count"]
        if room < 0:
            break
        least = 1 << r["power"]
    frequent = counted.where(F.col("n") >= least).toArrow() if least else None  # at most ``most`` rows
    place = F.shiftrightunsigned("shingle", 64 - bits)
    words = (
        counted.groupBy(F.shiftrightunsigned(place, 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(shingle, %d) & 63 AS int))" % (64 - bits))).alias("flags"))
        .toArrow()  # at most 2 ** (bits - 6) rows
    )
    bitmap = np.zeros(max(1, 1 << (bits - 6)), dtype=np.uint64)
    bitmap[words.column("word").to_numpy()] = words.column("flags").to_numpy().view(np.uint64)
    if frequent is None:
        return Order(np.empty(0, np.uint64), np.empty(0, np.int64), bitmap, bits)
    values, n = frequent.column("shingle").to_numpy().view(np.uint64), frequent.column("n").to_numpy()
    by_value = np.argsort(values)
    return Order(values[by_value], n[by_value], bitmap, bits)


def _prefixes(k: int, threshold: float, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_of = shared.value
        t = Fraction(str(threshold))
        for batch in batches:
            for part in slices(batch, "text"):
                values, starts = shingle_sets(part.column("text"), k)
                sizes = np.diff(starts)
                row = np.repeat(np.arange(len(sizes)), sizes)
                often = order_of.of(values)
                order = np.lexsort((values, often, row))
                values, often = values[order], often[order]
                place = np.arange(len(values)) - starts[:-1][row]
                length = sizes - -(-(sizes * t.numerator) // t.denominator) + 1
                keep = (place < length[row]) & (often > 0)
                ends = np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=len(sizes)))))
                lists = ends.astype(np.int32)
                a, b = fingerprints(values, starts)
                full = pa.array(sizes > 0)
                yield pa.record_batch(
                    {
                        "id": part.column("id"),
                        "indexed": part.column("indexed"),
                        "size": pa.array(sizes.astype(np.int32)),
                        "mark_a": pa.array(a),
                        "mark_b": pa.array(b),
                        "keys": pa.ListArray.from_arrays(pa.array(lists), pa.array(values[keep].view(np.int64))),
                        "places": pa.ListArray.from_arrays(pa.array(lists), pa.array(place[keep].astype(np.int32))),
                    }
                ).filter(full)

    return run


def prefixes(rows: DataFrame, k: int, threshold: float, order: Order) -> DataFrame:
    """id, indexed, size, mark_a, mark_b and the prefix (keys, places) of every row (id, indexed, text) with shingles."""
    shared = rows.sparkSession.sparkContext.broadcast(order)
    return rows.select("id", "indexed", "text").mapInArrow(
        _prefixes(k, threshold, shared),
        "id bigint, indexed boolean, size int, mark_a bigint, mark_b bigint, keys array<bigint>, places array<int>",
    )


def prefix_tokens(rows: DataFrame, side: str) -> DataFrame:
    """One row for each key of the prefixes: key, rep_<side>, size_<side>, place_<side>."""
    return rows.select("id", "size", F.inline(F.arrays_zip("keys", "places"))).select(
        F.col("keys").alias("key"), F.col("id").alias(f"rep_{side}"), F.col("size").alias(f"size_{side}"), F.col("places").alias(f"place_{side}")
    )


def prefix_candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Distinct (rep_a, rep_b) that share a prefix key and may reach the threshold by size and place."""
    t = Fraction(str(threshold))
    need = F.ceil(F.lit(t.numerator) * (F.col("size_a") + F.col("size_b")) / F.lit(t.numerator + t.denominator) - F.lit(1e-9))
    return (
        left.join(right, "key")
        .where(sizes_fit(threshold) & (F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) + F.least("place_a", "place_b") >= need))
        .select("rep_a", "rep_b")
        .distinct()
    )


def sizes_fit(threshold: float):
    """Whether sets of size_a and size_b shingles can reach the threshold."""
    t = Fraction(str(threshold))
    return (F.col("size_a") * t.denominator >= F.col("size_b") * t.numerator) & (F.col("size_b") * t.denominator >= F.col("size_a") * t.numerator)


def _verify(k: int, threshold: float):
    t = Fraction(str(threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a", 4 << 20):
                common, union = pair_overlaps(part.column("text_a"), part.column("text_b"), k)
                keep = pa.array((common * t.denominator >= union * t.numerator) & (union > 0))
                yield pa.record_batch(
                    {
                        "rep_a": part.column("rep_a"),
                        "rep_b": part.column("rep_b"),
                        "overlap": pa.array(common / np.maximum(union, 1)),
                    }
                ).filter(keep)

    return run


def verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs (rep_a, rep_b) whose texts have the overlap; ``texts``: id, text.

    Only texts of candidates move: a semi-join on the candidates' ids comes first.
    """
    wanted = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("id")).distinct()
    some = texts.join(wanted, "id", "left_semi").dropDuplicates(["id"])
    both = pairs.join(some.select(F.col("id").alias("rep_a"), F.col("text").alias("text_a")), "rep_a").join(
        some.select(F.col("id").alias("rep_b"), F.col("text").alias("text_b")), "rep_b"
    )
    return both.select("rep_a", "rep_b", "text_a", "text_b").mapInArrow(
        _verify(k, threshold), "rep_a bigint, rep_b bigint, overlap double"
    )


def cross_split_pairs(
    texts: DataFrame, k: int = 5, threshold: float = 0.8, most: int = MOST_FREQUENT, bits: int = BITMAP_BITS
) -> tuple[DataFrame, DataFrame]:
    """Overlapping pairs between two sides, between classes of equal shingle sets.

    ``texts``: id BIGINT, indexed BOOLEAN (true: evaluation side), text STRING;
    other columns are ignored and an id may stand several times with one text.
    Returns (pairs, members): pairs has rep_a (indexed side), rep_b (other
    side) and overlap for each two classes that reach ``threshold``; members
    has rep, indexed, id. Null texts, and texts of fewer than k words, have
    no shingle and overlap nothing; empty tables give no rows. A class is
    named by its least id, so repeated rows and ties give one result.
    ``most`` and ``bits`` bound what is broadcast and change no result.
    """
    rows = texts.select(F.col("id"), F.col("indexed"), F.lower("text").alias("text")).where("text is not null")
    found = stage(prefixes(rows, k, threshold, shingle_order(rows.where("indexed"), k, most, bits)), "prefixes")
    sets = ["indexed", "mark_a", "mark_b", "size"]
    classes = found.groupBy(*sets).agg(F.min("id").alias("rep"))
    members = found.select("id", *sets).distinct().join(classes, sets).select("rep", "indexed", "id")
    # the least id of a class carries its prefix; a redelivered id is kept once by the distinct pairs below
    reps = found.join(classes.select(F.col("rep").alias("id"), "indexed"), ["id", "indexed"], "left_semi")
    # staged, so that its true size tells Spark how to find the candidates' texts
    candidates = stage(prefix_candidates(prefix_tokens(reps.where("indexed"), "a"), prefix_tokens(reps.where("not indexed"), "b"), threshold), "candidates")
    return verified(candidates, rows.select("id", "text"), k, threshold), members
