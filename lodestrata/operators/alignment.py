"""What a fix touches, from an alignment of the lines of both sides.

Only the alignment itself runs in Python, over Arrow batches: which lines of
the old side find no partner, and between which of them new ones were put in.
Line numbers, identifiers and the rule for snippets are column expressions on
top of it.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T

#: Share of removed lines above which a fix is taken for a snippet, not for the whole code. Fixed value.
SNIPPET_SHARE = 0.6

_ALIGNED = "removed array<int>, seams array<int>, added array<string>"


def align(old: list[str], new: list[str]) -> tuple[list[int], list[int], list[str]]:
    """(numbers of old lines without a partner, seams, lines added at seams); numbers start at 1.

    A seam is the number of old lines before new ones that replace nothing.
    """
    partner = np.full(len(old), -1)
    for a, b, n in difflib.SequenceMatcher(a=old, b=new, autojunk=False).get_matching_blocks():
        partner[a : a + n] = np.arange(b, b + n)
    removed = [int(i) + 1 for i in np.flatnonzero(partner < 0)]
    # every old line and both ends as (place in old, place in new): new lines between two neighbours that kept touch are a seam
    kept = [(-1, -1), *((int(i), int(partner[i])) for i in np.flatnonzero(partner >= 0)), (len(old), len(new))]
    seams, added = [], []
    for (i, j), (after, beyond) in zip(kept, kept[1:]):
        if after == i + 1 and beyond > j + 1:
            seams.append(after)
            added += new[j + 1 : beyond]
    return removed, seams, added


def _alignments(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("before").to_pylist(), batch.column("after").to_pylist(), strict=True)
            found = [align(a.splitlines(), b.splitlines()) if a is not None and b is not None else ([], [], []) for a, b in sides]
            kinds = (pa.int32(), pa.int32(), pa.string())
            yield pa.record_batch(
                {key: batch.column(key), "before": batch.column("before"), "after": batch.column("after")}
                | {name: pa.array([f[i] for f in found], pa.list_(kind)) for i, (name, kind) in enumerate(zip(("removed", "seams", "added"), kinds))}
            )

    return run


def lines_of(text: Column) -> Column:
    """Lines of a text; a line end at the end of the text starts no further line."""
    every = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
    return T.let(every, lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))


def _touched() -> Column:
    """Removed lines, and the lines on both sides of a seam."""
    beside = F.flatten(F.transform("seams", lambda s: F.array(s, s + 1)))
    return F.array_sort(F.array_distinct(F.concat("removed", F.filter(beside, lambda i: i.between(1, F.size("old"))))))


def regions(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """``key``, lines, identifiers, source of the region that each fix touches, sorted.

    Removed and replaced lines count with their identifiers; around a pure
    insertion the neighbouring lines do, with the identifiers that come in.
    Where more than ``SNIPPET_SHARE`` of the lines are gone the fix is a
    snippet: then the identifiers on one side only count, and the lines that
    have them. source is diff or none. A null side gives an unknown region
    (none, empty arrays); so do equal sides.
    """
    kind = pairs.schema[key].dataType.simpleString()
    narrow = pairs.select(key, F.col(before).alias("before"), F.col(after).alias("after"))
    aligned = narrow.mapInArrow(_alignments(key), f"{key} {kind}, before string, after string, {_ALIGNED}")
    nothing = F.array().cast("array<int>")
    told = aligned.select("*", lines_of(F.col("before")).alias("old")).select("*", _touched().alias("touched"))
    joined = F.concat(F.transform("touched", lambda i: F.get("old", i - 1)), "added")
    own, fixed = T.identifiers(F.col("before")), T.identifiers(F.col("after"))
    one_sided = F.when(
        F.size("removed") > F.lit(SNIPPET_SHARE) * F.size("old"), F.array_sort(F.concat(F.array_except(own, fixed), F.array_except(fixed, own)))
    )
    told = told.select(key, "old", "touched", T.identifiers(F.array_join(joined, "\n")).alias("names"), one_sided.alias("one_sided"))
    snippet = F.size("one_sided") > 0
    having = F.filter(F.sequence(F.lit(1), F.size("old")), lambda i: F.arrays_overlap(T.identifiers(F.get("old", i - 1)), F.col("one_sided")))
    lines = F.when(snippet, having).otherwise(F.coalesce("touched", nothing))
    result = told.select(key, lines.cast("array<int>").alias("lines"), F.when(snippet, F.col("one_sided")).otherwise(F.coalesce("names", F.array().cast("array<string>"))).alias("identifiers"))
    return result.select("*", F.when(F.size("lines") > 0, "diff").otherwise("none").alias("source"))


Analyser = Callable[[list[str]], list[list[tuple[int, str | None]]]]


def located(pairs: DataFrame, key: str, before: str, after: str, cwe: str, language: str, analyser: Analyser | None = None) -> DataFrame:
    """``regions`` with the pair's CWE, and with what an analyser finds where a fix shows nothing.

    ``analyser`` maps codes to their findings (line, CWE id or None); it runs
    on the executors, on Python code without a region from its fix. Its lines
    and the identifiers on them become the region (source analyser); its first
    CWE stands in for a missing one.
    """
    told = regions(pairs, key, before, after).join(pairs.select(key, F.col(cwe).alias("cwe"), F.col(before).alias("code"), F.col(language).alias("language")), key)
    if analyser is None:
        return told.drop("code", "language")
    open_ = (F.col("source") == "none") & F.coalesce(F.startswith(F.lower("language"), F.lit("py")), F.lit(False)) & F.col("code").isNotNull()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = analyser(batch.column("code").to_pylist())
            yield pa.record_batch(
                {
                    key: batch.column(key),
                    "code": batch.column("code"),
                    "cwe": batch.column("cwe"),
                    "hits": pa.array([sorted({line for line, _ in f}) for f in found], pa.list_(pa.int32())),
                    "hit_cwe": pa.array([next((c for _, c in f if c), None) for f in found], pa.string()),
                }
            )

    kind = pairs.schema[key].dataType.simpleString()
    analysed = told.where(open_).select(key, "code", "cwe").mapInArrow(run, f"{key} {kind}, code string, cwe string, hits array<int>, hit_cwe string")
    at = F.filter("hits", lambda i: i.between(1, F.size(lines_of(F.col("code")))))
    names = T.identifiers(F.array_join(F.transform(at, lambda i: F.get(lines_of(F.col("code")), i - 1)), "\n"))
    told_by_it = analysed.select(
        key, at.alias("lines"), names.alias("identifiers"), F.when(F.size(at) > 0, "analyser").otherwise("none").alias("source"), F.coalesce("cwe", "hit_cwe").alias("cwe")
    )
    return told.where(~open_).drop("code", "language").unionByName(told_by_it)
