"""Unified diffs as relations: files of a patch, hunks of a file."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import dims
from lodestrata.functions import text as T

_HEADER = re.compile(r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")


def read_patches(spark: SparkSession, folder: str) -> DataFrame:
    """patch, text of every .patch file under ``folder``; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.patch").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("patch"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def patch_files(patches: DataFrame, text: str = "text") -> DataFrame:
    """One row for each file of each patch: columns of ``patches``, old_path, new_path, body.

    Null text and text without a diff header give no rows.
    """
    others = [c for c in patches.columns if c != text]
    parts = patches.select(*others, F.posexplode(F.split(F.concat(F.lit("\n"), text), r"\ndiff --git ")).alias("_n", "body")).where("_n > 0")
    first = F.regexp_extract("body", r"^([^\n]*)", 1)
    header = r"^a/(.+?) b/(.+?)\s*$"
    return parts.select(
        *others, F.regexp_extract(first, header, 1).alias("old_path"), F.regexp_extract(first, header, 2).alias("new_path"), "body"
    ).where("new_path <> ''")


def hunks_of(body: str | None) -> list[tuple[str, str]]:
    """(old, new) text of every hunk, by the line counts of its header.

    Context and removed lines make the old side, context and added ones the
    new side; a stripped blank context line counts as context, the mark of a
    missing line end as nothing, and what follows the counted lines (a mail's
    signature) is no part of the hunk.
    """
    out: list[tuple[str, str]] = []
    old: list[str] = []
    new: list[str] = []
    left_old = left_new = 0
    for line in (body or "").split("\n"):
        header = _HEADER.match(line)
        if header:
            if old or new:
                out.append(("\n".join(old), "\n".join(new)))
            old, new = [], []
            left_old, left_new = (int(n) if n is not None else 1 for n in header.groups())
        elif line.startswith("\\"):
            continue
        elif left_old > 0 or left_new > 0:
            if line.startswith("-"):
                old.append(line[1:])
                left_old -= 1
            elif line.startswith("+"):
                new.append(line[1:])
                left_new -= 1
            elif line[:1] in ("", " "):
                old.append(line[1:])
                new.append(line[1:])
                left_old, left_new = left_old - 1, left_new - 1
            else:
                left_old = left_new = 0
    if old or new:
        out.append(("\n".join(old), "\n".join(new)))
    return out


def _hunks(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, *h) for i, body in enumerate(batch.column("body").to_pylist()) for n, h in enumerate(hunks_of(body))]
            at, number, old, new = zip(*rows, strict=True) if rows else ((), (), (), ())
            where = pa.array(at, pa.int64())
            yield pa.record_batch(
                {c: batch.column(c).take(where) for c in names}
                | {"hunk": pa.array(number, pa.int32()), "old_code": pa.array(old, pa.string()), "new_code": pa.array(new, pa.string())}
            )

    return run


def patch_hunks(files: DataFrame) -> DataFrame:
    """One row for each hunk: columns of ``files`` but body, hunk, old_code, new_code."""
    names = [c for c in files.columns if c != "body"]
    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in names)
    return files.mapInArrow(_hunks(names), f"{kinds}, hunk int, old_code string, new_code string")


def fix_pairs(patches: DataFrame, languages: tuple[str, ...] = ()) -> DataFrame:
    """Fix pairs from patches, with the filters in the order of their cost.

    Paths (language, tests, collateral files) are filtered before any hunk is
    read; then size (80 to 1500 characters, three lines), change and
    relevance. The type and CWE come from the old code.
    """
    files = patch_files(patches).withColumn("language", T.extension_language(F.col("new_path"), dims.PATCH_EXTENSIONS)).where("language is not null")
    if languages:
        files = files.where(F.col("language").isin(*languages))
    path = F.col("new_path")
    files = files.where(~path.rlike("(?i)" + dims.TEST_PATH) & ~path.rlike("(?i)" + dims.COLLATERAL_PATH))
    old, new = F.col("old_code"), F.col("new_code")
    relevant = "(?i)" + dims.RELEVANT_HUNK
    kept = patch_hunks(files).where(
        (old != new) & F.length(old).between(80, 1500) & (T.nonblank_lines(old) >= 3) & (old.rlike(relevant) | new.rlike(relevant))
    )
    return kept.withColumn("type", T.classify(old)).select("*", "type.*").drop("type").withColumnsRenamed({"old_code": "vuln_code", "new_code": "fixed_code"})


def flattened_sides(files: DataFrame, before: int = 5, after: int = 3) -> DataFrame:
    """Both sides of whole file diffs, as labelled rows: label, code.

    The changed lines with the last ``before`` context lines in front and the
    first ``after`` context lines behind; removed lines make the vulnerable
    row, added ones the safe row. A side without changed lines gives no row.
    """
    lines = F.filter(F.split("body", "\n"), lambda x: ~x.rlike(r"^(?:\+\+\+|---|@@|index |a/|new file|deleted file|similarity|rename|\\)"))
    context = F.transform(F.filter(lines, lambda x: x.startswith(" ")), lambda x: F.substring(x, F.lit(2), F.length(x)))
    head = F.slice(context, F.greatest(F.lit(1), F.size(context) - after - before + 1), before)
    tail = F.slice(context, F.greatest(F.lit(1), F.size(context) - after + 1), after)

    def side(mark: str, label: str):
        changed = F.transform(F.filter(lines, lambda x: x.startswith(mark)), lambda x: F.substring(x, F.lit(2), F.length(x)))
        return F.struct(F.lit(label).alias("label"), F.size(changed).alias("changed"), F.array_join(F.concat(head, changed, tail), "\n").alias("code"))

    others = [c for c in files.columns if c != "body"]
    return files.select(*others, F.inline(F.array(side("-", "vuln"), side("+", "safe")))).where("changed > 0").drop("changed")
