"""Readers of files: JSON lines, CSV, TSV, split datasets, source trees.

Schemas are always given, never inferred: a reader makes no pass of its own.
Rows that do not parse are kept apart, not dropped in silence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.functions import dims
from lodestrata.functions import text as T
from lodestrata.operators import traces

_CORRUPT = "_corrupt_record"


def jsonl(spark: SparkSession, path: str | list[str], schema: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON lines; blank lines are skipped.

    A line that is no JSON object goes to rejects, with the file it came from;
    ``strict`` fails on it. A missing file is an error of the reader, a folder
    without matching files gives empty tables. Rows know their file's stem
    (``shape``) and an order within the read (``ord``).
    """
    if strict:
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        return _located(rows), spark.createDataFrame([], f"{_CORRUPT} string, file string")
    # lines are parsed here, not by the reader, so that rejects can be asked for on their own
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    lines = _located(spark.read.text(path).where(F.trim("value") != ""))
    parsed = lines.withColumn("_row", F.from_json("value", f"{schema}, {_CORRUPT} string", options))
    rows = parsed.where(F.col(f"_row.{_CORRUPT}").isNull()).select("_row.*", "file", F.col("shape").alias("_stem"), "ord").drop(_CORRUPT)
    rows = rows.drop("_stem") if "shape" in rows.columns else rows.withColumnRenamed("_stem", "shape")
    rejects = parsed.where(F.col(f"_row.{_CORRUPT}").isNotNull()).select(F.col("value").alias(_CORRUPT), "file")
    return rows, rejects


def _located(df: DataFrame) -> DataFrame:
    """File name, its stem and an ordinal, taken before any exchange: files in their order, rows in theirs."""
    stem = [] if "shape" in df.columns else [F.regexp_extract("_metadata.file_name", r"(.+?)\.[^.]+$", 1).alias("shape")]
    return df.select(
        *df.columns,
        F.col("_metadata.file_name").alias("file"),
        *stem,
        F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("ord"),
    )


def records(spark: SparkSession, path: str | list[str], strict: bool = False, skip: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Training records, (rows, rejects); rows without messages are rejects' business only if they do not parse.

    Files whose stem is in ``skip`` are left out.
    """
    rows, rejects = jsonl(spark, path, schemas.RECORD, strict)
    if skip:
        stem = F.regexp_extract("file", r"(.+?)\.[^.]+$", 1)
        rows, rejects = rows.where(~stem.isin(*skip)), rejects.where(~stem.isin(*skip))
    return rows, rejects


def eval_set(spark: SparkSession, folder: str, shapes: tuple[str, ...] = schemas.EVAL_SHAPES) -> DataFrame:
    """Held-out records of the given shapes; a shape without file has no rows."""
    return records(spark, f"{folder}/*.jsonl")[0].where(F.col("shape").isin(*shapes))


def either_format(spark: SparkSession, flat: str | None = None, pilot: str | None = None) -> DataFrame:
    """Flat traces from a flat file or from a file of records; exactly one of them is given."""
    if (flat is None) == (pilot is None):
        raise ValueError("give either the flat file or the pilot file")
    if flat:
        rows = jsonl(spark, flat, schemas.FLAT_TRACE)[0]
        return rows.select(*[f.strip().split(" ")[0] for f in schemas.FLAT_TRACE.split(",")])
    rows = records(spark, pilot)[0]
    shaped = rows.select(
        F.monotonically_increasing_id().alias("record_id"),
        "shape",
        *[F.col(f"_meta.{c}").alias(c) for c in ("source", "language", "label", "oracle", "improved")],
        F.coalesce(F.get("_meta.cwes", 0), "_meta.ground_truth_cwe").alias("cwe"),
        "messages",
    )
    return traces.flatten(shaped).drop("improved").withColumn("improved_reasoning", F.lit(None).cast("string"))


def csv_rows(spark: SparkSession, path: str, schema: str, separator: str = ",", header: bool = True) -> DataFrame:
    """CSV with quoted line breaks and doubled quotes; a row of too few fields has nulls."""
    return (
        spark.read.schema(schema).option("header", header).option("sep", separator).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    )


def large_files(spark: SparkSession, folder: str, pattern: str = "*.csv", least_bytes: int = 100_000_000) -> DataFrame:
    """path, length of files above a size, by name; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length").where(F.col("length") > least_bytes).orderBy("path")


def labelled_csv(spark: SparkSession, path: str, quota_safe: int | None = None) -> DataFrame:
    """Labelled code rows with one language name each, code of 60 to 2500 characters; safe rows up to a quota."""
    rows = csv_rows(spark, path, schemas.LABELLED_CSV).where(F.length("code").between(60, 2500))
    rows = rows.select("code", traces.normal_language(F.col("language")).alias("language"), T.tidy(F.col("safety")).alias("label"))
    if quota_safe is None:
        return rows
    return rows.where("label <> 'safe'").unionByName(rows.where("label = 'safe'").limit(quota_safe))


def fix_pair_csv(spark: SparkSession, path: str) -> DataFrame:
    """Fix pairs from CSV: both sides non-empty and different, CWE from the type's text."""
    rows = csv_rows(spark, path, schemas.FIX_PAIR_CSV)
    vuln, fixed = T.strip(F.col("vulnerable_code")), T.strip(F.col("fixed_code"))
    return rows.where((F.length(vuln) >= 60) & (fixed != "") & (vuln != fixed)).select(
        vuln.alias("vuln_code"),
        fixed.alias("fixed_code"),
        T.type_to_cwe(F.col("vulnerability_type")).alias("cwe"),
        T.tidy(F.col("language")).alias("language"),
        F.col("vulnerability_type").alias("vuln_type"),
        F.lit("csv").alias("source"),
    )


def fixed_code_answers(records: DataFrame) -> DataFrame:
    """Fix pairs from answers that end in a "Fixed code:" block, vulnerable records only."""
    answer = F.get(F.filter("messages", lambda m: m["role"] == "assistant"), 0)["content"]
    user = F.get(F.filter("messages", lambda m: m["role"] == "user"), 0)["content"]
    low = F.lower(answer)
    found = T.any_contains(low, ("vulnerability detected", "security flaw", "security issue"))
    block = T.nonempty(T.strip(F.substring(answer, F.instr(low, "fixed code:") + len("fixed code:"), F.length(answer))))
    vuln = T.scan_code(user)
    return records.where(found & F.contains(low, F.lit("fixed code:"))).select(
        vuln.alias("vuln_code"), block.alias("fixed_code"), F.lit(None).cast("string").alias("cwe"), T.detect_language(vuln).alias("language"), F.lit(None).cast("string").alias("vuln_type"), F.lit("answers").alias("source")
    ).where("length(vuln_code) >= 60 and fixed_code is not null")


def tagged_union(*sources: DataFrame, languages: tuple[str, ...] = ()) -> DataFrame:
    """Fix pairs of all sources in one schema, with the classifier's type; the source's type and CWE are kept beside it."""
    out = None
    for source in sources:
        out = source if out is None else out.unionByName(source, allowMissingColumns=True)
    if languages:
        out = out.where(F.col("language").isin(*languages))
    kind = T.classify(F.col("vuln_code"))
    return out.withColumn("_kind", kind).select(
        *[c for c in out.columns if c not in ("cwe", "vuln_type")],
        F.col("vuln_type").alias("vuln_type_src"),
        F.col("_kind.vuln_type").alias("vuln_type"),
        F.coalesce("cwe", "_kind.cwe").alias("cwe"),
    )


def split_dataset(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train",), most: int | None = None) -> DataFrame:
    """Rows of a Parquet dataset with a ``split`` column or partition; unknown splits have no rows.

    With ``most`` the scan stops once so many rows are read.
    """
    rows = spark.read.parquet(path).where(F.col("split").isin(*splits))
    return rows if most is None else rows.limit(most)


def paired_files(spark: SparkSession, folder: str, pattern: str = "*.js") -> DataFrame:
    """bucket, name, before, after of files that stand in bucket/before and bucket/after."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    located = files.select(
        F.regexp_extract(path, r"([^/]+)/(?:before|after)/[^/]+$", 1).alias("bucket"),
        F.regexp_extract(path, r"/(before|after)/[^/]+$", 1).alias("side"),
        F.regexp_extract(path, r"([^/]+)$", 1).alias("name"),
        F.col("value").alias("code"),
    )
    side = lambda s: located.where(F.col("side") == s).select("bucket", "name", F.col("code").alias(s))
    return side("before").join(side("after"), ["bucket", "name"])


#: Path parts that are no library code. Fixed values.
SKIP_PARTS = (
    r"(?i)(^|/)(tests?|testing|examples?|samples|docs?|documentation|benchmarks?|perf|fixtures|migrations|vendor|third_party|thirdparty|node_modules|\.git|\.tox|__pycache__)(/|$)"
    r"|(^|/)test_[^/]*$|_test\.py$"
)


def source_tree(spark: SparkSession, folder: str, least: int = 100, most: int = 100_000, pattern: str = "*.py", skip: str | None = SKIP_PARTS) -> DataFrame:
    """path, code of source files within a size, outside skipped folders; paths are filtered before files are read."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    located = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("code"))
    inside = F.replace(F.col("path"), F.lit(folder), F.lit(""))
    kept = located.where((F.col("size") > least) & (F.col("size") < most * 4))
    if skip:
        kept = kept.where(~inside.rlike(skip))
    return kept.where((F.length("code") > least) & (F.length("code") < most)).select("path", "code")


def scan_targets(spark: SparkSession, folder: str) -> DataFrame:
    """path, language, code of every file a scan can read, none of them under .git."""
    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    found = files.select(path.alias("path"), T.extension_language(F.lower(path), dims.SCAN_EXTENSIONS).alias("language"), F.col("value").alias("code"))
    return found.where(F.col("language").isNotNull() & ~F.contains("path", F.lit("/.git/")))


def targets(spark: SparkSession, path: str, languages: tuple[str, ...] = (), skip: int = 0) -> DataFrame:
    """Harvest targets of a TSV file, optionally of some languages and after the first ``skip`` rows."""
    rows = spark.read.schema(schemas.TARGET).option("sep", "\t").csv(path).where("patch_file is not null")
    if languages:
        rows = rows.where(F.col("lang").isin(*languages))
    return rows.offset(skip) if skip else rows


def cache(spark: SparkSession, path: str) -> DataFrame:
    """Keyed resume cache, one value a key (the greatest); lines that do not parse are left out."""
    rows = jsonl(spark, path, schemas.CACHED)[0]
    return rows.where("key is not null").groupBy("key").agg(F.max("raw_text").alias("raw_text"))


def reasoning_dataset(rows: DataFrame) -> DataFrame:
    """Shape-1 answers and preference parts from a reasoning dataset's columns."""
    label = traces.is_vulnerable(F.col("vulnerable"))
    cwe, lang = T.loose_cwe(F.get("cwe_id", 0)), traces.normal_language(F.col("lang"))
    good = T.strip(traces.clean_reasoning(F.coalesce("positive_reasoning", F.lit(""))))
    severity = F.coalesce(dims.lookup(dims.SEVERITY_BY_CWE, cwe), F.lit("MEDIUM"))
    head = F.concat(F.lit("<think>\n"), good, F.lit("\n</think>\n\n"))
    vuln = F.concat(
        head, F.lit("status: confirmed\ncwe: "), F.coalesce(cwe, F.lit("CWE-UNK")), F.lit("\nseverity: "), severity,
        F.lit("\nline: none\ntrace: "), traces.trace_summary(good, cwe, lang, label), F.lit("\nfix: "), traces.fix_summary(good, label), F.lit("\n"),
    )
    safe = F.concat(head, F.lit("status: safe\ncwe: none\nseverity: none\nline: none\ntrace: "), traces.trace_summary(good, cwe, lang, label), F.lit("\nfix: none\n"))
    return rows.where("function is not null").select(
        F.col("function").alias("code"),
        lang.alias("language"),
        F.when(label, "vuln").otherwise("safe").alias("label"),
        cwe.alias("cwe"),
        F.when(label, vuln).otherwise(safe).alias("answer"),
        good.alias("good_reasoning"),
        T.nonempty(T.strip(traces.clean_reasoning(F.coalesce("negative_reasoning", F.lit(""))))).alias("bad_reasoning"),
    )
