"""Queries on windows, sorts, limits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import dims
from lodestrata.functions import text as T
from lodestrata.operators import dedup, generation, sampling
from lodestrata.operators.alignment import regions
from lodestrata.operators.quality import severities_fall
from lodestrata.plans import duck as D
from lodestrata.plans.registry import query
from lodestrata.sources import corpus


@query(D.query(D.TASKS, body="SELECT task_no, CAST(row_number() OVER (PARTITION BY source ORDER BY task_no) - 1 AS BIGINT) AS ordinal FROM tasks"))
def source_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Ordinal of every task within its source, from 0.

    Counts by source and id range give each range its start, so a source is
    numbered range by range and not in one task.
    """
    t = corpus.tasks(spark, d).select("task_no", "source").withColumn("_range", F.floor(F.col("task_no") / 4096))
    counts = t.groupBy("source", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = [t["source"].eqNullSafe(F.col("s")), t["_range"] == F.col("r")]
    joined = t.join(starts.select(F.col("source").alias("s"), F.col("_range").alias("r"), "_start"), same)
    inside = F.row_number().over(Window.partitionBy("source", "_range").orderBy("task_no")) - 1
    return joined.select("task_no", (F.col("_start") + inside).cast("bigint").alias("ordinal"))


@query(D.query(D.REC, body="SELECT record_id, shape || ':' || (row_number() OVER (PARTITION BY shape ORDER BY record_id) - 1) AS position_id FROM rec WHERE shape IS NOT NULL"))
def positional_ids(spark: SparkSession, d: str) -> DataFrame:
    """Positional id of every record within its shape."""
    r = corpus.records(spark, d).where("shape is not null").select("record_id", "shape").withColumn("_range", F.floor(F.col("record_id") / 4096))
    before = Window.partitionBy("shape").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = r.groupBy("shape", "_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("shape", "_range").orderBy("record_id")) - 1
    return r.join(starts, ["shape", "_range"]).select("record_id", F.concat_ws(":", "shape", F.col("_start") + inside).alias("position_id"))


@query(
    D.query(
        D.PAIRS,
        "t AS (SELECT pair_id, vuln_type, row_number() OVER (PARTITION BY vuln_type ORDER BY pair_id) AS turn, min(pair_id) OVER (PARTITION BY vuln_type) AS f FROM pairs WHERE vuln_type IS NOT NULL)",
        body="SELECT pair_id, vuln_type, CAST(turn AS BIGINT) AS turn FROM t ORDER BY t.turn, f LIMIT 100",
    )
)
def round_robin_balanced(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 pairs, the vulnerability types taking turns."""
    p = corpus.pairs(spark, d).where("vuln_type is not null").select("pair_id", "vuln_type")
    return sampling.round_robin(p, "vuln_type", "pair_id", 100).select("pair_id", "vuln_type", F.col("turn").cast("bigint").alias("turn"))


@query(
    D.query(
        D.TASKS,
        f"""sides AS (SELECT task_no, label, row_number() OVER (PARTITION BY label ORDER BY {D.hash_order('mix', 'task_no')}) - 1 AS r FROM tasks WHERE label IN ('safe', 'vuln'))""",
        body="SELECT task_no, label, CAST(CASE WHEN label = 'safe' THEN r * 10 // 3 ELSE (r // 7) * 10 + [1, 2, 4, 5, 7, 8, 9][CAST(r % 7 + 1 AS INT)] END AS BIGINT) AS slot FROM sides ORDER BY slot LIMIT 200",
    )
)
def ratio_interleave(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 tasks of an order in which every prefix is 30 % safe."""
    t = corpus.tasks(spark, d).where("label in ('safe', 'vuln')").select("task_no", "label")
    # no side reaches beyond slot 200 with more than 200 rows
    ranked = t.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(T.hash_order("mix", F.col("task_no"))))).where("r <= 201")
    slot = sampling.interleave_slot(F.col("r") - 1, F.col("label") == "safe")
    return ranked.select("task_no", "label", slot.alias("slot")).orderBy("slot").limit(200)


@query(D.query(D.FINDS, body="SELECT finding_id, owner_repo FROM (SELECT finding_id, owner_repo, row_number() OVER (PARTITION BY owner_repo ORDER BY finding_id) AS r FROM finds WHERE owner_repo IS NOT NULL) WHERE r <= 3"))
def per_group_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most three findings of each repository."""
    f = corpus.findings(spark, d).where("owner_repo is not null").select("finding_id", "owner_repo")
    return sampling.per_group(f, ["owner_repo"], ["finding_id"], 3)


_CAPS = {"patchmill": 60, "fixledger": 60, "hunkmine": 8, "taintwell": 8, "codeharvest": 32, "legacy_csv": 32}


@query(
    D.query(
        D.REC,
        "caps(source, cap) AS (VALUES " + ", ".join(f"('{s}', {n})" for s, n in _CAPS.items()) + ")",
        body=f"SELECT record_id, source FROM (SELECT r.record_id, r.source, cap, row_number() OVER (PARTITION BY r.source ORDER BY {D.hash_order('caps', 'r.record_id')}) AS n FROM rec r JOIN caps USING (source)) WHERE n <= cap",
    )
)
def stratified_caps(spark: SparkSession, d: str) -> DataFrame:
    """A capped sample of each source."""
    caps = spark.createDataFrame(list(_CAPS.items()), "source string, cap int")
    r = corpus.records(spark, d).select("record_id", "source")
    biggest = max(_CAPS.values())
    some = sampling.per_group(r.where(F.col("source").isin(*_CAPS)), ["source"], [T.hash_order("caps", F.col("record_id"))], biggest)
    return sampling.quota_by_group(some, ["source"], caps, T.hash_order("caps", F.col("record_id")), "cap").select("record_id", "source")


@query(D.query(D.TASKS, body="SELECT task_no FROM tasks WHERE label = 'safe' ORDER BY task_no LIMIT 50"))
def quota_early_stop(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 safe tasks."""
    return corpus.tasks(spark, d).where("label = 'safe'").select("task_no").orderBy("task_no").limit(50)


@query(D.query(D.FINDS, body=f"""SELECT file, CAST(count(*) AS BIGINT) AS n, coalesce(bool_and(rank >= nxt), TRUE) AS falls FROM (
  SELECT file, rank, lead(rank) OVER (PARTITION BY file ORDER BY finding_id) AS nxt FROM (SELECT file, finding_id, coalesce(CAST({D.lookup({k: str(v) for k, v in dims.SEVERITY_RANK.items()}, 'upper(severity)')} AS INT), 0) AS rank FROM finds WHERE file IS NOT NULL)) GROUP BY 1"""))
def severity_monotonic(spark: SparkSession, d: str) -> DataFrame:
    """Whether severities fall from finding to finding within a file, over all of its findings.

    Neighbours are compared range by range of ids, and the last rank of a range
    with the first one of the file's next range, so a hot file is not one task.
    """
    rank = F.coalesce(dims.lookup({k: str(v) for k, v in dims.SEVERITY_RANK.items()}, F.upper("severity")).cast("int"), F.lit(0))
    f = corpus.findings(spark, d).where("file is not null").select("file", "finding_id", rank.alias("rank")).withColumn("_range", F.floor(F.col("finding_id") / 4096))
    following = F.lead("rank").over(Window.partitionBy("file", "_range").orderBy("finding_id"))
    ranges = f.withColumn("nxt", following).groupBy("file", "_range").agg(
        F.count("*").alias("n"), F.bool_and(F.col("rank") >= F.col("nxt")).alias("falls"), F.min_by("rank", "finding_id").alias("first"), F.max_by("rank", "finding_id").alias("last")
    )
    beyond = F.lead("first").over(Window.partitionBy("file").orderBy("_range"))
    falls = F.bool_and("falls"), F.bool_and(F.col("last") >= F.col("beyond"))
    return ranges.withColumn("beyond", beyond).groupBy("file").agg(F.sum("n").alias("n"), (F.coalesce(falls[0], F.lit(True)) & F.coalesce(falls[1], F.lit(True))).alias("falls"))


@query(
    D.query(
        D.REC,
        body=r"""SELECT record_id, CAST(len(l) AS BIGINT) AS listed, coalesce(list_bool_and(list_transform(l, lambda x, i: i = len(l) OR x >= l[i + 1])), TRUE) AS falls FROM (
  SELECT record_id, list_transform(regexp_extract_all(usr, '- \[(HIGH|MEDIUM|LOW)\]', 1), lambda s: CASE s WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS l FROM rec WHERE usr IS NOT NULL)""",
    ),
    per_row=True,
)
def severity_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Whether the findings that a question lists fall in severity, within the row."""
    listed = F.regexp_extract_all("usr", F.lit(r"- \[(HIGH|MEDIUM|LOW)\]"), 1)
    return corpus.records(spark, d).where("usr is not null").select("record_id", F.size(listed).cast("bigint").alias("listed"), severities_fall(listed).alias("falls"))


@query(
    """SELECT doc_id, CAST(i AS BIGINT) AS chunk, i * 60 + 1 AS first_line, CAST(length(array_to_string(list_slice(l, i * 60 + 1, i * 60 + 60), chr(10))) AS BIGINT) AS chars FROM (
  SELECT doc_id, l, unnest(generate_series(0, CAST((len(l) - 1) // 60 AS BIGINT))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"""
)
def line_chunks_60(spark: SparkSession, d: str) -> DataFrame:
    """Documents in chunks of 60 lines."""
    docs = corpus.documents(spark, d).where("text is not null").select("doc_id", F.split("text", "\n").alias("l"))
    chunks = docs.select("doc_id", "l", F.explode(F.sequence(F.lit(0), ((F.size("l") - 1) / 60).cast("int"))).alias("i"))
    part = F.array_join(F.slice("l", F.col("i") * 60 + 1, 60), "\n")
    return chunks.select("doc_id", F.col("i").cast("bigint").alias("chunk"), (F.col("i").cast("bigint") * 60 + 1).alias("first_line"), F.length(part).cast("bigint").alias("chars"))


@query(D.query(D.FINDS, body="SELECT source, CAST(count(*) AS BIGINT) AS n FROM finds WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, source LIMIT 3"))
def topk_sources(spark: SparkSession, d: str) -> DataFrame:
    """The three sources with the most findings, ties by name."""
    f = corpus.findings(spark, d).where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    return f.orderBy(F.desc("n"), "source").limit(3)


_SEV = "CASE upper(severity) WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 1 END"


@query(D.query(D.FINDS, body=f"SELECT finding_id, file, {_SEV} AS rank FROM finds WHERE file IS NOT NULL AND cwe IS NOT NULL ORDER BY file, rank, finding_id LIMIT 500"))
def sorted_findings(spark: SparkSession, d: str) -> DataFrame:
    """The first findings by file and severity."""
    rank = F.expr(_SEV)
    return corpus.findings(spark, d).where("file is not null and cwe is not null").select("finding_id", "file", rank.alias("rank")).orderBy("file", "rank", "finding_id").limit(500)


@query("SELECT doc_id, CAST(b AS BIGINT) AS bytes FROM (SELECT doc_id, strlen(text) AS b, sum(strlen(text)) OVER (ORDER BY doc_id) AS run FROM documents WHERE text IS NOT NULL) WHERE run <= 500000")
def byte_budget(spark: SparkSession, d: str) -> DataFrame:
    """Documents in order of their id up to 500,000 bytes."""
    docs = corpus.documents(spark, d).where("text is not null").select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"))
    return sampling.budget_prefix(docs, "doc_id", "bytes", 500_000)


@query(D.query(D.TASKS, body=f"SELECT task_no FROM tasks ORDER BY {D.hash_order('pool', 'task_no')} LIMIT 100"))
def seeded_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 tasks of a seeded order."""
    return corpus.tasks(spark, d).select("task_no").orderBy(T.hash_order("pool", F.col("task_no"))).limit(100)


@query(
    D.query(
        D.REC,
        f"""h AS (SELECT record_id, shape, row_number() OVER (PARTITION BY shape ORDER BY {D.hash_order('holdout', 'record_id')}) AS r, count(*) OVER (PARTITION BY shape) AS n FROM rec WHERE shape IS NOT NULL)""",
        body="SELECT record_id, shape, CASE WHEN r <= least(150, CASE WHEN floor(n * 0.3) > 0 THEN floor(n * 0.3) ELSE n END) THEN 'eval' ELSE 'train' END AS side FROM h",
    )
)
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    """Every record's side: up to 150 and 30 % of each shape are held out.

    The holdout is bounded by 150 rows a shape, so it is found first and the
    rest is an anti-join: no shape is ranked whole.
    """
    r = corpus.records(spark, d).where("shape is not null").select("record_id", "shape")
    sizes = r.groupBy("shape").agg(F.count("*").alias("n"))
    share = F.floor(F.col("n") * F.lit(3) / 10)
    quotas = sizes.select("shape", F.least(F.lit(150), F.when(share > 0, share).otherwise(F.col("n"))).alias("quota"))
    order = T.hash_order("holdout", F.col("record_id"))
    held = sampling.quota_by_group(sampling.per_group(r, ["shape"], [order], 150), ["shape"], quotas, order)
    return r.join(held.select("record_id", F.lit("eval").alias("side")), "record_id", "left").select("record_id", "shape", F.coalesce("side", F.lit("train")).alias("side"))


@query(D.query(D.REC, body=f"SELECT record_id FROM rec ORDER BY {D.hash_order('fixed', 'record_id')} LIMIT 80"))
def fixed_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 80 records."""
    return corpus.records(spark, d).select("record_id").orderBy(T.hash_order("fixed", F.col("record_id"))).limit(80)


@query(
    D.query(
        D.FINDS,
        f"f AS (SELECT finding_id, file, cwe, CAST(finding_id % 50 AS BIGINT) AS set_id, row_number() OVER (PARTITION BY finding_id % 50 ORDER BY {D.hash_order('sets', 'finding_id')}) AS r FROM finds WHERE file IS NOT NULL)",
        body=f"""SELECT set_id, finding_id, file, FALSE AS copied FROM f WHERE r <= 4 + set_id % 5
UNION ALL SELECT set_id, finding_id, regexp_replace(file, '\\.', '_v2.'), TRUE FROM f WHERE r = 1 AND {D.hash_uniform('copy', 'set_id')} < 0.3""",
    )
)
def finding_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sets of four to eight findings, three in ten with a near-duplicate of their first one."""
    f = corpus.findings(spark, d).where("file is not null").select("finding_id", "file", (F.col("finding_id") % 50).alias("set_id"))
    order = Window.partitionBy("set_id").orderBy(T.hash_order("sets", F.col("finding_id")))
    ranked = f.withColumn("r", F.row_number().over(order)).where("r <= 8")
    chosen = ranked.where(F.col("r") <= 4 + F.col("set_id") % 5).select("set_id", "finding_id", "file", F.lit(False).alias("copied"))
    first_dot = F.regexp_replace("file", r"^([^.]*)\.", "$1_v2.")
    copies = ranked.where((F.col("r") == 1) & (T.hash_uniform("copy", F.col("set_id")) < 0.3)).select("set_id", "finding_id", first_dot.alias("file"), F.lit(True).alias("copied"))
    return chosen.unionByName(copies)


@query(D.query(D.REC, body=f"SELECT record_id, shape FROM (SELECT record_id, shape, row_number() OVER (PARTITION BY shape ORDER BY {D.hash_order('smoke', 'record_id')}) AS r FROM rec WHERE label IN ('safe', 'vuln') AND shape IS NOT NULL) WHERE r <= CASE WHEN shape = 'shape3' THEN 40 ELSE 6 END"))
def smoke_sample(spark: SparkSession, d: str) -> DataFrame:
    """Six labelled records of each shape, forty of the cross-file one."""
    r = corpus.records(spark, d).where("label in ('safe', 'vuln') and shape is not null").select("record_id", "shape")
    some = sampling.per_group(r, ["shape"], [T.hash_order("smoke", F.col("record_id"))], 40)
    return sampling.per_group(some, ["shape"], [T.hash_order("smoke", F.col("record_id"))], F.when(F.col("shape") == "shape3", 40).otherwise(6))


_WEIGHTS = {"shape1": 1.0, "shape1_verified": 3.0, "shape2": 2.0, "shape3": 2.5, "shape4": 1.5}


@query(
    f"""WITH w(shape, weight) AS (VALUES {", ".join(f"('{s}', {w})" for s, w in _WEIGHTS.items())}),
c AS (SELECT shape, sum(weight) OVER (ORDER BY shape) / (SELECT sum(weight) FROM w) AS upto FROM w),
draws AS (SELECT event_id, {D.hash_uniform('draw', 'event_id')} AS u FROM events)
SELECT event_id, (SELECT min(shape) FROM c WHERE upto > u) AS shape FROM draws"""
)
def weighted_sample_replacement(spark: SparkSession, d: str) -> DataFrame:
    """One draw of a shape by weight, with replacement, for every event."""
    weights = spark.createDataFrame(list(_WEIGHTS.items()), "shape string, weight double")
    draws = corpus.table(spark, d, "events").select("event_id", T.hash_uniform("draw", F.col("event_id")).alias("u"))
    return sampling.weighted_with_replacement(weights, "shape", "weight", draws, "u").select("event_id", "shape")


@query(D.query(D.REC, body=f"SELECT record_id, CASE WHEN {D.hash_uniform('val', 'record_id')} < 0.05 THEN 'val' ELSE 'train' END AS side FROM rec"), per_row=True)
def train_val_split(spark: SparkSession, d: str) -> DataFrame:
    """Five in a hundred records for validation, by hash."""
    return corpus.records(spark, d).select("record_id", F.when(T.hash_uniform("val", F.col("record_id")) < 0.05, "val").otherwise("train").alias("side"))


_PHRASES = ("No issue found.", "The code is safe.", "Nothing to report.", "No finding.")


@query(D.query(D.REC, body=f"SELECT record_id, [{', '.join(D.lit(p) for p in _PHRASES)}][CAST(floor({D.hash_uniform('phrase', 'record_id')} * {len(_PHRASES)}) AS INT) + 1] AS phrase FROM rec"), per_row=True)
def phrase_choice(spark: SparkSession, d: str) -> DataFrame:
    """A wording for every record, chosen by hash."""
    at = F.floor(T.hash_uniform("phrase", F.col("record_id")) * len(_PHRASES)).cast("int")
    return corpus.records(spark, d).select("record_id", F.get(F.array(*map(F.lit, _PHRASES)), at).alias("phrase"))


@query("SELECT user_id, arg_max(event_id, (CAST(value AS DOUBLE), -event_id)) AS event_id FROM events WHERE value IS NOT NULL GROUP BY 1".replace("(CAST(value AS DOUBLE), -event_id)", "row(value, -event_id)"))
def best_of_n(spark: SparkSession, d: str) -> DataFrame:
    """The best-scored candidate of every group, the first among equals."""
    e = corpus.table(spark, d, "events").where("value is not null")
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


@query(D.query(D.REC, body=f"SELECT record_id, CASE WHEN {D.hash_uniform('flip', 'record_id')} < 0.2 THEN CASE label WHEN 'safe' THEN 'vuln' WHEN 'vuln' THEN 'safe' ELSE label END ELSE label END AS verdict FROM rec"), per_row=True)
def verdict_flip(spark: SparkSession, d: str) -> DataFrame:
    """Labels with a fifth of the verdicts flipped."""
    flipped = F.when(F.col("label") == "safe", "vuln").when(F.col("label") == "vuln", "safe").otherwise(F.col("label"))
    return corpus.records(spark, d).select("record_id", F.when(T.hash_uniform("flip", F.col("record_id")) < 0.2, flipped).otherwise(F.col("label")).alias("verdict"))


@query(
    D.query(
        D.PAIRS,
        "k AS (SELECT pair_id, sha256(vuln_code) AS h, cwe FROM pairs WHERE length(vuln_code) >= 60 AND language IN ('python', 'javascript', 'typescript'))",
        body="SELECT min(pair_id) AS pair_id FROM k GROUP BY h",
    )
)
def converter_dedup(spark: SparkSession, d: str) -> DataFrame:
    """First pair of each vulnerable code, after the size and language filters and before the CWE filter."""
    fits = (F.length("vuln_code") >= 60) & F.col("language").isin("python", "javascript", "typescript")
    return dedup.first_by_key(corpus.mapped(spark, d, "pairs", fits, F.sha2("vuln_code", 256).alias("h")), "h", ["pair_id"]).select("pair_id")


@query(D.query(D.FINDS, body="SELECT finding_id, substring(sha256(coalesce(file, '') || coalesce(cwe, '') || coalesce(unit, '')), 1, 16) AS print FROM finds"), per_row=True)
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint of every finding over its file, CWE and unit."""
    return corpus.findings(spark, d).select("finding_id", dedup.fingerprint(F.col("file"), F.col("cwe"), F.col("unit")).alias("print"))


@query(D.query(D.TASKS, body="SELECT task_no, 'shape1:' || source || ':' || substring(sha256(code), 1, 10) AS short_id FROM tasks WHERE code IS NOT NULL AND source IS NOT NULL"), per_row=True)
def short_ids(spark: SparkSession, d: str) -> DataFrame:
    """Task ids made from the hash of the code."""
    t = corpus.tasks(spark, d).where("code is not null and source is not null")
    return t.select("task_no", F.concat_ws(":", F.lit("shape1"), "source", dedup.fingerprint(F.col("code"), length=10)).alias("short_id"))


@query(
    D.query(
        D.TASKS,
        f"""u AS (SELECT min(task_no) AS task_no FROM tasks WHERE code IS NOT NULL GROUP BY {D.strip('code')}),
r AS (SELECT t.task_no, t.label, t.source, row_number() OVER (PARTITION BY t.label ORDER BY {D.hash_order('pool', 't.task_no')}) - 1 AS r FROM tasks t JOIN u USING (task_no) WHERE t.label IN ('safe', 'vuln')),
s AS (SELECT *, CASE WHEN label = 'safe' THEN r * 10 // 3 ELSE (r // 7) * 10 + [1, 2, 4, 5, 7, 8, 9][r % 7 + 1] END AS slot FROM r WHERE r < 300),
k AS (SELECT * FROM s ORDER BY slot LIMIT 300)""",
        body="SELECT concat_ws(':', 'shape1', source, CAST(row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS VARCHAR)) AS task_id, label, task_no FROM k",
    )
)
def ratio_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The first 300 generation tasks of a pool in which every prefix is 30 % safe, with ids by source."""
    pool = corpus.tasks(spark, d).select(F.col("task_no").alias("ord"), "code", "language", "label", "source")
    return generation.ratio_tasks(pool, 300, "shape1", "pool").select("task_id", "label", F.col("ord").alias("task_no"))


@query()
def balanced_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The first 60 located fixes, vulnerability types taking turns."""
    p = corpus.pairs(spark, d).where("vuln_type is not null")
    where = regions(p, "pair_id", "vuln_code", "fixed_code").withColumnRenamed("source", "region_source")
    return generation.balanced_tasks(p.join(where, "pair_id"), 60).select("pair_id", "vuln_type")


_FORM = D.lit(generation.VERDICT_FORM)


@query(
    D.query(
        D.TASKS,
        body=f"""SELECT task_no, sha256(concat_ws(chr(10), 'Analyse this ' || coalesce(language, 'code') || ' code for one vulnerability. Trace the data flow over its real names.',
  'A reviewer suspects ' || cwe || '.', '<SCAN>' || chr(10) || code || chr(10) || '</SCAN>', 'Answer in this form:' || chr(10) || {_FORM})) AS prompt_hash FROM tasks WHERE code IS NOT NULL""",
    ),
    per_row=True,
)
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Scan prompts of all tasks, as hashes."""
    t = corpus.tasks(spark, d).where("code is not null")
    return t.select("task_no", F.sha2(generation.scan_prompt(F.col("code"), F.col("language"), cwe=F.col("cwe")), 256).alias("prompt_hash"))


@query(D.query(D.FINDS, body="SELECT finding_id % 40 AS task, arg_max(finding_id, row(length(coalesce(trace, '')), -finding_id)) AS finding_id FROM finds GROUP BY 1"))
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate of every task by its score, the first among equals."""
    score = F.length(F.coalesce("trace", F.lit("")))
    f = corpus.mapped(spark, d, "findings", F.lit(True), (F.col("finding_id") % 40).alias("task"), F.col("finding_id").alias("n"), F.col("finding_id").alias("text"), score.alias("score"))
    return generation.best_candidate(f, "task", F.col("score")).withColumnRenamed("text", "finding_id")


@query(D.query(D.TASKS, body="SELECT task_no, CAST(least(task_no % 4 + 1, 3) AS INT) AS attempt, task_no % 4 < 3 AS kept FROM tasks WHERE code IS NOT NULL"))
def attempt_loop(spark: SparkSession, d: str) -> DataFrame:
    """Three attempts of a stand-in generator at every task, failed ones corrected; it passes at attempt task_no % 4 + 1."""
    named = F.concat_ws("\n", F.lit("task"), F.col("task_no").cast("string"))
    tasks = corpus.mapped(spark, d, "tasks", "code is not null", "task_no", generation.scan_prompt(named, F.lit("python")).alias("prompt"))
    check = lambda df: df.withColumn("failed", F.when(F.col("raw_text") == "pass", F.array().cast("array<string>")).otherwise(F.array(F.lit("cwe"))))
    made = generation.attempts(tasks, _third_time, check, 3, key="task_no")
    return made.select("task_no", "attempt", (F.size("failed") == 0).alias("kept"))


def _third_time(prompts: list[str]) -> list[str]:
    return ["pass" if p.count("was rejected") >= int(p.split("task\n")[1].split("\n")[0]) % 4 else "fail" for p in prompts]


@query(
    D.query(
        D.REC,
        body="""SELECT record_id, '<<<CALLER_CODE>>>' || chr(10) || usr || chr(10) || '<<<END_CALLER_CODE>>>' || chr(10) || chr(10) || '<think>' || chr(10) || label || chr(10) || '</think>' || chr(10) || chr(10)
  || 'status: needs_context' || chr(10) || 'open_refs:' || chr(10) || '  - ' || helper_fn || ' (' || source || ')' || chr(10) || 'partial_trace: user input from ' || shape || ' flows into ' || helper_fn || '(' || label
  || ') — verdict depends on ' || helper_fn || '''s implementation' || chr(10) AS answer FROM rec WHERE helper_fn IS NOT NULL AND usr IS NOT NULL AND label IS NOT NULL AND source IS NOT NULL AND shape IS NOT NULL""",
    ),
    per_row=True,
)
def templated_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers that wait for a helper, filled from the columns of records that name one."""
    r = corpus.records(spark, d).where("helper_fn is not null and usr is not null and label is not null and source is not null and shape is not null")
    answer = generation.context_answer(F.col("usr"), F.col("label"), F.col("helper_fn"), F.col("source"), F.col("shape"), F.col("label"))
    return r.select("record_id", answer.alias("answer"))
