"""Queries on projections and scalar functions of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import dims
from lodestrata.functions import text as T
from lodestrata.operators import traces
from lodestrata.plans import duck as D
from lodestrata.plans.registry import query
from lodestrata.sources import corpus


@query(D.query(D.REC, body="SELECT record_id, sha256(usr) AS user_hash, CAST(length(answer) AS BIGINT) AS answer_chars FROM rec WHERE usr IS NOT NULL AND answer IS NOT NULL AND len(messages) >= 2"), per_row=True)
def first_user_assistant(spark: SparkSession, d: str) -> DataFrame:
    """First user and assistant content of records that have both."""
    rec = corpus.records(spark, d).where("usr is not null and answer is not null and size(messages) >= 2")
    return rec.select("record_id", F.sha2("usr", 256).alias("user_hash"), F.length("answer").cast("bigint").alias("answer_chars"))


@query(D.query(D.REC, body="SELECT record_id, messages[1].role AS role_0, CAST(length(messages[1].content) AS BIGINT) AS chars_0, messages[2].role AS role_1, CAST(length(messages[2].content) AS BIGINT) AS chars_1 FROM rec"), per_row=True)
def positional_messages(spark: SparkSession, d: str) -> DataFrame:
    """Role and size of the first two messages by position."""
    rec = corpus.records(spark, d)
    at = [(F.get("messages", i), i) for i in (0, 1)]
    return rec.select("record_id", *[c for m, i in at for c in (m["role"].alias(f"role_{i}"), F.length(m["content"]).cast("bigint").alias(f"chars_{i}"))])


@query(D.query(D.REC, body="SELECT record_id, [m.content for m in messages if m.role = 'user' and trim(coalesce(m.content, ''), ' ') <> ''][1] IS NOT NULL AS has_user, CAST(length([m.content for m in messages if m.role = 'assistant' and trim(coalesce(m.content, ''), ' ') <> ''][1]) AS BIGINT) AS answer_chars FROM rec"), per_row=True)
def first_nonempty_turns(spark: SparkSession, d: str) -> DataFrame:
    """First non-empty user and assistant turns of a conversation."""

    def first(role: str):
        return F.get(F.filter("messages", lambda m: (m["role"] == role) & (F.trim(F.coalesce(m["content"], F.lit(""))) != "")), 0)["content"]

    return corpus.records(spark, d).select(
        "record_id", first("user").isNotNull().alias("has_user"), F.length(first("assistant")).cast("bigint").alias("answer_chars")
    )


@query(
    D.query(
        D.REC,
        body=f"""SELECT 'r' || record_id AS id, shape, coalesce({D.lookup(dims.TIERS, 'shape')}, 'other') AS tier, source, language, label, cwe, oracle,
  sha256(messages[1].content) AS prompt_hash, sha256(messages[2].content) AS reasoning_hash FROM rec WHERE len(messages) >= 2""",
    ), per_row=True)
def flat_traces(spark: SparkSession, d: str) -> DataFrame:
    """Records flattened to traces, with the quality tier of their shape."""
    return traces.flatten(corpus.records(spark, d)).select(
        "id", "shape", "tier", "source", "language", "label", "cwe", "oracle", F.sha2("prompt", 256).alias("prompt_hash"), F.sha2("current_reasoning", 256).alias("reasoning_hash")
    )


@query(
    D.query(
        D.REC,
        body="""SELECT 'r' || record_id AS id, coalesce(improved, FALSE) AND messages[2].content IS NOT NULL AS was_improved,
  sha256(coalesce(CASE WHEN improved THEN '+ ' || messages[2].content END, messages[2].content)) AS answer_hash FROM rec WHERE len(messages) >= 2""",
    ), per_row=True)
def rebuild_records(spark: SparkSession, d: str) -> DataFrame:
    """Records rebuilt from traces, with the improved reasoning where there is one (a marked copy stands for it)."""
    flat = traces.flatten(corpus.records(spark, d)).withColumn("improved_reasoning", F.when(F.col("improved"), F.concat(F.lit("+ "), F.col("current_reasoning"))))
    built = traces.rebuild(flat)
    return built.select("id", F.col("_meta.improved").alias("was_improved"), F.sha2(F.get("messages", 1)["content"], 256).alias("answer_hash"))


@query(D.query(D.REC, body=f"SELECT record_id, nullif(regexp_extract(usr, '<(SCAN|GENERATE|EXPLAIN|SYNTHESIZE)>', 1), '') AS task_tag, sha256({D.scan_code('usr')}) AS code_hash FROM rec"), per_row=True)
def task_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Task tag and tagged code of every question."""
    return corpus.records(spark, d).select("record_id", T.task_tag(F.col("usr")).alias("task_tag"), F.sha2(T.scan_code(F.col("usr")), 256).alias("code_hash"))


@query(D.query(D.TASKS, body=f"SELECT {D.detect_language('code')} AS detected, language, CAST(count(*) AS BIGINT) AS n FROM tasks WHERE code IS NOT NULL GROUP BY ALL"))
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    """Detected against stated language of the generation tasks."""
    tasks = corpus.mapped(spark, d, "tasks", "code is not null", T.detect_language(F.col("code")).alias("detected"), "language")
    return tasks.groupBy("detected", "language").agg(F.count("*").alias("n"))


@query(D.query(D.PAIRS, body="SELECT pair_id, CASE WHEN contains(language, 'javascript') OR language = 'js' THEN 'javascript' WHEN contains(language, 'python') OR language = 'py' THEN 'python' ELSE coalesce(language, '') END AS language FROM pairs"), per_row=True)
def language_alias(spark: SparkSession, d: str) -> DataFrame:
    """Language aliases to one name."""
    return corpus.pairs(spark, d).select("pair_id", traces.normal_language(F.col("language")).alias("language"))


@query(
    D.query(
        D.FINDS,
        body=f"SELECT {D.extension_language('file', dims.PATCH_EXTENSIONS)} AS patch_language, {D.extension_language('file', dims.SCAN_EXTENSIONS)} AS scan_language, CAST(count(*) AS BIGINT) AS n FROM finds GROUP BY ALL",
    )
)
def extension_languages(spark: SparkSession, d: str) -> DataFrame:
    """Findings by the language of their file's extension, under both tables."""
    f = corpus.findings(spark, d)
    return f.groupBy(
        T.extension_language(F.col("file"), dims.PATCH_EXTENSIONS).alias("patch_language"), T.extension_language(F.col("file"), dims.SCAN_EXTENSIONS).alias("scan_language")
    ).agg(F.count("*").alias("n"))


@query(D.query(D.PAIRS, body=f"SELECT pair_id, {D.loose_cwe('cwe')} AS loose, {D.first_cwe('cwe')} AS strict FROM pairs"), per_row=True)
def cwe_normalize(spark: SparkSession, d: str) -> DataFrame:
    """CWE ids in the loose and the strict reading."""
    return corpus.pairs(spark, d).select("pair_id", T.loose_cwe(F.col("cwe")).alias("loose"), T.first_cwe(F.col("cwe")).alias("strict"))


@query(
    D.query(
        D.PAIRS,
        body=f"SELECT vuln_type, {D.type_to_cwe('replace(vuln_type, chr(95), chr(32))')} AS by_substring, {D.lookup(dims.TYPE_EXACT_CWE, 'replace(vuln_type, chr(95), chr(32))')} AS by_name, CAST(count(*) AS BIGINT) AS n FROM pairs GROUP BY ALL",
    )
)
def type_to_cwe(spark: SparkSession, d: str) -> DataFrame:
    """CWE of a free-text type: by contained name, and by exact name."""
    spoken = F.replace(F.col("vuln_type"), F.lit("_"), F.lit(" "))
    return corpus.pairs(spark, d).groupBy("vuln_type", T.type_to_cwe(spoken).alias("by_substring"), dims.lookup(dims.TYPE_EXACT_CWE, spoken).alias("by_name")).agg(F.count("*").alias("n"))


@query(
    D.query(
        D.REC,
        body=rf"""SELECT record_id, CASE WHEN length(CASE WHEN {D.any_contains('lower(t)', dims.PLACEHOLDER_TITLES)} THEN '' ELSE t END) >= 20 THEN left(t, 80)
  WHEN cwes[1] IS NOT NULL THEN cwes[1] || ' finding' ELSE 'Vulnerability finding' END AS title,
  coalesce(nullif(upper(regexp_extract(answer, '(?im)^\s*severity\s*:\s*(HIGH|MEDIUM|LOW)\s*$', 1)), ''), 'MEDIUM') AS severity
FROM (SELECT *, {D.field('trace', 'answer')} AS t FROM rec WHERE answer IS NOT NULL)""",
    ), per_row=True)
def short_titles(spark: SparkSession, d: str) -> DataFrame:
    """Title and severity that a trace gives a finding."""
    rec = corpus.records(spark, d).where("answer is not null")
    return rec.select("record_id", traces.short_title(F.col("answer"), F.col("cwes")).alias("title"), traces.severity_of(F.col("answer")).alias("severity"))


@query(rf"""SELECT owner_repo, regexp_extract(patch_file, '([^/]+)$', 1) AS file, nullif(regexp_extract(patch_file, '([0-9a-f]{{40}})', 1), '') AS commit_sha FROM harvest_targets""")
def patch_names(spark: SparkSession, d: str) -> DataFrame:
    """Base name and commit in the names of patch files."""
    t = corpus.table(spark, d, "harvest_targets")
    return t.select("owner_repo", F.regexp_extract("patch_file", r"([^/]+)$", 1).alias("file"), T.nonempty(F.regexp_extract("patch_file", r"([0-9a-f]{40})", 1)).alias("commit_sha"))


@query(D.query(D.FINDS, body="SELECT finding_id, CAST(coalesce(finding_id % 50 + 1 + line - 1, finding_id % 50 + 1) AS BIGINT) AS absolute_line FROM finds"), per_row=True)
def absolute_lines(spark: SparkSession, d: str) -> DataFrame:
    """Snippet-relative to file lines, the snippet's start where there is none."""
    start = F.col("finding_id") % 50 + 1
    return corpus.findings(spark, d).select("finding_id", F.coalesce(start + F.col("line") - 1, start).cast("bigint").alias("absolute_line"))


@query(D.query(D.TASKS, body="SELECT task_no, array_to_string(list_slice(string_split(code, chr(10)), greatest(1, CAST(task_no % 12 + 1 AS INT) - 4), CAST(task_no % 12 + 1 AS INT) + 4), chr(10)) AS context FROM tasks WHERE code IS NOT NULL"), per_row=True)
def context_windows(spark: SparkSession, d: str) -> DataFrame:
    """Four lines around a line of the code."""
    line = (F.col("task_no") % 12 + 1).cast("int")
    return corpus.tasks(spark, d).where("code is not null").select("task_no", traces.context_lines(F.col("code"), line, 4, 4).alias("context"))


@query(D.query(D.TASKS, body="SELECT label, label IN ('1', 'vulnerable', 'vuln', 'yes', 'true') AS vulnerable, CAST(count(*) AS BIGINT) AS n FROM tasks GROUP BY ALL"))
def label_decode(spark: SparkSession, d: str) -> DataFrame:
    """Permissive decoding of raw labels."""
    return corpus.tasks(spark, d).groupBy("label", traces.is_vulnerable(F.col("label")).alias("vulnerable")).agg(F.count("*").alias("n"))


@query(D.query(D.FINDS, body="SELECT finding_id, sha256(think) AS good, sha256(trace) AS bad FROM finds WHERE trim(coalesce(trace, '')) <> ''"), per_row=True)
def preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Good and bad reasoning side by side, where there is a bad one."""
    f = corpus.findings(spark, d).where(F.trim(F.coalesce("trace", F.lit(""))) != "")
    return f.select("finding_id", F.sha2("think", 256).alias("good"), F.sha2("trace", 256).alias("bad"))


_PARSED = ", ".join(f"{D.last_field(n, 'body')} AS {n}" for n in ("severity", "line", "trace", "fix"))


@query(
    D.query(
        D.REC,
        f"b AS (SELECT record_id, answer, {D.after_think('answer')} AS body FROM rec WHERE answer IS NOT NULL)",
        body=f"""SELECT record_id, {D.strip(D.think('answer'))} AS think, {D.verdict_status(D.last_field('status', 'body'))} AS status, {D.first_cwe(D.last_field('cwe', 'body'))} AS cwe, {_PARSED} FROM b""",
    ), per_row=True)
def parse_verdict_fields(spark: SparkSession, d: str) -> DataFrame:
    """Thought and six fields of every verdict; the last of repeated fields counts."""
    rec = corpus.records(spark, d).where("answer is not null")
    return rec.select("record_id", T.parse_verdict(F.col("answer")).alias("v")).select("record_id", "v.*")


@query(
    D.query(
        D.REC,
        body=f"""SELECT record_id, {D.prediction_status(D.field('status', 'answer'))} AS status, {D.first_cwe(D.last_field('cwe', 'answer'))} AS cwe,
  upper({D.last_field('severity', 'answer')}) AS severity FROM rec WHERE answer IS NOT NULL""",
    ), per_row=True)
def parse_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Status (of the first field), CWE and severity of every prediction."""
    a = F.col("answer")
    return corpus.records(spark, d).where("answer is not null").select(
        "record_id", T.prediction_status(T.field("status", a)).alias("status"), T.first_cwe(T.last_field("cwe", a)).alias("cwe"), F.upper(T.last_field("severity", a)).alias("severity")
    )


@query(D.query(D.TASKS, body=f"SELECT task_no, {D.identifiers('code')} AS names FROM tasks WHERE code IS NOT NULL"), per_row=True)
def identifier_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Identifier-like tokens of every task's code."""
    return corpus.tasks(spark, d).where("code is not null").select("task_no", T.identifiers(F.col("code")).alias("names"))


@query(
    D.query(
        D.PAIRS,
        f"n AS (SELECT pair_id, {D.identifiers('vuln_code')} AS a, {D.identifiers('fixed_code')} AS b FROM pairs WHERE vuln_code IS NOT NULL AND fixed_code IS NOT NULL)",
        body="""SELECT pair_id, list_sort(list_distinct(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x))))) AS changed,
  CAST(len(list_intersect(a, b)) AS BIGINT) AS common FROM n""",
    ), per_row=True)
def identifier_differences(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers on one side of a fix only, and the number on both."""
    p = corpus.pairs(spark, d).where("vuln_code is not null and fixed_code is not null")
    p = p.select("pair_id", T.identifiers(F.col("vuln_code")).alias("a"), T.identifiers(F.col("fixed_code")).alias("b"))
    return p.select(
        "pair_id",
        F.array_sort(F.array_union(F.array_except("a", "b"), F.array_except("b", "a"))).alias("changed"),
        F.size(F.array_intersect("a", "b")).cast("bigint").alias("common"),
    )


@query(D.query(D.PAIRS, body=f"SELECT pair_id, {D.classify('vuln_code')} AS vuln_type, {D.classify('vuln_code', 'cwe')} AS cwe FROM pairs WHERE vuln_code IS NOT NULL"), per_row=True)
def classify_types(spark: SparkSession, d: str) -> DataFrame:
    """Vulnerability type of every vulnerable code by the first matching pattern."""
    return corpus.pairs(spark, d).where("vuln_code is not null").select("pair_id", T.classify(F.col("vuln_code")).alias("c")).select("pair_id", "c.*")


@query(f"SELECT doc_id, regexp_matches(text, {D.lit('(?i)' + dict((t[0], t[2]) for t in dims.TAXONOMY)['hardcoded_secret'])}) AS has_secret FROM documents WHERE text IS NOT NULL")
def secret_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents with hard-coded secrets."""
    pattern = next(p for name, _, p in dims.TAXONOMY if name == "hardcoded_secret")
    return corpus.documents(spark, d).where("text is not null").select("doc_id", F.col("text").rlike("(?i)" + pattern).alias("has_secret"))


@query(
    D.query(
        D.REC,
        body=rf"""SELECT record_id, CASE WHEN n > 20 AND (vuln OR TRUE) THEN h ELSE '' END AS head FROM (
  SELECT record_id, TRUE AS vuln, regexp_extract({D.strip(D.think('answer'))}, '^[\s\d.)*-]*([^.!?]*)', 1) AS h, length(regexp_extract({D.strip(D.think('answer'))}, '^[\s\d.)*-]*([^.!?]*)', 1)) AS n FROM rec WHERE {D.think('answer')} IS NOT NULL)""",
    ), per_row=True)
def trace_heads(spark: SparkSession, d: str) -> DataFrame:
    """The first clause of a thought after its list marks, '' where it is short."""
    rec = corpus.records(spark, d).select("record_id", T.strip(T.think(F.col("answer"))).alias("t")).where("t is not null")
    head = F.regexp_extract("t", r"^[\s\d.)*-]*([^.!?]*)", 1)
    return rec.select("record_id", F.when(F.length(head) > 20, head).otherwise("").alias("head"))


@query(
    D.query(
        D.REC,
        body=r"""SELECT record_id, trim(regexp_replace(regexp_replace(answer, '(?i)</?\s*(thinking|think|reasoning|analysis)\s*>', '', 'g'), '^\s*(?i:reasoning|analysis|answer)\s*:\s*', ''), chr(10) || chr(13) || chr(9) || ' ') AS cleaned FROM rec WHERE answer IS NOT NULL""",
    ), per_row=True)
def clean_reasoning(spark: SparkSession, d: str) -> DataFrame:
    """Answers without wrapper tags and lead-in words."""
    rec = corpus.records(spark, d).where("answer is not null")
    return rec.select("record_id", F.trim(traces.clean_reasoning(F.col("answer")), F.lit("\n\r\t ")).alias("cleaned"))


@query(D.query(D.REC, body=r"""SELECT record_id, CASE WHEN regexp_full_match(v, '\d{1,4}') THEN 'CWE-' || v WHEN regexp_matches(v, '(?i)CWE-\d+') THEN upper(regexp_extract(v, '(?i)CWE-\d+')) ELSE v END AS cwe FROM (SELECT record_id, regexp_replace(""" + D.field("cwe", "replace(answer, '-', chr(8209))") + r""", '[\x{2010}-\x{2015}\x{2212}]', '-', 'g') AS v FROM rec WHERE answer IS NOT NULL)"""), per_row=True)
def hyphen_cwe(spark: SparkSession, d: str) -> DataFrame:
    """CWE fields written with typographic hyphens, made plain again."""
    rec = corpus.records(spark, d).where("answer is not null").withColumn("a", F.replace("answer", F.lit("-"), F.lit("‑")))
    return rec.select("record_id", traces.plain_cwe(T.field("cwe", F.col("a"))).alias("cwe"))


@query(D.query(D.REC, body=f"""SELECT record_id, CASE WHEN length(answer) < 300 OR {D.think('answer')} IS NULL THEN 0.0 ELSE len(regexp_extract_all(answer, '`[^`]{{3,40}}`')) * 1.5 - {D.phrase_count('answer', dims.CANDIDATE_GENERIC)} * 2.0 END AS score FROM rec WHERE answer IS NOT NULL"""), per_row=True)
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    """Quick specificity of an answer: quoted names against generic phrases."""
    return corpus.records(spark, d).where("answer is not null").select("record_id", traces.candidate_score(F.col("answer")).alias("score"))


@query("SELECT event_id, CASE WHEN contains(props, '{') AND contains(props, '}') THEN json_extract_string('{' || regexp_extract('x ' || props || ' y', '(?s)\\{(.*)\\}', 1) || '}', '$.' || json_keys(props)[1]) END AS first_value FROM events")
def json_rescue(spark: SparkSession, d: str) -> DataFrame:
    """A value of the JSON object within surrounding text."""
    e = corpus.table(spark, d, "events")
    body = traces.rescue_json(F.concat(F.lit("x "), F.col("props"), F.lit(" y")))
    key = F.get(F.json_object_keys("props"), 0)
    return e.select("event_id", F.try_element_at(F.from_json(body, "map<string,string>"), key).alias("first_value"))
