"""Queries on predictions: gold answers against answers with flipped verdicts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import metrics as M
from lodestrata.operators import prediction as P
from lodestrata.operators import quality as Q
from lodestrata.plans import duck as D
from lodestrata.plans.registry import query
from lodestrata.sources import corpus
from lodestrata.staging import own_folder, stage

_PRED = f"""pred AS (SELECT record_id, shape, coalesce(language, 'unknown') AS language, {D.norm_label('label')} = 'vuln' AS vulnerable, {D.norm_label('label')} AS kind, cwes[1] AS primary_cwe,
  {D.prediction_status(D.field('status', 'answer'))} AS told, {D.first_cwe(D.last_field('cwe', 'answer'))} AS said_cwe, answer, usr, helper_fn, disposition, multi_hop, record_id % 5 = 0 AS flip FROM rec WHERE answer IS NOT NULL),
runs AS (SELECT *, 'gold' AS run, told AS status FROM pred UNION ALL SELECT *, 'flipped' AS run, CASE WHEN flip THEN CASE told WHEN 'confirmed' THEN 'safe' WHEN 'safe' THEN 'confirmed' ELSE told END ELSE told END AS status FROM pred),
scored AS (SELECT *, CASE WHEN status = 'confirmed' THEN CASE WHEN vulnerable THEN 'TP' ELSE 'FP' END WHEN status = 'safe' THEN CASE WHEN vulnerable THEN 'FN' ELSE 'TN' END ELSE 'MISS' END AS outcome FROM runs WHERE kind IN ('vuln', 'safe'))"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Every answer as the prediction of two runs: as it is, and with every fifth verdict flipped."""
    a = F.col("answer")
    told = corpus.mapped(
        spark, d, "records", "answer is not null", "shape", "disposition",
        F.coalesce("language", F.lit("unknown")).alias("language"),
        T.norm_label(F.col("label")).alias("kind"),
        F.get("cwes", 0).alias("primary_cwe"),
        T.prediction_status(T.field("status", a)).alias("told"),
        T.first_cwe(T.last_field("cwe", a)).alias("said_cwe"),
    )
    flipped = F.when(F.col("told") == "confirmed", "safe").when(F.col("told") == "safe", "confirmed").otherwise(F.col("told"))
    runs = F.array(
        F.struct(F.lit("gold").alias("run"), F.col("told").alias("status")),
        F.struct(F.lit("flipped").alias("run"), F.when(F.col("record_id") % 5 == 0, flipped).otherwise(F.col("told")).alias("status")),
    )
    return told.select("*", F.inline(runs)).withColumn("vulnerable", F.col("kind") == "vuln")


def scored(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).where("kind in ('vuln', 'safe')")
    return p.withColumn("outcome", M.outcome(F.col("vulnerable"), F.col("status")))


_COUNTS = ", ".join(f"CAST(count_if(outcome = '{c}') AS BIGINT) AS {c.lower()}" for c in M.CLASSES)
_RATES = (
    f"{D.ratio('fp', 'fp + tn')} AS fpr, {D.ratio('tp', 'tp + fn')} AS recall, {D.ratio('tp', 'tp + fp')} AS precision, "
    "CASE WHEN tp > 0 THEN 2.0 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) ELSE 0.0 END AS f1"
)


def _confusion(*groups: str, where: str = "TRUE") -> str:
    keys = ", ".join(groups)
    return D.query(D.REC, _PRED, f"n AS (SELECT {keys}, {_COUNTS} FROM scored WHERE {where} GROUP BY {keys})", body=f"SELECT {keys}, tp, fp, fn, tn, miss, {_RATES} FROM n")


@query(_confusion("run"))
def confusion_overall(spark: SparkSession, d: str) -> DataFrame:
    """Confusion matrix and rates of both runs."""
    return M.confusion(scored(spark, d), "outcome", "run")


@query(_confusion("run", "language"))
def confusion_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Confusion by language, all records."""
    return M.confusion(scored(spark, d), "outcome", "run", "language")


@query(_confusion("run", "primary_cwe", where="vulnerable AND primary_cwe IS NOT NULL"))
def confusion_by_cwe(spark: SparkSession, d: str) -> DataFrame:
    """Confusion by first CWE, vulnerable records only."""
    return M.confusion(scored(spark, d).where("vulnerable and primary_cwe is not null"), "outcome", "run", "primary_cwe")


@query(_confusion("run", "shape"))
def confusion_by_shape(spark: SparkSession, d: str) -> DataFrame:
    """Confusion by shape: every shape has a scorer."""
    return M.confusion(scored(spark, d), "outcome", "run", "shape")


@query(D.query(D.REC, _PRED, body=f"SELECT run, CAST(count(*) AS BIGINT) AS flagged, {D.ratio('count_if(said_cwe = primary_cwe)', 'count(*)')} AS cwe_accuracy FROM scored WHERE outcome = 'TP' GROUP BY 1"))
def cwe_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Share of true positives that name the first CWE."""
    tp = scored(spark, d).where("outcome = 'TP'")
    return tp.groupBy("run").agg(F.count("*").alias("flagged"), T.ratio(F.count_if(F.col("said_cwe") == F.col("primary_cwe")), F.count("*")).alias("cwe_accuracy"))


@query(
    D.query(
        D.REC, _PRED,
        body=f"""SELECT run, CAST(count(*) AS BIGINT) AS total, CAST(count_if(status IS NULL) AS BIGINT) AS parse_miss, {D.ratio("count_if(status = 'needs_context')", 'count(*)')} AS ask_rate,
  CAST(count_if(status IS NOT NULL AND status <> 'needs_context') AS BIGINT) AS guessed FROM runs WHERE shape = 'shape2' GROUP BY 1""",
    )
)
def ask_dont_guess(spark: SparkSession, d: str) -> DataFrame:
    """How often a record that lacks context is answered by asking for it."""
    p = predictions(spark, d).where("shape = 'shape2'")
    asked = F.count_if(F.col("status") == "needs_context")
    return p.groupBy("run").agg(
        F.count("*").alias("total"), F.count_if(F.col("status").isNull()).alias("parse_miss"), T.ratio(asked, F.count("*")).alias("ask_rate"), F.count_if(F.col("status") != "needs_context").alias("guessed")
    )


@query(
    D.query(
        D.REC, _PRED,
        f"""x AS (SELECT *, coalesce(disposition = 'confirm', FALSE) AS confirm FROM runs WHERE shape = 'shape3'),
y AS (SELECT *, CASE WHEN confirm THEN status = 'confirmed' ELSE status = 'safe' END AS ok FROM x WHERE status IS NOT NULL)""",
        body=f"""SELECT run, CAST(count(*) AS BIGINT) AS judged, {D.ratio("count_if(confirm AND ok)", "count_if(confirm AND status IN ('confirmed', 'safe'))")} AS confirm_accuracy,
  {D.ratio("count_if(NOT confirm AND ok)", "count_if(NOT confirm AND status IN ('confirmed', 'safe'))")} AS dismiss_accuracy FROM y GROUP BY 1""",
    )
)
def cross_file_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy on cross-file records, to confirm and to dismiss."""
    confirm = F.coalesce(F.col("disposition") == "confirm", F.lit(False))
    p = predictions(spark, d).where("shape = 'shape3' and status is not null").withColumn("confirm", confirm)
    ok = F.when(F.col("confirm"), F.col("status") == "confirmed").otherwise(F.col("status") == "safe")
    judged = F.col("status").isin("confirmed", "safe")
    return p.groupBy("run").agg(
        F.count("*").alias("judged"),
        T.ratio(F.count_if(F.col("confirm") & ok), F.count_if(F.col("confirm") & judged)).alias("confirm_accuracy"),
        T.ratio(F.count_if(~F.col("confirm") & ok), F.count_if(~F.col("confirm") & judged)).alias("dismiss_accuracy"),
    )


@query(
    D.query(
        D.REC,
        body=r"""SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(regexp_matches(answer, '(?i)executive_summary\s*:')) AS BIGINT) AS with_summary, CAST(count_if(regexp_matches(answer, '(?i)ranked_findings\s*:')) AS BIGINT) AS with_ranking,
  CAST(count_if(regexp_matches(lower(usr), '_v\d+\.')) AS BIGINT) AS with_duplicates FROM rec WHERE shape = 'shape4' AND answer IS NOT NULL""",
    )
)
def synthesis_structure(spark: SparkSession, d: str) -> DataFrame:
    """Structure of synthesis answers."""
    a = F.col("answer")
    flags = {
        "with_summary": a.rlike(r"(?i)executive_summary\s*:"),
        "with_ranking": a.rlike(r"(?i)ranked_findings\s*:"),
        "with_duplicates": F.lower("usr").rlike(r"_v\d+\."),
    }
    r = corpus.mapped(spark, d, "records", "shape = 'shape4' and answer is not null", *[c.alias(name) for name, c in flags.items()])
    return r.agg(F.count("*").alias("total"), *[F.count_if(name).alias(name) for name in flags])


@query(per_row=True)
def ranked_findings(spark: SparkSession, d: str) -> DataFrame:
    """Ranked findings of synthesis answers, and whether their severities fall (checked on fixtures in the tests)."""
    r = corpus.records(spark, d).where("shape = 'shape4' and answer is not null").select("record_id", Q.ranked_findings(F.col("answer")).alias("ranked"))
    return r.select("record_id", F.size("ranked").alias("n"), Q.severities_fall(F.transform("ranked", lambda x: x["severity"])).alias("falls"))


@query(D.query(D.REC, _PRED, f"n AS (SELECT run, {_COUNTS} FROM scored GROUP BY run)", f"m AS (SELECT run, tp, fp, fn, tn, miss, {_RATES} FROM n)",
    body="SELECT run, metric, CAST(value AS DOUBLE) AS value FROM (SELECT run, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tn AS DOUBLE) AS tn, CAST(miss AS DOUBLE) AS miss, CAST(fpr AS DOUBLE) AS fpr, CAST(recall AS DOUBLE) AS recall, CAST(precision AS DOUBLE) AS precision, CAST(f1 AS DOUBLE) AS f1 FROM m) UNPIVOT (value FOR metric IN (tp, fp, fn, tn, miss, fpr, recall, precision, f1))"))
def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of both runs as rows."""
    return M.long_form(M.confusion(scored(spark, d), "outcome", "run"), ["run"])


@query(
    D.query(
        D.REC, _PRED, f"n AS (SELECT run, shape, {_COUNTS} FROM scored GROUP BY run, shape)", f"m AS (SELECT run, shape, {_RATES} FROM n)",
        "l AS (SELECT run, shape, metric, value FROM (SELECT run, shape, CAST(fpr AS DOUBLE) AS fpr, CAST(recall AS DOUBLE) AS recall FROM m) UNPIVOT (value FOR metric IN (fpr, recall)))",
        body="""SELECT shape, metric, a.value AS before, b.value AS after, b.value - a.value AS delta,
  CASE WHEN (CASE WHEN contains(metric, 'fpr') THEN a.value - b.value ELSE b.value - a.value END) > 1e-9 THEN '+' WHEN (CASE WHEN contains(metric, 'fpr') THEN a.value - b.value ELSE b.value - a.value END) < -1e-9 THEN '-' ELSE '~' END AS direction
FROM (SELECT * FROM l WHERE run = 'gold') a FULL OUTER JOIN (SELECT * FROM l WHERE run = 'flipped') b USING (shape, metric)""",
    )
)
def compare_runs_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """Change of false-positive rate and recall from one run to the other, by shape."""
    rows = M.long_form(M.confusion(scored(spark, d), "outcome", "run", "shape").select("run", "shape", "fpr", "recall"), ["run", "shape"])
    side = lambda name: rows.where(F.col("run") == name).drop("run")
    return M.compare(side("gold"), side("flipped"), ["shape"], ("fpr",))


@query(
    D.query(
        D.REC,
        f"picked AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY {D.hash_order('judge', 'record_id')}) AS r FROM rec WHERE answer IS NOT NULL AND shape IS NOT NULL)",
        "scores AS (SELECT shape, unnest(['fix_quality', 'reasoning_faithfulness']) AS criterion, unnest([CASE WHEN f = '' THEN NULL ELSE length(f) % 5 + 1 END, length(answer) % 5 + 1]) AS score FROM (SELECT *, "
        + D.field("fix", "answer")
        + " AS f FROM picked WHERE r <= 10))",
        body="SELECT shape, criterion, CAST(count(score) AS BIGINT) AS judged, avg(score) AS mean FROM scores WHERE score IS NOT NULL GROUP BY ALL",
    )
)
def judge_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean scores by criterion over the replies that a stand-in judge gives on ten records of each shape."""
    fix = T.field("fix", F.col("answer"))
    scores = F.struct(F.when(fix != "", F.length(fix) % 5 + 1).alias("fix_quality"), (F.length("answer") % 5 + 1).alias("reasoning_faithfulness"))
    reply = F.concat(F.lit("My scores are:\n"), F.to_json(scores), F.lit("\nThey are final."))
    rec = corpus.mapped(spark, d, "records", "answer is not null and shape is not null", "shape", T.hash_order("judge", F.col("record_id")).alias("ord"), reply.alias("reply"))
    return P.judge_means(rec, 10)


@query(
    D.query(
        D.REC, _PRED, f"n AS (SELECT run, {_COUNTS} FROM scored GROUP BY run)",
        body=f"SELECT run, {D.percent('tp + tn', 'tp + fp + fn + tn + miss')} AS accuracy, {D.percent('fp', 'fp + tn')} AS fpr, {D.percent('fn', 'fn + tp')} AS fnr, {D.percent('tp + fp + fn + tn', 'tp + fp + fn + tn + miss')} AS parsed FROM n",
    )
)
def smoke_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Whole percents of accuracy, error rates and parsed answers."""
    c = M.confusion(scored(spark, d), "outcome", "run")
    tp, fp, fn, tn, miss = (F.col(x) for x in ("tp", "fp", "fn", "tn", "miss"))
    judged = tp + fp + fn + tn
    return c.select("run", T.percent(tp + tn, judged + miss).alias("accuracy"), T.percent(fp, fp + tn).alias("fpr"), T.percent(fn, fn + tp).alias("fnr"), T.percent(judged, judged + miss).alias("parsed"))


def _items_sql(header: str) -> str:
    block = rf"regexp_extract(answer, '(?i){header}\s*:\s*\n((?:\s*-\s*[^\n]+\n?)+)', 1)"
    return f"CAST(len(list_filter(string_split({block}, chr(10)), lambda x: starts_with({D.strip('x')}, '-'))) AS INT)"


_STATED = D.prediction_status(f"nullif({D.field('status', 'answer')}, '')")


@query(
    D.query(
        D.REC,
        body=rf"""SELECT record_id, CASE WHEN shape IS NULL OR shape = 'shape4' THEN NULL ELSE {_STATED} END AS status,
  CASE WHEN shape = 'shape2' THEN {_items_sql('open_refs')} END AS open_refs, CASE WHEN shape = 'shape3' THEN {_items_sql('follow_up_refs')} END AS follow_ups,
  CASE WHEN shape = 'shape4' THEN CAST(len(list_filter(regexp_split_to_array(regexp_extract(answer, '(?is)(?:^|\n)[^\n]*?ranked_findings\s*:\s*\n(.*)', 1), '(?:^|\n)\s*-\s*rank\s*:\s*'),
    lambda x: regexp_matches(x, '^\s*\d') AND regexp_matches(x, '(?im)title\s*:\s*\S'))) AS INT) END AS ranked FROM rec WHERE answer IS NOT NULL""",
    ),
    per_row=True,
)
def parse_by_shape(spark: SparkSession, d: str) -> DataFrame:
    """Every answer under the parser of its shape (checked on fixtures in the tests)."""
    rec = corpus.records(spark, d).where("answer is not null")
    p = P.parsed(F.col("shape"), F.col("answer"))
    return rec.select("record_id", "shape", p.alias("p")).select(
        "record_id",
        F.coalesce("p.shape1.status", "p.shape2.status", "p.shape3.status").alias("status"),
        F.size("p.shape2.open_refs").alias("open_refs"),
        F.size("p.shape3.follow_up_refs").alias("follow_ups"),
        F.size("p.shape4.ranked").alias("ranked"),
    )


@query()
def synthesis_scores(spark: SparkSession, d: str) -> DataFrame:
    """Structural scores of synthesis answers."""
    scores = P.synthesis_scores(F.col("answer"), F.col("usr"))
    rec = corpus.mapped(spark, d, "records", "shape = 'shape4' and answer is not null", scores.alias("s")).select("s.*")
    return rec.agg(F.count("*").alias("total"), *[F.count_if(c).alias(c) for c in rec.columns])


_KEY = "sha256('stub' || chr(0) || shape || chr(0) || usr)"
_ASKED = f"asked AS (SELECT DISTINCT {_KEY} AS key FROM rec WHERE split = 'eval' AND usr IS NOT NULL AND shape IS NOT NULL)"


@query(D.query(D.REC, _ASKED, body="SELECT key, 'status: safe' AS raw_text, TRUE AS kept FROM asked"))
def predicted_resumably(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a stand-in predictor that broke off after half of the questions and went on later."""
    key = P.cache_key("stub", F.col("shape"), F.col("usr"))
    asked = corpus.mapped(spark, d, "records", "split = 'eval' and usr is not null and shape is not null", key.alias("key"), F.col("usr").alias("prompt"))
    path = f"{own_folder(spark)}/answers-{uuid.uuid4().hex}"
    # what the first run wrote is set aside before the second one adds to the table
    before = stage(P.predict_resumable(asked.where("key < '8'"), _stub, path), "answers").withColumnRenamed("raw_text", "before")
    after = P.predict_resumable(asked, _stub, path)
    return after.join(before, "key", "left").select("key", "raw_text", F.coalesce(F.col("raw_text") == F.col("before"), F.lit(True)).alias("kept"))


@query(D.query(D.REC, _ASKED, body="SELECT key, CASE WHEN key < '4' THEN 'cached' ELSE 'status: safe' END AS raw_text FROM asked"))
def predicted_with_cache(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a stand-in predictor for every evaluation question, cached ones not predicted again."""
    key = P.cache_key("stub", F.col("shape"), F.col("usr"))
    asked = corpus.mapped(spark, d, "records", "split = 'eval' and usr is not null and shape is not null", key.alias("key"), F.col("usr").alias("prompt"))
    prompts = asked.select("key", "prompt").dropDuplicates(["key"])
    cached = prompts.where("key < '4'").select("key", F.lit("cached").alias("raw_text"))
    return P.predict(prompts, _stub, cached)


def _stub(prompts: list[str]) -> list[str]:
    return ["status: safe" for _ in prompts]


_STATUS = lambda x: D.prediction_status(f"nullif({D.field('status', x)}, '')")
_TURN = rf"""CASE WHEN {D.hash_uniform('perturb', 'record_id')} >= 0.2 THEN answer
  WHEN {_STATUS('answer')} = 'confirmed' THEN regexp_replace(answer, '(?im)^(\s*status\s*:\s*)(?:confirmed|vuln\w*)\b', '\1 safe', 'g')
  ELSE regexp_replace(answer, '(?im)^(\s*status\s*:\s*)(?:safe|clean)\b', '\1 confirmed', 'g') END"""


@query(
    D.query(
        D.REC,
        f"turned AS (SELECT answer, {_TURN} AS t FROM rec WHERE answer IS NOT NULL)",
        body=f"SELECT {_STATUS('answer')} AS before, {_STATUS('t')} AS after, CAST(count(*) AS BIGINT) AS n FROM turned GROUP BY ALL",
    )
)
def perturbed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers with the verdict of about a fifth turned around: statuses before and after."""
    turned = P.perturbed(F.col("answer"), 0.2, "perturb", F.col("record_id"))
    status = lambda c: T.prediction_status(T.nonempty(T.field("status", c)))
    rec = corpus.mapped(spark, d, "records", "answer is not null", status(F.col("answer")).alias("before"), status(turned).alias("after"))
    return rec.groupBy("before", "after").agg(F.count("*").alias("n"))
