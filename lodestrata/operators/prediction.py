"""Parsing generated answers by shape, and predictors as pluggable functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import quality as Q
from lodestrata.operators import sampling
from lodestrata.staging import stage


def parse_shape1(answer: Column) -> Column:
    value = lambda name: T.nonempty(T.field(name, answer))
    return F.struct(
        T.strip(T.think(answer)).alias("think"),
        T.prediction_status(value("status")).alias("status"),
        T.first_cwe(T.last_field("cwe", answer)).alias("cwe"),
        F.upper(T.last_field("severity", answer)).alias("severity"),
        T.last_field("trace", answer).alias("trace"),
        T.last_field("fix", answer).alias("fix"),
    )


def parse_shape2(answer: Column) -> Column:
    return F.struct(
        T.strip(T.think(answer)).alias("think"), T.prediction_status(T.nonempty(T.field("status", answer))).alias("status"), Q.list_items(answer, "open_refs").alias("open_refs")
    )


def parse_shape3(answer: Column) -> Column:
    first = parse_shape1(answer)
    return F.struct(*[first[c].alias(c) for c in ("think", "status", "cwe", "severity", "trace", "fix")], Q.list_items(answer, "follow_up_refs").alias("follow_up_refs"))


def parse_shape4(answer: Column) -> Column:
    summary = T.nonempty(T.strip(F.regexp_extract(answer, r"(?is)executive_summary\s*:\s*(.+?)(?=\n\s*ranked_findings|\z)", 1)))
    return F.struct(
        T.strip(T.think(answer)).alias("think"),
        summary.alias("executive_summary"),
        Q.ranked_findings(answer).alias("ranked"),
        Q.list_items(answer, "systemic_observations").alias("systemic"),
    )


def parsed(shape: Column, answer: Column) -> Column:
    """Struct of all parsers' fields; a shape without a parser of its own is read as shape 1."""
    return F.struct(
        F.when(~shape.isin("shape2", "shape3", "shape4"), parse_shape1(answer)).alias("shape1"),
        F.when(shape == "shape2", parse_shape2(answer)).alias("shape2"),
        F.when(shape == "shape3", parse_shape3(answer)).alias("shape3"),
        F.when(shape == "shape4", parse_shape4(answer)).alias("shape4"),
    )


def synthesis_scores(answer: Column, user: Column) -> Column:
    """Structure of a synthesis: well formed, falling severities, known titles, duplicates noted."""
    p = parse_shape4(answer)
    low = F.lower(user)
    readable = p["think"].isNotNull() & p["executive_summary"].isNotNull()
    ranked = p["ranked"]
    some = F.size(ranked) > 0
    notes = F.lower(T.strip(F.regexp_extract(answer, r"(?imd)dedup_notes\s*:\s*(.+?)$", 1)))
    return F.struct(
        readable.alias("readable"),
        (readable & some).alias("well_formed"),
        (readable & some & Q.severities_fall(F.transform(ranked, lambda r: r["severity"]))).alias("severity_falls"),
        (readable & some & F.forall(ranked, lambda r: F.contains(low, F.lower(F.substring(r["title"], 1, 30))))).alias("titles_known"),
        (readable & low.rlike(r"_v\d+\.") & ~notes.isin("", "none")).alias("duplicates_noted"),
    )


def predict(prompts: DataFrame, function: Callable[[list[str]], list[str]], cached: DataFrame | None = None, key: str = "key", prompt: str = "prompt") -> DataFrame:
    """``key`` and raw_text of every prompt: cached where there is a value, else from ``function``.

    ``function`` maps a list of prompts to answers and runs on the executors,
    batch by batch. Keys carry the predictor's name, so no run reads another
    one's cache.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "raw_text": function(batch[prompt].tolist())})

    kind = prompts.schema[key].dataType.simpleString()
    todo = prompts if cached is None else prompts.join(cached.select(key), key, "left_anti")
    made = todo.select(key, prompt).mapInPandas(run, f"{key} {kind}, raw_text string")
    return made if cached is None else made.unionByName(cached.join(prompts.select(key), key, "left_semi").select(key, "raw_text"))


def predict_resumable(prompts: DataFrame, function: Callable[[list[str]], list[str]], path: str, key: str = "key", prompt: str = "prompt", parts: int = 16) -> DataFrame:
    """``key`` and raw_text of every prompt, kept in a table at ``path`` so that a broken run goes on where it stopped.

    Prompts are taken in ``parts`` by a hash of their key; each part is written
    before the next one starts, and a later run predicts only what the table
    does not hold. Repeated keys are predicted once, null keys not at all.
    """
    from lodestrata.streaming.incremental import known_keys

    spark = prompts.sparkSession
    asked = prompts.where(F.col(key).isNotNull()).dropDuplicates([key])
    todo = asked.join(known_keys(spark, path, asked.schema[key]), key, "left_anti")
    todo = stage(todo.select(key, prompt, F.pmod(F.xxhash64(key), F.lit(parts)).alias("part")), "prompts")
    for part in [r["part"] for r in todo.select("part").distinct().orderBy("part").collect()]:  # at most ``parts``
        predict(todo.where(F.col("part") == part), function, key=key, prompt=prompt).write.mode("append").parquet(path)
    kind = asked.schema[key].dataType.simpleString()
    return spark.read.schema(f"{key} {kind}, raw_text string").parquet(path).join(asked.select(key), key, "left_semi").dropDuplicates([key])


def judge_means(replies: DataFrame, most: int) -> DataFrame:
    """(shape, criterion, judged, mean) over the replies of a judge, ``most`` for each shape at most.

    ``replies``: shape, ord, reply (text with a JSON object of numbers by
    criterion somewhere in it). Replies without such an object are not
    counted; the first ones in ``ord`` are taken.
    """
    some = sampling.per_group(replies, ["shape"], ["ord"], most)
    scores = some.select("shape", F.from_json(F.regexp_extract("reply", r"(?s)(\{.*\})", 1), "map<string,double>").alias("scores")).where(F.size("scores") > 0)
    return scores.select("shape", F.explode("scores").alias("criterion", "score")).where("score is not null").groupBy("shape", "criterion").agg(
        F.count("*").alias("judged"), F.avg("score").alias("mean")
    )


def cache_key(predictor: str, shape: Column, user: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", F.lit(predictor), shape, user), 256)


def perturbed(answer: Column, rate: float, seed: str, *ids: Column) -> Column:
    """Answers with the verdict of a share of the rows turned around."""
    turned = F.regexp_replace(answer, r"(?im)^(\s*status\s*:\s*)(?:confirmed|vuln\w*)\b", "$1 safe")
    other = F.regexp_replace(answer, r"(?im)^(\s*status\s*:\s*)(?:safe|clean)\b", "$1 confirmed")
    is_vuln = T.prediction_status(T.nonempty(T.field("status", answer))) == "confirmed"
    return F.when(T.hash_uniform(seed, *ids) < rate, F.when(is_vuln, turned).otherwise(other)).otherwise(answer)
