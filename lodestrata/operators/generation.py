"""Tasks and prompts for generated records: pools, ratios, ids, texts.

Generation itself is an external function (see ``prediction.predict``); what
is declared here is the table of tasks before it and the filter after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import text as T
from lodestrata.operators.prediction import predict
from lodestrata.operators.sampling import interleave_slot, per_group, round_robin
from lodestrata.staging import stage

VERDICT_FORM = "<think> ... </think>\nstatus: confirmed | safe\ncwe: CWE-<n> | none\nseverity: HIGH | MEDIUM | LOW | none\nline: <n> | none\ntrace: source -> sink\nfix: <one line> | none"


def unique_code(pool: DataFrame, code: str = "code", order: str = "ord") -> DataFrame:
    """Rows of the pool, one for each stripped code (the first in ``order``)."""
    from lodestrata.operators.dedup import first_by_key

    return first_by_key(pool.withColumn("_code", F.sha2(T.strip(F.col(code)), 256)), "_code", [order]).drop("_code")


def ratio_tasks(pool: DataFrame, limit: int, prefix: str, seed: str, key: str = "ord") -> DataFrame:
    """The first ``limit`` tasks of an order whose every prefix is 30 % safe, with ids by source.

    ``pool``: code, language, label (safe or vuln), source and the unique
    ``key``. When a side runs out the other one fills the order.
    """
    hashed = unique_code(pool.where("code is not null"), order=key)
    side = Window.partitionBy("label").orderBy(T.hash_order(seed, F.col(key)))
    ranked = hashed.where("label in ('safe', 'vuln')").withColumn("_r", F.row_number().over(side) - 1).where(F.col("_r") < limit)
    slotted = ranked.withColumn("_slot", interleave_slot(F.col("_r"), F.col("label") == "safe")).orderBy("_slot").limit(limit)
    number = F.row_number().over(Window.partitionBy("source").orderBy("_slot")) - 1
    return slotted.withColumn("task_id", F.concat_ws(":", F.lit(prefix), "source", number)).drop("_r", "_slot")


def balanced_tasks(located: DataFrame, limit: int, key: str = "pair_id", pool_factor: int = 4) -> DataFrame:
    """Located fix pairs, types taking turns; only pairs whose region is known."""
    known = located.where("region_source <> 'none' and (size(lines) > 0 or size(identifiers) > 0)")
    some = per_group(known, ["vuln_type"], [key], limit * pool_factor)
    return round_robin(some, "vuln_type", key, limit)


def scan_prompt(code: Column, language: Column, hints: Column | None = None, cwe: Column | None = None) -> Column:
    """Prompt for a single unit of code."""
    parts = [
        F.concat(F.lit("Analyse this "), F.coalesce(language, F.lit("code")), F.lit(" code for one vulnerability. Trace the data flow over its real names.")),
        None if cwe is None else F.concat(F.lit("A reviewer suspects "), cwe, F.lit(".")),
        None if hints is None else T.nonempty(hints),
        F.concat(F.lit("<SCAN>\n"), code, F.lit("\n</SCAN>")),
        F.lit("Answer in this form:\n" + VERDICT_FORM),
    ]
    return F.concat_ws("\n", *[p for p in parts if p is not None])  # null parts are left out


def context_prompt(helper: Column, path: Column, category: Column) -> Column:
    """Prompt for a caller whose verdict depends on a helper that is not shown."""
    return F.format_string(
        "Write a caller of `%s` (in %s) whose safety (%s) cannot be judged without seeing that helper.\n<<<CALLER_CODE>>>\n...\n<<<END_CALLER_CODE>>>\nstatus: needs_context\nopen_refs:\n  - <helper>",
        helper, path, category,
    )


def cross_file_prompt(helper: Column, disposition: Column, multi_hop: Column) -> Column:
    """Prompt for a caller and its helper in another file."""
    return F.format_string(
        "Write a caller and the helper `%s` so that the suspected flow is to be %sed.%s\n<<<CALLER_CODE>>> ... <<<END_CALLER_CODE>>>\n<<<HELPER_CODE>>> ... <<<END_HELPER_CODE>>>\n" + VERDICT_FORM,
        helper, disposition, F.when(multi_hop, " The helper calls on: name it under follow_up_refs.").otherwise(""),
    )


def synthesis_prompt(findings: Column) -> Column:
    """Prompt that lists findings (array of structs severity, cwe, file, title) to be ranked."""
    rows = F.transform(findings, lambda f: F.concat(F.lit("- ["), f["severity"], F.lit("] "), f["cwe"], F.lit(" "), f["file"], F.lit(": "), f["title"]))
    return F.concat(F.lit("<SYNTHESIZE>\n"), F.array_join(rows, "\n"), F.lit("\n</SYNTHESIZE>\nRank them, cluster duplicates, note what is systemic."))


def correction_prompt(prompt: Column, failed: Column) -> Column:
    """Prompt of a second attempt that says which gates the first one failed."""
    advice = {
        "correspondence": "name only identifiers that occur in the code",
        "localization": "point at the changed lines",
        "cwe": "give the true CWE",
        "substantiveness": "do not hedge; tell the flow from source to sink",
    }
    told = F.transform(failed, lambda f: F.concat(F.lit("- "), F.coalesce(*[F.when(f == k, v) for k, v in advice.items()], f)))
    return F.concat(prompt, F.lit("\n\nYour last answer was rejected:\n"), F.array_join(told, "\n"))


#: Frame of example answers in a prompt, and what each kind shows of an example. Fixed values.
EXEMPLAR_HEAD, EXEMPLAR_END = "=== EXEMPLAR(S) — match this style of {0} ===", "=== END EXEMPLARS ==="
EXEMPLAR_STYLES = {"shape1": "specificity", "shape3": "cross-file tracing", "shape4": "synthesis"}


def exemplar_block(shape: str, examples: list[dict[str, str]], on: bool = False) -> str:
    """Examples for a prompt of ``shape``, '' unless asked for.

    An example maps headings (CODE, INPUT, OUTPUT ...) to texts, in the order
    they are shown; ``note`` goes into its title line.
    """
    if not on or not examples:
        return ""
    shown = [EXEMPLAR_HEAD.format(EXEMPLAR_STYLES.get(shape, "answers"))]
    for n, example in enumerate(examples, 1):
        note = f" ({example['note']})" if example.get("note") else ""
        shown += [f"\n--- Example {n}{note} ---", *[f"{title}:\n{text}" for title, text in example.items() if title != "note"]]
    return "\n".join([*shown, EXEMPLAR_END, ""])


def context_answer(caller: Column, thought: Column, helper: Column, path: Column, source: Column, argument: Column) -> Column:
    """Answer to a context prompt from its parts: the verdict waits for the helper."""
    return F.format_string(
        "<<<CALLER_CODE>>>\n%s\n<<<END_CALLER_CODE>>>\n\n<think>\n%s\n</think>\n\nstatus: needs_context\nopen_refs:\n  - %s (%s)\n"
        "partial_trace: user input from %s flows into %s(%s) — verdict depends on %s's implementation\n",
        caller, thought, helper, path, source, helper, argument, helper,
    )


def cross_file_answer(files: dict[str, tuple[Column, Column]], thought: Column, fields: dict[str, Column], follow_ups: Column) -> Column:
    """Answer to a cross-file prompt: the code of every role (its file and text), the thought, the verdict's fields, what else to read."""
    blocks = [F.format_string(f'<<<{role}_CODE file="%s">>>\n%s\n<<<END_{role}_CODE>>>\n\n', file, code) for role, (file, code) in files.items()]
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(T.nonempty(value), F.lit("none")), F.lit("\n")) for name, value in fields.items()]
    listed = F.array_join(F.transform(follow_ups, lambda r: F.concat(F.lit("  - "), r, F.lit("\n"))), "")
    refs = F.when(F.size(follow_ups) > 0, F.concat(F.lit("follow_up_refs:\n"), listed)).otherwise("")
    return F.concat(*blocks, F.lit("<think>\n"), thought, F.lit("\n</think>\n\n"), *lines, refs)


def attempts(
    tasks: DataFrame, generate: Callable[[list[str]], list[str]], check: Callable[[DataFrame], DataFrame], most: int, key: str = "key", prompt: str = "prompt"
) -> DataFrame:
    """``key``, raw_text, attempt, failed of every task: its first answer that passes, else its last one.

    ``check`` adds ``failed`` (the names of failed gates) to ``key``, prompt,
    raw_text. A failed task is tried again with a prompt that says what failed,
    ``most`` times at most; every attempt works on what the one before left.
    """
    todo, done = tasks.select(key, prompt), None
    for n in range(1, most + 1):
        judged = stage(check(todo.join(predict(todo, generate, key=key, prompt=prompt), key)).withColumn("attempt", F.lit(n)), "attempt")
        settled = judged if n == most else judged.where(F.size("failed") == 0)
        settled = settled.select(key, "raw_text", "attempt", "failed")
        done = settled if done is None else done.unionByName(settled)
        todo = judged.where(F.size("failed") > 0).select(key, correction_prompt(F.col(prompt), F.col("failed")).alias(prompt))
    return done


def inflated(target: int, factor: float, more: int) -> int:
    """Tasks to prepare for so many kept records."""
    return int(target * factor) + more


def best_candidate(candidates: DataFrame, task: str, score: Column) -> DataFrame:
    """Each task's best answer (columns ``task``, n, text), the first among equals."""
    return candidates.groupBy(task).agg(F.max_by("text", F.struct(score, -F.col("n"))).alias("text"))
