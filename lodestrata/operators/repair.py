"""Repair of generated verdicts and safe answers, as tables of rules over their fields.

A verdict is parsed once into a map of its fields. Every field then has a
list of (condition, value) rules, of which the first that holds applies, and
the answer is written anew from the map. All of it is column expressions; the
SQL of the query ``repair_output`` states the same rules independently.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import dims
from lodestrata.functions import text as T
from lodestrata.operators.alignment import lines_of

Rule = tuple[Column | None, Column]

#: Formats of a verdict and its parts. Fixed values.
FIELD_LINE = r"(?i)^\s*(status|cwe|severity|line|trace|fix)\s*:\s*(.*)$"
THOUGHT = r"(?s)<think>(.*?)</think>"
CVE = r"(?i)\bCVE-\d{4}-\d{3,7}\b"
CVE_STANDS_FOR = "the relevant weakness"
SENTENCE_GAP, CLAUSE_GAP, STOP_GAP = r"(?<=[.!?])\s+", r"(?<=[.;])\s", r"(?<=[.])\s"
HYPHENS = "[‐-―−]"
#: Where prose begins behind a trace, in order of precedence: behind any trace, and behind a chain only. Fixed values.
PROSE_STARTS = (" — ", " -- ", ". ", "; Since", " Since ", ", an attacker", ", because")
CHAIN_PROSE_STARTS = (*PROSE_STARTS, " which ", " where the ")
#: Wording of prose in a trace, code that a trace may name, echoes of an analysis. Fixed values.
PROSE = r"(?i)the vulnerabilit|is (?:primarily |)related|handling of|argument in|because of|due to|this (?:code|function|line)|specific code|mechanism of|note that|refers to"
CODE_TOKEN = r"([A-Za-z_][\w.]*\([^)]*\)|[A-Za-z_]\w*(?:\.\w+)+|--?[A-Za-z][\w-]+)"
ECHO = r"(?i)^(specific code|the specific code|mechanism of|analysis of|potential impact|contextual relevance|step \d)"
#: Longest trace, last clause and field that is surely no run-on; code tokens of a trace. Fixed values.
TRACE_LENGTH, CLAUSE_LENGTH, PLAIN_TRACE, RUN_ON, TRACE_TOKENS = 160, 90, 130, 140, 3


def first_rule(rules: list[Rule]) -> Column:
    """Value of the first rule whose condition holds; a condition of None always does."""
    return reduce(lambda rest, rule: rule[1] if rule[0] is None else F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit(None))


def _before(value: Column, starts: tuple[str, ...]) -> Column:
    """``value`` up to the first of ``starts`` that it holds, null where it holds none."""
    return first_rule([(F.contains(value, F.lit(s)), T.strip(F.substring_index(value, s, 1))) for s in starts])


def _capped(value: Column, length: int = TRACE_LENGTH) -> Column:
    return F.substring(F.regexp_replace(value, ",+$", ""), 1, length)


def concise_trace(value: Column) -> Column:
    """The chain or construct of a trace without the prose around it."""

    def rules(v: Column) -> Column:
        head = _before(v, PROSE_STARTS)
        tokens = F.slice(F.array_distinct(F.regexp_extract_all(v, F.lit(CODE_TOKEN), 1)), 1, TRACE_TOKENS)
        prosaic = v.rlike(PROSE) | (F.length(v) > PLAIN_TRACE)
        return first_rule(
            [
                (F.contains(v, F.lit("->")) | F.contains(v, F.lit("→")), _capped(F.coalesce(_before(v, CHAIN_PROSE_STARTS), v))),
                (head.rlike(r"[=(]"), _capped(head)),
                (prosaic & (F.size(tokens) > 0), F.substring(F.array_join(tokens, " -> "), 1, TRACE_LENGTH)),
                (prosaic, F.substring(T.strip(F.substring_index(v, ".", 1)), 1, CLAUSE_LENGTH)),
                (None, _capped(T.strip(F.get(F.split(v, CLAUSE_GAP, 2), 0)))),
            ]
        )

    return T.let(T.strip(F.replace(value, F.lit("`"), F.lit(""))), rules)


def degraded(value: Column) -> Column:
    """Whether a field holds an echo of the analysis instead of a value."""
    v = T.strip(value)
    run_on = v.rlike(r"\b\w{1,3}$") & (F.length(v) > RUN_ON)
    return (value == "") | F.contains(v, F.lit("**")) | v.rlike(ECHO) | F.endswith(v, F.lit("...")) | F.endswith(v, F.lit("—")) | run_on


def _thought(raw: Column) -> Column:
    """The thought without sentences that cite a CVE id; null where there is none."""

    def clean(thought: Column) -> Column:
        kept = F.filter(F.split(thought, SENTENCE_GAP), lambda s: ~s.rlike(CVE))
        return first_rule(
            [
                (~thought.rlike(CVE), thought),
                (F.size(kept) > 0, T.strip(F.array_join(kept, " "))),
                (None, F.regexp_replace(thought, CVE, CVE_STANDS_FOR)),
            ]
        )

    return F.when(raw.rlike(THOUGHT), T.let(T.strip(F.regexp_extract(raw, THOUGHT, 1)), clean))


def parsed_fields(body: Column) -> Column:
    """Map of the fields of a body: the last line of each name, with what follows up to the next field."""

    def parse(lines: Column) -> Column:
        heads = F.transform(
            F.filter(F.transform(lines, lambda s, i: F.struct(i.alias("at"), F.lower(F.regexp_extract(s, FIELD_LINE, 1)).alias("name"))), lambda h: h["name"] != ""),
            lambda h: h,
        )

        def values(heads: Column) -> Column:
            def value(head: Column, turn: Column) -> Column:
                end = F.coalesce(F.get(heads, turn + 1)["at"], F.size(lines))
                first = F.regexp_extract(F.get(lines, head["at"]), FIELD_LINE, 2)
                more = F.transform(F.slice(lines, head["at"] + 2, F.greatest(end - head["at"] - 1, F.lit(0))), T.strip)
                return F.struct(head["name"].alias("name"), T.strip(F.array_join(F.concat(F.array(first), more), " ")).alias("value"))

            return F.transform(heads, value)

        return T.let(heads, values)

    def last(name: str) -> Callable[[Column], Column]:
        return lambda found: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(found, lambda f: f["name"] == name), lambda f: f["value"])), -1)

    return T.let(T.let(lines_of(body), parse), lambda found: F.struct(*[last(n)(found).alias(n) for n in T.FIELD_NAMES]))


def _cwe(value: Column) -> Column:
    """A plain id from a CWE field with odd hyphens, a bare number or words around the id."""

    def rules(plain: Column) -> Column:
        cited = F.regexp_extract(plain, r"(?i)(CWE-\d+)", 1)
        return first_rule([(plain.rlike(r"^\d{1,4}$"), F.concat(F.lit("CWE-"), plain)), (cited != "", F.upper(cited)), (None, plain)])

    return T.let(T.strip(F.regexp_replace(value, HYPHENS, "-")), rules)


def repaired(raw: Column) -> Column:
    """A generated verdict with clean fields; text without status and CWE stays as it is, null stays null.

    Values run on to the next field. Hyphens and bare numbers of the CWE
    become plain ids, a safe verdict loses what only a finding has, traces
    become concise, degraded fixes become the advice for their CWE, sentences
    of the thought that cite a CVE id go.
    """
    body = F.when(raw.rlike(THOUGHT), F.substring(raw, F.length(F.regexp_extract(raw, r"(?s)^(.*?<think>.*?</think>)", 1)) + 1, F.length(raw))).otherwise(raw)

    def write(found: Column) -> Column:
        safe = F.lower(found["status"]) == "safe"
        cwe = F.when(safe, "none").otherwise(_cwe(found["cwe"]))
        values = {
            "status": found["status"],
            "cwe": cwe,
            **{name: F.when(found[name].isNotNull(), F.when(safe, "none").otherwise(found[name])) for name in ("severity", "line", "fix")},
            "trace": found["trace"],
        }
        plain = {name: T.strip(F.regexp_replace(T.strip(F.replace(v, F.lit("**"), F.lit(""))), r"^`+|`+$", "")) for name, v in values.items()}
        advice = F.coalesce(dims.lookup(dims.FIX_BY_CWE, F.upper(F.coalesce(cwe, F.lit("none")))), F.lit(dims.FIX_DEFAULT))
        two_sentences = T.strip(F.array_join(F.slice(F.split(plain["fix"], STOP_GAP), 1, 2), " "))
        clean = plain | {
            "trace": F.when(plain["trace"].isNotNull(), concise_trace(plain["trace"])),
            "fix": first_rule([(values["fix"].isNull(), F.lit(None).cast("string")), (degraded(values["fix"]), advice), (None, two_sentences)]),
        }
        thought = T.nonempty(_thought(raw))
        head = F.concat(F.lit("<think>\n"), thought, F.lit("\n</think>\n"))
        out = F.concat_ws("\n", head, *[F.concat(F.lit(f"{name}: "), clean[name]) for name in T.FIELD_NAMES])
        return F.when(found["status"].isNull() & found["cwe"].isNull(), raw).otherwise(out)

    return T.let(parsed_fields(body), write)


def repair(texts: DataFrame, key: str) -> DataFrame:
    """``key``, repaired text and the text before of rows (key, text); null stays null."""
    return texts.select(key, repaired(F.col("text")).alias("text"), F.col("text").alias("before"))


# --- safe answers ---

#: Formats of a safe answer. Fixed values.
SAFE_FIELD = r"(?i)^(\s*)(status|cwe|severity|line|trace|fix)(\s*:\s*)(.*)$"
REFERENCE_LIST = r"(?i)^\s*(follow_up_refs|open_refs)\s*:"
NAMED_TRACE = r"(?i)^\s*CWE-\S+\s+in\s+(.+?)\s*$"
ANY_CWE, STAND_IN_CWE = r"\bCWE-(\d{1,4})\b", r"(?i)CWE-XX"
SAFE_TRACE = "no untrusted input reaches a dangerous sink; code is safe"
SAFE_TRACE_OF = ("no untrusted-input-to-sink data flow involving ", "; code is safe")
SAFE_VALUES = {"status": "safe", "cwe": "none", "severity": "none", "line": "none"}
LEAST_TRACE = 8


def safe_trace(value: Column) -> Column:
    """A trace for safe code: names no CWE."""
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, ANY_CWE, ""), STAND_IN_CWE, ""), r"^[ \-|:]+|[ \-|:]+$", "")
    return first_rule(
        [
            (value == "", F.lit(SAFE_TRACE)),
            (value.rlike(NAMED_TRACE), F.concat(F.lit(SAFE_TRACE_OF[0]), F.regexp_extract(value, NAMED_TRACE, 1), F.lit(SAFE_TRACE_OF[1]))),
            (value.rlike(ANY_CWE) | value.rlike(STAND_IN_CWE), F.when(F.length(rest) >= LEAST_TRACE, rest).otherwise(F.lit(SAFE_TRACE))),
            (None, value),
        ]
    )


def normalized_safe(content: Column) -> Column:
    """A safe answer whose fields fit its verdict; its thought, fix and reference lists stay.

    Lines belong to the field or list above them; those of the trace go, but for blank ones.
    """
    thought = F.regexp_extract(content, r"(?is)^(.*?<think>.*?</think>)", 1)

    def rewrite(line: Column) -> Column:
        name, value = F.lower(F.regexp_extract(line, SAFE_FIELD, 2)), T.strip(F.regexp_extract(line, SAFE_FIELD, 4))
        new = F.coalesce(dims.lookup(SAFE_VALUES, name), F.when(name == "trace", T.let(value, safe_trace)), value)
        return F.when(name == "", line).otherwise(F.concat(F.regexp_extract(line, SAFE_FIELD, 1), name, F.regexp_extract(line, SAFE_FIELD, 3), new))

    def rebuild(lines: Column) -> Column:
        owners = F.transform(lines, lambda s: F.when(s.rlike(REFERENCE_LIST), "refs").otherwise(F.lower(F.regexp_extract(s, SAFE_FIELD, 2))))

        def without_tails(owners: Column) -> Column:
            above = lambda i: F.element_at(F.concat(F.array(F.lit("")), F.filter(F.slice(owners, 1, i + 1), lambda o: o != "")), -1)
            rows = F.transform(lines, lambda s, i: F.struct(s.alias("line"), ((F.get(owners, i) == "") & (T.strip(s) != "") & (above(i) == "trace")).alias("tail")))
            return F.array_join(F.transform(F.filter(rows, lambda r: ~r["tail"]), lambda r: rewrite(r["line"])), "\n")

        return T.let(owners, without_tails)

    return F.concat(thought, T.let(lines_of(F.substring(content, F.length(thought) + 1, F.length(content))), rebuild))


def normalize_safe(texts: DataFrame, key: str) -> DataFrame:
    """``key``, normalised text and the text before of safe answers (key, text); null stays null."""
    return texts.select(key, normalized_safe(F.col("text")).alias("text"), F.col("text").alias("before"))
