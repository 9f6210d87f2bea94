"""Column functions over records of code review: fields, tags, hashes, identifiers.

All of them are built from native expressions, so they stay in one generated
stage. ``\\s`` and ``\\w`` are ASCII here and in the SQL counterparts, lines end
at ``\\n`` only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions import dims

FIELD_NAMES = ("status", "cwe", "severity", "line", "trace", "fix")
_ALL_FIELDS = r"(?imd)^\s*(status|cwe|severity|line|trace|fix)\s*:\s*(.+?)\s*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it.

    Catalyst merges equal expressions only where all of them are evaluated
    anyhow; inside conditions it computes them again.
    """
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    """Outer white space off (``trim`` takes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tidy(c: Column) -> Column:
    """Trimmed and in lower case: labels, languages, sources and types come dirty."""
    return F.lower(strip(c))


def nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def exact_hash(c: Column) -> Column:
    return F.sha2(strip(c), 256)


def normal_hash(c: Column, strict: bool = False) -> Column:
    """Hash of code without scan tags, line comments, white space and case.

    By default everything from ``#`` or ``//`` on is a comment, even inside
    strings and URLs; ``strict`` keeps ``://`` and preprocessor lines.
    """
    untagged = F.regexp_replace(c, r"</?SCAN>", "")
    comment = r"(?d)(?<!:)//.*|(?m)(?<![\w\"'])#(?!include|define|if|endif|pragma).*" if strict else r"(?d)#.*|//.*"
    return F.sha2(F.lower(F.regexp_replace(F.regexp_replace(untagged, comment, ""), r"\s+", "")), 256)


def norm_label(c: Column) -> Column:
    """vuln, safe or context (everything else, null included)."""
    return F.when(c.isin(*dims.VULN_LABELS), "vuln").when(c.isin(*dims.SAFE_LABELS), "safe").otherwise("context")


def field(name: str, c: Column) -> Column:
    """First ``name: value`` line, trimmed, '' where there is none.

    The blanks after the colon may cross a line end, so an empty field takes
    the next line's text; that is part of the format's definition.
    """
    return strip(F.regexp_extract(c, rf"(?imd)^\s*{name}\s*:\s*(.+)$", 1))


def think(c: Column) -> Column:
    return nonempty(F.regexp_extract(c, r"(?is)<think>(.*?)</think>", 1))


def after_think(c: Column) -> Column:
    return F.regexp_replace(c, r"(?is)^.*?<think>.*?</think>", "")


def _field_pairs(c: Column) -> Column:
    """Array of (k, v) of all field lines, in their order."""
    both = lambda text: F.arrays_zip(
        F.regexp_extract_all(text, F.lit(_ALL_FIELDS), 1).alias("k"), F.regexp_extract_all(text, F.lit(_ALL_FIELDS), 2).alias("v")
    )
    return let(c, both)


def _last_value(pairs: Column, name: str) -> Column:
    own = F.filter(pairs, lambda p: F.lower(p["k"]) == name)
    return let(F.try_element_at(own, F.lit(-1))["v"], lambda v: F.when(~F.lower(v).isin("none", "n/a", "-", ""), v))


def last_field(name: str, c: Column) -> Column:
    """Last value of ``name`` among all field lines; none, n/a and - are null."""
    return _last_value(_field_pairs(c), name)


#: Status words. Fixed values.
_VERDICT_WORDS = {"confirmed": "confirmed", "vuln": "confirmed", "vulnerable": "confirmed", "safe": "safe", "clean": "safe"}
_PREDICTION_WORDS = _VERDICT_WORDS | {"synthesis": "synthesis"}


def verdict_status(raw: Column) -> Column:
    """confirmed or safe by the first word; null otherwise."""
    return dims.lookup(_VERDICT_WORDS, F.regexp_extract(F.lower(raw), r"^(\S+)", 1))


def prediction_status(raw: Column) -> Column:
    """As ``verdict_status``, also needs_context and synthesis, and without closing marks."""
    word = F.regexp_replace(F.regexp_extract(F.lower(strip(raw)), r"^(\S+)", 1), r"^[.,;]+|[.,;]+$", "")
    return F.coalesce(dims.lookup(_PREDICTION_WORDS, word), F.when(word.contains("needs"), "needs_context"))


def first_cwe(c: Column) -> Column:
    """CWE-n of the first strict mention, null where there is none."""
    number = F.regexp_extract(c, r"\bCWE-(\d{1,4})\b", 1)
    return F.when(number != "", F.concat(F.lit("CWE-"), number))


def loose_cwe(c: Column) -> Column:
    """CWE-n from ``CWE-n`` or ``cwen`` in any case."""
    number = F.regexp_extract(c, r"(?i)CWE-?(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("CWE-"), number))


def parse_verdict(c: Column) -> Column:
    """Struct of think, status, cwe, severity, line, trace, fix of a generated verdict."""

    def parsed(pairs: Column) -> Column:
        value = lambda name: _last_value(pairs, name)
        return F.struct(
            strip(think(c)).alias("think"),
            verdict_status(value("status")).alias("status"),
            first_cwe(value("cwe")).alias("cwe"),
            *[value(name).alias(name) for name in ("severity", "line", "trace", "fix")],
        )

    return let(_field_pairs(after_think(c)), parsed)


def scan_code(c: Column) -> Column:
    """Code between the scan tags, null where there are none."""
    return nonempty(F.regexp_extract(c, r"(?s)<SCAN>\s*\n?(.*?)\n?</SCAN>", 1))


def task_tag(c: Column) -> Column:
    return nonempty(F.regexp_extract(c, r"<(SCAN|GENERATE|EXPLAIN|SYNTHESIZE)>", 1))


def identifiers(c: Column) -> Column:
    """Distinct identifier-like tokens of more than two letters that are no keywords, sorted."""
    found = F.regexp_extract_all(c, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1)
    return F.array_sort(
        F.array_distinct(F.filter(found, lambda t: (F.length(t) > 2) & ~F.lower(t).isin(*dims.STOP_IDENTIFIERS)))
    )


def any_contains(c: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in needles])


def detect_language(c: Column) -> Column:
    """react, typescript, javascript, python or other by ordered substring hints."""
    hints = {name: any_contains(c, words) for name, words in dims.LANGUAGE_HINTS.items()}
    markup = (F.contains(c, F.lit("<")) & F.contains(c, F.lit("/>"))) | F.contains(F.lower(c), F.lit("jsx"))
    return (
        F.when(hints["react"] & markup, "react")
        .when(hints["typescript"] & hints["javascript"], "typescript")
        .when(hints["javascript"], "javascript")
        .when(hints["python"], "python")
        .otherwise("other")
    )


def extension_language(path: Column, table: dict[str, str]) -> Column:
    return dims.lookup(table, F.regexp_extract(path, r"(\.[^./]+)$", 1))


def family(cwe: Column) -> Column:
    return dims.lookup(dims.family_by_cwe(), F.upper(strip(cwe)))


def marker_hits(c: Column, markers: tuple[str, ...]) -> Column:
    """Number of distinct markers that occur in the lower-cased text."""
    low = F.lower(c)
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(m)).cast("int") for m in markers])


def classify(c: Column) -> Column:
    """Struct (vuln_type, cwe) of the first type whose pattern occurs, else (other, null)."""
    names = [F.when(c.rlike("(?i)" + pattern), F.struct(F.lit(name).alias("vuln_type"), F.lit(cwe).alias("cwe"))) for name, cwe, pattern in dims.TAXONOMY]
    return F.coalesce(*names, F.struct(F.lit("other").alias("vuln_type"), F.lit(None).cast("string").alias("cwe")))


def type_to_cwe(c: Column, table: dict[str, str] | None = None) -> Column:
    """CWE of a free-text type: first table entry contained in it, else a CWE number in it."""
    low = tidy(c)
    hits = [F.when(F.contains(low, F.lit(k)), v) for k, v in (table or dims.TYPE_SUBSTRING_CWE).items()]
    return F.coalesce(*hits, loose_cwe(c))


def phrase_count(c: Column, phrases: tuple[str, ...]) -> Column:
    """Occurrences of all phrases in the lower-cased text, with multiplicity."""

    def count(low: Column) -> Column:
        return reduce(lambda a, b: a + b, [((F.length(low) - F.length(F.replace(low, F.lit(p)))) / len(p)).cast("int") for p in phrases])

    return let(F.lower(c), count)


def nonblank_lines(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\n"), lambda line: strip(line) != ""))


def is_explanation(c: Column, least: int = 30, most: int = 2000, words: int = 5) -> Column:
    """Whether a docstring or note explains something: its size, its words, and no to-do mark in front."""
    spoken = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return F.length(c).between(least, most) & (spoken >= words) & ~c.rlike(r"(?i)^\s*(todo|fixme)")


def approx_tokens(c: Column) -> Column:
    """Rough token count: a quarter of the characters, 1 at least, 0 for empty."""
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(c) / 4))).cast("bigint")


def percent(n: Column, d: Column) -> Column:
    """Whole percent, rounded down; 0 for a zero denominator."""
    return F.floor(n * 100 / F.greatest(d, F.lit(1))).cast("bigint")


def ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def hash_order(seed: str, *ids: Column) -> Column:
    """A reproducible pseudo-random order: prefixes of it are samples."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[i.cast("string") for i in ids]), 256)


def hash_uniform(seed: str, *ids: Column) -> Column:
    """A number in [0, 1) from the first 12 hexadecimal digits of ``hash_order``."""
    return F.conv(F.substring(hash_order(seed, *ids), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
