"""Problem 3: template residue, filler and error-page text.

Texts are cut into prose segments (sentences outside code and tags). What is
trusted as residue from the start is little: open template syntax that means
nothing else, one word over and over, and ``EXEMPLARS``, a short fixed list of sentences that stand for
kinds of filler, error pages and script notices. Everything else is found from
there. Every distinct segment gets a 64-bit SimHash; it is compared with the
exemplars, a stated set of fixed size, wherever Hamming distance and text
similarity allow. Residue then looks for its near-duplicates in partitioned
SimHash tables, which find all that lies within three bits, and so does what
it reaches, until nothing new comes. Pairs are verified by Hamming distance
and word overlap, so labels go through the connected components that hold
trusted residue, and nothing is looked for in the others. A text that holds a
labelled segment is a case.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.prose import segments
from lodestrata.llm.shingles import mix
from lodestrata.staging import stage

#: Bits and word overlap within which a segment is like an exemplar, and like other residue.
FAR, LIKE_EXEMPLAR = 26, 0.5
NEAR, ALIKE = 3, 0.6
#: Skeletons a worker remembers to have told; it only saves telling them again.
MOST_TOLD = 1 << 17

_NAME = r"[a-z][a-z0-9]*(?:[_ .-][a-z0-9]+)*"
_WISH = r"(?:insert|your|add|enter|put|replace)\b"
#: Template syntax around a name that stands for nothing else. Fixed values.
OPEN_SYNTAX = re.compile(
    "|".join(
        [
            r"\{\{\s*" + _NAME + r"\s*\}\}",
            r"\{%-?\s*" + _NAME + r"\s*-?%\}",
            r"\[\[\s*" + _NAME + r"\s*\]\]",
            r"<<\s*" + _NAME + r"\s*>>",
            r"\$\{\s*" + _NAME + r"\s*\}",
            r"%\(" + _NAME + r"\)[sdf]",
            r"\[\s*" + _WISH + r"[^\]\n`]*\]",
            r"<\s*" + _WISH + r"[^>\n`]*>",
        ]
    ),
    re.I,
)
#: Marks around a name that may be template syntax: they count if near-duplicates show it. Fixed values.
DOUBTFUL_SYNTAX = re.compile(
    "|".join(
        [
            r"\$[a-z]+(?:_[a-z]+)*\$",
            r"(?<![\w.])__[a-z]+(?:_[a-z]+)*__(?![\w(])",
            r"(?<![\w$%{])\{[a-z]+(?:_[a-z]+)*\}(?!\})",
            r"(?<![\w<])<(?!(?:think|scan|generate|explain|synthesize|analysis|answer|br|p|div|b|i|em|ul|li|hr|pre|h\d|html|head|body|title|center|noscript|script|span|a|td|tr|table|form|section)>)[a-z]+(?:_[a-z]+)*>(?!>)",
        ]
    ),
    re.I,
)
_SYNTAX_MARK = re.compile(r"[{\[<$%]|__")
#: Stands for a placeholder in a skeleton.
SLOT = "◊"

#: Trusted residue: one sentence for each kind, with any word in the place that varies. Fixed values.
EXEMPLARS = {
    "script_notice": """\
Please enable JavaScript to view this page.
JavaScript is disabled.
JavaScript must be enabled to load the page.
<noscript>JavaScript must be enabled to load the page.</noscript>
This page requires JavaScript.
You need to enable JavaScript to run this app.
You need to turn on scripts in your browser to run this app.
Your browser does not run scripts, so the page cannot be shown.
Your browser does not support JavaScript.
We're sorry but this page doesn't work properly without JavaScript enabled.
Some parts of the page cannot be displayed.
Turn it on and reload the page.
Checking your browser before the page opens.
Checking your browser before accessing the site.
Verifying you are human.
Please verify that you are human.
Cookies and scripts have to be allowed for this page.
Please enable cookies and reload the page.""",
    "error_page": """\
400 - Bad Request.
401 - Unauthorized.
403 - Forbidden.
404 - Not Found.
404 Page Not Found
405 - Method Not Allowed.
408 - Request Timeout.
410 - Gone.
429 - Too Many Requests.
500 - Internal Server Error.
501 - Not Implemented.
502 - Bad Gateway.
503 - Service Unavailable.
504 - Gateway Timeout.
HTTP Error 400: Bad Request
HTTP Error 403: Forbidden
HTTP Error 404: Not Found
HTTP Error 429: Too Many Requests
HTTP Error 500: Internal Server Error
HTTP Error 502: Bad Gateway
HTTP Error 503: Service Unavailable
HTTP Error 504: Gateway Timeout
<html><head><title>404 Not Found</title></head><body><center><h1>404 Not Found</h1></center></body></html>
<html><head><title>502 Bad Gateway</title></head><body><center><h1>502 Bad Gateway</h1></center></body></html>
<!doctype html><title>Page not available</title><p>The page could not be loaded.</p>
<h2>Whoops, looks like something went wrong.</h2><p>Not Found (404)</p>
{"error": {"code": 404, "message": "Not Found"}}
{"error": {"code": 500, "message": "Internal Server Error"}}
upstream connect error, reset before headers (503)
Too many calls from this address; slow down and retry after 30 seconds.
Too many requests, try again in 5 minutes.
Rate limit exceeded.
Service is down for maintenance, try again in 10 minutes.
The service is temporarily unavailable, try again later.
Your session has expired.
Sign in again to view this page.
Request blocked.
Incident id 1234.
Reference 1234.
Access to /page/1234 was denied by the administrator.
Access denied.
Something went wrong while loading the page.
The page you asked for was moved or removed.
The page could not be loaded.""",
    "filler": """\
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Dolor sit amet, word ipsum lorem.
TBD
To be determined.
-- to be completed by the security team --
TODO
TODO: write the analysis
TODO: add description
FIXME describe the flow
Fill in later (analysis)
Placeholder explanation for item 1
Placeholder text
Text goes here
Insert analysis...
Insert text here
This is dummy content number 1
This is sample text
sample answer sample answer sample answer
xxxx xxx xxxxx
asdf asdf asdf
test test test
blah blah blah
qwerty qwerty
foo bar baz
???""",
}

_DIGITS = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]+\b")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]")
_WORD = re.compile(rf"\w|{SLOT}")
_LETTER = re.compile(rf"[^\W\d]|{SLOT}")


@lru_cache(maxsize=1 << 16)
def skeleton(segment: str) -> tuple[str, str | None]:
    """The lower-case tokens of a segment and its label, if its own syntax shows one.

    Numbers and hexadecimal ids are 0, placeholders ``SLOT``; code spans, written `I` by then, stay apart from them.
    """
    label = None
    if _SYNTAX_MARK.search(segment):
        segment, n = OPEN_SYNTAX.subn(SLOT, segment)
        label = "placeholder" if n else None
        segment = DOUBTFUL_SYNTAX.sub(SLOT, segment)
    words = " ".join(_TOKEN.findall(_DIGITS.sub("0", segment.lower())))
    return words, label or ("filler" if monotonous(words) else None)


def monotonous(skeleton: str) -> bool:
    """Whether one word makes up most of a segment, three times at least."""
    words = re.findall(r"\w+", skeleton)
    if len(words) < 3:
        return False
    most = max(Counter(words).values())
    return most >= 3 and most * 5 >= len(words) * 3


def word_set(skeleton: str) -> frozenset[str]:
    """Words, numbers and placeholders of a skeleton; one without letters and placeholders is a word of its own."""
    if not _LETTER.search(skeleton):
        return frozenset(("\0" + skeleton,))
    return frozenset(filter(_WORD.match, skeleton.split(" ")))


def simhash(skeletons: list[str]) -> np.ndarray:
    """64-bit SimHash over words and pairs of successive words."""
    out = np.zeros(len(skeletons), dtype=np.uint64)
    bits = np.arange(64, dtype=np.uint64)
    for i, text in enumerate(skeletons):
        words = text.split(" ")
        features = words + [a + " " + b for a, b in zip(words, words[1:])]
        raw = np.array([_stable(f) for f in features], dtype=np.uint64)
        votes = ((mix(raw)[:, None] >> bits) & np.uint64(1)).astype(np.int32)
        out[i] = np.bitwise_or.reduce(np.where(votes.sum(axis=0) * 2 > len(features), np.uint64(1) << bits, np.uint64(0)))
    return out


@lru_cache(maxsize=1 << 16)
def _stable(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text)


@lru_cache(maxsize=1)
def _exemplars() -> tuple[list[str], list[frozenset[str]], np.ndarray]:
    """Labels, word sets and marks of the trusted sentences."""
    rows = [(label, skeleton(line)[0]) for label, lines in EXEMPLARS.items() for line in lines.splitlines()]
    return [r[0] for r in rows], [word_set(r[1]) for r in rows], simhash([r[1] for r in rows])


def nearest_exemplar(skeletons: list[str], marks: np.ndarray) -> list[int | None]:
    """The exemplar that each skeleton is like: the greatest overlap, the first on ties."""
    _, words, trusted = _exemplars()
    close = np.bitwise_count(marks[:, None] ^ trusted[None, :]) <= FAR
    out: list[int | None] = []
    for text, row in zip(skeletons, close, strict=True):
        own, best, at = word_set(text), LIKE_EXEMPLAR, None
        for i in np.flatnonzero(row):
            share = len(own & words[i]) / len(own | words[i])
            if share > best or (share == best and at is None):
                best, at = share, int(i)
        out.append(at)
    return out


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by node, the hash of the skeleton. The skeleton itself stands beside a node once a worker or so, and wherever a label does."""
    told: set[int] = set()
    for batch in batches:
        rows: list[tuple] = []
        for at, text in enumerate(batch.column("text").to_pylist()):
            for segment in segments(text) if text else ():
                words, label = skeleton(segment)
                if words:
                    node = _stable(words)
                    known = node in told and label is None
                    told.add(node)
                    rows.append((at, node, None if known else words, label))
        if len(told) > MOST_TOLD:
            told.clear()
        if rows:
            at, nodes, words, labels = zip(*rows, strict=True)
            where = pa.array(at)
            yield pa.record_batch(
                {name: batch.column(name).take(where) for name in ("origin", "row_id", "part")}
                | {
                    "node": pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)),
                    "skeleton": pa.array(words, type=pa.string()),
                    "label": pa.array(labels, type=pa.string()),
                }
            )


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = _exemplars()[0]
    for batch in batches:
        skeletons = batch.column("skeleton").to_pylist()
        marks = simhash(skeletons)
        like = nearest_exemplar(skeletons, marks)
        own = batch.column("label").to_pylist()
        labels = [a if a or i is None else names[i] for a, i in zip(own, like, strict=True)]
        how = ["seed" if a else None if i is None else "exemplar" for a, i in zip(own, like, strict=True)]
        yield pa.record_batch(
            {
                "node": batch.column("node"),
                "skeleton": batch.column("skeleton"),
                "label": pa.array(labels, pa.string()),
                "how": pa.array(how, pa.string()),
                "mark": pa.array(marks.view(np.int64)),
            }
        )


def tables(segments: int) -> list[int]:
    """Masks of the SimHash tables: in one of them at least, marks within ``NEAR`` bits agree.

    The 64 bits are cut into NEAR + c blocks; a table is keyed by c of them, and
    c grows with the number of distinct segments, so that a key has few of them
    at any size. Every choice finds the same pairs.
    """
    chosen = 1 if segments < 1 << 18 else 2 if segments < 1 << 27 else 3
    edges = [round(64 * i / (NEAR + chosen)) for i in range(NEAR + chosen + 1)]
    blocks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    masks = [sum(some) for some in combinations(blocks, chosen)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _keys(masks: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("table"), F.col("mark").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])


def _neighbours(frontier: DataFrame, others: DataFrame, masks: list[int]) -> DataFrame:
    """(node, label): the near-duplicates of the frontier among ``others``, with the label of the node that is near.

    Only marks are exchanged; the words of the few pairs that pass come in afterwards.
    """
    probes = frontier.select(F.col("node").alias("a"), F.col("mark").alias("mark_a"), F.inline(_keys(masks)))
    index = others.select(F.col("node").alias("b"), F.col("mark").alias("mark_b"), F.inline(_keys(masks)))
    close = (
        probes.join(index, ["table", "key"])
        .where(F.bit_count(F.col("mark_a").bitwiseXOR(F.col("mark_b"))) <= NEAR)
        .select("a", "b")
        .distinct()
    )
    words = F.array_distinct(F.filter(F.split("skeleton", " "), lambda w: w.rlike(rf"^(\w|{SLOT})")))
    left = frontier.select(F.col("node").alias("a"), F.col("label"), words.alias("words_a"))
    right = others.select(F.col("node").alias("b"), words.alias("words_b"))
    alike = F.size(F.array_intersect("words_a", "words_b")) >= ALIKE * F.size(F.array_union("words_a", "words_b"))
    # what makes a placeholder has to be in both
    shared = (F.col("label") != "placeholder") | F.array_contains("words_b", SLOT)
    return close.join(left, "a").join(right, "b").where(alike & shared).select(F.col("b").alias("node"), "label")


def residue_segments(texts: DataFrame) -> DataFrame:
    """origin, row_id, part, label, how of every residue segment of ``texts``.

    ``texts``: origin, row_id, part, text; other columns are ignored. Null,
    empty and blank texts have no segment; an empty table gives no rows.
    Labels are placeholder, filler, error_page and script_notice. ``how`` says
    what a segment has its label from: ``seed`` (open template syntax, one word
    over and over), ``exemplar`` (near-duplicate of a trusted sentence) or
    ``spread`` (reached from labelled segments through the connected component;
    it takes the most frequent label of its labelled neighbours, ties by name).
    """
    found = stage(
        texts.select("origin", "row_id", "part", "text")
        .where("text is not null")
        .mapInArrow(_segment_rows, "origin string, row_id bigint, part string, node bigint, skeleton string, label string"),
        "segments",
    )
    distinct = found.where("skeleton is not null").groupBy("node").agg(F.min("skeleton").alias("skeleton"), F.min("label").alias("label"))
    marked = stage(distinct.mapInArrow(_hash_rows, "node bigint, skeleton string, label string, how string, mark bigint"), "marks")
    masks = tables(marked.count())
    # staged, so that its true size tells Spark how to join it
    frontier = stage(marked.where("label is not null"), "frontier")
    reached = frontier.select("node", "label", "how")
    others = marked.where("label is null")
    while True:  # ends, as every hop but the last reaches new segments
        # only residue and what it reached look for neighbours, and only among what is not labelled yet:
        # the work follows the residue, not the corpus, and a large kind of residue is not paired with itself
        near = _neighbours(frontier, others, masks).groupBy("node", "label").count()
        new = stage(near.groupBy("node").agg(F.min_by("label", F.struct(-F.col("count"), F.col("label"))).alias("label")), "reached")
        if new.isEmpty():
            break
        reached = reached.unionByName(new.select("node", "label", F.lit("spread").alias("how")))
        frontier = stage(others.drop("label").join(new, "node"), "frontier")
        others = others.join(new.select("node"), "node", "left_anti")
    labelled = stage(reached.select("node", F.col("label").alias("spread"), "how"), "labels")
    return found.select("origin", "row_id", "part", "node", F.col("label").alias("own")).join(labelled, "node").select(
        "origin",
        "row_id",
        "part",
        F.coalesce("own", "spread").alias("label"),
        # a segment without open syntax of its own shares its skeleton with one that has some
        F.when(F.col("own").isNull() & (F.col("how") == "seed"), "spread").otherwise(F.col("how")).alias("how"),
    )
