"""Problem 2: texts cut off by field limits or in transfer.

One pass over the texts gathers corpus statistics: the vocabulary of word
pieces that occur before the end of a text, the skeletons of all prose
sentences, and the lengths of the texts of each source. Around them stand

* a trie of the vocabulary, kept as a table of all proper prefixes of its
  words (the trie's inner nodes): a text whose last piece is not a known word
  but a proper prefix of known ones was cut inside a word;
* a terminal-context model: how often the last one to three tokens of a
  sentence end sentences, and how often they go on. A text that stops in a
  context that hardly ever ends a sentence was cut between words. Ends of
  whole texts without an end mark count as ends only beside contexts that are
  known otherwise, as they may be cuts themselves;
* length evidence: a source in which far more texts without an end have one
  length than have the lengths near it cuts there; a text that ends openly at
  such a length is cut unless its last words plainly end a sentence.

The same pass looks at the end of every text and keeps those that are not
clearly complete, with what the statistics have to decide about. Open code
spans, open tags, open brackets and signs of omission decide where the
vocabulary and the lengths do not. Code between tags is looked at too: tags may
be put around what was cut before.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.prose import CODE_TAGS, FIELDS, INVISIBLE, TICKS, has_visible, is_code_line, mostly_code, prose_lines, split_sentences
from lodestrata.llm.residue import residue_segments
from lodestrata.staging import stage

#: A context that ends a sentence less often than this is no end; with length evidence the second holds.
RARE_END, RARE_END_AT_LIMIT = 0.1, 0.8
#: Occurrences a context needs to count as evidence.
LEAST_SEEN = 3
#: A piece is known if it occurs at least this often, and this often for each word it begins.
KNOWN_COUNT, KNOWN_RATIO = 2, 1e-3
#: Shares of lines that end like statements, and with a semicolon, from which on a last line without end is cut.
STATEMENT_SHARE, SEMICOLON_SHARE = 0.6, 0.25
#: A length is a limit if so many unended texts of a source have it, this share of its texts of that length, and so
#: many times as many as a length near it, up to so many characters away, has on average.
LIMIT_ROWS, LIMIT_SHARE, LIMIT_PEAK, LIMIT_NEAR = 5, 0.5, 8.0, 10
#: Longest run of letters that is a word (longer ones are data); counters are handed on beyond so many keys.
WORD_LETTERS, MOST_KEYS = 64, 200_000

#: Signs that something was left out, at the end of a text. Fixed values.
SIGN = re.compile(
    r"(?:\.{3,}|…+|�+"
    r"|[\[(<{]\s*(?:\.{2,}|…|(?:(?:output |text |message |trace )?(?:truncated|cut(?: off)?|snip(?:ped)?|shortened|abbreviated|clipped|omitted)|(?:read |see |show )?more|cont(?:inued|\.|'d)?|rest omitted)(?!\w))[^\])>}]{0,24}[\])>}]"
    r"|-{2,}\s*more\s*-{2,}|\b(?:read|show) more)\s*$",
    re.I,
)
#: What a sign ends with.
_SIGN_ENDS = frozenset(".…\ufffd])>}-eE")


def ending_sign(reach: str) -> re.Match | None:
    """The sign of omission that a text ends in."""
    last = reach.rstrip()[-1:]
    if last not in _SIGN_ENDS or last == "." and not reach.rstrip().endswith("..."):
        return None
    return SIGN.search(reach)


_ENDED = re.compile(r"[.!?。！？][\"'”’)\]*_]*$")
_LETTERS = re.compile(r"[A-Za-z]+")
_HUMPS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_LAST_PIECE = re.compile(r"([A-Za-z]+)$")
_CWE = re.compile(r"(?i)cwe-\d+")
_TOKEN = re.compile(
    r"`I`(?:\(\))?|->|[A-Za-z][A-Za-z0-9]*(?:[_$][A-Za-z0-9]+)+|[A-Za-z]+[0-9][A-Za-z0-9]*|[a-z]+[A-Z][A-Za-z0-9]*"
    r"|[^\W\d_]+(?:'[a-z]+)?|\d+|[^\w\s]"
)
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")
_IDENTIFIER = re.compile(r"[_$\d]|[a-z][A-Z]")
_WRAPPED = re.compile(r"<(" + "|".join(CODE_TAGS) + r")>((?:(?!<\1>).)*)</\1>$", re.S | re.I)
_CUT_LINE = re.compile(r"^\s{2,}\S|[({\[=]")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_LAST_NAME = re.compile(r"[A-Za-z_$][\w$]*$")
_CLOSED = re.compile(r"</(?:" + "|".join((*CODE_TAGS, "think")) + r")>$|```$", re.I)
#: Characters at the end of a text in which its last piece, end mark or sign is sought (none is longer).
_REACH = 96
_FIELD_LINE = re.compile(r"^\s*(" + "|".join(FIELDS) + r")\s*:", re.I)
_OPEN_TAG = re.compile(r"<(/?)(" + "|".join((*CODE_TAGS, "think")) + r")>", re.I)


def tokens(sentence: str) -> list[str]:
    """Tokens of a prose sentence: identifiers as `I` or _i, numbers as 0, wide script by character."""
    out = []
    for token in _TOKEN.findall(sentence):
        if token.startswith("`I`"):
            out.append("`I`")
        elif token[0].isdigit():
            out.append("0")
        elif _IDENTIFIER.search(token) and token[0].isascii():
            out.append("_i")
        elif _WIDE.match(token):
            out.extend(token)
        else:
            out.append(token.lower())
    return out


def contexts(words: list[str]) -> list[str]:
    """The contexts of three, two and one token that end at the last of ``words``."""
    padded = ["^", "^", *words]
    return [f"3 {' '.join(padded[-3:])}", f"2 {' '.join(padded[-2:])}", f"1 {padded[-1]}"]


def body_of(text: str) -> str:
    return text.rstrip().rstrip(INVISIBLE).rstrip()


def sentences(text: str) -> tuple[list[str], str | None]:
    """Complete sentences of the prose, and the last fragment if it has no end mark.

    A last fragment that ends in a sign of omission is neither.
    """
    done: list[str] = []
    last: str | None = None
    lines = prose_lines(text)
    for number, line in enumerate(lines):
        parts = split_sentences(line)
        for at, part in enumerate(parts):
            if number < len(lines) - 1 or at < len(parts) - 1:
                done.append(part)
            elif not ending_sign(part[-_REACH:]):
                if _ENDED.search(part[-_REACH:]):
                    done.append(part)
                else:
                    last = part
    return done, last


def pieces_of(word: str) -> list[str]:
    return [h.lower() for h in _HUMPS.findall(word)]


def unbalanced(code: str) -> bool:
    """Whether a code text ends inside a string, a bracket or an open statement."""
    bare = re.sub(r"\\.", "", code)
    bare = re.sub(r"(?m)//[^\n]*$|#[^\n{(\[]*$|/\*.*?\*/", "", bare)
    last = bare.rstrip().rsplit("\n", 1)[-1]
    no_strings = re.sub(r"\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`", "S", bare)
    tail = no_strings.rstrip().rsplit("\n", 1)[-1]
    if tail.count('"') % 2 or "`" in tail:
        return True
    # a block whose end got lost in its middle still ends with one
    for a, b in ("()", "[]") if last.rstrip().endswith("}") else ("()", "[]", "{}"):
        if no_strings.count(a) > no_strings.count(b):
            return True
    return _dangling(last)


def _dangling(line: str) -> bool:
    """Whether a line of code ends with an operator that wants more."""
    return bool(re.search(r"(?:[=+*/%&|^,.(\[<-]|->|&&|\|\|)\s*$", line)) and not line.rstrip().endswith(("++", "--", "*/", "/>", "->"))


def wrapped_cut(code: str) -> bool:
    """Whether code between tags stops inside its last statement.

    Blocks left open do not count: the tags show that the piece is meant to
    end here. A line without end is cut where most of the others have one, as
    is one whose last name only begins another name of the code.
    """
    code = code.rstrip()
    last = re.sub(r"\s+(?://|#\s).*$", "", code.rsplit("\n", 1)[-1]).rstrip()
    if not is_code_line(last) and not _CUT_LINE.search(last) or last.lstrip().startswith(("//", "#", "*", "/*", "<!--")):
        return False
    closed = all(last.count(a) <= last.count(b) for a, b in ("()", "[]")) and last.count('"') % 2 == 0
    if closed and last.endswith((";", "{", "}", ":", ")", "]", ">", '"', "'")):
        return False
    bare = re.sub(r"\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`", "S", re.sub(r"(?m)//[^\n]*$|/\*.*?\*/", "", re.sub(r"\\.", "", code)))
    if any(bare.count(a) > bare.count(b) for a, b in ("()", "[]")) or last.count('"') % 2 or _dangling(last):
        return True
    lines = [x.rstrip() for x in code.split("\n")[:-1] if x.strip()]
    ends = Counter(x[-1] for x in lines)
    if len(lines) > 2 and ends[";"] >= SEMICOLON_SHARE * len(lines) and ends[";"] + ends["{"] + ends["}"] >= STATEMENT_SHARE * len(lines):
        return True
    name = _LAST_NAME.search(last)
    names = Counter(_NAME.findall(code)) if name else {}
    return bool(name) and names[name.group()] == 1 and any(x.startswith(name.group()) and len(x) > len(name.group()) for x in names)


def mostly_prose(body: str) -> bool:
    return not mostly_code(body.strip().splitlines())


def _open_tag(text: str) -> bool:
    """Whether a tag that wraps code or thought is opened and not closed at the end."""
    depth: Counter = Counter()
    for close, name in _OPEN_TAG.findall(text):
        depth[name.lower()] += -1 if close else 1
    return any(v > 0 for v in depth.values())


def look_at_end(text: str) -> tuple[str, str | None, str | None, list[str]] | None:
    """What the end of a text says: None if it is complete or empty.

    Otherwise (verdict, last piece, bare token, contexts); the verdict is
    ``cut`` where the text itself shows it and ``open`` where the corpus has
    to decide.
    """
    whole = body_of(text)
    if not whole or not has_visible(whole):
        return None
    reach = whole[-_REACH:]
    sign = ending_sign(reach)
    if sign:
        return ("cut", None, None, []) if has_visible(whole[: len(whole) - len(reach) + sign.start()]) else None
    if "<" in whole and _open_tag(whole) or whole.count("```") % 2:
        return ("cut", None, None, [])
    last_line = whole.rsplit("\n", 1)[-1]
    if _CLOSED.search(reach):
        inner = _WRAPPED.search(whole) if reach.endswith(">") else None
        return ("cut", None, None, []) if inner and not mostly_prose(inner.group(2)) and wrapped_cut(inner.group(2)) else None
    if last_line.count("`") % 2:
        # a template literal of a code text may span lines; a code span of prose does not
        return ("cut", None, None, []) if not is_code_line(last_line) or whole.count("`") % 2 else None
    last_piece = _LAST_PIECE.search(reach)
    piece = pieces_of(last_piece.group(1))[-1] if last_piece and pieces_of(last_piece.group(1)) else None
    if is_code_line(last_line) and not _FIELD_LINE.match(last_line):
        lines = whole.split("\n")
        first = len(lines)
        while first and (not lines[first - 1].strip() or is_code_line(lines[first - 1])):
            first -= 1
        if unbalanced("\n".join(lines[first:])):
            return ("cut", None, None, [])
        return ("open", piece, None, []) if piece else None
    if _ENDED.search(last_line[-_REACH:]):
        return None
    masked = (split_sentences(TICKS.sub("`I`", last_line)) or [last_line])[-1]
    for a, b in ("()", "[]", "{}"):
        if masked.count(a) > masked.count(b):
            return ("cut", None, None, [])
    field = _FIELD_LINE.match(last_line)
    if not field and re.search(r"(?m)^\s*status\s*:\s*\S", whole, re.I) and re.match(r"^\w{0,8}$", last_line.strip()):
        wanted = last_line.strip().lower()
        if any(f.startswith(wanted) for f in FIELDS):
            return ("cut", None, None, [])
    if field and not last_line[field.end() :].strip():
        return ("cut", None, None, []) if re.search(r"(?m)^\s*\w+\s*:[ \t]*\S", whole) else None
    cwe = re.search(r"(?i)\bcwe(?:-\d*)?$", last_line[-_REACH:])
    if cwe:
        return ("open", cwe.group(0).lower(), "cwe", [])
    words = tokens(masked)
    if not words:
        return None
    return ("open", piece if not last_line.endswith("`") else None, None, contexts(words))


_READ = (
    "kind string, key string, n bigint, origin string, row_id bigint, part string, source string, verdict string, piece string, "
    "contexts array<string>, chars bigint, octets bigint"
)
_FIELDS = {
    "kind": pa.string(), "key": pa.string(), "n": pa.int64(), "origin": pa.string(), "row_id": pa.int64(), "part": pa.string(), "source": pa.string(),
    "verdict": pa.string(), "piece": pa.string(), "contexts": pa.list_(pa.string()), "chars": pa.int64(), "octets": pa.int64(),
}


def _rows(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch of ``_READ`` with nulls in the columns that are not given."""
    size = len(next(iter(columns.values())))
    return pa.record_batch({name: columns[name] if name in columns else pa.nulls(size, kind) for name, kind in _FIELDS.items()})


class _Statistics:
    """Counts of words, sentences, last fragments and lengths, until there are too many keys to keep."""

    def __init__(self) -> None:
        self.words: Counter = Counter()
        self.spoken: Counter = Counter()
        self.last_words: Counter = Counter()
        self.other: Counter = Counter()

    def add(self, text: str, part: str | None, source: str | None, octets: int) -> None:
        whole = body_of(text)
        found = _LETTERS.findall(whole)
        reach = whole[-_REACH:]
        if found and _LAST_PIECE.search(reach):
            found.pop()  # what stands last may be cut: it vouches for no word
        self.words.update(found)
        for cwe in _CWE.finditer(whole):
            if cwe.end() < len(whole):
                self.other["c", cwe.group().lower()] += 1
        done, last = sentences(whole)
        self.spoken.update(sentence.rstrip(".!?。！？") for sentence in done)
        if last is not None and last.count("`") % 2 == 0:
            self.last_words[last] += 1
        ended = int(bool(_ENDED.search(reach)))
        for unit, size in (("c", len(text)), ("b", octets)):
            self.other["l", f"{part}\t{source or ''}\t{unit}\t{size}\t{ended}"] += 1

    def full(self) -> bool:
        return len(self.words) + len(self.spoken) + len(self.last_words) + len(self.other) > MOST_KEYS

    def flush(self) -> pa.RecordBatch:
        # each distinct word and sentence is taken apart once
        pieces: Counter = Counter()
        for word, n in self.words.items():
            for piece in pieces_of(word) if len(word) <= WORD_LETTERS else ():
                pieces[piece] += n
        rows = [("w", k, n) for k, n in pieces.items()]
        for kind, counted in (("s", self.spoken), ("u", self.last_words)):
            skeletons: Counter = Counter()
            for sentence, n in counted.items():
                skeletons[" ".join(tokens(sentence))] += n
            rows += [(kind, k, n) for k, n in skeletons.items()]
        rows += [(kind, key, n) for (kind, key), n in self.other.items()]
        self.__init__()
        kinds, keys, counts = zip(*rows, strict=True) if rows else ((), (), ())
        return _rows({"kind": pa.array(kinds, pa.string()), "key": pa.array(keys, pa.string()), "n": pa.array(counts, pa.int64())})


def _read(judged: str | None):
    """One pass over the texts: the statistics of all of them, and what the ends of the judged ones say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = _Statistics()
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("text", "part", "source"))
            for at, (text, part, source) in enumerate(zip(*columns, strict=True)):
                if not text:
                    continue
                octets = len(text.encode("utf-8", "replace"))
                counted.add(text, part, source, octets)
                if counted.full():
                    yield counted.flush()
                seen = look_at_end(text) if judged in (None, part) else None
                if seen is None:
                    continue
                verdict, piece, _, found = seen
                if verdict == "cut":  # what the vocabulary and the lengths say of it comes first
                    last = _LAST_PIECE.search(body_of(text)[-_REACH:])
                    piece = (pieces_of(last.group(1)) or [None])[-1] if last else None
                rows.append((at, verdict, piece, found, len(text), octets))
            if rows:
                at, *values = zip(*rows, strict=True)
                where = pa.array(at)
                ends = {name: pa.array(v, _FIELDS[name]) for name, v in zip(("verdict", "piece", "contexts", "chars", "octets"), values, strict=True)}
                yield _rows({name: batch.column(name).take(where).cast(_FIELDS[name]) for name in ("origin", "row_id", "part", "source")} | ends)
        yield counted.flush()

    return run


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends: Counter = Counter()
        loose: Counter = Counter()
        goes_on: Counter = Counter()
        for kind, skeleton, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "key", "n")), strict=True):
            words = skeleton.split(" ")
            for at in range(len(words)):
                into = goes_on if at < len(words) - 1 else ends if kind == "s" else loose
                for context in contexts(words[max(0, at - 2) : at + 1] if at >= 2 else words[: at + 1]):
                    into[context] += n
        keys = list(ends.keys() | goes_on.keys() | loose.keys())
        yield pa.record_batch(
            {
                "context": pa.array(keys, pa.string()),
                "ends": pa.array([ends[k] for k in keys], pa.int64()),
                "loose": pa.array([loose[k] for k in keys], pa.int64()),
                "goes_on": pa.array([goes_on[k] for k in keys], pa.int64()),
            }
        )


def _known(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(piece, unknown_prefix, prefix) for the wanted pieces, by the trie of the vocabulary.

    A prefix is an inner node: it begins known words. It is unknown if it is
    no word of its own, measured by the words it begins.
    """
    whole = wanted.join(counts, wanted["piece"] == counts["key"], "left").select("piece", F.coalesce("n", F.lit(0)).alias("own"))
    inner = counts.where(F.length("key") > 1).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.length("key") - 1), lambda i: F.substring("key", F.lit(1), i))).alias("piece"),
        "n",
    )
    begun = inner.join(wanted, "piece", "left_semi").groupBy("piece").agg(F.sum("n").alias("begun"))
    prefix = F.coalesce("begun", F.lit(0)) >= KNOWN_COUNT
    rare = F.col("own") < F.greatest(F.lit(float(KNOWN_COUNT)), F.col("begun") * KNOWN_RATIO)
    return whole.join(begun, "piece", "left").select("piece", (prefix & rare).alias("unknown_prefix"), prefix.alias("prefix"))


def _limits(lengths: DataFrame) -> DataFrame:
    """(part, source, unit, size) at which a source cuts its texts.

    At a limit most texts have no end mark, and there are far more of them
    than at the lengths around it.
    """
    fields = F.split("key", "\t")
    counted = (
        lengths.select(
            fields[0].alias("part"),
            fields[1].alias("source"),
            fields[2].alias("unit"),
            fields[3].cast("bigint").alias("size"),
            F.when(fields[4] == "1", 0).otherwise(F.col("n")).alias("unended"),
            "n",
        )
        .groupBy("part", "source", "unit", "size")
        .agg(F.sum("n").alias("n"), F.sum("unended").alias("unended"))
    )
    # a row is a length, of which a source has as many as its longest text has characters at most
    near = Window.partitionBy("part", "source", "unit").orderBy("size").rangeBetween(-LIMIT_NEAR, LIMIT_NEAR)
    return (
        counted.withColumn("usual", (F.sum("unended").over(near) - F.col("unended")) / (2 * LIMIT_NEAR))
        .where((F.col("unended") >= LIMIT_ROWS) & (F.col("unended") >= LIMIT_SHARE * F.col("n")) & (F.col("unended") >= LIMIT_PEAK * F.col("usual")))
        .select("part", "source", "unit", "size")
    )


def truncated_texts(texts: DataFrame, part: str | None = None, residue: DataFrame | None = None) -> DataFrame:
    """origin, row_id, part, source, evidence of every text that was cut off.

    With ``part`` only the texts of that part are judged, by the statistics of
    all ``texts``: the same rows as those of that part without it. ``residue``:
    origin, row_id, part of the texts of problem 3, if they are known already.

    ``texts``: origin, row_id, part, source, text; other columns are ignored.
    evidence is the first of ``word`` (its last piece is an unknown proper
    prefix of known words), ``length`` (it ends openly at a length at which its
    source cuts), ``sign`` (the text shows it: an omission sign, an open span,
    tag or bracket) and ``context`` (cut between words) that holds. Null, empty and blank texts, and texts of residue, are none; a
    null source is a source of its own; repeated rows stay repeated; an empty
    table gives no rows.
    """
    rows = texts.select("origin", "row_id", "part", "source", "text").where("text is not null")
    read = stage(rows.mapInArrow(_read(part), _READ), "read")
    statistics = stage(read.where("kind is not null").groupBy("kind", "key").agg(F.sum("n").alias("n")), "statistics")
    ends = read.where("verdict is not null").drop("kind", "key", "n")
    undecided = ends.withColumn("row", F.xxhash64("origin", "row_id", "part", "piece", "contexts"))
    vocabulary = statistics.where("kind in ('w', 'c')").groupBy("key").agg(F.sum("n").alias("n"))
    known = _known(vocabulary, undecided.where("piece is not null").select("piece").distinct())
    wanted = undecided.select("row", F.posexplode("contexts").alias("order", "context"))
    counts = (
        statistics.where("kind in ('s', 'u') and key <> ''")
        .select("kind", "key", "n")
        .mapInArrow(_context_rows, "context string, ends bigint, loose bigint, goes_on bigint")
        .join(wanted.select("context").distinct(), "context", "left_semi")
        .groupBy("context")
        .agg(*[F.sum(c).alias(c) for c in ("ends", "loose", "goes_on")])
        .where(F.col("ends") + F.col("goes_on") >= LEAST_SEEN)
        .select("context", ((F.col("ends") + F.col("loose")) / (F.col("ends") + F.col("loose") + F.col("goes_on"))).alias("share"))
    )
    # an outer join: the side of all undecided texts, small as it looks in storage, is never the one to broadcast
    judged = (
        wanted.join(counts, "context", "left")
        .groupBy("row")
        .agg(F.min_by("share", F.when(F.col("share").isNotNull(), F.col("order"))).alias("end_share"))
    )
    limits = _limits(statistics.where("kind = 'l'"))
    at_limit = F.coalesce("char_limit", F.lit(False)) | F.coalesce("byte_limit", F.lit(False))

    def limit(unit: str, size: str, flag: str) -> tuple[DataFrame, Column]:
        found = limits.where(F.col("unit") == unit).select(
            F.col("part").alias(f"{flag}_part"), F.col("source").alias(f"{flag}_source"), F.col("size").alias(f"{flag}_size"), F.lit(True).alias(flag)
        )
        return found, (
            (F.col("part") == F.col(f"{flag}_part"))
            & (F.coalesce("source", F.lit("")) == F.col(f"{flag}_source"))
            & (F.col(size) == F.col(f"{flag}_size"))
        )

    chars, same_chars = limit("c", "chars", "char_limit")
    octets, same_octets = limit("b", "octets", "byte_limit")
    decided = (
        undecided.join(known, "piece", "left")
        .join(judged, "row", "left")
        .join(chars, same_chars, "left")
        .join(octets, same_octets, "left")
        .withColumn(
            "evidence",
            F.when(F.col("unknown_prefix"), "word")
            .when((F.col("verdict") == "cut") & at_limit, "length")
            .when(F.col("verdict") == "cut", "sign")
            # in prose no sentence knows the last token: the beginning of a word, even if it is one elsewhere
            .when(F.col("prefix") & (F.size("contexts") > 0) & F.col("end_share").isNull(), "word")
            .when(at_limit & (F.col("end_share") < RARE_END_AT_LIMIT), "length")
            .when(F.col("end_share") < RARE_END, "context"),
        )
        .where("evidence is not null")
    )
    names = ["origin", "row_id", "part", "source"]
    cut = decided.select(*names, "evidence")
    if residue is None:
        residue = residue_segments(rows).select("origin", "row_id", "part").distinct()
    return cut.join(residue, ["origin", "row_id", "part"], "left_anti")
