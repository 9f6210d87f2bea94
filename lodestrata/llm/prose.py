"""Telling prose from code, tags and fields in records of code review."""

from __future__ import annotations

import re

#: Tags that wrap code or listings in a question. Fixed values.
CODE_TAGS = ("SCAN", "GENERATE", "EXPLAIN", "SYNTHESIZE")
#: Field names of a verdict. Fixed values.
FIELDS = ("status", "cwe", "severity", "line", "trace", "fix")

#: Share of code lines up to which the body of a tag is prose, whatever its length.
CODE_SHARE = 0.1
INVISIBLE = "​‌‍⁠﻿­"
_CODE_BLOCK = re.compile(r"<(" + "|".join(CODE_TAGS) + r")>(.*?)(?:</\1>|\Z)", re.S | re.I)
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
TICKS = re.compile(r"`[^`\n]*`")
_CODE_LINE = re.compile(
    r"""^(?:\t|\ {2,})\S.*$
    |.*[;{}]\s*$
    |^\s*(?:[}\])]|//|/\*|\*/|\#(?!\#)|@\w|<\?php|<!--)
    |^(?:import|package|from|using|require|include)\s[\w.*{"'<].*(?<![.?!:])$
    |^(?:async\s+)?(?:def|class|func|function|interface|struct|enum)\s+[\w$].*[({:]
    |^(?:export|public|private|protected|static|async|const|let|var|final|module\.exports)\b.*[=({]
    |^(?:if|elif|else|for|while|with|try|except|finally|switch|case)\b.*[:{]\s*$
    |^(?:return|raise|throw|del|assert|await|yield)\b[^.]*$
    |^[\w$.\[\]>-]+\s*(?:[+\-*/|]?=|\+=)\s*\S.*$
    |^[\w$]+(?:(?:\.|->|::)[\w$]+)*\([^.]*\)[;,]?$
    |^[-\w.$]+\s*->\s*[\w$]+\s*=""",
    re.X,
)


#: Lines that end like code but are open template syntax or the body of an error.
_NOT_CODE = re.compile(
    r"""^(?!\s*(?:return|const|let|var|export|import|yield|throw)\b)(?:[^{}=;]*(?:\{\{[^{}]*\}\}|\{%[^{}]*%\}|(?<![\w)])\$?\{[a-z]+(?:_[a-z]+)*\}))+[\s.]*$|^\s*\{\s*["']\w+["']\s*:""", re.I
)


def is_code_line(line: str) -> bool:
    return bool(_CODE_LINE.match(line)) and not (line[:1] not in " \t" and _NOT_CODE.match(line))


def mostly_code(lines: list[str]) -> bool:
    """Whether more than CODE_SHARE of the lines are lines of code; the rest is not looked at once that is plain."""
    most = int(len(lines) * CODE_SHARE)
    return any(n >= most for n, _ in enumerate(filter(is_code_line, lines)))


def without_code_blocks(text: str) -> str:
    """``text`` with tagged and fenced code taken out, unless a tag wraps prose."""

    def inner(match: re.Match) -> str:
        body = match.group(2).strip()
        lines = body.splitlines()
        if body and (len(lines) == 1 and " " not in body or not mostly_code(lines)):
            return "\n" + body + "\n"
        return "\n"

    if "<" in text:
        text = _CODE_BLOCK.sub(inner, text)
    return _FENCE.sub("\n", text) if "```" in text else text


def prose_lines(text: str) -> list[str]:
    """Lines of ``text`` outside code, with code spans in back ticks written as `I`."""
    out = []
    for line in without_code_blocks(text).splitlines():
        if "`" in line:
            line = TICKS.sub("`I`", line)
        if line.strip() and not is_code_line(line):
            out.append(line)
    return out


_FIELD_NAME = re.compile(r"^\s*(?:" + "|".join(FIELDS) + r")\s*:[ \t]*", re.I)
_TAG = re.compile(r"</?\w+>")
_SENTENCE_END = re.compile(r"[.!?][)\"'\]”’]*\s+|[。！？]")
_VISIBLE = re.compile(r"[^\W_]")


def split_sentences(line: str) -> list[str]:
    """Sentences of one line, each with its end mark."""
    out, at = [], 0
    for match in _SENTENCE_END.finditer(line):
        out.append(line[at : match.end()].strip())
        at = match.end()
    rest = line[at:].strip()
    if rest:
        out.append(rest)
    return out


def segments(text: str) -> list[str]:
    """Sentences of the prose of ``text``, without tags and field names."""
    return [part for line in prose_lines(text) for part in split_sentences(_FIELD_NAME.sub("", line)) if part]


def has_visible(text: str) -> bool:
    """Whether anything shows in an answer beside tags, field names and invisible characters."""
    return any(_VISIBLE.search(_FIELD_NAME.sub("", _TAG.sub(" ", line))) for line in text.splitlines())
