"""Problem 10: splitting oversized items at natural boundaries.

A text is encoded once; every token edge gets the coarsest separator it lies
at (section, paragraph, sentence or line, word, character). The text falls
into sections; one that has more tokens than a piece has room falls into its
paragraphs, and so on down to characters, so that a unit that fits whole is
never cut. Units are packed greedily, as many as the limit allows. The next
piece starts ``overlap`` tokens back, or at the first character edge before
that where a token splits a character, and has so much less room.

The recursion runs from cut to cut: the unit that starts at an edge is the
block of the coarsest kind that starts there and fits, and blocks of one kind
are taken in one step up to the end of the block they are parts of.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.llm.encoding import FOLDER, NAME, SPAN, rank_tokenizer, spans
from lodestrata.llm.shingles import slices

#: Places before which a text may be cut, coarsest first.
SEPARATORS = (
    # section: a blank line before a heading, a file or diff header, or an unindented definition
    re.compile(
        r"(?m)(?<=\n)(?=#{1,6} |={3,}|-{3,}|diff --git |@@ |# FILE:|From |class |def |func |function |export |public |static |module\.)"
    ),
    # paragraph: after a blank line
    re.compile(r"(?<=\n\n)(?=[^\n])|(?<=\n\r\n)(?=[^\r\n])"),
    # sentence or line
    re.compile(r"(?<=\n)(?=[^\n])|(?<=[.!?;])(?=\s)|(?<=[。！？；])"),
    # word
    re.compile(r"(?<=\S)(?=\s)|(?<=[,)\]}>])(?=\S)"),
)
WORST = len(SEPARATORS)


@lru_cache(maxsize=4)
def _token_lengths(folder: str, name: str) -> np.ndarray:
    tokenizer = rank_tokenizer(folder, name)
    out = np.zeros(tokenizer.n_vocab, dtype=np.int64)
    for rank in range(tokenizer.n_vocab):
        try:
            out[rank] = len(tokenizer.decode_single_token_bytes(rank))
        except KeyError:
            out[rank] = 0
    return out


def tokens_of(text: str, folder: str, name: str) -> np.ndarray:
    tokenizer = rank_tokenizer(folder, name)
    parts = [tokenizer.encode_ordinary(s) for s in (spans(text) if len(text) > SPAN else (text,))]
    return np.concatenate([np.asarray(p, dtype=np.int64) for p in parts]) if parts else np.empty(0, np.int64)


def edges_of(text: str, ids: np.ndarray, folder: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(character position, separator level) of the edge before each token, and the end.

    An edge inside a character has the position -1.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    ends = np.concatenate(([0], np.cumsum(_token_lengths(folder, name)[ids])))
    heads = (raw & 0xC0) != 0x80
    position = np.concatenate((np.cumsum(heads) - 1, [len(text)]))
    whole = np.concatenate((heads, [True]))
    place = np.where(whole[ends], position[ends], -1)
    at = np.full(len(text) + 1, WORST, dtype=np.int8)
    for level in range(WORST - 1, -1, -1):
        found = [m.start() for m in SEPARATORS[level].finditer(text)]
        if found:
            at[np.asarray(found)] = level
    return place, np.where(place >= 0, at[place], WORST + 1)


class _Edges:
    """Token edges by separator level."""

    def __init__(self, place: np.ndarray, level: np.ndarray) -> None:
        self.place, self.level, self.n = place, level, len(place) - 1
        self.at = [np.flatnonzero(level <= kind) for kind in range(WORST + 1)]

    def after(self, edge: int, kind: int) -> int:
        """The next edge of a level of ``kind`` or coarser; the end where there is none."""
        found = self.at[kind] if kind >= 0 else ()
        i = np.searchsorted(found, edge, side="right") if kind >= 0 else 0
        return int(found[i]) if i < len(found) else self.n

    def upto(self, edge: int, kind: int) -> int:
        """The last edge of a level of ``kind`` or coarser that is not behind ``edge``; -1 where there is none."""
        i = int(np.searchsorted(self.at[kind], edge, side="right")) - 1
        return int(self.at[kind][i]) if i >= 0 else -1

    def unit(self, edge: int, room: int) -> tuple[int, int]:
        """(level, end) of the unit that starts at ``edge``: the coarsest block that has at most ``room`` tokens."""
        for kind in range(0 if edge == 0 else min(int(self.level[edge]), WORST), WORST + 1):
            end = self.after(edge, kind)
            if end - edge <= room:
                return kind, end
        return WORST, end  # one character of more tokens than that

    def fill(self, start: int, fresh: int, most: int, room: int) -> int:
        """The end of the piece from ``start`` whose new tokens begin at ``fresh``: the last unit's that ends by ``most``."""
        end = fresh
        while end < self.n:
            kind, close = self.unit(end, room)
            if close > most:
                return end if end > fresh else close
            end = max(close, self.upto(min(most, self.after(end, kind - 1)), kind))
        return end


def cut(text: str, limit: int, overlap: int, folder: str = FOLDER, name: str = NAME) -> list[tuple[int, int, int, int]]:
    """Pieces of one text: (first character, end character, tokens, repeated tokens).

    ``tokens`` counts the piece encoded on its own and never exceeds ``limit``
    (unless a single character has more tokens than that).
    """
    ids = tokens_of(text, folder, name)
    if len(ids) <= limit:
        return [(0, len(text), len(ids), 0)] if len(ids) else []
    tokenizer = rank_tokenizer(folder, name)
    place, level = edges_of(text, ids, folder, name)
    edges = _Edges(place, level)
    out, start, fresh = [], 0, 0
    while fresh < len(ids):
        room = limit
        while True:
            end = edges.fill(start, fresh, min(start + room, len(ids)), max(1, room - (fresh - start)))
            # a piece that starts or ends inside a word may encode to more tokens than it had
            count = len(tokenizer.encode_ordinary(text[place[start] : place[end]]))
            if count <= limit or end - start <= 1:
                break
            room = min(room, end - start) - (count - limit)
            if start + room <= fresh:
                if fresh == start:
                    break  # one character of more tokens than the limit
                # no room beside the repeated tokens: repeat fewer
                start = _character_edge(place, min(start + count - limit, fresh))
                room = limit
        out.append((int(place[start]), int(place[end]), count, fresh - start))
        fresh = end
        start = _character_edge(place, max(end - overlap, 0))
    return out


def _character_edge(place: np.ndarray, token: int) -> int:
    while place[token] < 0:
        token -= 1
    return token


def _split(limit: int, overlap: int, key: str, with_text: bool, folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                rows: list[tuple] = []
                for at, text in enumerate(part.column("text").to_pylist()):
                    # every token has at least one byte, so a text within the limit in bytes needs no encoding
                    if text is None or (len(text) <= limit // 4) or len(text.encode("utf-8", "replace")) <= limit:
                        continue
                    pieces = cut(text, limit, overlap, folder, name)
                    if len(pieces) > 1:
                        rows.extend((at, i, *p, text[p[0] : p[1]] if with_text else None) for i, p in enumerate(pieces))
                if not rows:
                    continue
                at, number, first, end, tokens, repeated, text = zip(*rows, strict=True)
                columns = {
                    key: part.column(key).take(pa.array(at)),
                    "piece": pa.array(number, type=pa.int32()),
                    "start_char": pa.array(first, type=pa.int64()),
                    "end_char": pa.array(end, type=pa.int64()),
                    "n_tokens": pa.array(tokens, type=pa.int32()),
                    "repeated_tokens": pa.array(repeated, type=pa.int32()),
                }
                if with_text:
                    columns["text"] = pa.array(text, type=pa.string())
                yield pa.record_batch(columns)

    return run


def split_oversized(
    texts: DataFrame,
    limit: int,
    overlap: int,
    key: str = "doc_id",
    with_text: bool = True,
    folder: str = FOLDER,
    name: str = NAME,
) -> DataFrame:
    """Pieces of every text of more than ``limit`` tokens; the other texts give no row.

    ``texts``: key, text; other columns are ignored. Returns key, piece (from
    0), start_char, end_char, n_tokens, repeated_tokens (taken over from the
    piece before) and, if asked, text. The pieces without their repeated
    tokens join to the text. Null and empty texts, and an empty table, give
    no rows; repeated rows are cut each.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    kind = texts.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, piece int, start_char bigint, end_char bigint, n_tokens int, repeated_tokens int"
    return texts.select(key, "text").mapInArrow(
        _split(limit, overlap, key, with_text, folder, name), schema + (", text string" if with_text else "")
    )
