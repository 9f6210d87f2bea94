"""Problem 8: token ids of whole texts under a public byte-level tokenizer.

The tokenizers library runs over Arrow batches. A byte-level vocabulary first
splits a text by a public pattern into words, each of which has the same ids
wherever it stands; a worker remembers them, so that only words it has not met
go through the library. Where the pattern could be read in two ways (rare
scripts, whose letters depend on the Unicode version, and rare white space) the
library gets the text itself. Long texts are fed in spans that end before white
space that follows a visible character, where the pattern always cuts, so
memory stays bounded. Decoding goes through
the reversed byte table: a token stands for bytes, and characters that several
tokens share come back once all of their bytes are together.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.llm.shingles import slices

#: Where the vocabulary files lie; a parameter of every operator.
FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k"
SPAN = 1 << 16
#: Words a worker remembers (some 250 bytes each; all are forgotten once it is full), the longest such word,
#: and bytes of text that are taken at once.
CACHED_WORDS, CACHED_LENGTH, PORTION = 1 << 18, 64, 1 << 19
#: The splitting pattern of the byte-level vocabularies, as their README gives it. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def hub_tokenizer(folder: str, name: str):
    """The vocabulary in the tokenizers library; strings like special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{folder}/{name}.json")
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(maxsize=4)
def rank_tokenizer(folder: str, name: str):
    """The same vocabulary as byte ranks, for counting and cutting by token."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(folder: str, name: str) -> list[bytes]:
    """The bytes of every token, from the vocabulary's printable characters.

    A byte-level vocabulary writes bytes as characters: printable ones as
    themselves, the others as the characters from 256 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    tokenizer = hub_tokenizer(folder, name)
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    out = []
    for i in range(tokenizer.get_vocab_size()):
        token = tokenizer.id_to_token(i)
        out.append(special[i].encode() if i in special else bytes(to_byte[c] for c in token))
    return out


#: A cut is safe before one of four plain white-space characters, behind a character that is white space nowhere.
_SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])")
#: Characters that every Unicode version of the last years reads alike: Latin, Greek, Cyrillic, common signs, Japanese
#: syllables, common Chinese characters, Korean syllables, full-width forms; without rare white space and numerals
#: that are no digits. Fixed values.
_UNSURE = re.compile(
    r"[^\t\n\r\x00-\x08\x0e-\x1b\x20-\x84\x86-\x9f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u02ff\u0370-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf"
    r"\u3001-\u3006\u3008-\u3020\u3041-\u30ff\u4e00-\u9fcc\uac00-\ud7a3\uff01-\uff5e]"
)
#: PATTERN in terms of the standard library, the same on characters that are not unsure; and for ASCII texts.
_WORDS = re.compile(r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?[^\s\w]+(?:_+[^\s\w]*)*| ?_+(?:[^\s\w]+_*)*|\s+(?!\S)|\s+")
_ASCII_WORDS = re.compile(r" ?[A-Za-z]+| ?\d+|'(?:s|t|re|ve|m|ll|d)| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.A)


def spans(text: str, size: int = SPAN) -> Iterator[str]:
    """``text`` in spans of about ``size`` characters that tokenize on their own."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _pieces(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """All spans of all texts, and the number of spans of each."""
    out, counts = [], np.empty(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        before = len(out)
        if text:
            out.extend(spans(text) if len(text) > SPAN else (text,))
        counts[i] = len(out) - before
    return out, counts


def _lists(values: list[list[int]], counts: np.ndarray, add: np.ndarray | None = None) -> pa.ListArray:
    lengths = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    flat = np.empty(int(lengths.sum()), dtype=np.int32)
    at = 0
    for ids in values:
        flat[at : at + len(ids)] = ids
        at += len(ids)
    if add is not None:
        flat += np.repeat(add, lengths).astype(np.int32)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    starts = np.concatenate(([0], np.cumsum(counts)))
    return pa.ListArray.from_arrays(pa.array(ends[starts].astype(np.int32)), pa.array(flat))


class WordEncoder:
    """Ids of texts from the ids of their words; the tokenizer sees a word once as long as it is remembered."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.known = tokenizer, {}

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if _UNSURE.search(text):
            return list(spans(text))
        return (_ASCII_WORDS if text.isascii() else _WORDS).findall(text)

    def encode(self, texts: list[str | None]) -> tuple[array, list[int]]:
        """All ids in a row, and the number of ids of each text."""
        split = [self.words(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known = {}
            new = set().union(*split)
        order = list(new)
        for at in range(0, len(order), 4096):
            part = order[at : at + 4096]
            for word, encoded in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[word] = array("i", encoded.ids)
        ids, counts = array("i"), []
        for own in split:
            before = len(ids)
            deque(map(ids.extend, map(self.known.__getitem__, own)), maxlen=0)
            counts.append(len(ids) - before)
        for word in order:
            if len(word) > CACHED_LENGTH:  # long ones hardly come again
                del self.known[word]
        return ids, counts


@lru_cache(maxsize=4)
def word_encoder(folder: str, name: str) -> WordEncoder:
    return WordEncoder(hub_tokenizer(folder, name))


def _encode(folder: str, name: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(folder, name)
        for batch in batches:
            for part in slices(batch, "text", PORTION):
                ids, counts = encoder.encode(part.column("text").to_pylist())
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                values = pa.array(np.frombuffer(ids, dtype=np.int32) if ids else np.empty(0, np.int32))
                yield pa.record_batch({key: part.column(key), "ids": pa.ListArray.from_arrays(pa.array(ends), values)})

    return run


def _encode_offsets(folder: str, name: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = hub_tokenizer(folder, name)
        for batch in batches:
            for part in slices(batch, "text", 1 << 17):
                pieces, counts = _pieces(part.column("text").to_pylist())
                encoded = tokenizer.encode_batch(pieces, add_special_tokens=False)
                lengths = np.array([len(p) for p in pieces], dtype=np.int64)
                before = np.cumsum(lengths) - lengths if len(lengths) else lengths
                heads = np.cumsum(counts) - counts
                base = before - np.repeat(before[np.minimum(heads, max(len(before) - 1, 0))] if len(before) else heads, counts)
                offsets = [e.offsets for e in encoded]
                yield pa.record_batch(
                    {
                        key: part.column(key),
                        "ids": _lists([e.ids for e in encoded], counts),
                        "starts": _lists([[a for a, _ in o] for o in offsets], counts, base),
                        "ends": _lists([[b for _, b in o] for o in offsets], counts, base),
                    }
                )

    return run


def encode(texts: DataFrame, key: str = "doc_id", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(key, ids ARRAY<INT>) of every row of ``texts`` (key, text), no special token added.

    An empty and a null text have the empty list. Other columns are ignored;
    repeated rows stay repeated; an empty table gives no rows.
    """
    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInArrow(_encode(folder, name, key), f"{key} {kind}, ids array<int>")


def encode_with_offsets(texts: DataFrame, key: str = "doc_id", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """As ``encode``, with the first and the end character of the text each token touches.

    Tokens that share a character have overlapping ranges.
    """
    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInArrow(
        _encode_offsets(folder, name, key), f"{key} {kind}, ids array<int>, starts array<int>, ends array<int>"
    )


def _decode(folder: str, name: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(folder, name)
        for batch in batches:
            texts = [
                None if ids is None else b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")
                for ids in batch.column("ids").to_pylist()
            ]
            yield pa.record_batch({key: batch.column(key), "text": pa.array(texts, type=pa.string())})

    return run


def decode(encoded: DataFrame, key: str = "doc_id", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(key, text) of rows (key, ids); bytes that form no character become U+FFFD, null ids a null text."""
    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(_decode(folder, name, key), f"{key} {kind}, text string")


def _count(folder: str, name: str, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = rank_tokenizer(folder, name)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                counts = [
                    sum(len(tokenizer.encode_ordinary(span)) for span in (spans(text) if len(text) > SPAN else (text,)))
                    if text
                    else 0
                    for text in part.column("text").to_pylist()
                ]
                columns = {k: part.column(k) for k in keys}
                yield pa.record_batch(columns | {"n_tokens": pa.array(counts, type=pa.int64())})

    return run


def count_tokens(texts: DataFrame, *keys: str, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """``keys`` and n_tokens of every row of ``texts``; 0 for empty and null texts."""
    kinds = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)
    return texts.select(*keys, "text").mapInArrow(_count(folder, name, list(keys)), f"{kinds}, n_tokens bigint")
