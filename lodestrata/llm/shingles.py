"""Word shingles of whole Arrow batches, vectorised with numpy.

Words are maximal runs of ``a-z``, ``0-9`` and ``_`` of the lower-cased text.
A word's hash is a polynomial over its bytes, taken as a difference of prefix
sums modulo 2**64, so no Python loop runs over words or characters. A shingle
is the hash of k successive words; a document's shingles are a set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _U(0xD6E8FEB86659FD93)
_BLOCK = 1 << 20
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), ord("_")]] = True
_powers: dict[str, np.ndarray] = {}


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    v = values.astype(_U, copy=True)
    v ^= v >> _U(30)
    v *= _U(0xBF58476D1CE4E5B9)
    v ^= v >> _U(27)
    v *= _U(0x94D049BB133111EB)
    v ^= v >> _U(31)
    return v


def _power_table(base: int, length: int, name: str) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < length:
        steps = np.full(max(length, _BLOCK), _U(base), dtype=_U)
        steps[0] = 1
        table = np.multiply.accumulate(steps)
        _powers[name] = table
    return table[:length]


def _block_words(data: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of one block; words end at ``starts_at`` too."""
    word = _WORD_BYTE[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    before[starts_at] = False
    first = np.flatnonzero(word & ~before)
    if not len(first):
        return np.empty(0, _U), first
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    after[starts_at[starts_at > 0] - 1] = False
    last = np.flatnonzero(word & ~after)
    n = len(data)
    sums = np.cumsum(data.astype(_U) * _power_table(_BASE, n, "up"), dtype=_U)
    below = np.where(first > 0, sums[first - 1], _U(0))
    hashes = (sums[last] - below) * _power_table(_BASE_INVERSE, n, "down")[first]
    return mix(hashes + (last - first).astype(_U)), first


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string array, and the row of each (nulls have none)."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.empty(0, _U), np.empty(0, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if buffers[2] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    bounds = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    found, places, at = [], [], 0
    while at < len(data):
        end = min(at + _BLOCK, len(data))
        while end < len(data) and _WORD_BYTE[data[end]]:  # never cut inside a word
            stop = min(end + 4096, len(data))
            gap = np.flatnonzero(~_WORD_BYTE[data[end:stop]])
            end = end + int(gap[0]) if len(gap) else stop
            if len(gap):
                break
        inside = bounds[(bounds >= at) & (bounds < end)] - at
        hashes, first = _block_words(data[at:end], inside)
        found.append(hashes)
        places.append(first + at)
        at = end
    if not found:
        return np.empty(0, _U), np.empty(0, np.int64)
    place = np.concatenate(places)
    return np.concatenate(found), np.searchsorted(offsets, place, side="right") - 1


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles: (values, starts), row r has values[starts[r]:starts[r+1]], ascending."""
    words, row = words_of(texts)
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, _U), np.zeros(len(texts) + 1, np.int64)
    whole = row[:n] == row[k - 1 :]
    value = words[:n].copy()
    for j in range(1, k):
        value = value * _STEP + words[j : j + n]
    value, row = mix(value[whole]), row[:n][whole]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    if len(value):
        new = np.empty(len(value), dtype=bool)
        new[0] = True
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(texts) + 1))


def fingerprints(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set: equal sets have equal pairs, whatever their order."""
    counts = np.diff(starts)
    out = []
    for salt in (0xA5A5A5A5A5A5A5A5, 0x5DEECE66D1CE4E5B):
        total = np.concatenate(([_U(0)], np.cumsum(mix(values ^ _U(salt)), dtype=_U)))
        out.append((total[starts[1:]] - total[starts[:-1]] + counts.astype(_U)).astype(np.int64))
    return out[0], out[1]


def minhash(values: np.ndarray, starts: np.ndarray, hashes: int) -> np.ndarray:
    """Min-wise signatures, 32 bits a hash, one row for each non-empty set."""
    full = np.flatnonzero(np.diff(starts) > 0)
    out = np.empty((len(full), hashes), dtype=np.uint32)
    if not len(full):
        return out
    heads = starts[:-1][full]
    rng = np.random.default_rng(20240607)
    factor = rng.integers(1, 1 << 63, hashes, dtype=np.uint64) * _U(2) + _U(1)
    shift = rng.integers(0, 1 << 63, hashes, dtype=np.uint64)
    for j in range(hashes):
        out[:, j] = np.minimum.reduceat(((values * factor[j]) + shift[j]) >> _U(32), heads).astype(np.uint32)
    return out


def pair_overlaps(left: pa.Array, right: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(size of intersection, size of union) of the shingle sets, row by row."""
    a, sa = shingle_sets(left, k)
    b, sb = shingle_sets(right, k)
    na, nb = np.diff(sa), np.diff(sb)
    row = np.concatenate((np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)))
    value = np.concatenate((a, b))
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    same = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
    common = np.bincount(row[1:][same], minlength=len(na)) if len(row) else np.zeros(len(na), np.int64)
    return common, na + nb - common


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """The batch in slices whose ``column`` holds about ``limit`` bytes at most (or one row)."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths.astype(np.int64))
    at = 0
    while at < len(total):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end
