"""Word shingles of whole texts as 64-bit hashes, for a slice of an Arrow column at once.

A word is a run of other than white space (space, 9 to 13). A shingle is five consecutive words; a text of one to four
words has one shingle of all of them, and a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
_SLICE_BYTES = 1 << 21
_SLICE_ROWS = 1000
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of parts of the column that hold about two megabytes, or one row that is longer, and a thousand rows at most."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
    start = size = 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and (size + n > _SLICE_BYTES or i - start >= _SLICE_ROWS):
            yield start, i - start
            start, size = i, 0
        size += n
    if len(lengths) > start:
        yield start, len(lengths) - start


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of a slice, in order; null counts as empty."""
    texts = pa.concat_arrays([pa.compute.fill_null(texts.cast(pa.large_string()), "")])
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    b = np.frombuffer(data, np.uint8)[first:last]
    offsets = offsets - first
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    before = np.empty(len(b), bool)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(b)]] = False
    after = np.empty(len(b), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    after[ends] = False
    start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = (total[stop] - total[start]) * down[start]
    row = np.searchsorted(offsets, start, side="right") - 1
    return mix(h + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), row


def grams(word: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of n consecutive words of a row, in order; of a row of n words this is its shingle, if n is at most WORDS."""
    if len(word) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factors, last = mix(np.arange(1, n + 1, dtype=np.uint64)), len(word) - n + 1
    whole = row[:last] == row[n - 1 :]
    h = sum(mix(word[k : last + k] + factors[k]) for k in range(n))[whole]
    return mix(h if n == WORDS else h + np.uint64(n)), row[:last][whole]


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every shingle of a slice, in order, repeated ones included."""
    word, row = word_hashes(texts)
    h, at = grams(word, row, WORDS)
    counts = np.bincount(row, minlength=len(texts))
    for n in range(1, WORDS):
        some = counts[row] == n
        if some.any():
            more, where = grams(word[some], row[some], n)
            h, at = np.concatenate([h, more]), np.concatenate([at, where])
    order = np.argsort(at, kind="stable")
    return h[order], at[order]


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, count) of the different hashes of each row, by row and then hash."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[first], row[first], np.diff(np.r_[first, len(h)])


def lists(h: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """An Arrow list of signed 64-bit values for each of so many rows."""
    offsets = np.zeros(rows + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=rows), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))
