"""Words and their hashes for whole Arrow columns of text.

A word is a maximal run of letters, digits and underscores after Unicode
lower-casing. Beyond ASCII every character belongs to a word except those of
the blocks C1/Latin-1 punctuation, General Punctuation with the first
superscripts, and CJK punctuation (but for the letters and numbers in them), and
the signs x and / of Latin-1.

A long text is hashed piece by piece: what is held of it are a few bytes a
character and its words' hashes and places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; a longer single text is handled alone.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
#: Letters and numbers among the blocks that are punctuation otherwise: last bytes after C2, E2 81 and E3 80.
_LATIN = (0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE)
_RAISED = (0xB0, 0xB1, *range(0xB4, 0xBA), 0xBF)
_CJK = (0x85, 0x86, 0x87, *range(0xA1, 0xAA), *range(0xB1, 0xB6), *range(0xB8, 0xBD))
#: Bytes whose powers are held, and so hashed at once.
_PIECE = 1 << 16


def _powers(base: np.uint64) -> np.ndarray:
    table = np.full(_PIECE + 1, base, np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


_UP, _DOWN = _powers(_BASE), _powers(_UNBASE)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if column.offset:
        column = pa.concat_arrays([column])
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each."""
    if not len(column):
        return
    sizes = pc.fill_null(pc.binary_length(column.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > limit:
            yield begin, k
            begin, held = k, 0
        held += int(size)
    yield begin, len(column)


@dataclass
class Words:
    """Words of some rows: row ``r`` has those from ``at[r]`` to ``at[r + 1]``."""

    at: np.ndarray
    hashes: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def spelled(self, k: int) -> str:
        return self.data[self.begins[k] : self.ends[k]].tobytes().decode("utf-8", "replace")


def _hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each word: the sum of its bytes, each times the power of its place."""
    out = np.zeros(len(begins), np.uint64)
    total = np.zeros(_PIECE + 1, np.uint64)
    running = None  # a word that began in an earlier piece
    for at in range(0, len(data), _PIECE):
        part = data[at : at + _PIECE].astype(np.uint64)
        part += np.uint64(1)
        part *= _UP[: len(part)]
        np.cumsum(part, out=total[1 : len(part) + 1])
        if running is not None:
            lift = np.uint64(pow(int(_BASE), at - int(begins[running]), 1 << 64))
            stop = min(int(ends[running]) - at, len(part))
            out[running : running + 1] += total[stop : stop + 1] * lift
            if ends[running] <= at + len(part):
                running = None
        lo, hi = np.searchsorted(begins, (at, at + len(part)))
        first, last = begins[lo:hi] - at, np.minimum(ends[lo:hi] - at, len(part))
        out[lo:hi] = (total[last] - total[first]) * _DOWN[first]
        if hi > lo and ends[hi - 1] > at + len(part):
            running = hi - 1
    return mix(out)


def words_of(column: pa.Array, keep_digits: bool = True) -> Words:
    """All words of a column; hashes are 64 bits. Without ``keep_digits`` words are letters only."""
    data, offsets = buffers(pc.utf8_lower(column.cast(pa.large_string())))
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64), none, none, data)
    word = _WORD[data]
    if not keep_digits:
        word &= ~(((data >= 48) & (data <= 57)) | (data == 95))
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xE3))
    lead = lead[(lead + 1 < n) & np.isin(data[lead], (0xC2, 0xC3, 0xE2, 0xE3))]
    a, b, c = data[lead], data[lead + 1], data[np.minimum(lead + 2, n - 1)]
    two = lead[((a == 0xC2) & ~np.isin(b, _LATIN)) | ((a == 0xC3) & np.isin(b, (0x97, 0xB7)))]
    marks = ((a == 0xE2) & ((b == 0x80) | ((b == 0x81) & ~np.isin(c, _RAISED)))) | ((a == 0xE3) & (b == 0x80) & ~np.isin(c, _CJK))
    three = lead[marks]
    for shift in (0, 1):
        word[two + shift] = False
    for shift in (0, 1, 2):
        word[np.minimum(three + shift, n - 1)] = False
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word
    last[:-1] &= ~word[1:] | edge[1:-1]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(np.searchsorted(begins, offsets), _hashes(data, begins, ends), begins, ends, data)


def gram_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word ``n``-grams of each row, and where each row's begin.

    A row of fewer than ``n`` but at least one word has the one gram of all its
    words; a row without words has none.
    """
    counts = np.diff(words.at)
    many = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(at[-1], np.uint64)
    factors = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    total = len(words.hashes)
    if total >= n:
        rolled = np.zeros(total - n + 1, np.uint64)
        for k in range(n):
            rolled += words.hashes[k : total - n + 1 + k] * factors[k]
        full = counts >= n
        lengths = many[full]
        if len(counts) == 1 and len(lengths):
            out = mix(rolled)
        elif len(lengths):
            steps = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            out[np.repeat(at[:-1][full], lengths) + steps] = mix(rolled[np.repeat(words.at[:-1][full], lengths) + steps])
    for r in np.flatnonzero((counts > 0) & (counts < n)):
        w = words.hashes[words.at[r] : words.at[r + 1]]
        out[at[r]] = mix(np.array([np.sum(w * factors[: len(w)]) + np.uint64(len(w))], np.uint64))[0]
    return out, at
