"""Words of whole Arrow text columns as 64-bit hashes, without a Python object per word.

A word is ``[^\\x20\\x09-\\x0D]+`` after A-Z is lower-cased. Its hash is a polynomial
over random byte values, taken from prefix sums and then mixed; two different words
share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about this many bytes, which bounds the memory of a task.
SLICE_BYTES = 512 << 10

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power(base: int, size: int) -> np.ndarray:
    """base**0 .. base**(size-1) modulo 2**64; kept between calls up to the size of a slice."""
    if len(_powers[base]) >= size:
        return _powers[base][:size]
    steps = np.full(size, base & (1 << 64) - 1, np.uint64)
    steps[0] = 1
    made = np.multiply.accumulate(steps)
    if size <= 4 * SLICE_BYTES:
        _powers[base] = made
    return made


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = values.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """An ordered pair of hashes as one hash."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + mix(right))


@dataclass
class Words:
    """Words of ``rows`` texts in order: hash, text number, and place in the raw bytes."""

    rows: int
    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    raw: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) with about SLICE_BYTES of text each, one row at least."""
    chunks = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]
    first = 0
    for chunk in chunks:
        sizes = chunk.cast(pa.large_string()).fill_null("")
        at = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset:sizes.offset + len(sizes) + 1]
        start = 0
        while start < len(chunk):
            stop = int(np.searchsorted(at, at[start] + SLICE_BYTES, side="right")) - 1
            stop = min(len(chunk), max(start + 1, stop))
            yield first + start, sizes.slice(start, stop - start)
            start = stop
        first += len(chunk)
    pa.default_memory_pool().release_unused()


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a slice of ``slices`` and the offset of each text, the end included."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


_LETTER = np.ones(256, bool)
_LETTER[[*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]] = False


def split(texts: pa.Array, letters: bool = False) -> Words:
    """The words of a slice of ``slices``; null and empty texts have none.

    With ``letters``, ASCII punctuation and control bytes part words as white space does.
    """
    raw, offsets = raw_bytes(texts)
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(len(texts), np.zeros(0, np.uint64), none, none, none, raw, offsets)
    solid = _LETTER[raw] if letters else ~_SPACE[raw]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | border[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | border[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    row = np.searchsorted(offsets[1:], starts, side="right")
    return Words(len(texts), hashes(raw, starts, ends), row, starts, ends, raw, offsets)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each run of bytes ``raw[start:end]``, A-Z as a-z."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[raw]] * _power(_BASE, len(raw)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, max(len(raw), 1))[starts])


def group_sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sum of ``values`` (1-d or 2-d) per row number; ``row`` is in ascending order."""
    out = np.zeros((rows, *values.shape[1:]), np.float64)
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[first]] = np.add.reduceat(values, first, axis=0)
    return out


def ordered(key: np.ndarray) -> np.ndarray:
    """The places of ``key``, whole numbers from 0, in order of their values; equal ones stay in order."""
    if len(key) == 0:
        return np.zeros(0, np.int64)
    place = (len(key) - 1).bit_length()
    if int(key.max()).bit_length() + place > 63:
        return np.argsort(key, kind="stable")
    # value and place in one number: sorting numbers is several times faster than sorting places by them
    return np.sort(key.astype(np.int64) << place | np.arange(len(key))) & ((1 << place) - 1)
