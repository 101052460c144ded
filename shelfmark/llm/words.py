"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than space and 0x09-0x0D. Those bytes never occur inside a
multi-byte UTF-8 character, so words can be found on the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_MIX[0])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow text column and the offset of each text; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    ends = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) \
        if len(column) else np.zeros(1, np.int64)
    base, last = int(ends[0]), int(ends[-1])
    raw = np.frombuffer(data, dtype=np.uint8)[base:last] if last > base else np.zeros(0, np.uint8)
    return raw, ends - base


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text is a range of its own."""
    row, n = 0, len(offsets) - 1
    while row < n:
        to = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        to = min(max(to, row + 1), n)
        yield row, to
        row = to


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets within them) for each slice of a column."""
    raw, offsets = text_bytes(column)
    for lo, hi in slices(offsets, limit):
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def lowered(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[raw]


def find_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start and end of every word, index of the first word of each text and of the end)."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = np.empty(n + 1, dtype=bool)
    inside[:n] = ~_SPACE[raw]
    inside[n] = False
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1]
    cuts = offsets[offsets < n]
    first[cuts] = inside[cuts]
    last = inside[:n] & ~inside[1:]
    before = cuts[cuts > 0] - 1
    last[before] = inside[before]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of every word; equal words have equal hashes wherever they stand.

    Works through the bytes in steps, so the extra memory does not follow the text.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        to = max(int(np.searchsorted(ends, starts[at] + step, side="right")), at + 1)
        s, e = starts[at:to], ends[at:to]
        sizes = e - s
        total = int(sizes.sum())
        first = np.cumsum(sizes) - sizes
        place = np.arange(total, dtype=np.int64)
        inner = place - np.repeat(first, sizes)
        longest = int(sizes.max())
        powers = np.full(longest, _BASE | 1, dtype=np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        chars = raw[inner + np.repeat(s, sizes)].astype(np.uint64) + np.uint64(1)
        out[at:to] = np.add.reduceat(chars * powers[inner], first)
        at = to
    return mix64(out)
