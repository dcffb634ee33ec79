"""Word spans and rolling hashes over Arrow text buffers, in numpy, a slice of rows at a time.

A word is a maximal run of bytes other than space and 0x09-0x0D. UTF-8 never uses
those bytes inside a longer character, so working on bytes equals working on text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ROLL = 0xD6E8FEB86659FD93 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that one polynomial hash spans; longer words are hashed by xxhash, whatever surrounds them.
SPAN = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(SPAN + 1, base, U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@dataclass
class Slice:
    """Some rows of a batch: their bytes, and where each row's bytes and words begin."""

    first: int
    n: int
    data: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray

    def owner(self) -> np.ndarray:
        """The row (from 0 in the slice) of each word."""
        return np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.words))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; with ``lower``, after lower-casing A-Z."""
        data = _LOWER[self.data] if lower else self.data
        up, down = _power_tables()
        out = np.empty(len(self.starts), U)
        i = 0
        while i < len(out):
            base = int(self.starts[i])
            j = int(np.searchsorted(self.ends, base + SPAN, "right"))
            if j <= i:
                out[i] = xxhash.xxh3_64_intdigest(data[base : self.ends[i]].tobytes())
                i += 1
                continue
            part = data[base : self.ends[j - 1]].astype(U)
            part += U(1)
            part *= up[: len(part)]
            total = np.zeros(len(part) + 1, U)
            np.cumsum(part, out=total[1:])
            s = self.starts[i:j] - base
            out[i:j] = (total[self.ends[i:j] - base] - total[s]) * down[s]
            i = j
        return mix(out)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column (null: empty) and the int64 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def slices(column: pa.Array, size: int = SPAN) -> Iterator[Slice]:
    """Consecutive rows of about ``size`` bytes together; a longer row makes a slice of its own."""
    raw, at = text_buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        data, rows = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        word = ~_SPACE[data]
        before, after = np.zeros(len(word), bool), np.zeros(len(word), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        before[rows[:-1][rows[:-1] < len(word)]] = False
        after[rows[1:][rows[1:] > 0] - 1] = False
        starts = np.flatnonzero(word & ~before)
        yield Slice(lo, hi - lo, data, rows, starts, np.flatnonzero(word & ~after) + 1, np.searchsorted(starts, rows))
        lo = hi


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """An unmixed hash of each run of ``k`` consecutive values; doubles the run length while it can."""
    if len(h) < k:
        return np.zeros(0, U)
    out, have, power, width = None, 0, h, 1
    base = _ROLL
    while True:
        if k & width:
            if out is None:
                out, have = power, width
            else:
                m = min(len(out), len(power) - have)
                out, have = out[:m] * U(base) + power[have : have + m], have + width
        if width * 2 > k:
            return out[: len(h) - k + 1]
        power = power[:-width] * U(base) + power[width:]
        width, base = width * 2, base * base % (1 << 64)


def windows(s: Slice, k: int) -> np.ndarray:
    """Indexes of the words at which a window of ``k`` words of one row starts."""
    count = np.maximum(np.diff(s.words) - k + 1, 0)
    total = int(count.sum())
    shift = s.words[:-1] - (np.cumsum(count) - count)
    return np.arange(total) + np.repeat(shift, count)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end what allocators keep goes back to the system, as workers live on between tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
