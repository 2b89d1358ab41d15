"""Words of many texts at once, from the flat byte buffer of an Arrow column.

All functions here run inside tasks on one Arrow batch. Texts stay UTF-8 bytes in
one array with offsets, so that no Python object is made per word.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# functions of this module travel with the query, executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes handled at a time; a longer text is handled alone.
SLICE_BYTES = 1 << 19

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
STEP = U(0xD6E8FEB86659FD93)
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_CODES = BYTE_CODES[LOWER]
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[list(SPACES)] = False


def flat_texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and their offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.null_count:
        lengths = np.diff(bounds) * ~column.is_null().to_numpy(zero_copy_only=False)
        if lengths.sum() != bounds[-1] - bounds[0]:
            return flat_texts(column.fill_null(""))
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together, one text at least."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordTable:
    """Start, end, text and 64-bit hash of each word; ASCII letters count as lower case."""

    def __init__(self) -> None:
        self._powers = self._inverse = np.zeros(0, np.uint64)

    def __call__(self, data: np.ndarray, bounds: np.ndarray):
        if len(self._powers) <= len(data):
            self._powers = powers(max(len(data), SLICE_BYTES), STEP)
            self._inverse = powers(max(len(data), SLICE_BYTES), U(pow(int(STEP), -1, 1 << 64)))
        n = len(data)
        inside = IN_WORD[data]
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        filled = bounds[:-1][np.diff(bounds) > 0]
        before[filled] = False
        after[bounds[1:][np.diff(bounds) > 0] - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(LOWER_CODES[data] * self._powers[:n], out=sums[1:])
        codes = (sums[end] - sums[start]) * self._inverse[start]
        codes = mixed(codes + (end - start).astype(np.uint64) * BASE)
        text = np.searchsorted(bounds, start, "right") - 1
        return start, end, text, codes


def rows_per_text(text: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each text's rows, given the text of each row in order."""
    return np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))])
