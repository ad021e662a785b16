"""Texts of an Arrow column as flat numpy arrays, so that one call works on many documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins (one more for the end); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def chunks(starts: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer text is a range of its own."""
    row, rows = 0, len(starts) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + most, "right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, size: int) -> np.ndarray:
    table = _powers.get(str(base))
    if table is None or len(table) < size:
        factors = np.full(max(size, 1 << 16), base, np.uint64)
        factors[0] = 1
        table = _powers[str(base)] = np.cumprod(factors)
    return table


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the texts: a 64-bit hash and the row of its text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    before = np.concatenate(([False], inside[:-1]))
    begin = np.flatnonzero(inside & (first[:-1] | ~before))
    after = np.concatenate((inside[1:], [False]))
    end = np.flatnonzero(inside & (first[1:] | ~after)) + 1
    total = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(MULTIPLIER, len(data))[: len(data)])))
    hashes = mix((total[end] - total[begin]) * _power(INVERSE, len(data))[begin])
    return hashes, np.searchsorted(starts, begin, "right") - 1
