"""Words of UTF-8 texts and their 64-bit hashes, computed on whole Arrow columns with numpy."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
KEPT = "_depotlens_tokens"  # the module in which encoders stay in a worker process
_ROOT = 0x9E3779B97F4A7C15
_U = np.uint64


@dataclass
class Words:
    """Words of the rows ``first`` to ``first + rows - 1`` of a batch; ``row`` counts from ``first``."""

    first: int
    rows: int
    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def bounds(self) -> np.ndarray:
        """Where each row's words begin, and at the end their number."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _spaces() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def _letters(fold_case: bool) -> np.ndarray:
    table = mixed((np.arange(256, dtype=_U) + _U(1)) * _U(_ROOT))
    if fold_case:
        table[65:91] = table[97:123]
    return table


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_ROOT, -1, 1 << 64)
    steps = [np.full(n, root, _U) for root in (_ROOT, inverse)]
    for s in steps:
        s[:1] = 1
    return tuple(np.cumprod(s, dtype=_U) for s in steps)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; NULL counts as the empty text."""
    if column.null_count:
        column = column.fill_null(pa.scalar("").cast(column.type))
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def give_back() -> None:
    """Hand freed memory of this worker process back to the system; it waits for later tasks, and keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def let_go() -> None:
    """Free the encoders that an earlier stage left in this worker process, as a stage of words needs none.

    Spark reuses its workers, and they share the executor's memory with all stages that follow.
    """
    kept = sys.modules.pop(KEPT, None)
    if kept is not None:
        kept.__dict__.clear()
        give_back()


def words_of(column: pa.Array, fold_case: bool = True, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of a string column, in chunks of whole rows of about ``chunk_bytes``.

    Equal words (A-Z folded if asked) have equal hashes, others differ but for chance, 2**-64 a pair.
    """
    let_go()
    data, offsets = column_bytes(column)
    spaces, letters = _spaces(), _letters(fold_case)
    powers = inverses = np.zeros(0, _U)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk_bytes, "right")) - 1)
        last = min(last, len(column))
        at = offsets[first:last + 1] - offsets[first]
        part = data[offsets[first]:offsets[last]]
        n = len(part)
        if n > len(powers):
            powers, inverses = _powers(max(n, chunk_bytes))
        inside = ~spaces[part]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        filled = at[1:] > at[:-1]
        before[at[:-1][filled]] = False
        after[at[1:][filled] - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        sums = np.zeros(n + 1, _U)
        np.cumsum(letters[part] * powers[:n], out=sums[1:])
        value = mixed((sums[end] - sums[start]) * inverses[start] if n else sums[:0])
        row = np.searchsorted(at, start, "right") - 1
        yield Words(first, last - first, part, row, start, end, value)
        first = last


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every window of ``size`` words inside one row."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    value = np.full(n, size, _U)
    for i in range(size):
        value = mixed(value * _U(_ROOT) + words.hash[i:i + n])
    whole = words.row[:n] == words.row[size - 1:]
    return words.row[:n][whole], value[whole]
