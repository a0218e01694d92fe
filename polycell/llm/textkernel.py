"""Vectorised word and shingle kernels over Arrow text buffers.

All of them work on the UTF-8 bytes of a whole Arrow batch with numpy, never on
one word at a time. A word hash is 64 bits wide; two different words or
shingles collide with probability 2**-64 each, which is the only inexactness.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa


class _Without:
    @staticmethod
    def find_spec(name, path=None, target=None):
        if name == "pandas":
            raise ImportError(name)


def _lean() -> None:
    """Arrow looks for pandas at its first conversion, which would load it into each worker; a worker's Arrow finds none. It looks again where somebody asks for pandas objects."""
    from pyspark import TaskContext

    if TaskContext.get() is not None and "pandas" not in sys.modules:
        sys.meta_path.insert(0, _Without)
        try:
            pa.array([0])
        finally:
            sys.meta_path.remove(_Without)


_lean()

_RNG = np.random.default_rng(0x5EED_0F_C0DE)
_RANDOM = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.cumprod(np.full(1 << 12, _ODD, dtype=np.uint64))

#: Bytes of text that a kernel call handles at once; a longer text stands alone.
CHUNK_BYTES = 256 << 10

SPACES = bytes([0x20, *range(0x09, 0x0E)])


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.full(1 << (n - 1).bit_length(), _ODD, dtype=np.uint64))
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _STEP
        h = (h ^ (h >> np.uint64(29))) * _ODD
        return h ^ (h >> np.uint64(32))


def byte_table(lower: bool = True) -> np.ndarray:
    """Random value of each byte, 0 for the white space between words; A-Z count as a-z."""
    table = _RANDOM.copy()
    if lower:
        table[65:91] = table[97:123]
    table[list(SPACES)] = 0
    return table


_TABLE = byte_table()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def trim() -> None:
    """Gives freed memory back to the system, Arrow's and, where it can, the C library's: workers stay, idle, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def chunks(column: pa.ChunkedArray | pa.Array, limit: int = CHUNK_BYTES):
    """(first row, bytes, offsets) of runs of rows with about ``limit`` bytes of text."""
    row = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        data, offsets = text_buffers(part)
        a = 0
        while a < len(part):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
            yield row + a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            a = b
        row += len(part)
    trim()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the end) of the words of some rows."""
    inside = _TABLE[data] != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] |= inside[edges]
    starts = np.flatnonzero(begins)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[edges - 1] |= inside[edges - 1]
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the end)."""
    values = _TABLE[data]
    inside = values != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] |= inside[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    lengths = np.diff(starts, append=len(data))
    at = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        values = values[starts[0] :]
        values *= _powers(int(lengths.max()))[at]
        hashes = np.add.reduceat(values, starts - starts[0])
    return mix(hashes), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k-word shingle, first shingle of each row and the end).

    A row with fewer than k words, but at least one, has its whole sequence as
    its one shingle; a row without words has none.
    """
    counts = np.diff(first)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    with np.errstate(over="ignore"):
        rolling = words.copy()
        for t in range(1, k):
            rolling[:-t] = rolling[:-t] * _ODD + words[t:]
        rolling = mix(rolling)
        at = np.arange(ends[-1]) - np.repeat(ends[:-1] - first[:-1], sizes)
        out = rolling[at]
        for d in np.flatnonzero((counts > 0) & (counts < k)):
            h = np.uint64(counts[d])
            for w in words[first[d] : first[d + 1]]:
                h = h * _ODD + w
            out[ends[d]] = mix(np.array([h * _STEP], dtype=np.uint64))[0]
    return out, ends
