"""Vectorised word kernels over the UTF-8 bytes of Arrow string columns.

Nothing here makes a Python string per word: words are byte spans, and a word, n-gram or window is a 64-bit
hash. A block of documents is bounded by bytes, so memory follows the block and the longest single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 8 << 20
_PIECE = 1 << 20
_BASE = U64(0x9E3779B97F4A7C15 | 1)

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] over bytes, before folding A-Z
WORDY = np.ones(256, dtype=bool)
WORDY[0:0x30] = WORDY[0x3A:0x61] = WORDY[0x7B:0x80] = False

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers = np.array([pow(int(_BASE), i, 1 << 64) for i in range(64)], dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    """The first powers of the base, n at least; the table grows with the longest word."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * np.array([pow(int(_BASE), len(_powers), 1 << 64)], dtype=np.uint64)])
    return _powers


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the words before each document (n + 1)."""
    if not len(data):
        z = np.empty(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    on = np.concatenate([[False], inside[data], [False]])
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[off] = True
    start = np.flatnonzero(on[1:-1] & (~on[:-2] | cut[:-1]))
    end = np.flatnonzero(on[1:-1] & (~on[2:] | cut[1:])) + 1
    return start, end, np.searchsorted(start, off, side="left")


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hash of each byte span; fold: A-Z count as a-z."""
    table, size = (_FOLDED if fold else _TABLE), end - start
    total, out, i, n = np.cumsum(size), np.empty(len(start), np.uint64), 0, len(start)
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + _PIECE, side="right")))
        own = size[i:j]
        first = np.cumsum(own) - own
        m = int(own.sum())
        place = np.arange(m, dtype=np.int64) - np.repeat(first, own)
        value = table[data[np.repeat(start[i:j], own) + place]] * _power(int(own.max()) + 1)[place]
        out[i:j] = mix(np.add.reduceat(value, first) + own.astype(np.uint64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i : i + n] for each i with n elements left."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out *= _BASE
        out += h[j : j + m]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i with w elements left."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def trim() -> None:
    """Gives freed memory back to the machine: Python workers are kept for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Tables of consecutive rows holding about limit bytes of text (more only if one row does)."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = column_bytes(batch.column(batch.schema.get_field_index(text)))
        i = 0
        while i < batch.num_rows:
            j = int(np.searchsorted(off, off[i] + limit - size, side="right")) - 1
            j = min(max(j, i + (not held)), batch.num_rows)
            if j > i:
                held.append(batch.slice(i, j - i))
                size += int(off[j] - off[i])
                i = j
            if size >= limit or i < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
        held = []
    trim()


def planes(x: np.ndarray) -> bytes:
    """Bytes of an array, most alike first: the k-th bytes of all items stand together, which compresses well."""
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""


def unplanes(raw: bytes, dtype: str, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(dtype).reshape(n)
