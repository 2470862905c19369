"""Simple-8b: unsigned ids packed into 64-bit words, a 4-bit selector and 60 data bits each (Anh and Moffat, 2010).

Layout of one packed array, little-endian: magic, id count, word count, block count, exception count (4 x u64); the first
word of each block (u32); exceptions (position u64, id u64); the words. Every BLOCK ids start a new word, so a block can be
decoded alone. Ids of 60 bits and more are escaped: 0 in the words, the id in the exceptions.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
MAGIC = b"S8B1\0\0\0\0"
BLOCK = 4096
STRIDE = 64
# Fixed values of the published format: ids per word and bits per id for the selectors 0 to 15.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_SELECTOR = np.zeros(256, dtype=np.int64)
_SELECTOR[COUNTS] = np.arange(16)


def _starts(width: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First id of each word and the slots of that word; greedy, never across a block."""
    blocks = -(-n // BLOCK)
    padded = np.zeros((blocks, BLOCK + int(COUNTS[0]) - 1), dtype=np.uint8)
    flat = np.zeros(blocks * BLOCK, dtype=np.uint8)
    flat[:n] = width
    padded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    fit, widest, have = np.ones((blocks, BLOCK), dtype=np.uint8), padded, 1
    for count, bits in zip(COUNTS[14::-1], BITS[14::-1], strict=True):
        while have < count:
            step = min(have, int(count) - have)
            widest = np.maximum(widest[:, : widest.shape[1] - step], widest[:, step:])
            have += step
        ok = widest[:, :BLOCK] <= bits
        if not ok.any():
            continue
        fit[ok] = count
    # the place after each word is one chain over all blocks; it is walked STRIDE words at a time and filled in between
    place = np.arange(n, dtype=np.int32)
    after = np.append(np.minimum(place + fit.reshape(-1)[:n], np.minimum((place // BLOCK + 1) * BLOCK, n)), np.int32(n)).astype(np.int32)
    far = after
    for _ in range(STRIDE.bit_length() - 1):
        far = far[far]
    at, i = [], 0
    while i < n:
        at.append(i)
        i = int(far[i])
    rows = [np.array(at, dtype=np.int32)]
    for _ in range(STRIDE - 1):
        rows.append(after[rows[-1]])
    starts = np.stack(rows, axis=1).reshape(-1).astype(np.int64)
    starts = starts[starts < n]
    return starts, fit.reshape(-1)[starts].astype(np.int64)


def encode(ids: np.ndarray) -> bytes:
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return MAGIC + np.zeros(4, dtype="<u8").tobytes()
    over = np.flatnonzero(ids >> U64(60))
    raised = ids[over]
    if len(over):
        ids = ids.copy()
        ids[over] = 0
    width = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)  # at most one too wide, above 53 bits
    starts, slots = _starts(np.minimum(width, 60), n)
    selector = _SELECTOR[slots]
    words = selector.astype(np.uint64) << U64(60)
    stop = np.minimum((starts // BLOCK + 1) * BLOCK, n)
    padded = np.concatenate([ids, np.zeros(int(COUNTS[0]), dtype=np.uint64)])
    for s in np.unique(selector):
        if BITS[s]:
            at = np.flatnonzero(selector == s)
            for j in range(COUNTS[s]):
                p = starts[at] + j
                words[at] |= np.where(p < stop[at], padded[p], U64(0)) << U64(j * BITS[s])
    first = np.searchsorted(starts, np.arange(0, n, BLOCK)).astype("<u4")
    head = np.array([n, len(words), len(first), len(over)], dtype="<u8")
    return MAGIC + head.tobytes() + first.tobytes() + over.astype("<u8").tobytes() + raised.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def decode(raw: bytes) -> np.ndarray:
    """All ids; whole words of one selector are unpacked at once."""
    if raw[:8] != MAGIC:
        raise ValueError("not a Simple-8b array")
    n, m, blocks, escapes = (int(x) for x in np.frombuffer(raw, "<u8", 4, 8))
    at = 40
    first = np.frombuffer(raw, "<u4", blocks, at).astype(np.int64)
    at += 4 * blocks
    where = np.frombuffer(raw, "<u8", escapes, at)
    raised = np.frombuffer(raw, "<u8", escapes, at + 8 * escapes)
    words = np.frombuffer(raw, "<u8", m, at + 16 * escapes)
    out = np.zeros(n + int(COUNTS[0]), dtype=np.uint64)
    if n:
        selector = (words >> U64(60)).astype(np.int64)
        slots = COUNTS[selector]
        before = np.cumsum(slots) - slots
        block = np.repeat(np.arange(blocks), np.diff(np.append(first, m)))
        starts = before - before[first][block] + block * BLOCK
        stop = np.minimum((block + 1) * BLOCK, n)
        data = words & U64((1 << 60) - 1)
        for s in np.unique(selector):
            if BITS[s]:
                own = np.flatnonzero(selector == s)
                mask = U64((1 << int(BITS[s])) - 1)
                for j in range(COUNTS[s]):
                    p = starts[own] + j
                    ok = p < stop[own]
                    out[p[ok]] = (data[own[ok]] >> U64(j * BITS[s])) & mask
        out[where.astype(np.int64)] = raised
    return out[:n]
