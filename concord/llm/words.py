"""Vectorised word hashing over Arrow string batches.

A batch is cut into blocks of whole rows with about ``BLOCK_BYTES`` of UTF-8, so
that memory follows the block (or the longest single text), not the batch.  All
kernels treat null texts as empty.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1 << 20
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 48
FNV_OFFSET = np.uint64(0xCBF29CE484222325)
FNV_PRIME = np.uint64(0x100000001B3)


def release() -> None:
    """Give memory that isn't used any more back to the system: executors keep their Python workers, and so what those keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def splitmix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all 64 bits (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-dependent hash of two hashes."""
    with np.errstate(over="ignore"):
        return splitmix(a * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(23)) | (b >> np.uint64(41))))


def ascii_lower_words() -> np.ndarray:
    """Byte map: blanks (0x20, 0x09-0x0D) separate, A-Z are lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


def alphanumeric_words() -> np.ndarray:
    """Byte map: only ASCII letters, digits and bytes of other scripts form words; A-Z are lower-cased."""
    table = np.zeros(256, dtype=np.uint8)
    for a, b in ((48, 58), (97, 123), (128, 256)):
        table[a:b] = np.arange(a, b)
    table[65:91] = np.arange(97, 123)
    return table


def string_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (from 0) and bytes of a string array; nulls become empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    large = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and len(texts) else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES):
    """Row ranges (first, last) of about ``size`` bytes each, one row at least."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


def word_bounds(offsets: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each run of non-zero bytes that stays within one row."""
    n = len(b)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    solid = b != 0
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = solid[edges]
    stops[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    per_row = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), per_row)


def hash_runs(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """64-bit hash of each byte run; for each k in ``prefixes`` also that of its first k bytes (0 where the run is not longer)."""
    lengths = ends - starts
    out = np.full(len(starts), FNV_OFFSET)
    heads = {k: np.zeros(len(starts), np.uint64) for k in prefixes}
    if not len(starts):
        return out, heads
    short = np.minimum(lengths, LONG_WORD)
    order = np.argsort(-short.astype(np.int8), kind="stable")
    at, state = starts[order], out[order]
    longer = np.searchsorted(-short[order], -np.arange(LONG_WORD + 1), "left")  # runs with more than k bytes
    with np.errstate(over="ignore"):
        for k in range(int(short.max())):
            m = int(longer[k])
            if k in heads:
                heads[k][order[:m]] = splitmix(state[:m])
            state[:m] = (state[:m] ^ b[at[:m] + k]) * FNV_PRIME
    out[order] = state
    out = splitmix(out)
    for i in np.flatnonzero(lengths > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(b[starts[i] : ends[i]].tobytes())
    return out, heads


def hashed_blocks(texts: pa.Array, table: np.ndarray, size: int = BLOCK_BYTES):
    """For each block of rows: (first row, last row, word hashes, row of each word from 0)."""
    offsets, data = string_parts(texts)
    for first, last in blocks(offsets, size):
        lo, hi = offsets[first], offsets[last]
        b = table[data[lo:hi]]
        starts, ends, row = word_bounds(offsets[first : last + 1] - lo, b)
        yield first, last, hash_runs(b, starts, ends)[0], row
