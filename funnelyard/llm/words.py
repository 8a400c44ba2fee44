"""Words of a batch of texts as arrays: boundaries and 64-bit digests, many documents at a time.

The functions run inside `mapInArrow` tasks. They take the bytes of an Arrow column, so a task never
makes a Python object for each word. Memory is bounded by CHUNK bytes of text, or by one document where
a single document is longer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are worked on at once (whole documents; a longer document is a chunk of its own).
CHUNK = 1 << 20
#: Bytes that are digested at once, and the length from which a word is digested on its own.
BLOCK, LONG_WORD = 1 << 18, 4096

_M = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _POWERS:
        n = BLOCK + LONG_WORD + 1
        step = np.full(n, _BASE, np.uint64)
        step[0] = 1
        back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        back[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(step, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        _POWERS["byte"] = mix(np.arange(1, 257, dtype=np.uint64) * _M)
    return _POWERS["up"], _POWERS["down"], _POWERS["byte"]


def releasing(scan: Callable) -> Callable:
    """A `mapInArrow` function that gives freed memory back to the system at the end of its task: its worker lives on,
    beside those of the next stages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)
    return run


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of the bytes in the inclusive ranges."""
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo:hi + 1] = True
    return out


#: Separators of `[^\x20\x09-\x0D]+` words, and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` words.
SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))
NON_WORD = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column and the n + 1 offsets of its rows; a null is an empty row."""
    col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    bufs = col.buffers()
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    if bufs[2] is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(bufs[2], np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about `size` bytes of the column each; an empty batch gives none."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = column_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def find_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row of each word); a word never reaches into the next row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~separators[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def digest_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each non-overlapping, ascending span, depending on its bytes only."""
    up, down, byte = _powers()
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    long = lengths > LONG_WORD
    for i in np.flatnonzero(long):
        out[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]].tobytes())
    short = np.flatnonzero(~long)
    s, e = starts[short], ends[short]
    at = 0
    while at < len(short):
        lo = s[at]
        to = int(np.searchsorted(s, lo + BLOCK - LONG_WORD, "right"))
        part = data[lo:e[to - 1]]  # BLOCK bytes at most
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(byte[part] * up[:len(part)], out=sums[1:], dtype=np.uint64)
        i, j = s[at:to] - lo, e[at:to] - lo
        out[short[at:to]] = mix((sums[j] - sums[i]) * down[i] + (j - i).astype(np.uint64) * _M)
        at = to
    return out


def windows(digests: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A digest of each run of `size` words (over row borders too: mask those with `whole`)."""
    n = len(digests) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step = np.uint64((0xA0761D6478BD642F + 2 * seed * 0x9E3779B97F4A7C15) % (1 << 64) | 1)
    out = np.full(n, np.uint64(seed + size), np.uint64)
    for j in range(size):
        out *= step
        out += digests[j:j + n]
    return mix(out)


def whole(rows: np.ndarray, size: int) -> np.ndarray:
    """Whether the run of `size` words that starts at each place stays in one row."""
    n = len(rows) - size + 1
    return rows[:n] == rows[size - 1:] if n > 0 else np.zeros(0, bool)


def covered(hits: np.ndarray, size: int, n: int) -> np.ndarray:
    """Of n words, those in a run of `size` words that starts at one of `hits`."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, hits, 1)
    np.add.at(marks, np.minimum(hits + size, n), -1)
    return np.cumsum(marks[:-1]) > 0
