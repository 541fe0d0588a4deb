"""Vectorised word splitting and hashing over Arrow string columns.

Words are maximal runs of bytes that are not separators. The separators are ASCII, so splitting UTF-8 bytes is
the same as splitting code points. Work goes in segments of about ``SEGMENT`` bytes, cut at separators, so memory
stays bounded for texts of any length.
"""

from __future__ import annotations

import contextlib
import ctypes
import ctypes.util

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20

#: The bytes that separate words: space and \x09-\x0D.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_rng = np.random.Generator(np.random.PCG64(20260101))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_powers = np.ones(1, np.uint64)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _pow(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = powers(_BASE, max(n, 4096))
    return _powers


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser on 64-bit words; different salts give independent-looking hashes."""
    h = h + np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SEGMENT):
    """Row slices of a batch with about ``most`` bytes of text each, one row at least."""
    _, off = text_buffers(batch.column(batch.schema.get_field_index(text)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def spans(buf: np.ndarray, off: np.ndarray, separators: np.ndarray = SEPARATORS):
    """Starts and ends of all words, and the index of each document's first word (n + 1 values)."""
    sep = separators[buf]
    before = np.empty(len(buf) + 1, bool)
    before[0] = True
    before[1:] = sep
    edges = off[:-1]
    before[edges] = True
    starts = np.flatnonzero(~sep & before[:-1])
    after = np.empty(len(buf) + 1, bool)
    after[:-1] = sep
    after[-1] = True
    after[off[1:]] = True
    ends = np.flatnonzero(~sep & after[1:]) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans are in order, without overlap, and not empty. Equal spans have equal hashes;
    that the converse holds is for the caller to check."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = []
    lens = ends - starts
    cuts = np.searchsorted(np.cumsum(lens), np.arange(SEGMENT, int(lens.sum()) + SEGMENT, SEGMENT), "left") + 1
    lo = 0
    for hi in np.unique(np.minimum(cuts, len(starts))):
        if hi <= lo:
            continue
        n = lens[lo:hi]
        first = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(first, n)
        bytes_ = buf[inside + np.repeat(starts[lo:hi], n)]
        vals = _BYTE[bytes_]
        vals *= _pow(int(n.max()))[inside]
        out.append(mix(np.add.reduceat(vals, first) + n.astype(np.uint64)))
        lo = hi
    return np.concatenate(out)


def same_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each span of ``buf`` has the bytes of the span of ``other`` beside it; none is empty. In pieces, so that
    memory stays bounded."""
    lens = ends - starts
    same = lens == other_ends - other_starts
    todo = np.flatnonzero(same if buf is not other else same & (starts != other_starts))
    stops = np.cumsum(lens[todo])
    lo = 0
    while lo < len(todo):
        hi = max(lo + 1, int(np.searchsorted(stops, (stops[lo - 1] if lo else 0) + SEGMENT, "right")))
        part = todo[lo:hi]
        n = lens[part]
        first = np.cumsum(n) - n
        inside = np.arange(int(n.sum()))
        differ = buf[inside + np.repeat(starts[part] - first, n)] != other[inside + np.repeat(other_starts[part] - first, n)]
        same[part[np.add.reduceat(differ, first, dtype=np.int64) > 0]] = False
        lo = hi
    return same


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, separators: np.ndarray = SEPARATORS) -> tuple[np.ndarray, np.ndarray]:
    """The words with one blank between those of a document, and where each word begins; documents may touch."""
    keep = ~separators[buf]
    lead = starts > 0
    lead[lead] = separators[buf[starts[lead] - 1]]
    keep[starts[lead] - 1] = True
    out = buf[keep]
    out[separators[out]] = 0x20
    lens = ends - starts
    return out, np.cumsum(lens + lead) - lens


@contextlib.contextmanager
def released():
    """For one partition: memory that it frees goes back to the system after it, so that idle workers don't hold it."""
    try:
        yield
    finally:
        release()


def release() -> None:
    """Give memory that is free in this process back to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    name = ctypes.util.find_library("c")
    if name and hasattr(libc := ctypes.CDLL(name), "malloc_trim"):
        libc.malloc_trim(0)


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of each document's first word."""
    if len(buf) <= 4 * SEGMENT:
        starts, ends, first = spans(buf, off)
        return hash_spans(buf, starts, ends), first
    parts, counts = [], np.zeros(len(off) - 1, np.int64)
    for d in range(len(off) - 1):
        lo, end = int(off[d]), int(off[d + 1])
        while lo < end:
            hi = min(end, lo + SEGMENT)
            while hi < end and not SEPARATORS[buf[hi]]:
                more = np.flatnonzero(SEPARATORS[buf[hi : min(end, hi + SEGMENT)]])
                hi = hi + int(more[0]) if len(more) else min(end, hi + SEGMENT)
            part = buf[lo:hi]
            starts, ends, _ = spans(part, np.array([0, hi - lo]))
            parts.append(hash_spans(part, starts, ends))
            counts[d] += len(starts)
            lo = hi
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([[0], np.cumsum(counts)])


def rolling(h: np.ndarray, width: int, salt: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes (over document edges too; mask those)."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    x = mix(h, salt)
    out = np.zeros(len(h) - width + 1, np.uint64)
    base = np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        out *= base
        out += x[k : len(x) - width + 1 + k]
    return mix(out, width)
