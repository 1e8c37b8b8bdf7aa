"""Byte-level numpy kernels shared by the text operators.

Every kernel works on the UTF-8 buffer of an Arrow string column, so a text never becomes a Python object. Words, word
hashes and k-gram hashes of a block of documents come out of a fixed number of vector operations, whatever the number
of documents in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are taken in blocks of about so many bytes; one longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Spans are hashed in stretches of about so many bytes, however long the block is; one longer span is a stretch of its own.
HASH_BYTES = 1 << 18
#: Odd multiplier of the polynomial hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; those of a stretch are kept between calls, more are made and let go."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, HASH_BYTES + 1), U(base))
        have[0] = U(1)
        np.multiply.accumulate(have, out=have)
        if n <= HASH_BYTES + 1:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    wide = pa.large_binary() if binary else pa.large_string()
    if column.type != wide:
        column = column.cast(wide)
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1] if off is not None and n else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about `limit` bytes."""
    raw, off = string_buffers(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def table(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: Bytes of the words that white space [\x20\x09-\x0D] separates, and of alphanumeric words: digits, a-z and non-ASCII.
SPACED = ~table((0x20, 0x20), (0x09, 0x0D))
ALNUM = table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """The words of a block: byte starts and ends, document of each, and first word of each document."""

    __slots__ = ("data", "doc", "end", "first", "hash", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool) -> None:
        self.data = LOWER[data] if lower else data
        flag = np.zeros(len(data) + 1, bool)
        flag[:-1] = inside[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[0] = True
        edge[offsets[:-1]] = True  # a word ends with its document
        edge[offsets[-1]] = True
        before = np.empty_like(flag)
        before[0] = False
        before[1:] = flag[:-1]
        self.start = np.flatnonzero(flag & (edge | ~before))
        self.end = np.flatnonzero(before & (edge | ~flag))
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = hash_spans(self.data, self.start, self.end)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, joined by one space."""
        return self.texts(np.array([a]), np.array([b]))[0].as_py()

    def texts(self, a: np.ndarray, b: np.ndarray) -> pa.Array:
        """Runs of words, from each a to each b, joined by one space: one gather for all of them (binary)."""
        at = ranges(a, b - a)
        size = self.end[at] - self.start[at] + 1
        flat = np.append(self.data, np.uint8(32))[ranges(self.start[at], size)]
        flat[np.cumsum(size) - 1] = 32
        ends = counts_before(size)[counts_before(b - a)]
        long = np.diff(ends)
        keep = np.ones(len(flat), bool)
        keep[ends[1:][long > 0] - 1] = False  # no space after the last word
        flat = flat[keep]
        return binary_array(flat, counts_before(np.maximum(0, long - 1)))


def span_hash(sums: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """The hash of spans from their sums of (byte + 1) * BASE ** place and their lengths."""
    return mix(sums ^ (np.asarray(length).astype(U) * U(0xD6E8FEB86659FD93)))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, the same wherever a span stands; `start` ascends. Memory follows HASH_BYTES."""
    out = np.zeros(len(start), U)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = int(np.searchsorted(start, base + HASH_BYTES, side="right"))
        far = int(np.searchsorted(end[i:j], base + HASH_BYTES, side="right")) + i  # ends ascend with starts
        j = max(i + 1, far)
        s, e = start[i:j] - base, end[i:j] - base
        n = int(e[-1])
        acc = np.zeros(n + 1, U)
        np.cumsum((data[base : base + n].astype(U) + U(1)) * powers(BASE, n), out=acc[1:])
        out[i:j] = span_hash((acc[e] - acc[s]) * powers(BASE_INV, n + 1)[s], e - s)
        i = j
    return out


def kgram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out *= U(0x2545F4914F6CDD1D)
        out += h[j : j + n]
    return mix(out)


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the rightmost least value of every w consecutive values; len(h) - w + 1 of them."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = h[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, w):
        x = h[j : j + n]
        less = x <= best
        best = np.where(less, x, best)
        at[less] = j
    return at + np.arange(n)


def crossing(doc: np.ndarray, k: int) -> np.ndarray:
    """For every k consecutive words: they belong to one document."""
    n = len(doc) - k + 1
    return doc[:n] == doc[k - 1 : k - 1 + n] if n > 0 else np.zeros(0, bool)


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def binary_array(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The runs of `flat` (bytes) between offsets; large_binary where 32 bits do not reach."""
    wide = int(offsets[-1]) > 0x7FFFFFFF
    kind, off = (pa.large_binary(), offsets.astype(np.int64)) if wide else (pa.binary(), offsets.astype(np.int32))
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(flat))])


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each run, one after the other."""
    if not len(start):
        return np.zeros(0, np.int64)
    total = int(length.sum())
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(start - (np.cumsum(length) - length), length)
    return out


def counts_before(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def union_length(start: np.ndarray, end: np.ndarray) -> int:
    """Covered length of intervals."""
    if not len(start):
        return 0
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    return int(e[-1] - s[0] - np.maximum(0, s[1:] - e[:-1]).sum())
