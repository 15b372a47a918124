"""Whole Arrow batches of text as NumPy vectors: words, hashes of words, hashes of word windows.

Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r. A word's hash is
the BLAKE2b of its bytes, made once for each distinct word of a batch; a window's is made of
those of its halves, quarters and so on by a non-linear mix, like a hash tree. They
depend on the bytes only, so every executor and every retry gets the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text bytes worked on at once; one longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20

_ODD = U64(0x9E3779B97F4A7C15)
#: Longer byte strings are hashed by BLAKE2b.
LONG = 512
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)  # masks of the first n bytes of a block
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (shifts and multiplications)."""
    x = x ^ U64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - counts, counts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and where each begins and the last ends; a null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if at is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices of about ``limit`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings data[start:end] as a column; they stand in order and do not overlap."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    if len(starts) and offsets[-1] != ends[-1] - starts[0]:
        inside = np.zeros(len(data) + 1, np.int8)
        full = ends > starts
        inside[starts[full]] += 1
        inside[ends[full]] -= 1
        data = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    elif len(starts):
        data = data[starts[0] : ends[-1]]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of the byte strings data[start:end], equal ones the same, in order of first occurrence; compared byte by byte."""
    return np.asarray(strings(data, starts, ends).dictionary_encode().indices).astype(np.int64)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte string data[start:end]."""
    blocks = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    size = ends - starts
    a = mix(size.astype(U64), seed + 21)
    b = mix(a, seed + 22)
    who = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = starts[who], size[who]
    while len(who):
        block = blocks[at] & _FIRST[np.minimum(left, 8)]
        a[who] = mix(a[who] ^ block, seed + 23)
        b[who] = mix(b[who] * _ODD + block, seed + 24)
        more = left > 8
        who, at, left = who[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        found = blake2b(data[starts[i] : ends[i]], digest_size=16, salt=seed.to_bytes(8, "little")).digest()
        a[i], b[i] = np.frombuffer(found, "<u8")
    return mix(a * _ODD + b, 25)


class Words:
    """Words of each value of a column.

    ``first[i]`` is the number of words before value ``i``; ``starts`` and ``ends`` are
    byte positions in ``data``; ``hashes`` has one hash for each word.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.offsets = text_bytes(column)
        if lower:
            self.data = _LOWER[self.data]
        n, data = len(self.data), self.data
        word = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        begin = word.copy()
        begin[1:] &= ~word[:-1] | edge[1:n]
        self.starts = np.flatnonzero(begin)
        del begin
        finish = word
        finish[:-1] &= ~word[1:] | edge[1:n]
        self.ends = np.flatnonzero(finish) + 1
        del word, finish, edge
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.hashes = hashed(data, self.starts, self.ends)
        self._levels = [self.hashes]

    def _level(self, j: int) -> np.ndarray:
        """Hashes of the 2**j words from each word, as far as there are so many."""
        while len(self._levels) <= j:
            half, last = 1 << len(self._levels) - 1, self._levels[-1]
            self._levels.append(mix(last[: max(0, len(last) - half)] * _ODD + last[half:], 1))
        return self._levels[j]

    def spans(self, starts: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hashes of the word sequences of ``length`` words from each of ``starts``."""
        if np.isscalar(length):
            out, at = np.full(len(starts), mix(np.array([length], U64), 2)[0], U64), starts
            for j in reversed(range(int(length).bit_length())):
                if int(length) >> j & 1 and len(starts):
                    out = mix(out * _ODD + self._level(j)[at], 3)
                    at = at + (1 << j)
            return out
        length = np.asarray(length, np.int64)
        out = np.zeros(len(starts), U64)
        for k in np.unique(length).tolist():  # a few lengths: those below a window's
            mine = np.flatnonzero(length == k)
            out[mine] = self.spans(starts[mine], k)
        return out

    def windows(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``k`` words, value after value, and the number of each.

        short: a value of fewer words, if it has any, counts as one window.
        """
        counts = np.maximum(self.counts - k + 1, 0)
        if short:
            counts = np.where((self.counts > 0) & (self.counts < k), 1, counts)
        starts = np.repeat(self.first[:-1], counts) + ragged(counts)
        if not short or (self.counts[self.counts > 0] >= k).all():
            return self.spans(starts, k), counts
        return self.spans(starts, np.repeat(np.minimum(self.counts, k), counts)), counts
