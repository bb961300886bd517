"""Vectorised text helpers used inside tasks (numpy over Arrow buffers).

Spark partitions the rows; these helpers turn one bounded slice of a record
batch into flat numpy arrays (bytes, word spans, 64-bit word hashes), so the
work per row stays out of the Python interpreter. A word is a maximal run of
characters other than space and U+0009..U+000D. NULL texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20  # text bytes handled at once; a longer single text forms its own slice
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LONG_WORD = 64  # bytes; longer words are hashed one by one


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; row i is ``bytes[offsets[i]:offsets[i + 1]]``."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)[off[0]:off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def batch_slices(batch: pa.RecordBatch, text_col: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of rows of at most ``max_bytes`` of text (one row at least)."""
    if batch.num_rows == 0:
        return
    _, off = text_buffer(batch.column(text_col))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield batch.slice(lo, hi - lo)
        lo = hi


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one per byte or per word) over each row's span."""
    c = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return c[offsets[1:]] - c[offsets[:-1]]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row_offsets) of all words; row i owns words ``row_offsets[i]:row_offsets[i + 1]``."""
    w = ~IS_SPACE[data]
    first = w.copy()
    last = w.copy()
    if len(w):
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        rows = offsets[:-1][offsets[1:] > offsets[:-1]]
        first[rows] = w[rows]
        ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        last[ends] = w[ends]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span, eight bytes at a time across all spans."""
    n = (end - start).astype(np.int64)
    h = n.astype(np.uint64) * _M1 + np.uint64(0x5851F42D4C957F2D)
    if not len(start):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    live = np.flatnonzero((n > 0) & (n <= _LONG_WORD))
    k = 0
    while len(live):
        left = n[live] - k
        v = eight[start[live] + k]
        short = left < 8
        if short.any():
            v = np.where(short, v & ~(np.uint64(0xFFFFFFFFFFFFFFFF) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))), v)
        x = (h[live] ^ v) * _M2
        h[live] = (x ^ (x >> np.uint64(29))) * _M1
        k += 8
        live = live[left > 8]
    for i in np.flatnonzero(n > _LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(data[start[i]:end[i]].tobytes())
    return mix64(h)


def window_hashes(h: np.ndarray, row_offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words of a row: (hash, index of the window's first word)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(row_offsets) - 1), np.diff(row_offsets))
    at = np.flatnonzero(row[k - 1:] == row[:n - k + 1])
    x = np.full(len(at), k, np.uint64) * _M1
    for j in range(k):
        x = (x ^ h[at + j]) * _M2
        x ^= x >> np.uint64(31)
    return mix64(x), at


def to_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def ragged_take(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of ``values[start[i]:start[i] + length[i]]``."""
    total = int(length.sum())
    if total == 0:
        return values[:0]
    out_start = np.cumsum(length) - length
    idx = np.arange(total) + np.repeat(start - out_start, length)
    return values[idx]


class PieceCache:
    """Token ids of distinct text pieces, encoded once per worker process (bounded; cleared when full).

    ``encode_many(data, start, end)`` gives (ids of all spans, ids per span).
    """

    def __init__(self, encode_many, limit: int = 1_000_000):
        self.encode_many, self.limit = encode_many, limit
        self.clear()

    def clear(self) -> None:
        self.key, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids of each piece)."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        key, first, inv = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.key) + len(key) > self.limit:
            self.clear()
        where = np.searchsorted(self.key, key)
        new = np.ones(len(key), bool)
        if len(self.key):
            new = self.key[np.minimum(where, len(self.key) - 1)] != key
        if new.any():
            ids, n = self.encode_many(data, start[first[new]], end[first[new]])
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
            self.flat[self.used:self.used + len(ids)] = ids
            self.key = np.insert(self.key, where[new], key[new])
            self.at = np.insert(self.at, where[new], self.used + np.cumsum(n) - n)
            self.n = np.insert(self.n, where[new], n.astype(np.int32))
            self.used += len(ids)
            where = np.searchsorted(self.key, key)
        length = self.n[where].astype(np.int64)[inv]
        return ragged_take(self.flat, self.at[where][inv], length), length


class ByteTrie:
    """Trie of byte strings as sorted arrays: 12 bytes an edge instead of a row of 256 entries a node.

    Nodes are numbered level by level, so the edges, as ``node << 8 | byte``, lie
    in order and edge i leads to node i + 1. Steps from the root and its children
    go through a small dense table, deeper ones through a binary search.
    """

    def __init__(self, words: dict[bytes, int]):
        items = [w for w in words if w]
        size = np.array([len(w) for w in items], np.int64)
        data = np.frombuffer(b"".join(items), np.uint8)
        first = np.cumsum(size) - size
        at = np.zeros(len(items), np.int64)
        edges, nodes, ends = [], 1, [1]
        for k in range(int(size.max(initial=0))):
            live = np.flatnonzero(size > k)
            level, inv = np.unique(at[live] << 8 | data[first[live] + k], return_inverse=True)
            at[live] = nodes + inv
            nodes += len(level)
            edges.append(level)
            ends.append(nodes)
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.accept = np.full(nodes, -1, np.int64)
        self.accept[at] = [words[w] for w in items]
        self.near = ends[min(1, len(ends) - 1)]  # the root and its children
        self.table = np.zeros(self.near * 256, np.int32)
        top = int(np.searchsorted(self.edges, self.near << 8))
        self.table[self.edges[:top]] = np.arange(1, top + 1)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes reached (0: none)."""
        out = np.zeros(len(node), np.int64)
        close = node < self.near
        key = node << 8 | byte
        out[close] = self.table[key[close]]
        far = np.flatnonzero(~close)
        if len(far):
            want = key[far]
            i = np.searchsorted(self.edges, want)
            i[i == len(self.edges)] = 0
            out[far] = np.where(self.edges[i] == want, i + 1, 0)
        return out
