"""Vectorised text: whole batches of UTF-8 as one byte array, words and windows as positions in it.

Nothing here loops over words or bytes in Python. A hash of any byte range comes from the prefix sums of
one polynomial (modulo 2**64 over a random byte table) and is then mixed, so equal ranges hash alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 17
_MULT = 0x9E3779B97F4A7C55
_MASK = (1 << 64) - 1
_INV = pow(_MULT, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def _powers(base: int, n: int) -> np.ndarray:
    a = np.full(n, base, U64)
    a[0] = 1
    return np.cumprod(a)


_POW, _INVPOW = _powers(_MULT, BLOCK), _powers(_INV, BLOCK)
#: Word separators: space and the control characters from tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(at: np.ndarray, most: int):
    """Runs [i, j) of documents of at most so many bytes together; a longer document stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def _prefix(data: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The polynomial's sums over data[:p] for each p of where, which ascends."""
    out = np.zeros(len(where), U64)
    base, scale, step = U64(0), U64(1), U64(pow(_MULT, BLOCK, 1 << 64))
    lo = 0
    with np.errstate(over="ignore"):
        for s in range(0, max(1, len(data)), BLOCK):
            part = data[s : s + BLOCK]
            sums = np.zeros(len(part) + 1, U64)
            np.cumsum(_BYTES[part] * _POW[: len(part)], out=sums[1:])
            hi = int(np.searchsorted(where, s + len(part), "right"))
            out[lo:hi] = base + scale * sums[where[lo:hi] - s]
            lo = hi
            base = base + scale * sums[-1]
            scale = scale * step
    return out


def _inverse(where: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = _INVPOW[where % BLOCK]
        if len(where) and where.max() >= BLOCK:
            steps = _powers(pow(_INV, BLOCK, 1 << 64), int(where.max()) // BLOCK + 1)
            out = out * steps[where // BLOCK]
        return out


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[s:e] for ascending, disjoint ranges."""
    both = np.empty(2 * len(starts), np.int64)
    both[0::2], both[1::2] = starts, ends
    sums = _prefix(data, both)
    with np.errstate(over="ignore"):
        return mix((sums[1::2] - sums[0::2]) * _inverse(starts) + (ends - starts).astype(U64))


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents, and the first word of each document (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    ink = ~IS_SPACE[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    first[cut] = ink[cut]
    last[cut - 1] = ink[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at, "left")


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of k words of each document as ascending hashes of 44 bits; n + 1 offsets.

    A document of fewer than k words, but one at least, has all its words as its one shingle.
    """
    starts, ends, first = word_bounds(data, at)
    n_docs = len(at) - 1
    if not len(starts):
        return np.zeros(0, U64), np.zeros(n_docs + 1, np.int64)
    words = range_hashes(data, starts, ends)
    count = np.diff(first)
    doc = np.repeat(np.arange(n_docs), count)
    left = first[1:][doc] - np.arange(len(words))  # words from here to the document's end
    take = (left >= k) | (np.arange(len(words)) == first[:-1][doc])
    with np.errstate(over="ignore"):
        h = words.copy()
        for j in range(1, k):
            h = h * U64(0x100000001B3F)
            upto = max(0, len(words) - j)
            h[:upto] += np.where(left[:upto] > j, words[j:] * U64(2 * j + 1), U64(j))
            h[upto:] += U64(j)
    h, doc = mix(h[take]), doc[take]
    out, sizes = [], np.zeros(n_docs, np.int64)
    for lo in range(0, n_docs, 1 << 19):  # the document's place takes the upper 20 bits of the sorting key
        part = (doc >= lo) & (doc < lo + (1 << 19)) if n_docs > (1 << 19) else slice(None)
        key = ((doc[part] - lo).astype(U64) << U64(44)) | (h[part] >> U64(20))
        key.sort()
        if len(key):
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        where = (key >> U64(44)).astype(np.int64) + lo
        sizes += np.bincount(where, minlength=n_docs)
        out.append(key & U64((1 << 44) - 1))
    return np.concatenate(out), np.concatenate(([0], np.cumsum(sizes)))


def binary_rows(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary values: the bytes of flat between consecutive offsets, counted in items."""
    flat = np.ascontiguousarray(flat)
    offsets = (np.asarray(at, np.int64) * flat.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])
