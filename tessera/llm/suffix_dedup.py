"""Exact removal of repeated byte strings: a depth-limited radix sort of suffixes over the cluster.

Suffixes need order only through ``depth`` bytes, and only equal groups matter, so each digit of the
most-significant-digit passes is a fingerprint of a byte block:

* pass 1 deals suffixes to tasks by the first digit's high bits and sorts by the whole digit, a block of
  ``anchor`` bytes. Only one suffix of each run of windows is dealt: the one that starts at the window's
  least fingerprint, which equal windows share. A group of one document is done.
* pass 2 sorts within a group by the next digit, the bytes that the run's windows cover. Equal groups are
  repeated runs: each holder but the first document learns that all of the run's windows are repeated.
  A group whose digits differ goes on.
* pass 3 sorts the windows of those runs at full depth. The runs of an anchor come whole to its place, as their
  bytes are a fraction of their windows' fingerprints, and there equal windows are told by the bytes.

Groups are told by 64 bits and confirmed by 32 more of another fingerprint; those within a task by the bytes.

Every task first settles what repeats among its own rows, so a passage that a third of all documents share
is dealt once a batch. An anchor with many different runs in a batch, a common phrase, is not dealt by itself:
its runs are spread over all places and go on to pass 3 window by window, and a mark at the anchor's place sends others after. Rows move as packed blocks. Texts move compressed, to a home of their own, twice.
"""

from __future__ import annotations

import functools
import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import cluster
from tessera.llm import vectext as vt

U64 = np.uint64
#: Bytes handled at once; longer documents are cut here, with an overlap of the depth.
SEGMENT = 1 << 18
#: Bytes of a home's texts that are looked at together; a longer text is looked at alone.
PART = 1 << 20
#: Bytes of text that make a place. Blocks go from places to places, so their number follows the data and not
#: the cluster's number of partitions.
PLACE_BYTES = 4 << 20
_LAST = np.iinfo(np.int64).max  # stands for a null id, after all others
_ANCHORS, _SETTLED, _OPEN, _WINDOWS, _COMMON, _SHOWN = range(6)
#: Different runs of one anchor in a batch from which on they are dealt by the run and not by the anchor.
MOST_RUNS = 16
#: Different runs of one anchor up to which they come to its place whole, and not window by window.
MOST_SHOWN = 1 << 14
#: Stands for a run in the place of a common anchor, to tell that there are others.
_MARK = U64((1 << 32) - 1)


#: The other fingerprint: of another multiplier and other numbers for the bytes.
_MULT2 = 0xC2B2AE3D27D4EB4F
_INV2 = pow(_MULT2, -1, 1 << 64)
_BYTES2 = np.random.default_rng(77003).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


@functools.cache
def _tables(n: int) -> tuple[np.ndarray, ...]:
    return vt._powers(vt._MULT, n), vt._powers(vt._INV, n), vt._powers(_MULT2, n), vt._powers(_INV2, n)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size, m = 1, v
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


class Chunk:
    """Pieces of documents end to end: the runs of windows that share their least anchor."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, anchor: int, runs: bool = True):
        self.depth, n = depth, len(data)
        power, self.inverse, power2, self.inverse2 = _tables(SEGMENT + 4 * depth + 64 if n <= SEGMENT + 4 * depth else n + 1)
        windows = n - depth + 1
        self.piece = self.begin = self.end = np.zeros(0, np.int64)
        self.h = self.c = self.e = np.zeros(0, U64)
        if windows < 1:
            return
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, U64)
            np.cumsum(vt._BYTES[data] * power[:n], out=self.sums[1:])
            self.sums2 = np.zeros(n + 1, U64)
            np.cumsum(_BYTES2[data] * power2[:n], out=self.sums2[1:])
            if not runs:
                return
            v = vt.mix((self.sums[anchor:] - self.sums[:-anchor]) * self.inverse[: n - anchor + 1])
            m = sliding_min(v, depth - anchor + 1)
            cut = np.zeros(windows + 1, bool)
            cut[1:windows] = m[1:] != m[:-1]
            cut[np.minimum(starts, windows)] = True
            cut[np.clip(ends - depth + 1, 0, windows)] = True
            begin = np.flatnonzero(cut[:windows])
            end = np.append(begin[1:], windows)
            piece = np.searchsorted(starts, begin, "right") - 1
            own = begin + depth <= ends[piece]
            self.piece, self.begin, self.end = piece[own], begin[own], end[own]
            self.h = m[self.begin] >> U64(8)
            self.c = np.minimum(_MARK - U64(1), vt.mix((self.sums[self.end - 1 + depth] - self.sums[self.begin]) * self.inverse[self.begin] + (self.end - self.begin).astype(U64)) >> U64(32))

            self.e = self.others(self.begin, self.end - 1 + depth)

    def window_hashes(self, at: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return vt.mix((self.sums[at + self.depth] - self.sums[at]) * self.inverse[at])

    def others(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The other fingerprint of the strings between, 32 bits of it."""
        with np.errstate(over="ignore"):
            return vt.mix((self.sums2[end] - self.sums2[begin]) * self.inverse2[begin] + (end - begin).astype(U64)) >> U64(32)


def run_key(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return vt.mix((h << U64(8)) ^ (c * U64(0xD6E8FEB86659FD93)))


def told_as(key: np.ndarray, other: np.ndarray) -> np.ndarray:
    """One number for both fingerprints: what a document is told."""
    with np.errstate(over="ignore"):
        return vt.mix(key + vt.mix(other + U64(0x632BE59BD9B4E019)))


def _open_as(told: np.ndarray, shown: np.ndarray | bool) -> np.ndarray:
    """What a document is told of an open run: the last bit has whether it is to be shown whole."""
    return (told & ~U64(1)) | np.asarray(shown).astype(U64)


def _confirmed(key: np.ndarray, other: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_settle by both fingerprints: (first entries, entries of other ids). Those that only seem equal are first entries too."""
    first, again, of = _settle(key, ids)
    same = other[again] == other[first[of]]
    if same.all():
        return first, again
    rest = again[~same]
    return np.concatenate([first, rest[_settle(told_as(key[rest], other[rest]), ids[rest])[0]]]), np.concatenate([again[same], rest[_settle(told_as(key[rest], other[rest]), ids[rest])[1]]])


def _tied(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One number for a document and a key."""
    with np.errstate(over="ignore"):
        return vt.mix(ids.astype(np.int64).view(U64) * U64(0x9FB21C651E98DF25) + keys)


def _chunks(data: np.ndarray, at: np.ndarray, depth: int, anchor: int, only: np.ndarray | None = None):
    """(chunk, document of each run, offset of the chunk in data) over all documents, long ones in segments."""
    for i, j in vt.chunks(at, SEGMENT):
        if only is not None and not only[i:j].any():
            continue
        if at[j] - at[i] <= SEGMENT:
            chunk = Chunk(data[at[i] : at[j]], at[i:j] - at[i], at[i + 1 : j + 1] - at[i], depth, anchor)
            yield chunk, chunk.piece + i, at[i]
        else:
            for s in range(int(at[i]), int(at[j]) - depth + 1, SEGMENT):
                e = min(s + SEGMENT + depth - 1, int(at[j]))
                chunk = Chunk(data[s:e], np.array([0]), np.array([e - s]), depth, anchor)
                yield chunk, chunk.piece + i, s


def _low_bytes(x: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :n]


def _from_bytes(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b), 8), np.uint8)
    out[:, : b.shape[1]] = b
    return out.view("<u8").ravel()


_STEPS = ("u1", "<u2", "<u4", "<u8")


def _pack(ids: np.ndarray, columns: list[tuple[np.ndarray, int]]) -> bytes:
    """A block of rows with ascending ids: the ids as steps, then each column's low bytes."""
    steps = np.diff(ids.view(U64) if len(ids) else ids)
    most = int(steps.max()) if len(steps) else 0
    kind = next(k for k, top in enumerate((1 << 8, 1 << 16, 1 << 32, 1 << 64)) if most < top)
    return b"".join([struct.pack("<IBq", len(ids), kind, int(ids[0]) if len(ids) else 0), steps.astype(_STEPS[kind]).tobytes(), *(_low_bytes(x, n).tobytes() for x, n in columns)])


def _unpack(block: bytes, widths: list[int]) -> list[np.ndarray]:
    n, kind, first = struct.unpack_from("<IBq", block)
    size = 1 << kind
    steps = np.frombuffer(block, _STEPS[kind], max(0, n - 1), 13).astype(U64)
    ids = np.empty(n, U64)
    ids[:1] = np.array([first], np.int64).view(U64)
    with np.errstate(over="ignore"):
        ids[1:] = ids[0] + np.cumsum(steps) if n > 1 else 0
    out, at = [ids.view(np.int64)], 13 + size * max(0, n - 1)
    for w in widths:
        out.append(_from_bytes(np.frombuffer(block, np.uint8, n * w, at).reshape(n, w)))
        at += n * w
    return out


def _deal(kind: int, place: np.ndarray, ids: np.ndarray, columns: list[tuple[np.ndarray, int]]):
    """Rows (kind, place, block) of the entries of each place, by ascending id."""
    if not len(ids):
        return
    order = np.argsort(ids, kind="stable")
    order = order[np.argsort(place[order].astype(np.uint16 if place.max() < 1 << 16 else np.uint32), kind="stable")]
    place, ids = place[order], ids[order]
    cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True])))
    # As _pack, all blocks at once: their number grows with the square of the places.
    steps = np.append(np.diff(ids.view(U64)), U64(0))
    steps[cut[1:] - 1] = 0
    wide = np.searchsorted(np.array([1 << 8, 1 << 16, 1 << 32], U64), np.maximum.reduceat(steps, cut[:-1]), "right")
    as_bytes = {k: steps.astype(_STEPS[k]).tobytes() for k in np.unique(wide).tolist()}
    held = [(_low_bytes(x[order], n).tobytes(), n) for x, n in columns]
    for a, b, k, at, first in zip(cut[:-1].tolist(), cut[1:].tolist(), wide.tolist(), place[cut[:-1]].tolist(), ids[cut[:-1]].tolist()):
        yield kind, at, b"".join([struct.pack("<IBq", b - a, k, first), as_bytes[k][a << k : b - 1 << k], *[x[a * n : b * n] for x, n in held]])


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "place", "block"])


_ROWS = "kind int, place int, block binary"


def _settle(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each group, the entry with the least id; the entries of other ids; and which of the first each of them has."""
    order = np.argsort(group)
    g = group[order]
    cut = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    held = ids[order]
    least = np.minimum.reduceat(held, cut) if len(cut) else held
    size = np.diff(np.append(cut, len(g)))
    same = held == np.repeat(least, size)
    where = np.flatnonzero(same)
    of = np.repeat(np.arange(len(cut)), size)[where]
    keep = where[np.concatenate(([True], of[1:] != of[:-1]))] if len(where) else where
    return order[keep], order[~same], np.repeat(np.arange(len(cut)), size)[~same]


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] and data[b : b + size] are the same bytes, for each."""
    out = np.ones(len(a), bool)
    upto = np.cumsum(size)
    for lo, hi in _slices(upto, 1 << 19):
        at, of = _spread(np.zeros(hi - lo, np.int64), size[lo:hi])
        differ = data[a[lo:hi][of] + at] != data[b[lo:hi][of] + at]
        out[lo + of[differ]] = False
    return out


def _slices(upto: np.ndarray, most: int):
    """Runs [i, j) of entries of about so many bytes together, given running sums of their sizes."""
    i = 0
    while i < len(upto):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def _homes(ids: np.ndarray, n: int) -> np.ndarray:
    return (vt.mix(ids.view(U64)) % U64(n)).astype(np.int64)


def _scan(batches, n: int, depth: int, anchor: int, most_runs: int):
    """Pass 1 on the texts' side: the anchors of each batch, what repeats within it settled at once."""
    for batch in batches:
        ids = np.array(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
        data, at = vt.column_bytes(batch.column(1))
        parts = [(doc, c.h, c.c, c.e, c.begin + base, c.end - c.begin - 1 + depth) for c, doc, base in _chunks(data, at, depth, anchor)]
        if not parts:
            continue
        doc, h, c, e, begin, size = (np.concatenate(x) for x in zip(*parts))
        own = ids[doc]
        key = run_key(h, c)
        first, again, of = _settle(key, own)
        good = size[again] == size[first[of]]
        good[good] = same_bytes(data, begin[again[good]], begin[first[of[good]]], size[again[good]])
        first, again = np.concatenate([first, again[~good]]), again[good]
        _, back, times = np.unique(h[first], return_inverse=True, return_counts=True)
        common = first[(times > most_runs)[back]]
        first = first[~(times > most_runs)[back]]
        rows = list(_deal(_COMMON, (key[common] % U64(n)).astype(np.int64), own[common], [(h[common], 7), (c[common], 4), (e[common], 4)]))
        _, once = np.unique(h[common], return_index=True)
        marks = common[once]
        ids_, h_, c_, e_ = np.concatenate([own[first], own[marks]]), np.concatenate([h[first], h[marks]]), np.concatenate([c[first], np.full(len(marks), _MARK)]), np.concatenate([e[first], np.zeros(len(marks), U64)])
        rows += _deal(_ANCHORS, (h_ % U64(n)).astype(np.int64), ids_, [(h_, 7), (c_, 4), (e_, 4)])
        tied = _unique_pairs(own[again], told_as(key[again], e[again]))
        rows += _deal(_SETTLED, _homes(tied[0], n), tied[0], [(tied[1], 8)])
        if rows:
            yield _batch(rows)


def _unique_pairs(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, at = np.unique(_tied(ids, keys), return_index=True)
    return ids[at], keys[at]


def _order_runs(key, table: pa.Table, n: int) -> pa.Table:
    """Passes 1 and 2 of one place: sort by anchor, then by context, and tell the documents.

    A common anchor's runs are dealt by themselves: equal ones settle, and all that are left go on.
    """
    kind, place = key[0].as_py(), key[1].as_py()
    if kind == _SETTLED:
        return table
    parts = [_unpack(b.as_py(), [7, 4, 4]) for b in table.column("block")]
    ids, h, c, e = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(h)
    s = h[order]
    many = np.full(len(s), kind == _COMMON)
    many[1:] |= s[1:] == s[:-1]
    many[:-1] |= s[1:] == s[:-1]
    ids, h, c, e = ids[order][many], s[many], c[order][many], e[order][many]
    rows: list = []
    if len(ids):
        runs = run_key(h, c)
        first, again = _confirmed(runs, e, ids)
        again = again[c[again] != _MARK]
        settled = _unique_pairs(ids[again], told_as(runs[again], e[again]))
        rows += _deal(_SETTLED, _homes(settled[0], n), settled[0], [(settled[1], 8)])
        h, ids, runs, mark = h[first], ids[first], told_as(runs[first], e[first]), c[first] == _MARK
        order = np.argsort(h)
        h, ids, runs, mark = h[order], ids[order], runs[order], mark[order]
        cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.append(cut, len(h)))
        mixed = np.minimum.reduceat(ids, cut) != np.maximum.reduceat(ids, cut)
        marked = np.logical_or.reduceat(mark, cut) | (kind == _COMMON)
        shown = np.repeat(~marked & (size <= MOST_SHOWN), size)
        mixed = np.repeat(mixed | marked, size) & ~mark
        rows += _deal(_OPEN, _homes(ids[mixed], n), ids[mixed], [(_open_as(runs, shown)[mixed], 8)])
    return pa.Table.from_batches([_batch(rows)])


def _order_windows(key, table: pa.Table, n: int) -> pa.Table:
    """Pass 3 of one place: windows at full depth."""
    if key[0].as_py() == _WINDOWS:
        return table
    if key[0].as_py() == _SHOWN:
        return _order_shown(table, n)
    parts = [_unpack(b.as_py(), [8, 4]) for b in table.column("block")]
    ids, w, e = (np.concatenate(x) for x in zip(*parts))
    _, again = _confirmed(w, e, ids)
    pair = _unique_pairs(ids[again], told_as(w[again], e[again]))
    return pa.Table.from_batches([_batch(list(_deal(_WINDOWS, _homes(pair[0], n), pair[0], [(pair[1], 8)])))])


def _show(place: np.ndarray, ids: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray, depth: int):
    """Rows (kind, place, block) of the bytes of each place's runs, by ascending id."""
    press = zstandard.ZstdCompressor(level=1)
    order = np.lexsort((ids, place))
    place, ids, begin, size = place[order], ids[order], begin[order], size[order]
    cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True]))) if len(place) else np.zeros(0, np.int64)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        head = _pack(ids[a:b], [(size[a:b], 4)])
        yield _SHOWN, int(place[a]), press.compress(struct.pack("<II", depth, len(head)) + head + data[_spread(begin[a:b], begin[a:b] + size[a:b])[0]].tobytes())


def _order_shown(table: pa.Table, n: int) -> pa.Table:
    """Pass 3 of one place where runs came whole: their windows, equal ones told by the bytes."""
    parts, depth, press = [], 0, zstandard.ZstdDecompressor()
    for block in table.column("block"):
        raw = press.decompress(block.as_py())
        depth, head = struct.unpack_from("<II", raw)
        parts.append((*_unpack(raw[8 : 8 + head], [4]), np.frombuffer(raw, np.uint8, offset=8 + head)))
    ids, size, data = (np.concatenate(x) for x in zip(*parts))
    at = np.concatenate(([0], np.cumsum(size.astype(np.int64))))
    found = []
    for i, j in vt.chunks(at, SEGMENT):
        chunk = Chunk(data[at[i] : at[j]], at[:0], at[:0], depth, depth, runs=False)
        where, of = _spread(at[i:j] - at[i], at[i + 1 : j + 1] - at[i] - depth + 1)
        found.append((chunk.window_hashes(where), chunk.others(where, where + depth), ids[i + of], where + at[i]))
    w, e, d, begin = (np.concatenate(x) for x in zip(*found))
    again, left = [], np.arange(len(w))
    while len(left):
        first, other, of = _settle(w[left], d[left])
        first, other = left[first], left[other]
        good = same_bytes(data, begin[other], begin[first[of]], np.full(len(other), depth))
        again.append(other[good])
        left = other[~good]  # of another string
    again = np.concatenate(again)
    pair = _unique_pairs(d[again], told_as(w[again], e[again]))
    return pa.Table.from_batches([_batch(list(_deal(_WINDOWS, _homes(pair[0], n), pair[0], [(pair[1], 8)])))])


def _pack_texts(batches, n: int):
    """Texts by home, each home's of a batch as one compressed block."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        ids = np.array(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
        data, at = vt.column_bytes(batch.column(1))
        home = _homes(ids, n)
        order = np.argsort(home, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], home[order][1:] != home[order][:-1], [True]))) if len(order) else [0]
        rows = []
        for a, b in zip(cut[:-1], cut[1:]):
            mine = order[a:b]
            body = [struct.pack("<I", len(mine)), ids[mine].tobytes(), (at[mine + 1] - at[mine]).astype("<i8").tobytes(), *(data[at[i] : at[i + 1]].tobytes() for i in mine.tolist())]
            rows.append((0, int(home[mine[0]]), press.compress(b"".join(body))))
        if rows:
            yield _batch(rows)


def _unpack_texts(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    (n,) = struct.unpack_from("<I", raw)
    ids, sizes = np.frombuffer(raw, np.int64, n, 4), np.frombuffer(raw, np.int64, n, 4 + 8 * n)
    return ids, np.frombuffer(raw, np.uint8, offset=4 + 16 * n), np.concatenate(([0], np.cumsum(sizes)))


def _told(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a home that were told something of this kind, and the sorted ties of what."""
    parts = [_unpack(b.as_py(), [8]) for k, b in zip(table.column("kind").to_pylist(), table.column("block")) if k == kind]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    ids, keys = (np.concatenate(x) for x in zip(*parts))
    return np.unique(ids), np.sort(_tied(ids, keys))


def _has(ties: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(ties):
        return np.zeros(len(of), bool)
    return ties[np.minimum(np.searchsorted(ties, of), len(ties) - 1)] == of


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and the range of each."""
    size = end - begin
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + begin[of], of


def _home(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts of a home end to end: ids, bytes, offsets."""
    blocks = [_unpack_texts(b.as_py()) for b in texts.column("block")]
    if not blocks:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ids, data, at = zip(*blocks)
    starts = np.cumsum([0, *(len(d) for d in data)])
    return np.concatenate(ids), np.concatenate(data), np.concatenate([*(a[:-1] + s for a, s in zip(at, starts)), starts[-1:]])


def _parts(texts: pa.Table):
    """A home's documents in parts of about PART bytes: ids, bytes, offsets."""
    ids, data, at = _home(texts)
    for i, j in vt.chunks(at, PART):
        yield ids[i:j], data[at[i] : at[j]], at[i : j + 1] - at[i]


def _open_windows(texts: pa.Table, told: pa.Table, n: int, depth: int, anchor: int) -> pa.Table:
    """A home's open runs for pass 3: those to be shown, and the windows of the others, of which what repeats here is settled by the bytes."""
    who, ties = _told(told, _OPEN)
    rows: list = []
    for ids, data, at in [_home(texts)] if len(who) else ():
        found, shown = [], []
        for chunk, doc, base in _chunks(data, at, depth, anchor, np.isin(ids, who)):
            run = told_as(run_key(chunk.h, chunk.c), chunk.e)
            tie = _tied(ids[doc], _open_as(run, True))
            mine = np.flatnonzero(_has(ties, tie))
            shown.append((chunk.h[mine], ids[doc[mine]], chunk.begin[mine] + base, chunk.end[mine] - chunk.begin[mine] - 1 + depth, tie[mine]))
            own = _has(ties, _tied(ids[doc], _open_as(run, False)))
            where, of = _spread(chunk.begin[own], chunk.end[own])
            if len(where):
                w, e, d = chunk.window_hashes(where), chunk.others(where, where + depth), ids[doc[own]][of]
                _, once = np.unique(_tied(d, told_as(w, e)), return_index=True)
                found.append((d[once], w[once], e[once], where[once] + base))
        if shown:
            h, d, begin, size, tie = (np.concatenate(x) for x in zip(*shown))
            _, once = np.unique(tie, return_index=True)
            rows += _show((h[once] % U64(n)).astype(np.int64), d[once], data, begin[once], size[once], depth)
        if found:
            d, w, e, begin = (np.concatenate(x) for x in zip(*found))
            first, again, of = _settle(w, d)
            good = same_bytes(data, begin[again], begin[first[of]], np.full(len(again), depth))
            first, again = np.concatenate([first, again[~good]]), again[good]
            rows += _deal(_ANCHORS, (w[first] % U64(n)).astype(np.int64), d[first], [(w[first], 8), (e[first], 4)])
            rows += _deal(_WINDOWS, _homes(d[again], n), d[again], [(told_as(w[again], e[again]), 8)])
    return pa.Table.from_batches([_batch(rows)])


def _remove(texts: pa.Table, told: pa.Table, depth: int, anchor: int) -> pa.Table:
    """A home's documents with their repeated bytes taken out."""
    _, settled = _told(told, _SETTLED)
    _, open_runs = _told(told, _OPEN)
    _, windows = _told(told, _WINDOWS)
    out: dict[str, list] = {k: [] for k in ("id", "n_bytes", "spans", "kept")}
    for ids, data, at in _parts(texts):
        edge = np.zeros(len(data) + 1, np.int32)
        if len(settled) or len(windows):
            for chunk, doc, base in _chunks(data, at, depth, anchor):
                run = told_as(run_key(chunk.h, chunk.c), chunk.e)
                all_of = _has(settled, _tied(ids[doc], run))
                np.add.at(edge, chunk.begin[all_of] + base, 1)
                np.add.at(edge, chunk.end[all_of] - 1 + depth + base, -1)
                some = (_has(open_runs, _tied(ids[doc], _open_as(run, False))) | _has(open_runs, _tied(ids[doc], _open_as(run, True)))) & ~all_of
                if some.any() and len(windows):
                    where, of = _spread(chunk.begin[some], chunk.end[some])
                    where = where[_has(windows, _tied(ids[doc[some]][of], told_as(chunk.window_hashes(where), chunk.others(where, where + depth))))]
                    np.add.at(edge, where + base, 1)
                    np.add.at(edge, where + depth + base, -1)
        gone = np.cumsum(edge[:-1]) > 0
        for i, doc_id in enumerate(ids.tolist()):
            mine, text = gone[at[i] : at[i + 1]], data[at[i] : at[i + 1]]
            flips = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)) if mine.any() else np.zeros(0, np.int64)
            out["id"].append(None if doc_id == _LAST else doc_id)
            out["n_bytes"].append(len(text))
            out["spans"].append([{"start": a, "end": b} for a, b in flips.reshape(-1, 2).tolist()])
            out["kept"].append(text[~mine].tobytes() if len(flips) else text.tobytes())
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = {"id": pa.int64(), "n_bytes": pa.int64(), "spans": span, "kept": pa.binary()}
    return pa.table({k: pa.array(v, types[k]) for k, v in out.items()})


def remove_repeats(spark: SparkSession, docs: DataFrame, depth: int = 50, id_col: str = "doc_id", text_col: str = "text", anchor: int | None = None) -> DataFrame:
    """Take out of each text every byte covered by a string of ``depth`` bytes that also starts in a document of a smaller id.

    Returns, per row of docs: the id, n_bytes, n_removed, n_spans, spans (array of start, end in bytes, end
    exclusive) and kept (the remaining bytes). Strings are judged on the input. A null text is empty; a null id
    counts as larger than any other; rows of the same id are never earlier than each other, so repeated rows
    stay alike. Texts shorter than ``depth`` lose nothing. Only the two columns are read, whatever else docs has.
    """
    cluster.ship(spark)
    anchor = anchor or max(1, min(20, depth // 2))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(1 << 24, total // PLACE_BYTES + 1)

    most_runs = MOST_RUNS
    dealt = rows.mapInArrow(lambda batches: cluster.handing_back(_scan(batches, n, depth, anchor, most_runs)), _ROWS)
    told = cluster.materialize(spark, dealt.groupBy("kind", "place").applyInArrow(lambda key, t: _order_runs(key, t, n), _ROWS), "runs")
    del dealt
    cluster.drop_shuffles(spark)
    homes = rows.mapInArrow(lambda batches: cluster.handing_back(_pack_texts(batches, n)), _ROWS)
    opened = homes.groupBy("place").cogroup(told.where(F.col("kind") == _OPEN).groupBy("place")).applyInArrow(lambda a, b: _open_windows(a, b, n, depth, anchor), _ROWS)
    windows = opened.groupBy("kind", "place").applyInArrow(lambda key, t: _order_windows(key, t, n), _ROWS)
    schema = "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    out = homes.groupBy("place").cogroup(told.unionByName(windows).groupBy("place")).applyInArrow(lambda a, b: _remove(a, b, depth, anchor), schema)
    return out.select(F.col("id").alias(id_col), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans", "kept")
