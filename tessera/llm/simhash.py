"""Near-duplicate classes by SimHash with random bit sampling.

Each document's distinct five-word shingles vote on a fingerprint of 256 bits. Documents of equal shingle
sets become one node at once. Tables, more of them the more bits they sample, deal nodes into buckets by
sampled bits of the fingerprint, and one deals short texts by the shingles that similar ones must share; a
bucket over its cap is dealt again by additional bits, under several samples, which links most of a large group.
Within a bucket, fingerprint distances give candidate links: all of them in a sparse bucket, a minimum spanning
forest in a dense one, so a group of copies never gives all its pairs. Links are then verified on the texts
themselves, first each node's closest, then those that still join different classes.

Nothing that met in a bucket is lost after that. Rows of a bucket over the cap whose classes still differ are
compared by their fingerprints, all with all, in pairs of blocks. Where close rows are still apart though
forests or blocks connect them, all texts of what is so connected are compared exactly, in pairs of blocks.
Rows of one class are never compared again. Classes are the connected components of what holds.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import cluster
from tessera.llm import vectext as vt

U64 = np.uint64
BITS, VARIANTS = 256, 3
#: A pair at the similarity asked for meets in no table with this probability at most, whatever the number of texts.
MISS = 0.001
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Rows in a bucket before additional bits are used, and rows that a task holds of what these leave together.
CAP, MOST_ROWS = 1024, 8192
#: Bits of the bitmap that tells most rows that their bucket is not over the cap: 1 MB, whatever the input.
SLOTS = 1 << 23
#: Rows of a bucket up to which all its distances are taken lag by lag, together with those of other buckets.
SMALL = 192
#: Texts and shingles of a block of those that are compared all with all.
BLOCK_TEXTS, BLOCK_SHINGLES = 2048, 1 << 20
#: Links up to which one task tells their components, 16 MB of them; more go by stars.
MOST_LINKS = 1 << 20
_LAST = np.iinfo(np.int64).max
#: Texts of so many shingles at most meet by shared shingles; at worst (4 and 5, sharing 4) they differ in this share of bits.
SHORT, SHORT_APART = 80, 0.1875
SHORT_MOST = math.ceil(BITS * SHORT_APART + 5 * math.sqrt(BITS * SHORT_APART * (1 - SHORT_APART)))


@functools.cache
def _order(table: int, variant: int = -1) -> np.ndarray:
    """The order in which a table samples bits; -1 is the table of shared shingles."""
    return np.random.default_rng([977, table + 1, variant + 1]).permutation(BITS)


def table_width(n: int) -> int:
    """Sampled bits for so many nodes: some 64 to 128 unrelated rows a bucket, as distances cost less than tables."""
    return max(8, min(40, math.ceil(math.log2(max(2, n))) - 7))


def tables(width: int, similarity: float = SIMILARITY) -> int:
    """Tables of so many sampled bits that leave a pair of this similarity unmet with probability MISS at most."""
    return _times((1 - expected_distance(similarity) / BITS) ** width)


def _times(meet: float) -> int:
    return 1 if meet >= 1 - MISS else math.ceil(math.log(MISS) / math.log1p(-meet))


def expected_distance(similarity: float, bits: int = BITS) -> float:
    """Of fingerprints of two sets of equal size with this Jaccard similarity."""
    return bits * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def loose_distance(similarity: float, bits: int = BITS) -> int:
    """Three and a half deviations above the expected distance: candidates, to be verified."""
    p = expected_distance(similarity, bits) / bits
    return math.ceil(bits * p + 3.5 * math.sqrt(bits * p * (1 - p)))


def fingerprints(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprints (n, BITS / 8 bytes) of sets of shingle hashes; none may be empty."""
    n = len(at) - 1
    out = np.zeros((n, BITS // 8), np.uint8)
    for i, j in vt.chunks(at, 1 << 16):
        part, local = sets[at[i] : at[j]], at[i : j + 1] - at[i]
        words = np.empty((len(part), BITS // 64), U64)
        with np.errstate(over="ignore"):
            for k in range(BITS // 64):
                words[:, k] = vt.mix(part * U64(2 * k + 1) + U64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
        votes = np.zeros((j - i, BITS), np.int64)
        for lo in range(0, len(part), 1 << 16):  # a longer set comes in parts
            piece = np.unpackbits(words[lo : lo + (1 << 16)].view(np.uint8), axis=1)
            here = np.clip(local, lo, lo + len(piece)) - lo
            own = np.flatnonzero(np.diff(here))
            begin = here[:-1][own]
            runs = np.concatenate([np.arange(b, e, 255) for b, e in zip(begin.tolist(), here[1:][own].tolist())])
            sums = np.add.reduceat(piece, runs, axis=0, dtype=np.uint8)  # at most 255 votes each
            votes[own] += np.add.reduceat(sums, np.searchsorted(runs, begin), axis=0, dtype=np.int64)
        sizes = np.diff(local)[:, None]
        out[i:j] = np.packbits((2 * votes > sizes) | ((2 * votes == sizes) & (np.arange(BITS) % 2 == 1)), axis=1)
    return out


def _heads(sets: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The least shingles of each short set, so many that two similar sets share one; offsets."""
    n = np.where((size > 0) & (size <= SHORT), size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, 0)
    place = np.arange(len(sets)) - np.repeat(np.cumsum(size) - size, size)
    return sets[place < np.repeat(n, size)], np.concatenate(([0], np.cumsum(n)))


def _signatures(batches, k: int, similarity: float):
    for batch in batches:
        data, at = vt.column_bytes(batch.column(1))
        ids = np.array(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
        for i, j in vt.chunks(at, 1 << 19):
            sets, where = vt.shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], k)
            size = np.diff(where)
            own = np.flatnonzero(size)
            s1, s2 = np.zeros(j - i, U64), np.zeros(j - i, U64)
            print_ = np.zeros((j - i, BITS // 8), np.uint8)
            if len(own):
                starts = where[:-1][own]
                s1[own] = np.add.reduceat(vt.mix(sets), starts)
                s2[own] = np.add.reduceat(vt.mix(sets ^ U64(0x5851F42D4C957F2D)), starts)
                print_[own] = fingerprints(sets, np.append(starts, len(sets)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i:j]), pa.array(size), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), vt.binary_rows(print_.ravel(), np.arange(j - i + 1) * (BITS // 8)), vt.binary_rows(*_heads(sets, size, similarity))], ["id", "size", "s1", "s2", "print", "heads"])


def _prints(column) -> np.ndarray:
    data, _ = vt.column_bytes(column)
    return data.reshape(-1, BITS // 8)


def _sampled(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bits), np.int64)
    for p in places.tolist():
        out = (out << 1) | bits[:, p]
    return out


def _dealt(batches, width: int, count: int):
    """Each node once a table, and a short one by its shingles in table -1: (table, keys, rows, batch)."""
    for batch in batches:
        bits = np.unpackbits(_prints(batch.column(1)), axis=1)
        for t in range(count):
            yield t, _sampled(bits, _order(t)[:width]), np.arange(len(bits)), batch
        data, at = vt.column_bytes(batch.column(2))
        heads, row = np.frombuffer(data.tobytes(), np.int64), np.repeat(np.arange(len(bits)), np.diff(at) // 8)
        if len(heads):
            yield -1, heads, row, batch


def _slots(table: int | np.ndarray, key: np.ndarray) -> np.ndarray:
    """A place in a bitmap of SLOTS bits for each bucket."""
    with np.errstate(over="ignore"):
        return (vt.mix(key.view(U64) * U64(1 << 13) + np.asarray(table, np.int64).view(U64) + U64(1)) % U64(SLOTS)).astype(np.int64)


def _deal(batches, width: int, count: int, over: np.ndarray | None, large: bool):
    """Rows (table, key, id, print): those of buckets that the bitmap over has, or all others."""
    for table, key, row, batch in _dealt(batches, width, count):
        if over is not None:
            at = _slots(table, key)
            mine = np.flatnonzero((over[at >> 6] >> (at & 63).astype(U64) & U64(1)).astype(bool) == large)
            key, row = key[mine], row[mine]
        if len(key):
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), table, np.int32)), pa.array(key), batch.column(0).take(rows), batch.column(1).take(rows)], ["table", "key", "id", "print"])


def _keys(batches, width: int, count: int):
    """The bucket of each row, once a table."""
    for table, key, _, _ in _dealt(batches, width, count):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), table, np.int32)), pa.array(key)], ["table", "key"])


def _bitmap(batches):
    """Buckets (table, key) as words of a bitmap: (word, bits)."""
    out = np.zeros(SLOTS // 64, U64)
    for batch in batches:
        at = _slots(batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy())
        np.bitwise_or.at(out, at >> 6, U64(1) << (at & 63).astype(U64))
    word = np.flatnonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(out[word].view(np.int64))], ["word", "bits"])


def _deal_again(batches, width: int, cap: int):
    """Nodes of buckets over the cap, by additional bits: as many as the bucket's size asks for, under several samples."""
    for batch in batches:
        table, key, n = (batch.column(k).to_numpy() for k in (0, 1, 4))
        bits = np.unpackbits(_prints(batch.column(3)), axis=1)
        more = np.minimum(np.ceil(np.log2(n / cap)).astype(np.int64) + 2, 24)
        often = {m: _times((1 - SHORT_APART) ** m) for m in np.unique(more).tolist()}
        variants = np.where(table < 0, [often[m] for m in more.tolist()], VARIANTS)
        for v in range(int(variants.max(initial=0))):
            mine = np.flatnonzero(variants > v)
            fresh = np.zeros(len(mine), np.int64)
            for t in np.unique(table[mine]).tolist():
                here = table[mine] == t
                order = _order(t, v)
                if t >= 0:
                    order = order[~np.isin(order, _order(t)[:width])]
                fresh[here] = _sampled(bits[mine[here]], order[:24]) >> (24 - more[mine[here]])
            with np.errstate(over="ignore"):
                salted = vt.mix(key[mine].view(U64) * U64(1 << 13) + U64(v + 1)) ^ vt.mix(fresh.view(U64) + U64(1 << 40))
            rows = pa.array(mine)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(salted.view(np.int64)), batch.column(2).take(rows), batch.column(3).take(rows)], ["table", "key", "id", "print"])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def spanning_forest(prints: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """A minimum spanning forest over distances of at most so much, in memory that is linear: (i, j, distance)."""
    n = len(prints)
    links = []
    best, near, out = np.full(n, 1 << 30), np.zeros(n, np.int64), np.ones(n, bool)
    at = 0
    out[0] = False
    for _ in range(n - 1):
        d = _distance(prints, prints[at])
        closer = out & (d < best)
        best[closer], near[closer] = d[closer], at
        at = int(np.where(out, best, 1 << 31).argmin())
        if best[at] <= most:
            links.append((int(near[at]), at, int(best[at])))
        out[at] = False
    return links


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Between all rows of left and all of right."""
    out = np.zeros((len(left), len(right)), np.uint16)
    for k in range(left.shape[1]):
        out += np.bitwise_count(left[:, k, None] ^ right[None, :, k])
    return out


def bucket_links(group: np.ndarray, ids: np.ndarray, prints: np.ndarray, most: int | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidate links within buckets, and which of them are a forest's: group marks the first row of each."""
    n = len(ids)
    most = np.broadcast_to(most, n)
    start = np.flatnonzero(group)
    size = np.diff(np.append(start, n))
    which = np.repeat(np.arange(len(start)), size)
    small = size <= SMALL
    a, b, d = [], [], []
    lag = 1
    rows = np.flatnonzero(small[which])
    left = (start + size)[which]
    while len(rows := rows[rows + lag < left[rows]]):
        dist = _distance(prints[rows], prints[rows + lag])
        close = dist <= most[rows]
        a.append(rows[close]), b.append(rows[close] + lag), d.append(dist[close])
        lag += 1
    i, j, dist = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, d))
    found = np.bincount(which[i], minlength=len(start))
    crowded = found > 3 * size
    keep = ~crowded[which[i]]
    i, j, dist = [i[keep]], [j[keep]], [dist[keep]]
    for g in np.flatnonzero(~small).tolist():
        lo, hi = start[g], start[g] + size[g]
        crowded[g] = size[g] > CAP
        if not crowded[g]:
            d = distances(prints[lo:hi], prints[lo:hi])
            x, y = np.nonzero(np.triu(d <= most[lo], 1))
            crowded[g] = len(x) > 3 * size[g]
            if not crowded[g]:
                i.append(x + lo), j.append(y + lo), dist.append(d[x, y].astype(np.int64))
    dense = np.flatnonzero(crowded)
    plain = sum(map(len, i))
    for g in dense.tolist():
        if links := spanning_forest(prints[start[g] : start[g] + size[g]], int(most[start[g]])):
            x = np.array(links)
            i.append(x[:, 0] + start[g]), j.append(x[:, 1] + start[g]), dist.append(x[:, 2])
    i, j, dist = (np.concatenate(x) for x in (i, j, dist))
    a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
    return a, b, dist, np.arange(len(a)) >= plain


def _link(batches, most: int):
    """Links of a partition's buckets, whose rows come sorted; a bucket that a batch cuts waits for the next."""
    held: list[tuple] = []

    def out(parts):
        table, key, ids = (np.concatenate([p[k] for p in parts]) for k in range(3))
        prints = np.ascontiguousarray(np.concatenate([p[3] for p in parts])).view(U64)
        group = np.ones(len(ids), bool)
        group[1:] = (table[1:] != table[:-1]) | (key[1:] != key[:-1])
        a, b, d, forest = bucket_links(group, ids, prints, np.where(table < 0, max(most, SHORT_MOST), most))
        _, once = np.unique(np.stack([a, b, forest]), axis=1, return_index=True) if len(a) else (None, np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once]), pa.array(d[once]), pa.array(forest[once])], ["a", "b", "distance", "forest"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table, key, ids = (batch.column(k).to_numpy() for k in range(3))
        rows = (table, key, ids, _prints(batch.column(3)))
        last = np.flatnonzero((table != table[-1]) | (key != key[-1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield out([*held, tuple(x[:cut] for x in rows)])
            held = []
        elif held and (held[-1][0][-1], held[-1][1][-1]) != (table[0], key[0]):
            yield out(held)
            held = []
        held.append(tuple(x[cut:].copy() for x in rows))
    if held:
        yield out(held)


def _verify(batches, k: int, least: float):
    """Links (a, b, texts) whose shingle sets are as similar as asked."""
    for batch in (b.slice(lo, 1024) for b in batches for lo in range(0, b.num_rows, 1024)):
        keys, sizes = [], []
        for c in (2, 3):
            data, at = vt.column_bytes(batch.column(c))
            parts = [vt.shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], k) for i, j in vt.chunks(at, 1 << 20)]
            size = np.concatenate([np.diff(w) for _, w in parts])
            row = np.repeat(np.arange(len(size)), size).astype(U64)
            keys.append((row << U64(44)) | np.concatenate([s for s, _ in parts]))
            sizes.append(size)
        both = np.intersect1d(*keys, assume_unique=True)
        common = np.bincount((both >> U64(44)).astype(np.int64), minlength=batch.num_rows)
        good = (common > 0) & (common >= least * (sizes[0] + sizes[1] - common) - 1e-9)
        yield pa.RecordBatch.from_arrays([x.filter(pa.array(good)) for x in (batch.column(0), batch.column(1))], ["a", "b"])


def _sets(batches, k: int):
    """Shingle sets of texts: clump, class, id, size, shingles."""
    for batch in batches:
        data, at = vt.column_bytes(batch.column(3))
        for i, j in vt.chunks(at, 1 << 20):
            sets, where = vt.shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], k)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), pa.array(np.diff(where)), vt.binary_rows(sets, where)], ["clump", "class", "id", "size", "shingles"])


def common_shingles(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many shingles each set of left (sets, offsets) shares with each of right."""
    n, m = len(left[1]) - 1, len(right[1]) - 1
    both = np.intersect1d(left[0], right[0])
    out = np.zeros((n, m), np.float32)
    if not len(both):
        return out
    sides = []
    for sets, at in (left, right):
        column = np.minimum(np.searchsorted(both, sets), len(both) - 1)
        mine = both[column] == sets
        column, row = column[mine], np.repeat(np.arange(len(at) - 1), np.diff(at))[mine]
        order = np.argsort(column, kind="stable")
        sides.append((row[order], np.searchsorted(column[order], np.arange(len(both) + 1))))
    (r1, at1), (r2, at2) = sides
    n1, n2 = np.diff(at1), np.diff(at2)
    rare = n1 * n2 <= 64
    for lo in range(0, len(both), 1 << 14):  # columns with few pairs: pair by pair
        c = lo + np.flatnonzero(rare[lo : lo + (1 << 14)])
        if len(c):
            times = n1[c] * n2[c]
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            c = np.repeat(c, times)
            out += np.bincount(r1[at1[c] + place // n2[c]] * m + r2[at2[c] + place % n2[c]], minlength=n * m).reshape(n, m)
    full = np.flatnonzero(~rare)
    for lo in range(0, len(full), 2048):  # the others: a product of matrices
        c = full[lo : lo + 2048]
        dense = []
        for r, at, size, rows in ((r1, at1, n1, n), (r2, at2, n2, m)):
            x = np.zeros((rows, len(c)), np.float32)
            begin = np.cumsum(size[c]) - size[c]
            where = np.repeat(at[c] - begin, size[c]) + np.arange(size[c].sum())
            x[r[where], np.repeat(np.arange(len(c)), size[c])] = 1
            dense.append(x)
        out += dense[0] @ dense[1].T
    return out


def spanning_links(joined: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links."""
    links = []
    left = joined.any(axis=1)
    while left.any():
        front = np.array([left.argmax()])
        left[front] = False
        while len(front):
            hit = joined[front] & left
            fresh = np.flatnonzero(hit.any(axis=0))
            links += zip(front[hit[:, fresh].argmax(axis=0)].tolist(), fresh.tolist())
            left[fresh] = False
            front = fresh
    return links


def _compare(table: pa.Table, least: float) -> pa.Table:
    """Links that connect what similar pairs of different classes connect, of one block or between two."""
    blocks = []
    for rows in table.column("rows").to_pylist():
        size = np.array([r["size"] for r in rows], np.int64)
        sets = np.frombuffer(b"".join(r["shingles"] for r in rows), U64)
        blocks.append((np.array([r["id"] for r in rows], np.int64), np.array([r["class"] for r in rows], np.int64), size, (sets, np.concatenate(([0], np.cumsum(size))))))
    (i1, c1, s1, x1), (i2, c2, s2, x2) = blocks[0], blocks[-1]
    common = common_shingles(x1, x2)
    good = (common > 0) & (common >= least * (s1[:, None] + s2[None, :] - common) - 1e-9) & (c1[:, None] != c2[None, :])
    return _connecting(i1, i2, good, len(blocks) == 2)


def _near(table: pa.Table, most: int) -> pa.Table:
    """Links that connect what close rows of different classes connect, of one block or between two."""
    blocks = []
    for rows in table.column("rows").to_pylist():
        prints = np.frombuffer(b"".join(r["print"] for r in rows), U64).reshape(-1, BITS // 64)
        blocks.append((np.array([r["id"] for r in rows], np.int64), np.array([r["class"] for r in rows], np.int64), prints, rows[0]["table"]))
    (i1, c1, p1, t), (i2, c2, p2, _) = blocks[0], blocks[-1]
    close = (distances(p1, p2) <= (most if t >= 0 else max(most, SHORT_MOST))) & (c1[:, None] != c2[None, :])
    return _connecting(i1, i2, close, len(blocks) == 2)


def _connecting(i1: np.ndarray, i2: np.ndarray, good: np.ndarray, two: bool) -> pa.Table:
    ids = i1
    if two:
        n, ids = len(i1), np.concatenate([i1, i2])
        joined = np.zeros((len(ids), len(ids)), bool)
        joined[:n, n:], joined[n:, :n] = good, good.T
        good = joined
    x = np.array(spanning_links(good), np.int64).reshape(-1, 2)
    ends = np.sort(ids[x], axis=1)
    return pa.table({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])})


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of links, ascending, and the least node that links lead to from each."""
    nodes, x = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = x[: len(a)], x[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        x, y = label[x], label[y]
        x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
        np.minimum.at(label, y, x)
        while not np.array_equal(up := label[label], label):
            label = up
    return nodes, nodes[label]


def _together(batches):
    """The components of all links (a, b) that come: (node, label)."""
    parts = [(np.array(b.column(0)), np.array(b.column(1))) for b in batches if b.num_rows]
    if parts:
        nodes, label = least_nodes(*(np.concatenate(x) for x in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], ["node", "label"])


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of links (a, b), a < b: the least node that links lead to.

    Up to MOST_LINKS links meet in one task, as rounds of jobs would take longer than what they do; more go by
    alternating large and small stars. Both are exact.
    """
    edges = cluster.materialize(spark, links.select("a", "b"), "stars")
    if edges.count() <= MOST_LINKS:
        return cluster.materialize(spark, edges.repartition(1).mapInArrow(lambda b: cluster.handing_back(_together(b)), "node long, label long"), "components")
    before = None
    for _ in range(60):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.*").where("a < b").distinct()
        edges = cluster.materialize(spark, small, "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components have not settled")
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return stars.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct()


def classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, k: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of docs: the id, class_id (the least id of its near-duplicate class) and n_shingles.

    Near duplicates have a Jaccard similarity of ``similarity`` or more over distinct shingles of k words
    (words part at space and tab to carriage return; a text of fewer words is one shingle). Links are exact:
    no pair below the similarity is linked; a pair above may be missed with the probability that bit sampling
    leaves (by its model MISS at most at the similarity itself, for any number of texts and any size of a bucket,
    for a pair that nothing else connects; less for short texts, which meet by shared shingles). A text without words,
    null or not, is a class of its own; a row without id takes no part and has no class. Rows of one id are
    one document. Only the two columns are read. An empty table gives an empty one.
    """
    cluster.ship(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = cluster.materialize(spark, rows.mapInArrow(lambda b: cluster.handing_back(_signatures(b, k, similarity)), "id long, size long, s1 long, s2 long, print binary, heads binary"), "prints")
    nodes = signed.where((F.col("size") > 0) & (F.col("id") != _LAST)).groupBy("s1", "s2").agg(F.min("id").alias("node"), F.max("print").alias("print"), F.max("heads").alias("heads"))
    nodes = cluster.materialize(spark, nodes, "nodes")
    links = _links(spark, rows, nodes, similarity, k)
    labels = components(spark, links)
    named = nodes.drop("print", "heads").join(labels, "node", "left").select("s1", "s2", F.coalesce("label", "node").alias("label"))
    out = signed.drop("print", "heads").withColumn("alone", (F.col("size") == 0) | (F.col("id") == _LAST)).join(named.withColumn("alone", F.lit(False)), ["s1", "s2", "alone"], "left")
    blank = lambda c: F.nullif(c, F.lit(_LAST))
    return out.select(blank(F.col("id")).alias(id_col), blank(F.coalesce("label", "id")).alias("class_id"), F.col("size").alias("n_shingles"))


def _hits(rows: DataFrame, ids: DataFrame, id_col: str, hit: str, words: int = 1 << 17) -> DataFrame:
    """rows with a column more: false for most whose id is not one of ids. A bitmap of hashed ids, of this many words at most, meets them where they are read; a null id is no hit."""
    word, bits = cluster.fresh_names("word", "bits")
    h = F.xxhash64(id_col)
    place, bit = F.pmod(h, F.lit(words)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int"))
    bitmap = ids.select(place.alias(word), bit.alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    met = rows.withColumn(word, place).join(F.broadcast(bitmap), word, "left")
    found = F.col(id_col).isNotNull() & F.coalesce(bit.bitwiseAND(F.col(bits)) != 0, F.lit(False))
    return met.withColumn(hit, found).drop(word, bits)


def _may_be(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows without most of those whose id is not one of ids."""
    return _hits(rows, ids, "id", "hit").where("hit").drop("hit")


def _dealt_out(spark: SparkSession, buckets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Buckets that additional bits leave over MOST_ROWS, cut at random into parts of about so many rows; and those of shared shingles whole.

    What agrees in so many bits is mostly one group of near copies. Its cuts differ by table and sample, and two
    independent cuts into large parts connect a group, so no task needs to hold all of it; what they leave apart
    meets in _across.
    """
    by = ["table", "key"]
    over = cluster.materialize(spark, buckets.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_ROWS), "large")
    if over.isEmpty():
        return buckets, None
    part = F.pmod(F.xxhash64("id", "table", "key"), F.ceil(F.col("n") / MOST_ROWS))
    salted = F.when(F.col("n").isNull(), F.col("key")).otherwise(F.xxhash64("key", part))
    return buckets.join(over, by, "left").select("table", salted.alias("key"), "id", "print"), buckets.where("table < 0").join(over, by).select("table", "key", "id", "print")


def _links(spark: SparkSession, rows: DataFrame, nodes: DataFrame, similarity: float, k: int) -> DataFrame:
    """Verified links between nodes that connect every class."""
    n = nodes.count()
    width = table_width(n)
    count = tables(width, similarity)
    most, cap = loose_distance(similarity), CAP
    own, fields = nodes.select(F.col("node").alias("id"), "print", "heads"), "table int, key long, id long, print binary"
    counted = own.mapInArrow(lambda b: cluster.handing_back(_keys(b, width, count)), "table int, key long").groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"))
    over = cluster.materialize(spark, counted.where(F.col("n") > cap), "over")
    if over.isEmpty():
        buckets, large = own.mapInArrow(lambda b: cluster.handing_back(_deal(b, width, count, None, False)), fields), None
    else:
        # The bitmap has some false hits; their buckets are known by the join and stay as they are.
        words = over.select("table", "key").mapInArrow(_bitmap, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        bitmap = np.zeros(SLOTS // 64, U64)
        bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(U64)
        marked = own.mapInArrow(lambda b: cluster.handing_back(_deal(b, width, count, bitmap, True)), fields).join(over, ["table", "key"], "left")
        marked = cluster.materialize(spark, marked, "crowded")
        fits = own.mapInArrow(lambda b: cluster.handing_back(_deal(b, width, count, bitmap, False)), fields).unionByName(marked.where("n is null").drop("n"))
        large = marked.where("n is not null")
        again = large.select("table", "key", "id", "print", "n").mapInArrow(lambda b: cluster.handing_back(_deal_again(b, width, cap)), "table int, key long, id long, print binary")
        dealt_again, whole = _dealt_out(spark, again)
        buckets = fits.unionByName(dealt_again)
        # Samples of shared-shingle buckets are as many as MISS asks for: only what is cut at random has to meet.
        large = large.where("table >= 0").drop("n")
        large = large if whole is None else large.unionByName(whole)
    parts = cluster.shuffle_partitions(spark)
    found = buckets.repartition(parts, "table", "key").sortWithinPartitions("table", "key").mapInArrow(lambda b: cluster.handing_back(_link(b, most)), "a long, b long, distance long, forest boolean")
    found = cluster.materialize(spark, found.groupBy("a", "b").agg(F.min("distance").alias("distance"), F.max("forest").alias("forest")), "found")

    def fetched(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
        ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
        if known is not None:
            ends = cluster.materialize(spark, ends.join(known.select("id"), "id", "left_anti"), "ends")
        # An inner join (ends are distinct): a semi-join would be pushed below the bitmap's, and all texts would move.
        return cluster.materialize(spark, _may_be(rows, ends).join(ends, "id").groupBy("id").agg(F.max("text").alias("text")), "texts")

    texts = fetched(found)

    def verified(links: DataFrame) -> DataFrame:
        left, right = texts.withColumnsRenamed({"id": "a", "text": "t1"}), texts.withColumnsRenamed({"id": "b", "text": "t2"})
        return links.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "t1", "t2").mapInArrow(lambda b: cluster.handing_back(_verify(b, k, similarity)), "a long, b long")

    either = found.select(F.col("a").alias("id"), "a", "b", "distance").unionByName(found.select(F.col("b").alias("id"), "a", "b", "distance"))
    closest = either.groupBy("id").agg(F.min(F.struct("distance", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
    closest = cluster.materialize(spark, closest, "closest")
    good = cluster.materialize(spark, verified(closest), "verified")
    label = components(spark, good)
    a, b = label.select(F.col("node").alias("a"), F.col("label").alias("la")), label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    rest = found.select("a", "b").join(closest, ["a", "b"], "left_anti").join(a, "a", "left").join(b, "b", "left").where(~F.coalesce("la", "a").eqNullSafe(F.coalesce("lb", "b")))
    good = cluster.materialize(spark, good.unionByName(verified(rest)), "links")
    forests = found.where("forest").select("a", "b")
    if large is not None:
        more = _across(spark, large, components(spark, good), most)
        texts, forests = texts.unionByName(fetched(more, texts)), forests.unionByName(more)
    return good.unionByName(_displaced(spark, texts, forests, good, similarity, k))


def _block_pairs(spark: SparkSession, rows: DataFrame, by: list[str], payload: list[str], similarity: float | None = None) -> DataFrame:
    """(pair, rows) for the pairs of blocks, and blocks with themselves, that have all pairs of rows of a group whose classes differ.

    rows: by, class, id and the payload. A class that fills blocks has them for itself: they are not compared
    with one another. Given a similarity, the payload has the sizes of sets, which bound it. Blocks are rows, so
    few rows move however large a group is.
    """
    sized = similarity is not None
    size = F.col("size") if sized else F.lit(0)
    each = rows.groupBy(*by, "class").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("shingles"))
    each = each.withColumn("own", F.when((F.col("n") > BLOCK_TEXTS // 8) | (F.col("shingles") > BLOCK_SHINGLES // 8), F.col("class")).otherwise(F.lit(_LAST)))
    parts = each.groupBy(*by, "own").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"))
    parts = parts.select(*by, "own", F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("parts"))
    placed = rows.join(each.select(*by, "class", "own").join(parts, [*by, "own"]), [*by, "class"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    bounds = (F.min(size).alias("least"), F.max(size).alias("most"))
    blocks = placed.groupBy(*by, "own", "part").agg(F.collect_list(F.struct("id", "class", *payload)).alias("rows"), *bounds)
    blocks = cluster.materialize(spark, blocks.withColumn("block", F.concat_ws(" ", *by, "own", "part")), "blocks")
    one = blocks.select(*by, "own", "block", "least", "most")
    other = one.withColumnsRenamed({c: c + "2" for c in one.columns if c not in by})
    met = (F.col("block") <= F.col("block2")) & ((F.col("own") != F.col("own2")) | (F.col("own") == _LAST))
    if sized:
        met = met & (F.col("most2") >= similarity * F.col("least") - 1e-9) & (F.col("most") >= similarity * F.col("least2") - 1e-9)
    pairs = one.join(other, by).where(met)
    sides = pairs.select(F.concat_ws("/", "block", "block2").alias("pair"), F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    return sides.join(blocks.select("block", "rows"), "block").select("pair", "rows")


def _named(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes as pairs of their classes, those within a class left out."""
    a, b = label.select(F.col("node").alias("a"), F.col("label").alias("la")), label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    la, lb = F.coalesce("la", "a"), F.coalesce("lb", "b")
    return pairs.join(a, "a", "left").join(b, "b", "left").where(la != lb).select(F.least(la, lb).alias("a"), F.greatest(la, lb).alias("b")).distinct()


def _across(spark: SparkSession, large: DataFrame, label: DataFrame, most: int) -> DataFrame:
    """Of buckets over the cap (table, key, id, print): links (a, b) that connect what pairs of close rows of different classes connect."""
    rows = large.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("class", F.coalesce("label", "id")).drop("label")
    mixed = rows.groupBy("table", "key").agg(F.min("class").alias("first"), F.max("class").alias("last")).where("first < last").select("table", "key")
    rows = cluster.materialize(spark, rows.join(mixed, ["table", "key"]), "mixed")
    met = _block_pairs(spark, rows, ["table", "key"], ["print", "table"])
    return cluster.materialize(spark, met.groupBy("pair").applyInArrow(lambda t: _near(t, most), "a long, b long").distinct(), "across")


def _displaced(spark: SparkSession, texts: DataFrame, forests: DataFrame, good: DataFrame, similarity: float, k: int) -> DataFrame:
    """Links that hold but that forests (a, b) have others for, which failed.

    A forest connects all rows of its bucket that close pairs connect. So what its failed links and those that
    hold connect, a clump, has both ends of every pair that was not proposed; a clump's texts are compared all
    with all, but for those of one class.
    """
    label = components(spark, good)
    apart = cluster.materialize(spark, _named(forests, label), "apart")
    if apart.isEmpty():
        return good.limit(0)
    clumps = components(spark, apart).select(F.col("node").alias("class"), F.col("label").alias("clump"))
    held = texts.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("class", F.coalesce("label", "id")).join(clumps, "class")
    sets = held.select("clump", "class", "id", "text").mapInArrow(lambda batches: cluster.handing_back(_sets(batches, k)), "clump long, class long, id long, size long, shingles binary")
    sets = cluster.materialize(spark, sets, "sets")
    met = _block_pairs(spark, sets, ["clump"], ["size", "shingles"], similarity)
    return cluster.materialize(spark, met.groupBy("pair").applyInArrow(lambda t: _compare(t, similarity), "a long, b long"), "displaced")


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each near-duplicate class, that of the least id; all columns stay.

    Rows without id stay. Of rows with one id and one text, one stays.
    """
    own = cluster.fresh_names("id", "class", "times", "text", "hit")
    id_ = docs[id_col].cast("long")
    named = classes(spark, docs, id_col, text_col, similarity).where(F.col(id_col).isNotNull())
    fate = named.groupBy(F.col(id_col).alias(own[0])).agg(F.max("class_id").alias(own[1]), F.count(F.lit(1)).alias(own[2]))
    # Most ids are there once and in a class of their own: only those of the others, and few besides, have to meet it.
    fate = cluster.materialize(spark, fate.where((F.col(own[2]) > 1) | (F.col(own[1]) != F.col(own[0]))), "fate")
    told = _hits(docs.withColumn(own[0], id_), fate.select(own[0]), own[0], own[4])
    clear = told.where(~F.col(own[4])).select(docs.columns)
    met = told.where(F.col(own[4])).join(fate, own[0], "left")
    single = met.where(F.col(own[1]).isNull() | ((F.col(own[2]) == 1) & (F.col(own[1]) == F.col(own[0])))).select(docs.columns)
    again = met.where((F.col(own[2]) > 1) & (F.col(own[1]) == F.col(own[0]))).withColumn(own[3], F.xxhash64(F.col(text_col))).dropDuplicates([own[0], own[3]]).select(docs.columns)
    return clear.unionByName(single).unionByName(again)
