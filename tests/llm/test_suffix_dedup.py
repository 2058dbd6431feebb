import hashlib
import random
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import suffix_dedup


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=repr)


def fixture():
    rng = random.Random(8)
    base = brute.prose(rng, 120)
    docs = [(i, brute.prose(rng, rng.randrange(0, 90))) for i in range(40)]
    docs += [(100 + i, base) for i in range(15)]  # a group of copies
    docs += [(200 + i, base[: rng.randrange(60, 300)] + brute.prose(rng, 12) + base[rng.randrange(50, 200) :]) for i in range(15)]
    docs += [(300, None), (301, ""), (302, "é" * 80), (303, "é" * 60 + "x"), (304, "a" * 49), (305, "a" * 49), (306, "ab" * 400), (307, "b" + "ab" * 90), (308, base + base)]
    docs += [(100, base), (None, base), (None, "unlike the others " * 5), (400, "tail of it"), (401, "tail of it")]
    return docs


def test_against_brute_force(spark):
    docs = fixture()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, kind string, place int").repartition(4)
    assert rows_of(suffix_dedup.remove_repeats(spark, df)) == sorted(brute.repeats(docs), key=repr)


@pytest.mark.parametrize("depth", [3, 10, 51])
def test_other_depths(spark, depth):
    rng = random.Random(depth)
    docs = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(suffix_dedup.remove_repeats(spark, df, depth=depth)) == sorted(brute.repeats(docs, depth), key=repr)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    rng = random.Random(2)
    long = brute.prose(rng, 9000)
    docs = [(1, long), (2, long[5000:30000]), (3, "start " + long), (4, long[100:400])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(brute.repeats(docs), key=repr)
    assert rows_of(suffix_dedup.remove_repeats(spark, df)) == want
    whole = spark.createDataFrame([(1, "q" + "z" * 600_000), (2, "z" * 600_000)], "doc_id long, text string")
    assert [(r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(spark, whole).orderBy("doc_id").collect()] == [(0, 0), (600_000, 1)]


def test_common_phrases_are_spread(spark, monkeypatch):
    """Anchors with many contexts in some batches and few in others."""
    rng = random.Random(5)
    phrase = "an often repeated phrase of some length, "
    docs = [(i, brute.prose(rng, 5) + phrase + brute.prose(rng, rng.randrange(3, 9)) + (phrase + "tail") * (i % 3)) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    for most in (0, 2, 1000):
        monkeypatch.setattr(suffix_dedup, "MOST_RUNS", most)
        assert rows_of(suffix_dedup.remove_repeats(spark, df)) == sorted(brute.repeats(docs), key=repr)


def test_spans_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x" + "abc" * 30), (2, "y" + "abc" * 30)], "doc_id long, text string")
    two = suffix_dedup.remove_repeats(spark, df).where("doc_id = 2").first()
    assert [tuple(s) for s in two.spans] == [(1, 91)] and bytes(two.kept) == b"y"
    assert suffix_dedup.remove_repeats(spark, df.limit(0)).count() == 0


def in_one_process(docs, depth=50, anchor=20, n=3, batch=7):
    """The operator's stages without Spark: spans by id."""
    sd = suffix_dedup
    batches = [pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs[i : i + batch]], pa.int64()), pa.array([d[1] for d in docs[i : i + batch]])], ["id", "text"]) for i in range(0, len(docs), batch)]

    def dealt(parts, by=("kind", "place")):
        held = defaultdict(list)
        for part in parts:
            for row in part.to_pylist():
                held[tuple(row[c] for c in by)].append(row)
        return {k: sd._batch([(r["kind"], r["place"], r["block"]) for r in rows]) for k, rows in held.items()}

    def grouped(parts, f):
        return [f(tuple(map(pa.scalar, k)), pa.Table.from_batches([t])) for k, t in dealt(parts).items()]

    homes = dealt(list(sd._pack_texts(batches, n)), ("place",))
    none = pa.Table.from_batches([sd._batch([])])

    def at_home(parts, f):
        told = dealt(parts, ("place",))
        table = lambda x: none if x is None else pa.Table.from_batches([x])
        return [f(table(homes.get(k)), table(told.get(k))) for k in sorted({*homes, *told})]

    of = lambda parts, *kinds: [p.filter(pa.compute.is_in(p.column("kind"), pa.array(kinds, pa.int32()))) for p in parts]
    told = grouped(sd._scan(batches, n, depth, anchor, 16), lambda k, t: sd._order_runs(k, t, n))
    opened = at_home(of(told, sd._OPEN), lambda a, b: sd._open_windows(a, b, n, depth, anchor))
    windows = grouped(opened, lambda k, t: sd._order_windows(k, t, n))
    out = at_home(told + windows, lambda a, b: sd._remove(a, b, depth, anchor))
    return {r["id"]: [(s["start"], s["end"]) for s in r["spans"]] for t in out for r in t.to_pylist()}


def gone(docs, depth=50):
    """By brute force, the bytes that go, by id."""
    first, out = {}, {}
    for i, t in docs:
        b = t.encode()
        for p in range(len(b) - depth + 1):
            first.setdefault(b[p : p + depth], i)
    for i, t in docs:
        b = t.encode()
        out[i] = {q for p in range(len(b) - depth + 1) if first[b[p : p + depth]] < i for q in range(p, p + depth)}
    return out


@pytest.mark.parametrize("bits", [64, 6, 2])
def test_equal_fingerprints_of_unlike_bytes_remove_nothing(monkeypatch, bits):
    """One fingerprint of few bits: the other one confirms, so all that goes is repeated, byte for byte; with whole ones, all that is repeated goes."""
    rng = random.Random(9)
    base = brute.prose(rng, 60)
    docs = [(i, brute.prose(rng, rng.randrange(20, 60))) for i in range(15)] + [(20 + i, base) for i in range(4)] + [(30 + i, brute.prose(rng, 9) + base[40 : 120 + 9 * i] + brute.prose(rng, 9)) for i in range(6)]
    key, windows, cut = suffix_dedup.run_key, suffix_dedup.Chunk.window_hashes, np.uint64((1 << bits) - 1)
    monkeypatch.setattr(suffix_dedup, "run_key", lambda h, c: key(h, c) & cut)
    monkeypatch.setattr(suffix_dedup.Chunk, "window_hashes", lambda self, at: windows(self, at) & cut)
    want = gone(docs)
    got = {i: {q for a, b in spans for q in range(a, b)} for i, spans in in_one_process(docs).items()}
    assert all(got[i] <= want[i] for i, _ in docs)
    if bits == 64:
        assert got == want and sum(map(len, want.values())) > 1000


@pytest.mark.parametrize("most", [1 << 14, 5, 0])
def test_open_runs_come_whole_and_move_little(monkeypatch, most):
    """Runs of one anchor and different contexts: whole, window by window, or both; whole they move a fraction of it."""
    sd, rng, moved = suffix_dedup, random.Random(11), []
    phrases = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(48)) for _ in range(40)]
    docs = [(i, " ".join(brute.prose(rng, 6) + rng.choice(phrases) + rng.choice("xyz") for _ in range(8)) + "q" * rng.randrange(120)) for i in range(60)]
    monkeypatch.setattr(sd, "MOST_SHOWN", most, raising=False)
    opened = sd._open_windows
    monkeypatch.setattr(sd, "_open_windows", lambda *a: moved.append(opened(*a)) or moved[-1])
    want = gone(docs)
    assert {i: {q for a, b in spans for q in range(a, b)} for i, spans in in_one_process(docs, n=2, batch=2).items()} == want and sum(map(len, want.values())) > 1000
    size = sum(len(b) for t in moved for b in t.column("block").to_pylist())
    assert most < 100 or size < sum(len(t.encode()) for _, t in docs)


def test_blocks_are_packed_together(monkeypatch):
    """A block for each place, as packed one by one, but without a call for each: there are as many as places squared."""
    sd, rng = suffix_dedup, np.random.default_rng(4)
    calls = []
    pack = sd._pack
    for top in (1 << 7, 1 << 14, 1 << 30, 1 << 62):
        ids = np.concatenate([rng.integers(-top, top, 300), [sd._LAST, 5, 5]])
        place, x, y = rng.integers(0, 40, 303), rng.integers(0, 1 << 56, 303).astype(np.uint64), rng.integers(0, 1 << 32, 303).astype(np.uint64)
        monkeypatch.setattr(sd, "_pack", lambda *a: calls.append(0) or pack(*a))
        got = list(sd._deal(3, place, ids, [(x, 7), (y, 4)]))
        want = []
        for p in np.unique(place).tolist():
            own = np.flatnonzero(place == p)
            own = own[np.argsort(ids[own], kind="stable")]
            want.append((3, p, pack(ids[own], [(x[own], 7), (y[own], 4)])))
        assert got == want
    assert not calls


def test_same_bytes():
    data = np.frombuffer(b"abcabdabcabc", np.uint8)
    a, b, size = (np.array(x) for x in ([0, 0, 0, 3, 6], [3, 6, 3, 9, 9], [3, 6, 2, 0, 3]))
    assert suffix_dedup.same_bytes(data, a, b, size).tolist() == [False, False, True, True, True]
