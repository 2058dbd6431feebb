import random
from collections import defaultdict

import brute
import numpy as np
import pytest

from tessera.llm import mixing


def test_points_below():
    bits = 12
    points = [int(format(n, f"0{bits}b")[::-1], 2) for n in range(1 << bits)]
    rng = random.Random(1)
    n, t = np.array([rng.randrange(1 << bits) for _ in range(300)]), np.array([rng.randrange(0, (1 << bits) + 1) for _ in range(300)])
    assert mixing.points_below(n, t, bits).tolist() == [sum(p < b for p in points[:a]) for a, b in zip(n.tolist(), t.tolist())]


def documents(rng, counts):
    docs, i = [], 0
    for source, (n, words) in counts.items():
        for _ in range(n):
            docs.append((i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, words)))))
            docs[-1] += (source,)
            i += 1
    return docs


@pytest.mark.parametrize("counts", [{"a": (60, 80), "b": (10, 400), "é": (1, 9), None: (30, 60), "z": (5, 5)}, {"only": (20, 50)}, {None: (3, 40), "b": (300, 30)}])
def test_targets_and_takings(spark, counts):
    docs = documents(random.Random(6), counts) + [(9000, None, "a"), (9001, "", "b"), (None, "one two", "b"), (None, "one two", "b")]
    df = spark.createDataFrame([(i, t, s, 3) for i, t, s in docs], "doc_id long, text string, source string, size int")
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(brute.WORDS.findall(t or ""))
    want = brute.targets(sizes)
    rows = mixing.taken(spark, df).collect()
    assert len(rows) == len(docs)
    source_of = {i: s for i, _, s in docs}
    got = defaultdict(int)
    for r in rows:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        got[s] += r.taken
    for s in sizes:
        assert got[s] == pytest.approx(want[s], rel=0.03, abs=3)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.taken(spark, df.repartition(3)).collect()), key=repr)


def test_segments_are_blocks_of_the_schedule(spark):
    docs = documents(random.Random(4), {"a": (50, 60), "b": (50, 90)})
    sized, segments = mixing.mix(spark, spark.createDataFrame(docs, "doc_id long, text string, source string"))
    size = {(r.key, r.row): r.size for r in sized.collect()}
    rows = segments.collect()
    assert all(0 <= r.first_word and r.n_words > 0 and r.first_word + r.n_words <= size[r.key, r.row] for r in rows)
    order = [r.key for r in sorted(rows, key=lambda r: r.slot)]
    share = order.count("sa") / len(order)
    for upto in (len(order) // 4, len(order) // 2):  # every beginning has about the mix's shares
        assert order[:upto].count("sa") / upto == pytest.approx(share, abs=0.08)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken(spark, empty).count() == 0
    assert mixing.repeat_documents(spark, empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.taken(spark, blank).collect()] == [(0, 0.0, 0)] * 2


def test_names_of_the_callers_columns(spark):
    df = spark.createDataFrame([(i, "a b c d", "s", i, 1, 2, 3) for i in range(5)] + [(None, "e f", None, 9, 1, 2, 3)], "doc_id long, text string, source string, _id long, _copies int, _copy int, key int")
    out = mixing.repeat_documents(spark, df)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in df.collect()} and out.count() > 0


def test_sources_in_ranges(spark, monkeypatch):
    """More ranges than one give the same targets and takings."""
    docs = documents(random.Random(9), {f"s{i:03d}": (3, 30) for i in range(60)} | {None: (4, 20)})
    df = spark.createDataFrame([(i, t, s) for i, t, s in docs], "doc_id long, text string, source string")
    whole = sorted(map(tuple, mixing.taken(spark, df).collect()), key=repr)
    monkeypatch.setattr(mixing, "ROWS_A_RANGE", 7)
    assert sorted(map(tuple, mixing.taken(spark, df).collect()), key=repr) == whole
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(brute.WORDS.findall(t or ""))
    want, source = brute.targets(sizes), {i: s for i, _, s in docs}
    assert all(t == pytest.approx(want[source[i]]) for i, _, _, t, _ in whole)


def test_an_id_of_very_many_rows(spark):
    """Rows that are alike are one until the end; together they take what their words are due."""
    docs = documents(random.Random(3), {"a": (40, 50), "b": (30, 80)})
    df = spark.createDataFrame(docs + [(7, "w x y z", "a")] * 9000, "doc_id long, text string, source string")
    rows = mixing.taken(spark, df).collect()
    assert len(rows) == len(docs) + 9000 and all(r.taken <= 3 * r.size for r in rows)
    sizes, got = defaultdict(int), defaultdict(int)
    source = {i: s for i, _, s in docs}
    for i, t, s in docs + [(7, "w x y z", "a")] * 9000:
        sizes[s] += len(brute.WORDS.findall(t))
    for r in rows:
        got[source[r.doc_id]] += r.taken
    want = brute.targets(sizes)
    assert all(got[s] == pytest.approx(want[s], rel=0.03, abs=5) for s in sizes)
