import random

import brute
import numpy as np
import pytest

from tessera.llm import simhash
from tessera.llm import vectext as vt


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = "".join(rng.choice("xyz") for _ in range(6))
    return " ".join(words)


def fixture():
    rng = random.Random(12)
    docs, i = {}, 0
    for _ in range(60):
        docs[i] = brute.prose(rng, rng.randrange(1, 150))
        i += 1
    for g in range(12):
        base = brute.prose(rng, rng.randrange(150, 400))
        for _ in range(rng.randrange(2, 9)):
            docs[i] = edited(rng, base, rng.randrange(0, 3))
            i += 1
    for t in (None, "", " \n", "one two", "one two", "one  two\n", "a b c d e", "a b c d e", "word " * 30, "word " * 50):
        docs[i] = t
        i += 1
    return docs


def test_against_all_pairs(spark):
    docs = fixture()
    df = spark.createDataFrame([(i, t, 1) for i, t in docs.items()], "doc_id long, text string, class_id int").repartition(5)
    got = {r.doc_id: r.class_id for r in simhash.classes(spark, df).collect()}
    assert got == brute.similar_classes(docs)
    kept = simhash.keep_one(spark, df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in got.items() if i == c)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CAP", 40)
    monkeypatch.setattr(simhash, "MOST_ROWS", 60)
    rng = random.Random(1)
    base = brute.prose(rng, 300)
    docs = [(i, edited(rng, base, 2)) for i in range(250)] + [(1000 + i, brute.prose(rng, 80)) for i in range(50)]
    got = {r.doc_id: r.class_id for r in simhash.classes(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(250)} == {0} and all(got[i] == i for i in range(1000, 1050))


def hub_and_copies(rng, n):
    """A base and copies, each over 0.8 to the base but under 0.8 to one another."""
    base = [f"w{i}" for i in range(304)]
    docs = {0: " ".join(base)}
    for i in range(1, n):
        words = list(base)
        for p in rng.sample(range(5, 300, 6), 6):
            words[p] = f"x{i}y{p}"
        docs[i] = " ".join(words)
    return docs


def test_a_base_that_failed_links_displaced(spark, monkeypatch):
    docs = hub_and_copies(random.Random(5), 160)
    want = brute.similar_classes(docs)
    assert set(want.values()) == {0}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    without = brute.similar_classes({i: t for i, t in docs.items() if i})
    assert len(set(without.values())) > 100  # nothing but the base connects them
    assert {r.doc_id: r.class_id for r in simhash.classes(spark, df).collect()} == want
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 32)
    monkeypatch.setattr(simhash, "CAP", 40)
    monkeypatch.setattr(simhash, "MOST_ROWS", 60)
    assert {r.doc_id: r.class_id for r in simhash.classes(spark, df).collect()} == want


def test_a_template_family_below_the_threshold(spark):
    rng = random.Random(6)
    docs = {}
    base = brute.prose(rng, 240)
    for i in range(90):
        docs[i] = base + " " + " ".join(f"own{i}x{j}" for j in range(50))
    docs[90] = docs[17].replace("own17x40", "other")
    want = brute.similar_classes(docs)
    assert len(set(want.values())) == 90 and want[90] == 17
    assert {r.doc_id: r.class_id for r in simhash.classes(spark, spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()} == want


def templated(rng, n, pairs, own, changed, words=240):
    """Pages of one template, each with words of its own; the last ones are edits of the first."""
    base = brute.prose(rng, words).split()
    docs = {}
    for i in range(n):
        docs[i] = base + [f"own{i}x{j}" for j in range(own)]
    for p in range(pairs):
        docs[n + p] = docs[p][: len(docs[p]) - changed] + [f"new{p}x{j}" for j in range(changed)]
    return {i: " ".join(w) for i, w in docs.items()}


@pytest.mark.parametrize("cap", [1024, 100])
def test_templated_pairs_just_above_the_threshold(spark, monkeypatch, cap):
    """Pairs at about 0.81 among pages that share a template at about 0.75: none is lost, in buckets below the cap or above it."""
    monkeypatch.setattr(simhash, "CAP", cap)
    monkeypatch.setattr(simhash, "MOST_ROWS", 4 * cap)
    docs = templated(random.Random(8), 240, 60, 40, 30)
    sets = {i: brute.shingles(t) for i, t in docs.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.8 <= min(alike(p, 240 + p) for p in range(60)) < 0.83 and 0.7 < alike(100, 101) < 0.77
    want = brute.similar_classes(docs)
    got = {r.doc_id: r.class_id for r in simhash.classes(spark, spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == want and sum(want[240 + p] == p for p in range(60)) == 60


def test_names_of_the_callers_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7, 8), (2, "a b c d e f", 9, 10), (2, "a b c d e f", 9, 10), (None, None, 1, 2)], "doc_id long, text string, _kept int, _row int")
    out = simhash.keep_one(spark, df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "a b c d e f", 7, 8), (None, None, 1, 2)], key=repr)
    assert simhash.keep_one(spark, df.limit(0)).count() == 0


def test_distances():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, (n, 4)).astype(np.uint64) for n in (7, 5))
    assert simhash.distances(a, b).tolist() == [[sum(int(x).bit_count() for x in r ^ t) for t in b] for r in a]


def test_tables_follow_the_width():
    p = simhash.expected_distance(0.8) / simhash.BITS
    for n in (100, 10_000, 250_000, 1_000_000, 15_000_000):
        width = simhash.table_width(n)
        assert (1 - (1 - p) ** width) ** simhash.tables(width) <= 0.001


def test_short_texts(spark):
    docs = {}
    for i in range(300):
        docs[2 * i] = " ".join(f"w{i}x{j}" for j in range(8))
        docs[2 * i + 1] = docs[2 * i] + " more"
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in simhash.classes(spark, df).collect()} == {i: i - i % 2 for i in docs}


def test_common_shingles_and_spanning_links():
    rng = np.random.default_rng(3)
    both = [[np.unique(rng.choice(300, rng.integers(1, 90))).astype(np.uint64) for _ in range(n)] for n in (40, 25)]
    packed = [(np.concatenate(x), np.concatenate(([0], np.cumsum([len(s) for s in x])))) for x in both]
    assert simhash.common_shingles(*packed).tolist() == [[len(np.intersect1d(a, b)) for b in both[1]] for a in both[0]]
    m = np.zeros((9, 9), bool)
    for i, j in ((0, 3), (3, 5), (0, 5), (2, 8), (8, 7), (2, 7)):
        m[i, j] = m[j, i] = True
    links = simhash.spanning_links(m)
    assert len(links) == 4 and all(m[i, j] for i, j in links)


def test_rows_without_id_repeated_rows_and_none(spark):
    text = "some words that are there twice or more"
    df = spark.createDataFrame([(None, text), (None, text), (3, text), (3, text), (5, text)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.class_id) for r in simhash.classes(spark, df).collect()), key=repr) == sorted([(None, None)] * 2 + [(3, 3)] * 2 + [(5, 3)], key=repr)
    assert sorted((r.doc_id for r in simhash.keep_one(spark, df).collect()), key=repr) == sorted([None, None, 3], key=repr)
    assert simhash.classes(spark, df.limit(0)).count() == 0


def test_fingerprints_by_plain_votes():
    rng = np.random.default_rng(2)
    sizes = [1, 2, 300, 70_000, 5]
    sets = rng.integers(0, 1 << 44, sum(sizes)).astype(np.uint64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    got = np.unpackbits(simhash.fingerprints(sets, at), axis=1)
    for i in range(len(sizes)):
        part = sets[at[i] : at[i + 1]]
        words = np.stack([vt.mix(part * np.uint64(2 * k + 1) + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) for k in range(4)], axis=1)
        votes = np.unpackbits(words.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
        assert (got[i] == ((2 * votes > len(part)) | ((2 * votes == len(part)) & (np.arange(256) % 2 == 1)))).all()


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [tuple(sorted(rng.sample(range(200, 400), 2))) for _ in range(120)]
    label = {x: x for e in links for x in e}
    for _ in range(400):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in simhash.components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == label


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_few_links_need_few_jobs(spark, monkeypatch, most):
    """A path, whose components took many rounds of jobs: up to MOST_LINKS links one task tells them, more go by stars."""
    monkeypatch.setattr(simhash, "MOST_LINKS", most, raising=False)
    links = spark.createDataFrame([(i, i + 1) for i in range(80)] + [(100 + i % 7, 200 + i) for i in range(50)], "a long, b long")
    begun = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    out = simhash.components(spark, links)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - begun
    assert {r.node: r.label for r in out.collect()} == {i: 0 for i in range(81)} | {100 + i: 100 + i for i in range(7)} | {200 + i: 100 + i % 7 for i in range(50)}
    assert jobs <= 8 or not most
    assert simhash.components(spark, links.limit(0)).count() == 0


def test_shingle_sets():
    rng = random.Random(7)
    texts = [brute.prose(rng, rng.randrange(0, 40)) for _ in range(80)] + ["", "a", "a b c d", " x  y ", "same same same same same same same"]
    raw = [t.encode() for t in texts]
    at = np.concatenate(([0], np.cumsum([len(b) for b in raw])))
    sets, where = vt.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), at)
    assert np.diff(where).tolist() == [len(brute.shingles(t)) for t in texts]
    seen = {}
    for i, t in enumerate(texts):
        for h in sets[where[i] : where[i + 1]].tolist():
            seen.setdefault(h, set()).add(i)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            assert len(brute.shingles(a) & brute.shingles(b)) == sum(i in s and j in s for s in seen.values())
