import math
import random
import re

import brute
import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality_model as qm
from tessera.llm import vectext as vt


def corpus(n, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        text = brute.prose(rng, rng.randrange(30, 120))
        if not good:
            text = rng.choice([lambda t: " ".join(w + rng.choice(["%%%", "$$$", "###"]) for w in t.split(" ")), lambda t: " | ".join(t.split(" ")), lambda t: " ".join(w.upper() + "!!" for w in t.split(" "))])(text)
        docs.append((i, text, "en", f"src{i % 5}", len(text) if i % 7 else None, "x"))
        labels.append((i, int(good), 0))
    return docs, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"
LABELS = "doc_id long, quality int, toxic int"


def scored(spark, df, marks):
    features = qm.featurize(spark, df)
    return qm.score(spark, features, qm.fit(spark, features, marks))


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus(600)
    odd = [(5000, None, None, None, None, None), (5001, "", "en", "src1", 0, None), (5002, " \n", "xx", "new", -4, None), (None, docs[1][1], "en", "src1", 9, None), (5003, "word " * 100_000, "en", "src1", None, None), docs[1]]
    df = spark.createDataFrame(docs + odd, SCHEMA).repartition(4)
    marks = spark.createDataFrame(labels[:300] + [(1, None, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0)], LABELS)
    rows = scored(spark, df, marks).collect()
    assert len(rows) == len(docs) + len(odd)
    by = {r.doc_id: r for r in rows}
    right = [by[i].kept == bool(q) for i, q, _ in labels[300:]]
    assert np.mean(right) > 0.97
    assert all(not by[i].kept and by[i].score == 0 for i in (5000, 5001, 5002))
    kept = qm.keep_good(spark, df, marks)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in rows if r.kept), key=repr)


def test_reruns_agree(spark):
    docs, labels = corpus(200, 3)
    df, marks = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels[:90], LABELS)
    a, b = (sorted(map(tuple, scored(spark, d, marks).collect())) for d in (df, df.repartition(5)))
    assert a == b


def test_nothing_to_learn_from(spark):
    docs, labels = corpus(40)
    df = spark.createDataFrame(docs, SCHEMA)
    for marks in ([], labels[:5], [(i, 1, 0) for i in range(40)]):
        features = qm.featurize(spark, df)
        model = qm.fit(spark, features, spark.createDataFrame(marks, LABELS))
        assert model.text is None and qm.score(spark, features, model).count() == 40
    empty = df.limit(0)
    assert scored(spark, empty, spark.createDataFrame([], LABELS)).count() == 0


def test_without_metadata_columns(spark):
    docs, labels = corpus(120)
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    assert qm.keep_good(spark, df, spark.createDataFrame(labels, LABELS)).columns == ["doc_id", "text"]


def test_views_teach_each_other():
    """One view alone separates; the pool gives the other labels that it lacks."""
    rng = np.random.default_rng(0)
    y = np.arange(400) % 2
    strong, weak = (y[:, None] * 4 + rng.normal(size=(400, 3))), rng.normal(size=(400, 2))
    pool_y = np.arange(2000) % 2
    pool = qm.Held(np.arange(2000), pool_y[:, None] * 4 + rng.normal(size=(2000, 3)), rng.normal(size=(2000, 2)))
    model = qm.co_train(strong, weak, y.astype(float), pool)
    _, _, both = model.score(strong, weak)
    assert ((both > 0.5) == y).mean() > 0.97


def test_a_document_with_an_id_of_many_rows(spark):
    """Rows of one labelled id come to the driver once, however many there are."""
    docs, labels = corpus(120)
    df = spark.createDataFrame(docs + [docs[4]] * 3000, SCHEMA)
    marks = spark.createDataFrame(labels, LABELS)
    assert len(qm._collected(qm.featurize(spark, df).join(marks.select(F.col("doc_id").alias("id")), "id"))[0]) == 120
    assert scored(spark, df, marks).count() == 3120


# The whole operator again, by plain loops


def slot(value, n):
    raw = np.frombuffer(value, np.uint8)
    return int(vt.range_hashes(raw, np.array([0]), np.array([len(raw)]))[0]) % n


def plain_features(text, lang, source, n_chars):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    some, size, lines = max(1, len(words)), max(1, len(data)), data.count(b"\n") + 1
    kinds = [rb"[A-Z]", rb"[a-z]", rb"[0-9]", rb"[#*$%&<>|=_{}\[\]\\/^~@]", rb"[!?]", rb"[.,;:]", rb"[\x80-\xff]"]
    counts = [len(re.findall(k, data)) for k in kinds]
    t = [c / size for c in counts] if words else [0.0] * 7
    t += [min(counts[3] / some, 4), min(counts[4] / some, 4)] if words else [0.0, 0.0]
    t.append(min(sum(map(len, words)) / some, 40) / 10)
    for k in (1, 2, 3):
        grams = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
        t.append(len(grams) / max(1, len(words) - k + 1))
    t.append(math.log1p(len(words)))
    spread = [0.0] * qm.WORD_SLOTS
    for w in words:
        spread[slot(w, qm.WORD_SLOTS)] += 1 / some
    known = -1 if n_chars is None else max(0, n_chars)
    m = [math.log1p(lines), math.log1p(size / lines), math.log1p(max(known, 0)), float(known < 0), min(len(data) / known, 4) if known > 0 else 1.0]
    for value, n in ((source, qm.SOURCE_SLOTS), (lang, qm.LANG_SLOTS)):
        own = [0.0] * n
        own[0 if value is None else 1 + slot(value.encode(), n - 1)] = 1.0
        m += own
    return t + spread, m, len(words)


def plain_logistic(rows, labels, weights, ridge):
    """Newton's steps on the penalised likelihood, summed row by row."""
    k = len(rows[0]) + 1
    beta, pull = np.zeros(k), np.array([1e-3] + [ridge] * (k - 1))
    for _ in range(12):
        gradient, curve = -pull * beta, np.diag(pull)
        for x, y, w in zip(rows, labels, weights):
            z = np.concatenate(([1.0], x))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(z @ beta)))))
            gradient, curve = gradient + z * w * (y - p), curve + np.outer(z, z) * w * max(p * (1 - p), 1e-4)
        step = np.linalg.solve(curve, gradient)
        beta = beta + step
        if abs(step).max() < 1e-5:
            break
    return beta


def plain_view(rows, labels, weights, held_rows, held_labels):
    x = np.array(rows, np.float32)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = lambda r: np.clip((np.array(r, np.float32) - mean) / scale, -8, 8)
    beta = plain_logistic([z(r) for r in rows], labels, weights, 2.0)
    raw = lambda r: float(z(r).astype(np.float64) @ beta[1:] + beta[0])
    offset, slope = plain_logistic([[raw(r)] for r in held_rows], held_labels, [1.0] * len(held_rows), 1e-2)
    return lambda r: max(-12.0, min(12.0, max(float(slope), 0.0) * raw(r) + float(offset)))


def test_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(qm, "ROUNDS", 2)
    monkeypatch.setattr(qm, "MOST_EXCHANGED", 8)
    docs, labels = corpus(150, 4)
    docs += [(900, None, None, None, None, None), (901, "", "fr", "src1", 3, None)]
    marks = {i: float(q) for i, q, _ in labels[:70]}
    own = {d[0]: plain_features(*d[1:5]) for d in docs}
    tie = lambda i: int(vt.mix(np.array([i], np.int64).view(np.uint64))[0])
    order = sorted(marks, key=lambda i: (tie(i), i))
    held = {i for label in (0.0, 1.0) for i in [i for i in order if marks[i] == label][::4]}
    good = (sum(marks.values()) + 1) / (len(marks) + 2)
    extra = [{}, {}]
    free = [i for i in own if i not in marks]
    share = min(qm.SHARE * len(free), 8)
    for r in range(3):
        views = []
        for v in (0, 1):
            fit = [i for i in order if i not in held]
            rows = [own[i][v] for i in fit] + [own[i][v] for i in sorted(extra[v])]
            views.append(plain_view(rows, [marks[i] for i in fit] + [extra[v][i] for i in sorted(extra[v])], [1.0] * len(fit) + [0.5] * len(extra[v]), [own[i][v] for i in order if i in held], [marks[i] for i in order if i in held]))
        if r == 2:
            break
        for v in (0, 1):
            for label, part in ((1.0, good), (0.0, 1 - good)):
                sure = {i: (p if label else 1 - p) for i in free for p in [1 / (1 + math.exp(-views[v](own[i][v])))]}
                best = sorted((i for i in free if sure[i] >= qm.SURE), key=lambda i: (-sure[i], tie(i), i))[: max(1, int(share * part)) * (r + 1)]
                for i in best:
                    extra[1 - v].setdefault(i, label)
    prior = math.log(good / (1 - good))
    assert extra[0] and extra[1]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    model_rounds = qm.co_train
    monkeypatch.setattr(qm, "co_train", lambda *a: model_rounds(*a, rounds=2))
    for row in scored(spark, df, spark.createDataFrame(labels[:70], LABELS)).collect():
        a, b = (views[v](own[row.doc_id][v]) for v in (0, 1))
        want = [1 / (1 + math.exp(-x)) for x in (a, b, a + b - prior)]
        assert abs(row.p_text - want[0]) < 1e-3 and abs(row.p_meta - want[1]) < 1e-3
        assert abs(row.score - (want[2] if own[row.doc_id][2] else 0.0)) < 2e-3
