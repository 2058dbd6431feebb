import random
import re

import brute

from tessera.llm import pii

ODD = [
    None, "", "no data here", "a.b@c.d and x_y%z+1@mail-1.example.com.au.", "a@b@c.de f@g", "a@b.c_d@e.f", "@a.b c@ d@.e", "mail a@b.co, b@c.de;c@d.es",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 99999999999.1.1.1 1..2.3.4 12.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 0000000000000000 41111111111111110000",
    "5500 0000 0000 0004 5500 0000 0000 0004", "+1 (729) 555-7725 +4 +12345678 +1234567 +1234567890123456 + 123 +1--2345678 +49.30.1234567.", "é😀 +33 1 23 45 67 89 日本 q@r.st", "1 " * 5000, "9" * 20000, "a" * 20000 + "@b.c", "." * 3000 + "1.1.1.1",
]


def texts():
    rng = random.Random(3)
    parts = ["a@b.c", "1.2.3.4", "+1 202 555 0143", "4111111111111111", "x", " ", ".", "@", "+", "-", "7", "55", "é", "😀", "\n", "(", ")"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(400)]


def test_base_spans_against_brute_force(spark):
    held = texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(held)], "doc_id long, text string, kind int")
    for r in pii.find(df).collect():
        want = brute.pii_spans(held[r.doc_id])
        assert [tuple(s) for s in r.pii_base] == want, held[r.doc_id]
        spans = [tuple(s) for s in r.pii_spans]
        assert set(want) <= set(spans) and spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        more = [s for s in spans if s not in want]
        assert not any(a[1] < b[2] and b[1] < a[2] for a in more for b in spans if a != b)


def test_expressions_equal_the_trees_in_numpy(spark):
    """Every proposal of the generators scores in Spark as the fitted trees do in Python."""
    import numpy as np

    samples = [(k, f"{b}{m}{a}") for k, rows in pii.labelled_samples(21, 60).items() for m, b, a, _ in rows]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(samples)], "doc_id long, text string")
    got = {r.doc_id: {tuple(s) for s in r.pii_spans} - {tuple(s) for s in r.pii_base} for r in pii.find(df).collect()}
    found = 0
    for i, (_, t) in enumerate(samples):
        proposals = {k: [] for k in pii.KINDS}
        for k, pattern, need in pii.GENERATORS:
            trees, threshold = pii.detector()[k]
            for m in re.finditer(pattern, t) if re.search(need, t) else ():
                x = np.array([pii.value_features(k, m[0], t[max(0, m.start() - pii.CONTEXT) : m.start()], t[m.end() : m.end() + pii.CONTEXT])])
                if sum(pii.RATE * pii._apply(tree, x)[0] for tree in trees) >= threshold:
                    proposals[k].append((k, m.start(), m.end()))
        taken = list(brute.pii_spans(t))
        for k in ("email", "card", "ip", "phone"):
            taken += [s for s in proposals[k] if not any(x[1] < s[2] and s[1] < x[2] for x in taken)]
        assert got[i] == set(taken) - set(brute.pii_spans(t)), t
        found += len(got[i])
    assert found > 60


def test_held_out_accuracy():
    """On samples of the calibration's make and of the fit's, of other seeds."""
    import numpy as np

    for make, precision, recall in ((pii.field_samples, 0.95, 0.6), (pii.labelled_samples, 0.95, 0.5)):
        for kind, rows in make(99, 500).items():
            trees, threshold = pii.detector()[kind]
            x, y = (np.array(a) for a in zip(*((pii.value_features(kind, m, b[-pii.CONTEXT :], a[: pii.CONTEXT]), t) for m, b, a, t in rows)))
            said = sum(pii.RATE * pii._apply(t, x) for t in trees) >= threshold
            assert (y[said] == 1).mean() > precision and said[y == 1].mean() > recall, (make.__name__, kind, (y[said] == 1).mean(), said[y == 1].mean())


def test_many_matches_in_one_text(spark):
    """Work that grows as n log n: 8,000 matches of either sort in one row take seconds."""
    import time

    text = " ".join(f"call +1 202 555 {i:04d} or phone 202-555-{i:04d} é" for i in range(8000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.find(df.limit(0)).collect()
    start = time.time()
    row = pii.find(df).first()
    assert time.time() - start < 30
    assert [tuple(s) for s in row.pii_base] == brute.pii_spans(text) and len(row.pii_spans) == 16000
    redacted = pii.redact(df).first().text
    assert redacted == " ".join(["call [PHONE] or phone [PHONE] é"] * 8000)


def test_names_of_the_callers_columns(spark):
    df = spark.createDataFrame([(1, "a@b.co", 7, "x", "y")], "doc_id long, text string, pii_base int, PII_SPANS string, _pii_text string")
    found = pii.find(df)
    assert found.columns == [*df.columns, *pii.names(df)] and pii.names(df) == ("pii_base_", "pii_spans_")
    row = found.first()
    assert (row.pii_base, row.PII_SPANS, row._pii_text) == (7, "x", "y") and [tuple(s) for s in row.pii_base_] == [("email", 0, 6)]
    assert [tuple(r) for r in pii.redact(df).collect()] == [(1, "[EMAIL]", 7, "x", "y")]


def test_spans_that_meet(spark):
    df = spark.createDataFrame([(1, [(5, 9), (20, 30)], [(0, 5), (4, 6), (9, 12), (29, 31), (10, 40), (30, 35)])], "i int, t array<struct<start:int,end:int>>, s array<struct<start:int,end:int>>")
    from pyspark.sql import functions as F

    tagged = lambda c: F.transform(c, lambda x: F.struct(F.lit("ip").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    assert [(r.start, r.end) for r in df.select(pii._clear(tagged("s"), tagged("t")).alias("c")).first().c] == [(0, 5), (9, 12), (30, 35)]


def test_running_results(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 16, 17, 100, 1000):
        values = [(7 * i) % 13 for i in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        row = df.select(pii.running(F.col("v"), lambda a, b: a + b).alias("s"), pii.running(F.col("v"), F.greatest).alias("m")).first()
        assert row.s == [sum(values[: i + 1]) for i in range(n)] and row.m == [max(values[: i + 1]) for i in range(n)]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.co tel +1 (729) 555-7725, 1.2.3.4!"), (2, None), (3, "clean")], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert rows[1] == "é [EMAIL] tel [PHONE], [IP]!" and rows[2] is None and rows[3] == "clean"
    assert pii.redact(df).columns == df.columns


def test_native_plan_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = pii.find(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert pii.find(df.limit(0)).count() == 0
