"""The whole pipeline on a small corpus, each stage against a plain reading of it on its own input."""

import hashlib
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tessera.llm import bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(31)
    docs, labels = [], []
    for i in range(260):
        text = brute.prose(rng, rng.randrange(70, 160))
        if i % 4 == 0:
            text = " ".join(w + rng.choice(["%%%", "$$$", "###"]) for w in text.split(" "))
        elif i % 9 == 1:
            text += f" write to user{i}@mail.example.org or +1 (202) 555-{1000 + i}"
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(i % 4 != 0), 0))
    for i in range(30):  # copies and near copies of clean ones
        k = 4 * i + 2
        words = docs[k][1].split(" ")
        if i % 2:
            words[len(words) // 2] = "changed"
        docs.append((1000 + i, " ".join(words), "en", "src2", None))
    docs += [(2000, None, None, None, None), (2001, "", "en", "src0", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels[:160], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir, tmp_path):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frames = [given]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], sf_dir).write.parquet(f"{tmp_path}/{k}")
        frames.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(f.columns == given.columns for f in frames[1:-1])
    start, good, single, redacted, mixed = ({r.doc_id: r for r in f.collect()} for f in frames[:5])

    clean = {i for i in start if i < 2000 and not (i < 1000 and i % 4 == 0)}
    assert len(set(good) & clean) / len(clean) > 0.97 and len(set(good) - clean) <= 2

    want = brute.similar_classes({i: r.text for i, r in good.items()})
    assert set(single) == {i for i, c in want.items() if i == c} and len(single) < len(good)

    assert set(redacted) == set(single)
    for i, r in single.items():
        out, at = "", 0
        for kind, a, b in sorted(brute.pii_spans(r.text), key=lambda s: s[1]):
            out += r.text[at:a] + f"[{kind.upper()}]"
            at = b
        assert redacted[i].text == out + r.text[at:]
        assert redacted[i].n_chars == (None if r.n_chars is None else len(redacted[i].text))
    assert any("[EMAIL]" in r.text and "[PHONE]" in r.text for r in redacted.values())

    copies = Counter(r.doc_id for r in frames[4].collect())
    size = {i: len(brute.WORDS.findall(r.text)) for i, r in redacted.items()}
    per = defaultdict(int)
    for i, r in redacted.items():
        per[r.source] += size[i]
    goal, got = brute.targets(per), defaultdict(int)
    for i, n in copies.items():
        assert n <= 3
        got[redacted[i].source] += n * size[i]
    assert all(got[s] == pytest.approx(goal[s], rel=0.1, abs=200) for s in goal)
    assert all(mixed[i].text == redacted[i].text for i in mixed)

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY)), special_tokens={})
    rows = frames[5].collect()
    assert Counter(r.doc_id for r in rows) == copies
    for r in rows:
        ids = np.array(library.encode_ordinary(mixed[r.doc_id].text), "<u4").tobytes()
        assert (r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(mixed[r.doc_id].text.encode()).hexdigest())


def test_run_equals_its_stages(spark, sf_dir):
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf_dir)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, out.collect()))


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
