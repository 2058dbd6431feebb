import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def odd_texts():
    rng = random.Random(4)
    signs = ["a", "B", "é", "ß", "日", "本", "😀", "1", "٣", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "'s", "'ll", "'T", "%", "&&", "_", "́", "​", "<|endoftext|>"]
    return ["", " ", "aaaaaaaaaaaaaaaaaaaaaa" * 40, "xy" * 3000, "the the the", *("".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(400))]


def test_pieces_and_ids_equal_the_library(reference):
    t = bpe.tokenizer(PATH, public_tokenizers.PATTERN)
    for text in odd_texts():
        ids = np.frombuffer(t.encode(text), "<u4").tolist()
        assert ids == reference.encode_ordinary(text), repr(text)
        assert t.decode(t.encode(text)) == text.encode()


def test_documents(spark, reference):
    texts = [None, "", "Hello, world's end", "Hello, world's end", "x" * 50_000, "é\n\n  日本"]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in bpe.encode_documents(spark, docs, PATH, public_tokenizers.PATTERN).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ids = np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()
        assert (rows[i].n_tokens, bytes(rows[i].ids), bytes(rows[i].decoded)) == (len(ids) // 4, ids, (t or "").encode())
    assert bpe.encode_documents(spark, docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_pieces_that_come_again_stay(monkeypatch, reference):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 20)
    t = bpe.Tokenizer(PATH, public_tokenizers.PATTERN)
    rng = random.Random(2)
    for _ in range(60):
        text = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 4))) for _ in range(30)) + " zebra"
        assert np.frombuffer(t.encode(text), "<u4").tolist() == reference.encode_ordinary(text)
        assert len(t.kept) <= 20 and len(t.kept.old) <= 20
