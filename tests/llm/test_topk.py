import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import topk


def run(spark, vectors, **more):
    df = spark.createDataFrame([(i, v, 7) for i, v in vectors], "vec_id long, embedding array<double>, rank int").repartition(3)
    return sorted(tuple(r) for r in topk.search(spark, df, F.col("vec_id") % 50 == 0, **more).select("query_id", "rank", "vec_id", "score").collect())


def test_against_brute_force(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(700)]
    vectors += [(1000 + i, [0.5, 0.25, -0.5, 0.0, 0.0, 0.125]) for i in range(20)]  # ties
    vectors += [(2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2051, [float("nan")] * 6), (2052, [float("inf")] * 6), (None, [9.0] * 6)]
    assert run(spark, vectors) == brute.top_k(vectors)


def test_a_group_of_several_blocks_meets_several_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    monkeypatch.setattr(topk, "RANGE_ROWS", 100)
    rng = random.Random(6)
    vectors = [(i * 10, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(500)]
    assert run(spark, vectors) == brute.top_k(vectors)


def test_many_shards_groups_and_short_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "RANGE_ROWS", 64)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 3)
    rng = random.Random(9)
    vectors = [(i, [float(rng.randrange(-2, 3)) / 4 for _ in range(4)]) for i in range(400)]
    assert run(spark, vectors) == brute.top_k(vectors)
    assert run(spark, [(0, [1.0]), (1, [2.0, 5.0]), (2, [])]) == [(0, 1, 1, 131072), (0, 2, 2, 0)]


@pytest.mark.parametrize("vectors", [[], [(0, [1.0])], [(1, [1.0]), (2, [1.0])]])
def test_few_rows(spark, vectors):
    assert run(spark, vectors) == brute.top_k(vectors)


def test_large_numbers(spark):
    vectors = [(i, [1e6 + i, -1e6]) for i in range(60)]
    assert run(spark, vectors) == brute.top_k(vectors)


def test_blocks_below_the_bound_are_not_scored():
    rng = np.random.default_rng(3)
    docs = [np.floor(rng.normal(size=(256, 8)) * (256 if b == 0 else 8)) for b in range(40)]
    ids = [np.arange(256) + 256 * b for b in range(40)]
    queries = np.floor(256 * rng.normal(size=(20, 8)))
    *_, scored = topk.search_cell(ids, docs, np.full(20, -1), queries, 5)
    assert scored < 20 * 40 / 4


def test_vectors_move_only_where_bounds_ask():
    """Ranges of small vectors are not asked once a query has its k-th score."""
    rng = np.random.default_rng(4)
    high, low = np.full((30, 8), 4.0), np.full((30, 8), -4.0)
    high[3], low[3] = 900.0, -900.0
    queries = np.floor(256 * rng.normal(size=(50, 8)))
    bound = topk.range_bounds(queries, high, low)
    assert (bound.argmax(axis=1) == 3).all() and ((bound >= 40.0 * np.abs(queries).sum(axis=1)[:, None]).sum(axis=1) == 1).all()
    docs = np.floor(rng.uniform(-4, 4, size=(500, 8)))
    assert (topk.range_bounds(queries, docs.max(axis=0)[None], docs.min(axis=0)[None])[:, 0] >= (queries @ docs.T).max(axis=1)).all()


def test_structured_vectors_and_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    monkeypatch.setattr(topk, "RANGE_ROWS", 50)
    rng = random.Random(7)
    vectors = [(i, [rng.uniform(-1, 1) * (5 if i < 100 else 0.05) for _ in range(4)]) for i in range(600)] + [(50, [0.5, 0.5, 0.5, 0.5])] * 120
    want = brute.top_k(vectors)
    assert sorted(run(spark, vectors)) == want
