"""Exact top-k by inner product: block-at-a-time pruning.

A vector's components are its terms. Ranges of documents form blocks; each keeps its rows by component (the
forward index) and the largest and smallest value of every component. For a query, the sum over components
of the best product that a block can give bounds its scores. Blocks are taken by falling bound until it is
below the query's k-th score; a block whose bound equals it is still scored, as a tie may have a smaller id.

Blocks lie in ranges, at most MOST_RANGES of them, whose maxima and minima every task has. A query goes first to
the range of the highest bound, which gives it a k-th score, and then only to ranges whose bound is not below
that; there it meets single blocks in the same way. So vectors move only to where their bounds ask for it. A
last pass ranks what the ranges give.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import cluster

BLOCK_ROWS, RANGE_ROWS, GROUP_QUERIES = 256, 16_384, 8_192
#: Ranges at most, so that their bounds stay a few MB whatever the input.
MOST_RANGES = 4_096
_WHOLE = -1
_BLOCKS = "part int, block long, ids binary, dims binary, values binary, high binary, low binary"
_PAIRS = "part int, grp int, query long, id long, vector binary, kth double"


def usable(vector: Column) -> Column:
    """True where a vector and all its components are there and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(~F.exists(vector.cast("array<double>"), bad), F.lit(False))


def _pack(batches, scale: float, size: int):
    """Rows (id, vector) of a range, by id, as blocks of whole numbers with their bounds; at last the range's own bounds."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    ids: list[int] = []
    vectors: list[np.ndarray] = []
    high = low = np.zeros(0)
    count = 0

    def block(number: int, own: list[int], held: list[np.ndarray], bounds: tuple[np.ndarray, np.ndarray]):
        sizes = np.array([len(v) for v in held], np.int32)
        values = np.concatenate(held) if held else np.zeros(0)
        columns = [pa.array([x.tobytes()]) for x in (np.array(own, np.int64), sizes, values, *bounds)]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), *columns], ["part", "block", "ids", "dims", "values", "high", "low"])

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal high, low, count, ids, vectors
        own = _padded(vectors, max(map(len, vectors)))
        bounds = own.max(axis=0), own.min(axis=0)
        high, low = (_merged(x, y, f) if count else y for x, y, f in ((high, bounds[0], np.maximum), (low, bounds[1], np.minimum)))
        yield block((part << 32) + count, ids, vectors, bounds)
        count, ids, vectors = count + 1, [], []

    for batch in batches:
        ids_of, lists = batch.column(0).to_numpy().tolist(), _vectors(batch.column(1))
        for i, v in zip(ids_of, lists):
            ids.append(i), vectors.append(np.floor(scale * v))
            if len(ids) == size:
                yield from flush()
    if ids:
        yield from flush()
    if count:
        yield block(_WHOLE, [], [], (high, low))


def _padded(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of one width; a short vector has zeros at its end."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _merged(a: np.ndarray, b: np.ndarray, f) -> np.ndarray:
    width = max(len(a), len(b))
    return f(*_padded([a, b], width))


def _vectors(column) -> list[np.ndarray]:
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b].astype(np.float64) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _matrix(table: pa.Table, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids and values of each block."""
    ids, values = [], []
    for i, s, v in zip(table.column("ids"), table.column("dims"), table.column("values")):
        i, s, v = np.frombuffer(i.as_py(), np.int64), np.frombuffer(s.as_py(), np.int32), np.frombuffer(v.as_py(), np.float64)
        m = np.zeros((len(i), width))
        m[np.arange(width) < s[:, None]] = v
        ids.append(i)
        values.append(m)
    return ids, values


def range_bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What no score of a query in a range exceeds: (queries, ranges). A slack covers the rounding of large numbers."""
    best = np.maximum(queries, 0) @ high.T - np.maximum(-queries, 0) @ low.T
    size = np.abs(queries) @ np.maximum(np.abs(high), np.abs(low)).T
    return best + 1e-12 * size


def _route(batches, scale: float, parts: np.ndarray, high: np.ndarray, low: np.ndarray, groups: int, first: bool):
    """Queries (query, id, vector, kth): to the range of the highest bound, or to all others whose bound reaches kth."""
    for batch in batches:
        number, ids, kth = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
        vectors = [np.floor(scale * v) for v in _vectors(batch.column(2))]
        for lo in range(0, len(ids), 256):
            held = vectors[lo : lo + 256]
            width = max(high.shape[1], max(map(len, held)))
            q = _padded(held, width)
            bound = range_bounds(q, *(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (high, low)))
            best = bound.argmax(axis=1)
            mine = np.zeros(bound.shape, bool)
            mine[np.arange(len(held)), best] = True
            if not first:
                mine = ~mine & (bound >= kth[lo : lo + 256, None])
            row, at = np.nonzero(mine)
            raw = [v.tobytes() for v in held]
            own = number[lo : lo + 256][row]
            yield pa.RecordBatch.from_arrays([pa.array(parts[at], pa.int32()), pa.array((own % groups).astype(np.int32)), pa.array(own), pa.array(ids[lo : lo + 256][row]), pa.array([raw[r] for r in row.tolist()], pa.binary()), pa.array(kth[lo : lo + 256][row])], ["part", "grp", "query", "id", "vector", "kth"])


def search_cell(doc_ids: list[np.ndarray], docs: list[np.ndarray], query_ids: np.ndarray, queries: np.ndarray, k: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query place, id, score) of the k best of each query, in any order, and the number of blocks scored. Of scores below a known k-th one, none need come."""
    n = len(query_ids)
    big = float(np.abs(queries).max(initial=0)) * max((float(np.abs(d).max(initial=0)) for d in docs), default=0) * queries.shape[1]
    if big >= 2.0**53:  # beyond exact doubles
        whole = np.vectorize(int, otypes=[object])
        docs, queries = [whole(d) if d.size else d.astype(object) for d in docs], whole(queries) if queries.size else queries.astype(object)
    top = [np.maximum(q, 0) for q in (queries, -queries)]
    bound = np.stack([top[0].dot(d.max(axis=0)) - top[1].dot(d.min(axis=0)) for d in docs], axis=1)
    order = np.argsort(-bound.astype(np.float64), axis=1, kind="stable")
    kth = np.full(n, -math.inf, bound.dtype)
    if known is not None:  # a known score is a long that may have been rounded: a little less is safe
        kth = np.where(np.isfinite(known), known - 1e-12 * np.abs(known), -math.inf).astype(bound.dtype)
    q_at, found, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bound.dtype)
    scored = 0
    live = np.arange(n)
    for step in range(len(docs)):
        block = order[live, step]
        go = bound[live, block] >= kth[live]
        live, block = live[go], block[go]
        if not len(live):
            break
        parts = [(q_at, found, score)]
        for b in np.unique(block).tolist():
            who = live[block == b]
            s = queries[who].dot(docs[b].T)
            scored += len(who)
            i, j = np.nonzero((s >= kth[who][:, None]) & (doc_ids[b] != query_ids[who][:, None]))
            parts.append((who[i], doc_ids[b][j], s[i, j]))
        q_at, found, score = (np.concatenate(x) for x in zip(*parts))
        by = np.lexsort((found, -score, q_at))
        q_at, found, score = q_at[by], found[by], score[by]
        first = np.concatenate(([True], q_at[1:] != q_at[:-1])) if len(q_at) else np.zeros(0, bool)
        rank = np.arange(len(q_at)) - np.maximum.accumulate(np.where(first, np.arange(len(q_at)), 0))
        full = q_at[rank == k - 1]
        kth[full] = np.maximum(kth[full], score[rank == k - 1])
        keep = rank < k
        q_at, found, score = q_at[keep], found[keep], score[keep]
    return q_at, found, score, scored


def search(spark: SparkSession, rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The k highest integer inner products of each query with all other rows: query_id, rank, id, score.

    Components become floor(scale * x). Rows whose vector is null or holds null or non-finite components,
    and rows without id, take no part. Every row is a candidate but those of the query's own id. Ties go to
    the smaller id. Repeated query rows each give their k rows; repeated candidates each count. A shorter
    vector has zeros at its end. Scores beyond a long stop at its ends. No rows, no results; only the two
    columns are read (is_query may read more).
    """
    cluster.ship(spark)
    own = rows.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    counts = own.agg(F.count(F.lit(1)), F.count_if("q")).first()
    if not counts[1]:
        return own.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id_col), F.col("id").alias("score")).limit(0)
    ranges, groups = max(1, min(MOST_RANGES, -(-counts[0] // RANGE_ROWS))), max(1, -(-counts[1] // GROUP_QUERIES))
    size = BLOCK_ROWS
    # Rows of one id may part: a number of their own follows the id.
    ranged = own.select("id", "v", F.monotonically_increasing_id().alias("n")).repartitionByRange(ranges, "id", "n").sortWithinPartitions("id", "n").select("id", "v")
    blocks = cluster.materialize(spark, ranged.mapInArrow(lambda b: _pack(b, scale, size), _BLOCKS), "blocks")
    whole = blocks.where(F.col("block") == _WHOLE).select("part", "high", "low").toArrow().to_pylist()  # MOST_RANGES rows at most
    parts = np.array([r["part"] for r in whole], np.int32)
    sides = [[np.frombuffer(r[c], np.float64) for r in whole] for c in ("high", "low")]
    width = max(len(x) for x in sides[0])
    high, low = (_padded(x, width) for x in sides)
    asked = cluster.materialize(spark, own.where("q").select(F.monotonically_increasing_id().alias("query"), "id", "v"), "queries")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            vectors = [np.frombuffer(v.as_py(), np.float64) for v in right.column("vector")]
            wide = max(max(int(np.frombuffer(s.as_py(), np.int32).max()) for s in left.column("dims")), max(map(len, vectors)))
            ids, values = _matrix(left, wide)
            query, query_ids, kth = (right.column(c).to_numpy() for c in ("query", "id", "kth"))
            for lo in range(0, len(vectors), 1024):
                q, f, s, _ = search_cell(ids, values, query_ids[lo : lo + 1024], _padded(vectors[lo : lo + 1024], wide), k, kth[lo : lo + 1024])
                s = np.clip(s, -(1 << 63), (1 << 63) - 1) if s.dtype == object else s
                found.append((query[lo + q], query_ids[lo + q], f, [int(x) for x in s]))
        columns = [np.concatenate([x[c] for x in found]) if found else np.zeros(0, np.int64) for c in range(4)]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query", "query_id", "id", "score"), columns)})

    held = blocks.where(F.col("block") != _WHOLE).drop("high", "low")

    def scored(routed: DataFrame) -> DataFrame:
        wanted = routed.select(F.col("part").alias("of"), F.col("grp").alias("group")).distinct()
        moved = held.join(wanted, held.part == F.col("of")).withColumnRenamed("group", "grp").drop("of")
        return moved.groupBy("part", "grp").cogroup(routed.groupBy("part", "grp")).applyInArrow(cell, "query long, query_id long, id long, score long")

    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    unknown = asked.withColumn("kth", F.lit(float("-inf")))
    first = cluster.materialize(spark, unknown.mapInArrow(lambda b: _route(b, scale, parts, high, low, groups, True), _PAIRS), "first")
    near = cluster.materialize(spark, scored(first), "near")
    kth = near.withColumn("rank", place).where(F.col("rank") == k).select("query", F.col("score").cast("double").alias("kth"))
    later = asked.join(kth, "query", "left").select("query", "id", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    later = cluster.materialize(spark, later.mapInArrow(lambda b: _route(b, scale, parts, high, low, groups, False), _PAIRS), "later")
    met = near.unionByName(scored(later))
    return met.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
