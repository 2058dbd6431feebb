"""A quality classifier by co-training of two views.

One logistic model reads the text (hashed words, and how words, signs and repeats are spread), the other the
page's metadata (language, source, length, layout of lines). Both start from the labelled sample. In each
round, each labels those of all unlabelled documents that it is surest of, and the other learns from them.
Labelled rows held out calibrate both views; their calibrated log-odds, less the prior, add up to the score.

Only the fit is on bounded samples: MOST_LABELLED labelled documents, by a hash of the id, and in each round
MOST_EXCHANGED more pseudo-labelled ones for each view. These are the surest of all documents: a pass over a table
of their features finds them. Every document is scored, whole.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import cluster
from tessera.llm import vectext as vt

MOST_LABELLED, MOST_EXCHANGED = 12_000, 1_200
ROUNDS, SURE, SHARE = 4, 0.97, 0.1
WORD_SLOTS, SOURCE_SLOTS, LANG_SLOTS = 192, 64, 8
N_TEXT, N_META = 14 + WORD_SLOTS, 5 + SOURCE_SLOTS + LANG_SLOTS
THRESHOLD = 0.5

_KIND = np.zeros((256, 7), np.uint8)
_KIND[ord("A") : ord("Z") + 1, 0] = 1
_KIND[ord("a") : ord("z") + 1, 1] = 1
_KIND[ord("0") : ord("9") + 1, 2] = 1
_KIND[list(b"#*$%&<>|=_{}[]\\/^~@"), 3] = 1
_KIND[list(b"!?"), 4] = 1
_KIND[list(b".,;:"), 5] = 1
_KIND[0x80:, 6] = 1


def _slot(value: str | None, slots: int) -> int:
    if value is None:
        return 0
    raw = np.frombuffer(value.encode(), np.uint8)
    return 1 + int(vt.range_hashes(raw, np.array([0]), np.array([len(raw)]))[0] % np.uint64(slots - 1))


def features(data: np.ndarray, at: np.ndarray, lang: list, source: list, n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text features, metadata features and numbers of words of documents end to end."""
    n = len(at) - 1
    starts, ends, first = vt.word_bounds(data, at)
    count = np.diff(first)
    some = np.maximum(count, 1)[:, None]
    text, meta = np.zeros((n, N_TEXT), np.float32), np.zeros((n, N_META), np.float32)
    size = np.maximum(np.diff(at), 1)[:, None]
    if len(starts):
        upto = np.zeros((len(data) + 1, 1), np.int64)
        for k in range(_KIND.shape[1]):
            np.cumsum(_KIND[data, k], out=upto[1:, 0])
            amount = (upto[at[1:], 0] - upto[at[:-1], 0])[:, None]
            text[:, k] = (amount / size)[:, 0]
            if k == 3:
                text[:, 7] = np.minimum(amount / some, 4)[:, 0]
            if k == 4:
                text[:, 8] = np.minimum(amount / some, 4)[:, 0]
        words = vt.range_hashes(data, starts, ends)
        doc = np.repeat(np.arange(n), count)
        length = np.bincount(doc, ends - starts, n)[:, None] / some
        text[:, 9] = np.minimum(length, 40)[:, 0] / 10
        for k, width in ((10, 1), (11, 2), (12, 3)):
            _, where = vt.shingle_sets(data, at, width)
            text[:, k] = np.diff(where) / np.maximum(count - width + 1, 1)
        text[:, 13] = np.log1p(count)
        slot = (words % np.uint64(WORD_SLOTS)).astype(np.int64)
        text[:, 14:] = np.bincount(doc * WORD_SLOTS + slot, minlength=n * WORD_SLOTS).reshape(n, WORD_SLOTS) / some
    breaks = np.flatnonzero(data == 10)
    lines = 1 + np.searchsorted(breaks, at[1:]) - np.searchsorted(breaks, at[:-1])
    meta[:, 0] = np.log1p(lines)
    meta[:, 1] = np.log1p(size[:, 0] / lines)
    known = np.array([-1 if x is None else max(0, x) for x in n_chars], np.float64)
    meta[:, 2] = np.log1p(np.maximum(known, 0))
    meta[:, 3] = known < 0
    meta[:, 4] = np.where(known > 0, np.diff(at) / np.maximum(known, 1), 1).clip(0, 4)
    slots = {x: _slot(x, SOURCE_SLOTS) for x in set(source)}
    meta[np.arange(n), [5 + slots[x] for x in source]] = 1
    slots = {x: _slot(x, LANG_SLOTS) for x in set(lang)}
    meta[np.arange(n), [5 + SOURCE_SLOTS + slots[x] for x in lang]] = 1
    return text, meta, count


def _featured(batch):
    """Features of a batch (id, text, lang, source, n_chars, ...) in runs of bounded size."""
    data, at = vt.column_bytes(batch.column(1))
    lang, source, n_chars = (batch.column(k).to_pylist() for k in (2, 3, 4))
    for i, j in vt.chunks(at, 1 << 20):
        yield i, j, *features(data[at[i] : at[j]], at[i : j + 1] - at[i], lang[i:j], source[i:j], n_chars[i:j])


@dataclass
class View:
    """A logistic model on standardised features, and its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z.astype(np.float64) @ self.weights[1:] + self.weights[0]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.offset, -12, 12)


@dataclass
class Model:
    text: View | None
    meta: View | None
    prior: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality by text, by metadata, and of both."""
        a = self.text.logit(text) if self.text else np.full(len(text), self.prior)
        b = self.meta.logit(meta) if self.meta else np.full(len(text), self.prior)
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b - self.prior)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 2.0, steps: int = 12) -> np.ndarray:
    """Weights (intercept first) by Newton steps with a ridge on all but the intercept."""
    z = np.concatenate([np.ones((len(x), 1)), x], axis=1).astype(np.float64)
    beta = np.zeros(z.shape[1])
    pull = np.full(z.shape[1], ridge)
    pull[0] = 1e-3
    for _ in range(steps):
        p = _sigmoid(z @ beta)
        h = (z * (w * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(pull)
        step = np.linalg.solve(h, z.T @ (w * (y - p)) - pull * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-5:
            break
    return beta


def fit_view(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> View:
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    return View(mean, scale, fit_logistic(np.clip((x - mean) / scale, -8, 8), y, w))


def _calibrate(view: View, x: np.ndarray, y: np.ndarray) -> View:
    beta = fit_logistic(view.raw(x)[:, None], y, np.ones(len(y)), ridge=1e-2)
    view.slope, view.offset = float(max(beta[1], 0.0)), float(beta[0])
    return view


def _surest(p: np.ndarray, ids: np.ndarray, label: float, most: int) -> np.ndarray:
    """Places of the ids that are surest of a label, at SURE or more: the surest first, equals by a hash of the id."""
    sure = p if label else 1 - p
    own = np.flatnonzero(sure >= SURE)
    order = np.lexsort((ids[own], vt.mix(ids[own].view(np.uint64)), -sure[own]))
    own = own[order]
    _, first = np.unique(ids[own], return_index=True)
    return own[np.sort(first)][:most]


class Held:
    """Unlabelled documents that are at hand: ids and features of both views."""

    def __init__(self, ids: np.ndarray, text: np.ndarray, meta: np.ndarray):
        self.ids, self.views, self.size = ids.astype(np.int64), (text, meta), len(ids)

    def surest(self, views: list[View], most: dict[float, int]) -> dict[tuple[int, float], np.ndarray]:
        """By view and label, the ids that this view is surest have the label."""
        p = [_sigmoid(views[v].logit(self.views[v])) for v in (0, 1)]
        return {(v, label): self.ids[_surest(p[v], self.ids, label, n)] for v in (0, 1) for label, n in most.items()}

    def fetch(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.ids, kind="stable")
        at = order[np.searchsorted(self.ids[order], ids)]
        return self.views[0][at], self.views[1][at]


class Spread:
    """Unlabelled documents as a table of features (id, text, meta) of any size, without those of the labelled ids."""

    def __init__(self, spark: SparkSession, features: DataFrame, labelled: np.ndarray):
        self.spark, self.features, self.labelled = spark, features.where("id is not null"), np.sort(labelled)
        self.size = max(0, self.features.count() - len(labelled))

    def surest(self, views: list[View], most: dict[float, int]) -> dict[tuple[int, float], np.ndarray]:
        labelled = self.labelled

        def run(batches):
            for batch in batches:
                ids = batch.column(0).to_numpy().astype(np.int64)
                free = ~np.isin(ids, labelled)
                ids = ids[free]
                for v in (0, 1):
                    p = _sigmoid(views[v].logit(_matrix(batch.column(1 + v))[free]))
                    for label, n in most.items():
                        at = _surest(p, ids, label, n)
                        sure = p[at] if label else 1 - p[at]
                        tie = vt.mix(ids[at].view(np.uint64)).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v, np.int32)), pa.array(np.full(len(at), label)), pa.array(sure), pa.array(tie), pa.array(ids[at])], ["view", "label", "sure", "tie", "id"])

        found = self.features.select("id", "text", "meta").mapInArrow(lambda b: cluster.handing_back(run(b)), "view int, label double, sure double, tie long, id long")
        found = cluster.materialize(self.spark, found.groupBy("view", "label", "id").agg(F.max("sure").alias("sure"), F.max("tie").alias("tie")), "surest")
        # The hash is compared as a number without sign, as numpy does.
        order = (F.desc("sure"), F.col("tie") < 0, "tie", "id")
        tops = [found.where((F.col("view") == v) & (F.col("label") == label)).orderBy(*order).limit(n) for v in (0, 1) for label, n in most.items()]
        every = functools.reduce(DataFrame.unionByName, tops).select("view", "label", "id").toArrow().to_pydict()
        out: dict[tuple[int, float], list[int]] = {(v, label): [] for v in (0, 1) for label in most}
        for v, label, i in zip(every["view"], every["label"], every["id"]):
            out[v, label].append(i)
        return {k: np.array(x, np.int64) for k, x in out.items()}

    def fetch(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chosen = self.spark.createDataFrame([(int(i),) for i in ids], "id long")  # bounded by MOST_EXCHANGED and the rounds
        table = _collected(self.features.join(F.broadcast(chosen), "id"))
        at = np.searchsorted(table[0], ids)
        return table[1][at], table[2][at]


def _matrix(column) -> np.ndarray:
    return vt.column_bytes(column)[0].view(np.float32).reshape(len(column), -1 if len(column) else 1)


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order and both features of rows of bounded many ids; of several rows of one id, the greatest."""
    table = rows.groupBy("id").agg(F.max(F.struct("text", "meta")).alias("x")).select("id", "x.text", "x.meta").toArrow().combine_chunks()
    ids = table.column("id").to_numpy().astype(np.int64)
    order = np.argsort(ids)
    return ids[order], _matrix(table.column("text"))[order], _matrix(table.column("meta"))[order]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: Held | Spread, rounds: int = ROUNDS) -> Model:
    """Fit both views. With fewer than 8 rows of either class there is nothing to learn: every score is the prior."""
    good = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
    prior = float(np.log(good / (1 - good)))
    if min((y == 1).sum(), (y == 0).sum()) < 8:
        return Model(None, None, prior)
    held = np.zeros(len(y), bool)
    for label in (0, 1):  # every fourth of either class; rows come in the order of a hash
        held[np.flatnonzero(y == label)[::4]] = True
    own = (text, meta)
    extra: list[dict[int, float]] = [{}, {}]  # of the pool's ids: the label that the other view gave
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    share = min(SHARE * pool.size, MOST_EXCHANGED)
    for r in range(rounds + 1):
        views = []
        for v in (0, 1):
            ids = sorted(extra[v])
            more = np.array([known[i][v] for i in ids], np.float32).reshape(len(ids), own[v].shape[1])
            label = np.array([extra[v][i] for i in ids])
            weight = np.concatenate([np.ones((~held).sum()), np.full(len(ids), 0.5)])
            views.append(_calibrate(fit_view(np.concatenate([own[v][~held], more]), np.concatenate([y[~held], label]), weight), own[v][held], y[held]))
        if r == rounds or not pool.size:
            break
        most = {label: max(1, int(share * (good if label else 1 - good))) * (r + 1) for label in (1.0, 0.0)}
        found = pool.surest(views, most)
        new = np.array(sorted({i for ids in found.values() for i in ids.tolist()} - set(known)), np.int64)
        if len(new):
            known.update(zip(new.tolist(), zip(*pool.fetch(new))))
        for v in (0, 1):
            for label in most:
                for i in found[v, label].tolist():
                    extra[1 - v].setdefault(i, label)
    return Model(views[0], views[1], prior)


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """At most so many rows of (id, ...), by a hash of the id: small enough to broadcast."""
    return F.broadcast(rows.orderBy(F.xxhash64("id"), "id").limit(most))


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    has = {c.lower() for c in docs.columns}
    own = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind).alias(c)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), own("lang", "string"), own("source", "string"), own("n_chars", "long"))


def featurize(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words and the features of both views of every row of docs, as a table."""
    cluster.ship(spark)

    def run(batches):
        for batch in batches:
            for i, j, text, meta, count in _featured(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(count), vt.binary_rows(text.ravel(), np.arange(j - i + 1) * N_TEXT), vt.binary_rows(meta.ravel(), np.arange(j - i + 1) * N_META)], ["id", "n_words", "text", "meta"])

    return cluster.materialize(spark, _columns(docs, id_col, text_col).mapInArrow(lambda b: cluster.handing_back(run(b)), "id long, n_words long, text binary, meta binary"), "features")


def fit(spark: SparkSession, features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: Column | None = None) -> Model:
    """Co-train on the labelled of the featurized documents (label: 1 good, 0 bad; null and contradicting labels do not count)."""
    cluster.ship(spark)
    label = F.col("quality") if label is None else label
    known = labels.select(F.col(id_col).cast("long").alias("id"), label.cast("double").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other and y in (0, 1)").drop("other")
    chosen = cluster.materialize(spark, _sample(known, MOST_LABELLED), "labelled")
    ids, text, meta = _collected(features.join(F.broadcast(chosen), "id"))
    told = chosen.toArrow()
    label_of = dict(zip(told.column("id").to_pylist(), told.column("y").to_pylist()))
    order = np.lexsort((ids, vt.mix(ids.view(np.uint64))))
    y = np.array([label_of[i] for i in ids[order].tolist()], np.float64)
    return co_train(text[order], meta[order], y, Spread(spark, features, ids))


def score(spark: SparkSession, features: DataFrame, model: Model, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of the featurized documents: the id, p_text, p_meta, score and kept (score at or above the threshold).

    A text without words, null or not, scores 0 and goes. Missing metadata columns and nulls in them have
    features of their own. Repeated rows are scored alike; an empty table gives an empty one.
    """
    cluster.ship(spark)

    def run(batches):
        for batch in batches:
            count = batch.column(1).to_numpy()
            a, b, both = model.score(_matrix(batch.column(2)), _matrix(batch.column(3))) if len(count) else (np.zeros(0),) * 3
            both = np.where(count > 0, both, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (np.round(a, 6), np.round(b, 6), np.round(both, 6), (both >= threshold) & (count > 0)))], ["id", "p_text", "p_meta", "score", "kept"])

    return features.select("id", "n_words", "text", "meta").mapInArrow(lambda b: cluster.handing_back(run(b)), "id long, p_text double, p_meta double, score double, kept boolean").withColumnRenamed("id", id_col)


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that the classifier rejects; all columns stay, and no row moves."""
    cluster.ship(spark)
    model = fit(spark, featurize(spark, docs, id_col, text_col), labels, id_col)
    types = dict(docs.dtypes)
    by_name = {c.lower(): c for c in types}
    names = [id_col, text_col, *(by_name.get(c) for c in ("lang", "source", "n_chars"))]
    order = docs.columns

    def run(batches):
        for batch in batches:
            none = pa.nulls(batch.num_rows)
            pick = [none if c is None else batch.column(order.index(c)) for c in names]
            plain = pa.RecordBatch.from_arrays(pick, ["id", "text", "lang", "source", "n_chars"])
            keep = np.zeros(batch.num_rows, bool)
            for i, j, text, meta, count in _featured(plain):
                keep[i:j] = (model.score(text, meta)[2] >= THRESHOLD) & (count > 0)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(lambda b: cluster.handing_back(run(b)), docs.schema)
