"""Indexes as tables: vectors with their length, postings with term and document frequencies, and a catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import cosine
from tessera.profile import Profile, safe_name

TERM = r"[\p{L}\p{N}]+"


def unique_violations(nodes: DataFrame, label: str, prop: str) -> DataFrame:
    """value, n of a label's property values that are there more than once."""
    safe_name(label), safe_name(prop)
    own = nodes.where(F.array_contains("labels", label)).select(F.try_element_at("properties", F.lit(prop)).alias("value"))
    return own.where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def vector_index(vectors: DataFrame, dimensions: int, similarity: str = "cosine") -> DataFrame:
    """id, embedding, norm. Raises, when it runs, at a vector of another number of dimensions; only cosine is served."""
    if similarity != "cosine":
        raise ValueError(f"no similarity {similarity!r}")
    size = F.size("embedding")
    checked = F.when(size == dimensions, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("a vector has "), size.cast("string"), F.lit(f" dimensions, not {dimensions}"))))
    own = vectors.where("embedding is not null").select("id", checked.cast("array<float>").alias("embedding"))
    return own.withColumn("norm", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def embed(rows: DataFrame, embedder: Callable[[str], list[float]]) -> DataFrame:
    """id, embedding of rows (id, text) by a callable, run where the rows are. A null text is empty."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([embedder(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.float32()))], ["id", "embedding"])

    return rows.select(F.col("id").cast("string"), "text").mapInArrow(run, "id string, embedding array<float>")


def terms(text):
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def fulltext_index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings: term, id, tf; lengths: id, size) of documents (id, text)."""
    held = docs.select("id", terms(F.col("text")).alias("t"))
    postings = held.select("id", F.explode("t").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
    return postings, held.select("id", F.size("t").alias("size"))


def catalog(spark: SparkSession, profile: Profile) -> DataFrame:
    """name, kind, label, property of the indexes and constraints that a profile asks for, as build_indexes makes them."""
    rows = [(f"{a.lower()}_{b.lower()}_unique", "constraint", safe_name(a), safe_name(b)) for a, b in profile.constraints]
    if profile.vector:
        rows.append((safe_name(profile.vector["name"]), "vector", profile.vector["label"], profile.vector["property"]))
    if profile.fulltext:
        rows += [(safe_name(profile.fulltext["name"]), "fulltext", a, b) for a in profile.fulltext["labels"] for b in profile.fulltext["properties"]]
    return spark.createDataFrame(rows, "name string, kind string, label string, property string")


def build_indexes(spark: SparkSession, chunks: DataFrame, vectors: DataFrame, profile: Profile, path: str) -> DataFrame:
    """Write the profile's indexes below a path and give their catalogue."""
    v = profile.vector
    vector_index(vectors, int(v.get("dimensions", 1536)), v.get("similarity", "cosine")).write.mode("overwrite").parquet(f"{path}/{safe_name(v['name'])}")
    postings, lengths = fulltext_index(chunks.select("id", "text"))
    postings.write.mode("overwrite").parquet(f"{path}/{safe_name(profile.fulltext['name'])}/postings")
    lengths.write.mode("overwrite").parquet(f"{path}/{safe_name(profile.fulltext['name'])}/lengths")
    out = catalog(spark, profile)
    out.write.mode("overwrite").parquet(f"{path}/catalog")
    return out


def vector_topk(index: DataFrame, query: list[float], k: int) -> DataFrame:
    """id, score of the k most similar; of equals the least id. The scan keeps k rows a task. An index with norms gives half of the sums."""
    vector = F.array(*(F.lit(float(x)) for x in query))
    if "norm" in index.columns:
        dot = F.aggregate(F.zip_with("embedding", vector, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
        score = dot / F.nullif(F.col("norm") * sum(float(x) ** 2 for x in query) ** 0.5, F.lit(0.0))
    else:
        score = cosine(F.col("embedding"), vector)
    return index.select("id", score.alias("score")).where("score is not null").orderBy(F.desc("score"), "id").limit(k)


def bm25(postings: DataFrame, lengths: DataFrame, query: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score of the k most relevant documents. Only the query's postings are read."""
    import re

    words = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    own = postings.where(F.col("term").isin(words)) if words else postings.limit(0)
    whole = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).withColumn("one", F.lit(1))
    df = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # as many rows as the query has words
    met = own.join(F.broadcast(df), "term").join(lengths, "id").withColumn("one", F.lit(1)).join(F.broadcast(whole), "one")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = F.sum(idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean"))))
    return met.groupBy("id").agg(score.alias("score")).orderBy(F.desc("score"), "id").limit(k)
