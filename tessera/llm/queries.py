"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, cluster, html_extract, mixing, oracles, pii, quality_model, quality_rules, simhash, suffix_dedup, topk, warc

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(spark, _table(spark, sf_dir, "pages"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(spark, _table(spark, sf_dir, "documents"), depth=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(spark, _table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_documents(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(spark, _table(spark, sf_dir, "documents"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark, _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("pii_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.joined(F.col("pii_base")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("pii_spans")).alias("spans"))


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = cluster.new_path(spark, "warc")
    warc.write_pages(spark, _table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = quality_model.featurize(spark, _table(spark, sf_dir, "documents"))
    return quality_model.score(spark, features, quality_model.fit(spark, features, _table(spark, sf_dir, "labels")))


def queries():
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_suffix_array_dedup": op2_suffix_array_dedup,
        "op3_source_mixing": op3_source_mixing,
        "op4_quality_rules": op4_quality_rules,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_simhash_dedup": op6_simhash_dedup,
        "op7_exact_topk": op7_exact_topk,
        "op8_pii": op8_pii,
        "op9_arc_to_warc": op9_arc_to_warc,
        "op10_quality_classifier": op10_quality_classifier,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
