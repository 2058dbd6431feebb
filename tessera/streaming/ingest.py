"""Incremental ingestion: a file stream whose batches are segmented and upserted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import graph, segment, xref
from tessera.profile import Profile
from tessera.sources import sinks


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, profile: Profile, files_a_batch: int = 1000) -> StreamingQuery:
    """Watch a folder of Parquet documents (doc_id, text) and keep the graph below ``target`` up to date.

    Each batch's chunks, lexical edges and references within the batch's documents are upserted, so a batch
    that runs twice changes nothing. The query takes what is there and ends; run it again for what has come.
    """

    def load(batch: DataFrame, number: int) -> None:
        chunks = segment.segment(batch, profile)
        nodes, edges = graph.lexical_graph(chunks)
        refs = graph.parser_edges(xref.cross_references(chunks, profile, "document"), chunks)
        sinks.write_graph(spark, nodes, edges.unionByName(refs), target)

    stream = spark.readStream.schema("doc_id string, text string").option("maxFilesPerTrigger", files_a_batch).parquet(source)
    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
