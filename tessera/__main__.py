"""Commands: python -m tessera COMMAND --help. Each reads and writes tables below a working folder.

    extract   page files to clean texts and their page map
    segment   texts to chunks with references, and their statistics
    cost      tokens that an extraction of the chunks would take
    dry       extract entities of some chunks by a gazetteer and show what was found
    init      build the profile's indexes
    load      write the graph: lexical layer, parser edges, extracted records; then resolve
    validate  the checks, and a failing exit where one fails
    query     search, and expand what was found
    all       segment and dry, and stop for a look
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import profile as profiles
from tessera import providers
from tessera.operators import clean, cost, graph, index, resolve, retrieve, segment, validate, xref
from tessera.sources import corpus, sinks
from tessera.sources.storage import materialize


def _show(df: DataFrame, title: str) -> None:
    print(title)
    df.show(50, truncate=120)


def _embedded(chunks: DataFrame, dimensions: int) -> DataFrame:
    return index.embed(chunks, providers.get(providers.EMBEDDERS, "hashed")(dimensions))


def extract(spark, a, p) -> int:
    pages = materialize(spark, corpus.read_pages(spark, a.input, a.engine), "pages")
    _show(pages.where("error is not null").select("doc_id", "error"), "files that no engine reads")
    docs, spans = clean.clean_pages(pages.where("page is not null").select("doc_id", "page", "text"), a.keep_headers, a.no_reflow)
    sinks.write_documents(docs, spans, f"{a.work}/clean")
    return 0


def cut(spark, a, p) -> int:
    spans = None
    if a.input:
        docs = corpus.read_corpus(spark, a.input)
    else:
        docs, spans = spark.read.parquet(f"{a.work}/clean/documents"), spark.read.parquet(f"{a.work}/clean/page_map")
    chunks = materialize(spark, segment.segment(docs.select("doc_id", "text"), p, spans), "chunks")
    refs = materialize(spark, xref.cross_references(chunks, p, a.scope), "xrefs")
    out = xref.attach(chunks, refs)
    sinks.write_chunks(segment.first_chunks(out, a.limit) if a.limit else out, f"{a.work}/chunks")
    _show(segment.statistics(chunks, refs), "segmentation")
    return 0


def estimate(spark, a, p) -> int:
    _show(cost.estimate(corpus.read_chunks(spark, f"{a.work}/chunks"), cost.schema_chars(p)), "estimate")
    return 0


def dry(spark, a, p) -> int:
    terms = {r.name: r.label for r in spark.read.option("header", "true").csv(a.gazetteer).select("name", "label").collect()} if a.gazetteer else {}
    chunks = corpus.read_chunks(spark, f"{a.work}/chunks", a.limit)
    records = materialize(spark, graph.extract(chunks, providers.get(providers.EXTRACTORS, "gazetteer")(terms), a.strict), "records")
    sinks.write_records(records.drop("error"), f"{a.work}/records")
    _show(graph.dry_run_summary(records), "found")
    return 0


def init(spark, a, p) -> int:
    chunks = corpus.read_chunks(spark, f"{a.work}/chunks")
    _show(index.build_indexes(spark, chunks, _embedded(chunks, int(p.vector.get("dimensions", 1536))), p, f"{a.work}/indexes"), "indexes")
    return 0


def load(spark, a, p) -> int:
    chunks = materialize(spark, corpus.read_chunks(spark, f"{a.work}/chunks"), "chunks")
    refs = xref.cross_references(chunks, p, a.scope)
    mentions = None
    nodes, edges = spark.createDataFrame([], graph.NODES), spark.createDataFrame([], graph.EDGES)
    if a.records:
        n, e, mentions = graph.records_to_graph(corpus.read_records(spark, a.records))
        nodes, edges = graph.prune(n, e, p)
    own_nodes, own_edges = graph.lexical_graph(chunks, mentions)
    sinks.write_graph(spark, own_nodes.unionByName(nodes), own_edges.unionByName(edges).unionByName(graph.parser_edges(refs, chunks)), f"{a.work}/graph", a.reset)
    if a.resolve:
        own = corpus.read_graph(spark, f"{a.work}/graph")
        rules = profiles.with_limits(p, resolution=tuple(r for r in p.resolution if r.strategy in ("exact", "fuzzy")))
        merged = [materialize(spark, x, "resolved") for x in resolve.resolve(spark, *own, rules)]
        sinks.write_graph(spark, *merged, f"{a.work}/graph", reset=True)
    return 0


def check(spark, a, p) -> int:
    catalog = spark.read.parquet(f"{a.work}/indexes/catalog") if a.indexes else None
    found = materialize(spark, validate.validate(*corpus.read_graph(spark, f"{a.work}/graph"), p, catalog), "checks")
    _show(found, "checks")
    return 0 if found.where("not ok").isEmpty() else 1


def ask(spark, a, p) -> int:
    params = retrieve.parse_params(a.param)
    dims = int(p.vector.get("dimensions", 1536))
    base, words = f"{a.work}/indexes/{p.vector['name']}", f"{a.work}/indexes/{p.fulltext['name']}"
    vector = providers.get(providers.EMBEDDERS, "hashed")(dims)(a.question)
    found = retrieve.seeds(spark.read.parquet(base), spark.read.parquet(f"{words}/postings"), spark.read.parquet(f"{words}/lengths"), a.question, vector, a.k, a.mode)
    found = materialize(spark, found, "seeds")
    nodes, edges = corpus.read_graph(spark, f"{a.work}/graph")
    out = found.join(nodes.select(F.col("id").alias("chunk_id"), F.try_element_at("properties", F.lit("text")).alias("text")), "chunk_id") if a.plain else retrieve.expand(found, nodes, edges, p, params)
    _show(out, f"tool: {retrieve.route(a.question)}")
    return 0


def both(spark, a, p) -> int:
    return cut(spark, a, p) or dry(spark, a, p)


COMMANDS = {"extract": extract, "segment": cut, "cost": estimate, "dry": dry, "init": init, "load": load, "validate": check, "query": ask, "all": both}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("question", nargs="?", default="")
    parser.add_argument("--profile", default="statutes", help="a preset's name or a YAML file")
    parser.add_argument("--work", default="work", help="the folder of all tables")
    parser.add_argument("--input", help="texts or page files")
    parser.add_argument("--engine", default="poppler", choices=sorted(providers.PAGE_ENGINES))
    parser.add_argument("--keep-headers", action="store_true")
    parser.add_argument("--no-reflow", action="store_true")
    parser.add_argument("--scope", default="corpus", choices=("corpus", "document"))
    parser.add_argument("--limit", type=int)
    parser.add_argument("--gazetteer", help="a CSV file of name and label")
    parser.add_argument("--strict", action="store_true")
    parser.add_argument("--records", help="extracted records to load")
    parser.add_argument("--reset", action="store_true")
    parser.add_argument("--resolve", action="store_true")
    parser.add_argument("--indexes", action="store_true", help="check that the indexes are there, too")
    parser.add_argument("-k", type=int, default=retrieve.DEFAULT_K)
    parser.add_argument("--mode", default="hybrid", choices=("hybrid", "vector", "text"))
    parser.add_argument("--plain", action="store_true", help="without expansion")
    parser.add_argument("--param", action="append", default=[], help="key=value of the expansion")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"tessera {a.command}").getOrCreate()
    return COMMANDS[a.command](spark, a, profiles.load(a.profile))


if __name__ == "__main__":
    sys.exit(main())
