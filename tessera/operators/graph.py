"""The property graph as two tables: nodes (id, labels, properties) and edges (src, rel, dst, properties)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.profile import Profile, safe_name
from tessera.sources.storage import materialize

NODES = "id string, labels array<string>, properties map<string,string>"
EDGES = "src string, rel string, dst string, properties map<string,string>"
RECORD = "chunk_id string, nodes array<struct<id:string,label:string,properties:map<string,string>>>, relationships array<struct<start_node_id:string,end_node_id:string,type:string,properties:map<string,string>>>"
#: Relations of the lexical layer: they link chunks and documents, not entities.
LEXICAL = ("NEXT_CHUNK", "FROM_DOCUMENT", "PART_OF_DOCUMENT", "PART_OF_CHUNK")
#: Labels that are not of the schema.
INFRASTRUCTURE = ("Document", "Chunk", "__Entity__", "__KGBuilder__", "Resolved")
ENTITY = "__Entity__"


def _props(**columns: Column) -> Column:
    return F.create_map(*(x for k, v in columns.items() for x in (F.lit(k), v.cast("string"))))


def lexical_graph(chunks: DataFrame, mentions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Document and Chunk nodes; NEXT_CHUNK in order of place, FROM_DOCUMENT, and PART_OF_CHUNK of mentions (node_id, chunk_id)."""
    docs = chunks.select("doc_id").distinct().select(F.col("doc_id").alias("id"), F.array(F.lit("Document")).alias("labels"), _props(path=F.col("doc_id")).alias("properties"))
    own = chunks.select("id", F.array(F.lit("Chunk")).alias("labels"), _props(id=F.col("id"), doc_id=F.col("doc_id"), path=F.col("path"), text=F.col("text"), level=F.col("level"), number=F.col("number"), title=F.col("title")).alias("properties"))
    none = F.create_map().cast("map<string,string>").alias("properties")
    following = F.lead("id").over(Window.partitionBy("doc_id").orderBy("char_start", "id"))
    chain = chunks.select(F.col("id").alias("src"), F.lit("NEXT_CHUNK").alias("rel"), following.alias("dst"), none).where("dst is not null")
    edges = chain.unionByName(chunks.select(F.col("id").alias("src"), F.lit("FROM_DOCUMENT").alias("rel"), F.col("doc_id").alias("dst"), none))
    if mentions is not None:
        edges = edges.unionByName(mentions.select("node_id", "chunk_id").distinct().select(F.col("node_id").alias("src"), F.lit("PART_OF_CHUNK").alias("rel"), F.col("chunk_id").alias("dst"), none))
    return docs.unionByName(own), edges


def parser_edges(xrefs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges of resolved references between chunks that are there, marked with their source; of several for one edge, the last reference's wording stays."""
    own = xrefs.where("target_chunk_id is not null").select("chunk_id", "relation", "target_chunk_id", "raw", "char_start", "pattern")
    # Sources last: the edges are then grouped where they lie.
    own = own.join(chunks.select(F.col("id").alias("target_chunk_id")), "target_chunk_id", "left_semi").join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    merged = own.groupBy(F.col("chunk_id").alias("src"), F.col("relation").alias("rel"), F.col("target_chunk_id").alias("dst")).agg(F.max_by("raw", F.struct("char_start", "pattern")).alias("raw"))
    return merged.select("src", "rel", "dst", _props(source=F.lit("parser"), raw=F.col("raw")).alias("properties"))


def upsert_edges(old: DataFrame, new: DataFrame, order: Column | None = None) -> DataFrame:
    """One edge for each (src, rel, dst): properties of both, the new ones' where they clash; of several new ones, the last by order."""
    by = ["src", "rel", "dst"]
    new = new.groupBy(*by).agg(F.max_by("properties", order if order is not None else F.to_json("properties")).alias("_new"))
    old = old.groupBy(*by).agg(F.first("properties").alias("_old"))
    merged = F.map_concat(F.map_filter("_old", lambda k, v: ~F.map_contains_key(F.col("_new"), k)), F.col("_new"))
    return old.join(new, by, "full").select(*by, F.when(F.col("_new").isNull(), F.col("_old")).when(F.col("_old").isNull(), F.col("_new")).otherwise(merged).alias("properties"))


def records_to_graph(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and mentions (node_id, chunk_id) of extracted records. Node ids are told apart by chunk until resolution."""
    scoped = lambda chunk, node: F.when((node != "") & node.isNotNull(), F.concat_ws(":", chunk, node)).otherwise(F.lit(""))
    nodes = records.select("chunk_id", F.explode("nodes").alias("n")).select(scoped(F.col("chunk_id"), F.col("n.id")).alias("id"), F.array(F.col("n.label"), F.lit(ENTITY)).alias("labels"), F.col("n.properties").alias("properties"), "chunk_id")
    edges = records.select("chunk_id", F.explode("relationships").alias("e")).select(scoped(F.col("chunk_id"), F.col("e.start_node_id")).alias("src"), F.col("e.type").alias("rel"), scoped(F.col("chunk_id"), F.col("e.end_node_id")).alias("dst"), F.col("e.properties").alias("properties"))
    return nodes.drop("chunk_id"), edges, nodes.where("id <> ''").select(F.col("id").alias("node_id"), "chunk_id")


def patterns_table(spark: SparkSession, profile: Profile) -> DataFrame:
    """The schema's legal triples."""
    return spark.createDataFrame(list(profile.patterns), "src_label string, rel string, dst_label string")


def _is_legal(a: Column, rel: Column, b: Column, profile: Profile) -> Column:
    """Whether any pair of labels forms a legal triple: a lookup in a literal of the schema's size."""
    legal = F.array(*(F.lit("|".join(p)) for p in profile.patterns)) if profile.patterns else F.array().cast("array<string>")
    return F.exists(a, lambda x: F.exists(b, lambda y: F.array_contains(legal, F.concat_ws("|", x, rel, y))))


def fix_direction(nodes: DataFrame, edges: DataFrame, profile: Profile) -> DataFrame:
    """Edges whose triple is illegal but legal the other way round, turned."""
    a, b = nodes.select(F.col("id").alias("src"), F.col("labels").alias("_a")), nodes.select(F.col("id").alias("dst"), F.col("labels").alias("_b"))
    turn = ~_is_legal(F.col("_a"), F.col("rel"), F.col("_b"), profile) & _is_legal(F.col("_b"), F.col("rel"), F.col("_a"), profile)
    met = edges.join(a, "src", "left").join(b, "dst", "left").withColumn("_turn", F.coalesce(turn, F.lit(False)))
    return met.select(F.when(F.col("_turn"), F.col("dst")).otherwise(F.col("src")).alias("src"), "rel", F.when(F.col("_turn"), F.col("src")).otherwise(F.col("dst")).alias("dst"), "properties")


def _among(names: list[str]) -> Callable[[Column, Column], Column]:
    return lambda k, v: k.isin(names)


def _close_properties(properties: Column, name: Column, kinds) -> Column:
    """Only the declared properties of closed kinds."""
    closed = {k.label: [p[0] for p in k.properties] for k in kinds if k.closed}
    out = properties
    for label, names in closed.items():
        out = F.when(name == label, F.map_filter(properties, _among(names))).otherwise(out)
    return out


def prune(nodes: DataFrame, edges: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """The graph within its closed schema.

    Nodes go that have no id, no declared label, no property left, or lack a required one; undeclared
    properties go from closed kinds. Edges are turned where only the other way is legal; those go whose
    type is empty or undeclared, whose triple is illegal, or whose ends are gone.
    """
    declared = [k.label for k in profile.labels]
    kept = nodes.where("id is not null and id <> ''").withColumn("_label", F.try_element_at(F.filter("labels", lambda x: x.isin(declared)), F.lit(1))).where("_label is not null")
    kept = kept.withColumn("properties", _close_properties(F.coalesce("properties", F.create_map().cast("map<string,string>")), F.col("_label"), profile.labels)).where(F.size("properties") > 0)
    for k in profile.labels:
        for name, _, required in k.properties:
            if required:
                kept = kept.where((F.col("_label") != k.label) | F.coalesce(F.try_element_at("properties", F.lit(name)) != "", F.lit(False)))
    kept = kept.drop("_label")
    types = [k.label for k in profile.relations]
    linked = edges.where(F.col("rel").isin(types))
    linked = linked.withColumn("properties", _close_properties(F.coalesce("properties", F.create_map().cast("map<string,string>")), F.col("rel"), profile.relations))
    # Each end's labels join once: dangling edges go, and both directions are judged on the same row.
    a, b = kept.select(F.col("id").alias("src"), F.col("labels").alias("_a")), kept.select(F.col("id").alias("dst"), F.col("labels").alias("_b"))
    met = linked.join(a, "src").join(b, "dst").withColumn("_as_is", _is_legal(F.col("_a"), F.col("rel"), F.col("_b"), profile))
    met = met.where(F.col("_as_is") | _is_legal(F.col("_b"), F.col("rel"), F.col("_a"), profile))
    ends = lambda x, y: F.when(F.col("_as_is"), F.col(x)).otherwise(F.col(y)).alias(x)
    return kept, met.select(ends("src", "dst"), "rel", ends("dst", "src"), "properties")


def prompt(text: Column, profile: Profile) -> Column:
    """The extraction prompt of a chunk: schema, what the parser has already found, and the text."""
    schema = "; ".join(f"({a})-[{r}]->({b})" for a, r, b in profile.patterns)
    skip = ", ".join(profile.parser_relations) or "none"
    lead = f"Find entities and relations of this schema only. Labels: {', '.join(k.label for k in profile.labels)}. Triples: {schema}. Quote the words behind every relation. Leave out these relations, which are known: {skip}.\n\n"
    return F.concat(F.lit(lead), text)


def extract(chunks: DataFrame, extractor: Callable[[str, str], dict], strict: bool = False) -> DataFrame:
    """Records (RECORD and error) of every chunk by a callable (id, text) -> record, run where the chunks are.

    A failure is a record without nodes and with its error; strict raises instead.
    """
    import json

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    out.append((i, json.dumps(extractor(i, text or "")), None))
                except Exception as e:  # noqa: BLE001  one chunk's failure is a row
                    if strict:
                        raise
                    out.append((i, None, f"{type(e).__name__}: {e}"))
            ids, records, errors = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(records, pa.string()), pa.array(errors, pa.string())], ["chunk_id", "record", "error"])

    raw = chunks.select("id", "text").mapInArrow(run, "chunk_id string, record string, error string")
    parsed = F.from_json("record", RECORD.split(", ", 1)[1])
    return raw.select("chunk_id", F.coalesce(parsed["nodes"], F.array().cast("array<struct<id:string,label:string,properties:map<string,string>>>")).alias("nodes"), F.coalesce(parsed["relationships"], F.array().cast("array<struct<start_node_id:string,end_node_id:string,type:string,properties:map<string,string>>>")).alias("relationships"), "error")


def dry_run_summary(records: DataFrame) -> DataFrame:
    """kind (node, edge, unquoted, quoted_share), name, n: what an extraction has found; a share under 0.8 is an alarm."""
    nodes = records.select(F.explode("nodes").alias("n")).groupBy(F.col("n.label").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    edges = records.select(F.explode("relationships").alias("e"))
    quoted = F.coalesce(F.try_element_at(F.col("e.properties"), F.lit("quote")) != "", F.lit(False))
    types = edges.groupBy(F.col("e.type").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.when(quoted, 0.0).otherwise(1.0)).alias("u"))
    share = edges.agg(F.coalesce(F.avg(F.when(quoted, 1.0).otherwise(0.0)), F.lit(1.0)).alias("n"))
    return nodes.unionByName(types.select(F.lit("edge").alias("kind"), "name", "n")).unionByName(types.select(F.lit("unquoted").alias("kind"), "name", F.col("u").alias("n"))).unionByName(share.select(F.lit("quoted_share").alias("kind"), F.lit("").alias("name"), "n"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int, relations: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """(seed, node, hop): nodes within so many steps, either way, each at its least hop; a cap on nodes of a seed takes nearer ones first.

    Each hop's front is a table, so no hop runs twice. A seed that has reached its cap goes no further.
    """
    spark = edges.sparkSession
    both = edges if not relations else edges.where(F.col("rel").isin(*map(safe_name, relations)))
    both = materialize(spark, both.select("src", "dst").unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
    seen = materialize(spark, seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("hop")).distinct(), "hop0")
    front = seen
    for hop in range(1, hops + 1):
        if limit is not None:
            room = seen.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < limit).select("seed")
            front = front.join(room, "seed", "left_semi")
        step = front.join(both, front.node == both.src).select("seed", F.col("dst").alias("node")).distinct()
        front = materialize(spark, step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)), f"hop{hop}")
        seen = seen.unionByName(front)
    if limit is not None:
        place = F.row_number().over(Window.partitionBy("seed").orderBy("hop", "node"))
        seen = seen.withColumn("_n", place).where(F.col("_n") <= limit).drop("_n")
    return seen


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree of entity nodes over all relations; a loop counts once."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.where("src <> dst").select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.where(F.array_contains("labels", ENTITY)).select("id", "labels", F.try_element_at("properties", F.lit("name")).alias("name")).join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def label_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def relation_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rel")


#: Edges of a part at most, about, where they are joined to nodes: what a task sorts does not grow with the graph.
PART_ROWS = 1 << 20


def triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src_labels, rel, dst_labels, n. Edges are counted by label set, so each node's labels join once on either end.

    They are dealt to as many parts as their number asks for, on either end.
    """
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // PART_ROWS))
    a, b = nodes.select(F.col("id").alias("src"), F.array_sort("labels").alias("src_labels")), nodes.select(F.col("id").alias("dst"), F.array_sort("labels").alias("dst_labels"))
    met = edges.select("src", "rel", "dst").repartition(parts, "src").join(a, "src").select("src_labels", "rel", "dst")
    return met.repartition(parts, "dst").join(b, "dst").groupBy("src_labels", "rel", "dst_labels").agg(F.count(F.lit(1)).alias("n"))
