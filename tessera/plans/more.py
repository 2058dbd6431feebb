"""Further registered queries: readers and writers, page cleanup, extraction, closed schemas, resolution, search with expansion."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import providers
from tessera.operators import clean, cost, graph, index, resolve, retrieve, segment
from tessera.plans import fixtures as fx
from tessera.plans import registry as r
from tessera.plans.registry import query
from tessera.profile import COOKBOOK, STATUTES, Kind, with_limits
from tessera.sources import corpus, sinks, storage
from tessera.sources.storage import materialize

_GRAPH = f"with {fx.GRAPH_SQL}"


def _md5(c) -> F.Column:
    return F.md5(c.cast("binary"))


# Readers and writers


def _nation_files(spark, sf_dir) -> str:
    """A folder of one small file a nation, by name, with five suffixes of which one is no text's; some hold bytes that are not UTF-8."""
    folder = storage.new_path(spark, "nations")
    for n in fx.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():  # 25 rows at any scale
        suffix = ("txt", "md", "MARKDOWN", "rst", "csv")[n.n_nationkey % 5]
        data = f"{n.n_name}\nsecond line é".encode() + (b"\xff" if n.n_nationkey % 3 == 0 else b"")
        storage.put(spark, f"{folder}/deep{n.n_nationkey % 2}/{n.n_name.replace(' ', '_')}.{suffix}", data)
    return folder


_NATION_TEXT = "n_name || chr(10) || 'second line é' || case when n_nationkey % 3 = 0 then chr(65533) else '' end"


@query("corpus_scan", f"select replace(n_name, ' ', '_') as stem, {_NATION_TEXT} as text from nation where n_nationkey % 5 <> 4")
def corpus_scan(spark, sf_dir):
    docs = corpus.read_corpus(spark, _nation_files(spark, sf_dir))
    return docs.select(segment.file_stem(F.col("doc_id")).alias("stem"), "text")


@query("corpus_single_file", f"select replace(n_name, ' ', '_') as stem, {_NATION_TEXT} as text from nation where n_nationkey = 4")
def corpus_single_file(spark, sf_dir):
    name = fx.table(spark, sf_dir, "nation").where("n_nationkey = 4").first().n_name.replace(" ", "_")
    docs = corpus.read_corpus(spark, f"{_nation_files(spark, sf_dir)}/deep0/{name}.csv")
    return docs.select(segment.file_stem(F.col("doc_id")).alias("stem"), "text")


_TURNS = "select cast(conv_id as varchar) as doc_id, coalesce(text, '') as text, turn from conversations"


def _talks(spark, sf_dir) -> DataFrame:
    """Each conversation as one text, its turns parted by form feeds, with a blank last page."""
    turns = fx.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    return turns.select(F.col("conv_id").cast("string").alias("doc_id"), F.concat(F.array_join(F.transform("t", lambda x: x["text"]), "\f"), F.lit("\f \n")).alias("text"))


_PAGES = f"select doc_id, cast(row_number() over (partition by doc_id order by turn, text) as integer) as page, md5(text) as digest from ({_TURNS})"


@query("form_feed_pages", _PAGES)
def form_feed_pages(spark, sf_dir):
    return corpus.split_form_feeds(_talks(spark, sf_dir)).select("doc_id", "page", _md5(F.col("text")).alias("digest"))


@query("page_engines", f"select doc_id, page, digest, 'text' as engine_used, cast(null as varchar) as error from ({_PAGES}) union all select 'broken', null, null, null, 'failed'")
def page_engines(spark, sf_dir):
    """No PDF: the engines for them fail, and the last one reads. A file that none reads is a row with its errors."""

    def plain(content: bytes) -> list[str]:
        if not content:
            raise ValueError("empty")
        return providers.text_pages(content)

    files = _talks(spark, sf_dir).select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    files = files.unionByName(spark.createDataFrame([("broken", bytearray())], "path string, content binary"))
    engines = {name: providers.get(providers.PAGE_ENGINES, name) for name in ("pdfplumber", "pypdf")}
    pages = corpus.extract_pages(files, engines | {"text": plain})
    told = F.when(F.col("error").contains("pdfplumber") & F.col("error").contains("pypdf") & F.col("error").contains("text: ValueError"), "failed")
    return pages.select("doc_id", "page", _md5(F.col("text")).alias("digest"), "engine_used", told.alias("error"))


@query(
    "text_layer",
    f"""with p as (select doc_id, text, row_number() over (partition by doc_id order by turn) as page from ({_TURNS}))
select doc_id, count(*) as n_pages, sum(case when page <= 3 then length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) else 0 end) > 50 as has_text from p group by 1""",
)
def text_layer(spark, sf_dir):
    return corpus.diagnose(corpus.split_form_feeds(_talks(spark, sf_dir)))


@query("incremental_files", "select 'order-' || o_orderkey as path from orders where o_orderkey % 3 <> 0 or o_orderkey % 2 = 0")
def incremental_files(spark, sf_dir):
    """A first run ingests every third file; half of these change before the second run, which takes what is new or changed."""
    manifest = storage.new_path(spark, "manifest")
    orders = fx.table(spark, sf_dir, "orders")
    files = orders.select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("path"), F.to_timestamp(F.lit("2024-01-01")).alias("modificationTime"), "o_orderkey")
    sinks.write_manifest(spark, corpus.new_files(spark, files.where("o_orderkey % 3 = 0"), manifest), manifest)
    later = files.withColumn("modificationTime", F.when(F.col("o_orderkey") % 2 == 0, F.to_timestamp(F.lit("2024-02-01"))).otherwise(F.col("modificationTime")))
    return corpus.new_files(spark, later, manifest).select("path")


@query("page_map_files", "select replace(n_name, '_', ' ') as stem, cast(k as integer) as page, cast(10 * n_nationkey + 100 * k as integer) as char_start, cast(10 * n_nationkey + 100 * k + 50 as integer) as char_end from nation, range(1, 4) as t(k) where n_nationkey % 5 <> 0")
def page_map_files(spark, sf_dir):
    """Side files with the spans of pages; every fifth is not JSON and gives none."""
    folder = storage.new_path(spark, "maps")
    for n in fx.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():  # 25 rows at any scale
        spans = ", ".join(f'{{"page": {k}, "char_start": {10 * n.n_nationkey + 100 * k}, "char_end": {10 * n.n_nationkey + 100 * k + 50}}}' for k in (1, 2, 3))
        storage.put(spark, f"{folder}/{n.n_name.replace(' ', '_')}.pages.json", f"[{spans}]".encode() if n.n_nationkey % 5 else b"not json")
    return corpus.read_page_map(spark, folder).select(F.replace(segment.file_stem(F.col("doc_id")), F.lit("_"), F.lit(" ")).alias("stem"), "page", "char_start", "char_end")


@query("chunk_files", f"with {fx.STATUTES_SQL} select id, doc_id, path, number, title, txt as text, char_start, char_end from chunks")
def chunk_files(spark, sf_dir):
    path = storage.new_path(spark, "chunk_files")
    sinks.write_chunks(r._acts(spark, sf_dir), path)
    return corpus.read_chunks(spark, path).select("id", "doc_id", "path", "number", "title", "text", "char_start", "char_end")


@query("chunk_limit", f"with {fx.STATUTES_SQL} select id, doc_id, char_start from chunks order by doc_id, char_start, id limit 50")
def chunk_limit(spark, sf_dir):
    path = storage.new_path(spark, "chunk_files")
    sinks.write_chunks(segment.first_chunks(r._acts(spark, sf_dir), 80), path)
    return corpus.read_chunks(spark, path, 50).select("id", "doc_id", "char_start")


@query("document_files", f"with {r._TALK} select doc_id, 'table' as kind, page, char_start, char_end from pm union all select doc_id, 'lines', page, char_start, char_end from pm")
def document_files(spark, sf_dir):
    """Clean texts with their page map, as a table and as JSON lines, and both read again."""
    path = storage.new_path(spark, "clean")
    docs, spans = clean.assemble(fx.conversation_pages(spark, sf_dir))
    sinks.write_documents(docs, spans, path)
    stored = spark.read.parquet(f"{path}/page_map")
    sinks.write_page_maps(stored, f"{path}/lines")
    lines = spark.read.schema("doc_id string, spans array<struct<page:int,char_start:int,char_end:int>>").json(f"{path}/lines").select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    return stored.select("doc_id", F.lit("table").alias("kind"), "page", "char_start", "char_end").unionByName(lines.withColumn("kind", F.lit("lines")))


@query("outside_vectors", f"with {r._V} select id, round(score, 5) as score from vt")
def outside_vectors(spark, sf_dir):
    """Vectors kept elsewhere, in another format and under other names, and an index with norms over them."""
    path = storage.new_path(spark, "vector_store")
    fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("values")).write.json(path)
    vectors = corpus.read_vectors(spark, path, "json", "key", "values")
    probe = r._probe(spark, sf_dir)
    return index.vector_topk(index.vector_index(vectors, len(probe)), probe, 10).select("id", F.round("score", 5).alias("score"))


@query("vector_index", "select cast(vec_id as varchar) as id, cast(len(embedding) as integer) as dimensions, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))), 6) as norm from embeddings where embedding is not null")
def vector_index(spark, sf_dir):
    out = index.vector_index(r._vectors(spark, sf_dir), len(r._probe(spark, sf_dir)))
    return out.select("id", F.size("embedding").alias("dimensions"), F.round("norm", 6).alias("norm"))


@query(
    "model_prices",
    f"""with {fx.STATUTES_SQL}, s as (select count(*) * 500.0 + sum(length(txt)) / 4.0 as i, sum(length(txt)) / 4.0 * 0.35 as o from chunks)
select r_name as model, round(cast(i as double) * (r_regionkey + 1) + cast(o as double) * 2 * (r_regionkey + 1), 3) as cost from region, s""",
)
def model_prices(spark, sf_dir):
    prices = fx.table(spark, sf_dir, "region").select(F.col("r_name").alias("model"), (F.col("r_regionkey") + 1).cast("double").alias("input_price"), (2 * (F.col("r_regionkey") + 1)).cast("double").alias("output_price"))
    return cost.estimate(r._acts(spark, sf_dir), 1300, prices).select("model", F.round("cost", 3).alias("cost"))


@query("reloaded_graph", f"""{_GRAPH}, e as (select distinct src, rel, dst from edges) select 'node' as kind, label as name, count(*) as n from nodes group by 2 union all select 'edge', rel, count(*) from e group by 2 union all select 'marked', 'yes', count(*) from nodes where label = 'Nation' union all select 'after reset', '', 0""")
def reloaded_graph(spark, sf_dir):
    """Written, written again, some nodes changed, and read back: one node an id, one edge a triple. Then emptied."""
    path = storage.new_path(spark, "graph")
    nodes, edges = r._graph(spark, sf_dir)
    for _ in range(2):
        sinks.write_graph(spark, nodes, edges, path)
    marked = nodes.where(F.array_contains("labels", "Nation")).select("id", "labels", F.create_map(F.lit("mark"), F.lit("yes")).alias("properties"))
    sinks.write_graph(spark, marked, edges.limit(0), path)
    n, e = corpus.read_graph(spark, path)
    count = lambda df, kind, name: df.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    has_both = n.where("properties['mark'] is not null and properties['name'] is not null")
    out = count(n, "node", F.element_at(F.array_except("labels", F.array(F.lit("__Entity__"))), 1)).unionByName(count(e, "edge", F.col("rel"))).unionByName(count(has_both, "marked", F.col("properties")["mark"]))
    out = materialize(spark, out, "counts")
    sinks.reset_graph(spark, path)
    empty = corpus.read_graph(spark, path)[0].agg(F.count(F.lit(1)).alias("n")).select(F.lit("after reset").alias("kind"), F.lit("").alias("name"), "n")
    return out.unionByName(empty)


# Page cleanup

_MEASURED = """w as (select source as doc_id, length(rtrim(l)) as w from (select source, unnest(string_split(coalesce(text, ''), chr(10))) as l from documents where source is not null) where length(trim(l)) > 20),
m as (select doc_id, case when count(*) >= 5 then list_sort(list(w))[cast(floor(count(*) * 0.9) as integer) + 1] else 0 end as measure from w group by 1)"""
_JOIN = """list_reduce(string_split(x, chr(10)), lambda a, l: case when trim(regexp_extract(a, '[^\\n]*$')) <> '' and trim(l) <> '' and length(rtrim(regexp_extract(a, '[^\\n]*$'))) >= {measure} * 0.85
  and not regexp_matches(rtrim(a, ' '), '[.:;!?]$') and regexp_matches(ltrim(l), '^[a-zà-ÿ0-9(]') then rtrim(a, ' ') || ' ' || trim(l) else a || chr(10) || l end)"""


@query("reflowed_pages", f"""with d as (select doc_id, source, replace(coalesce(text, ''), '. ', chr(10)) as x from documents where source is not null),
q as (select doc_id, x, cast(80 + doc_id % 3 * 300 as integer) as measure from d) select doc_id, md5({_JOIN.format(measure='measure')}) as digest from q""")  # fmt: skip
def reflowed_pages(spark, sf_dir):
    """Sentences as lines, joined again where they fill a measure of 80, 380 or 680 signs."""
    docs = fx.table(spark, sf_dir, "documents").where("source is not null")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit("\n"))
    return docs.select("doc_id", _md5(clean.reflow(text, F.lit(80) + F.pmod("doc_id", F.lit(3)).cast("int") * 300)).alias("digest"))


@query("collapsed_pages", """select doc_id, md5(regexp_replace(regexp_replace(chr(10) || replace(coalesce(text, ''), '. ', '.' || repeat(chr(10), cast(1 + doc_id % 5 as integer))), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')) as digest from documents""")
def collapsed_pages(spark, sf_dir):
    gap = F.repeat(F.lit("\n"), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    text = F.concat(F.lit("\n"), F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.concat(F.lit("."), gap)))
    return fx.table(spark, sf_dir, "documents").select("doc_id", _md5(clean.collapse(text)).alias("digest"))


_SQUEEZE = """array_to_string(list_transform(string_split({x}, chr(10)), lambda x: case when trim(x) = '' then '' else repeat(' ', cast(least(4, length(x) - length(ltrim(x))) as integer)) || regexp_replace(trim(x), ' {{2,}}', ' ', 'g') end), chr(10))"""
_COLLAPSE = "regexp_replace(regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')"
_HYPHENS = "regexp_replace(regexp_replace({x}, '([\\pL\\pN_])[-‐‑]\\n([a-zà-ÿ])', '\\1\\2', 'g'), '([\\pL\\pN_])[-‐‑]\\n([a-zà-ÿ])', '\\1\\2', 'g')"


@query("plain_clean_pages", f"""with t as (select cast(conv_id as varchar) as doc_id, turn, {_COLLAPSE.format(x=_HYPHENS.format(x=_SQUEEZE.format(x="coalesce(text, '')")))} as x from conversations),
n as (select doc_id, count(*) as n_pages from t group by 1),
j as (select doc_id, string_agg(x, chr(10) || chr(10) order by turn) as x from t where trim(x) <> '' group by 1)
select doc_id, md5(coalesce(x, '')) as digest, n_pages, length(coalesce(x, '')) < 200 * n_pages as low_yield from n left join j using (doc_id)""")  # fmt: skip
def plain_clean_pages(spark, sf_dir):
    """With headers and without reflow."""
    docs, _ = clean.clean_pages(fx.conversation_pages(spark, sf_dir), keep_headers=True, no_reflow=True)
    return docs.select("doc_id", _md5(F.col("text")).alias("digest"), "n_pages", "low_yield")


_BOOK = "select source as doc_id, cast(doc_id as integer) as page, 'Book of ' || source || '  ' || doc_id || chr(10) || replace(coalesce(text, ''), '. ', '.' || chr(10)) as text from documents where source is not null"


@query(
    "clean_pages",
    f"""with b as ({_BOOK}),
l as (select doc_id, page, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as k from b),
f as (select *, lower(trim(regexp_replace(line, '[0-9]+', '#', 'g'))) as fp from l where trim(line) <> ''),
z as (select *, row_number() over (partition by doc_id, page order by k) as a, row_number() over (partition by doc_id, page order by k desc) as z from f),
p as (select doc_id, fp, count(distinct page) as n from z where (a <= 3 or z <= 3) and length(fp) > 3 group by all),
n as (select doc_id, count(*) as n_pages from b group by 1),
g as (select z.doc_id, page, k from z join p using (doc_id, fp) join n using (doc_id) where (a <= 3 or z <= 3) and n_pages >= 2 and p.n >= greatest(2, floor(n_pages * 0.5))),
s as (select l.doc_id, l.page, case when bool_and(g.k is not null) then '' else string_agg(line, chr(10) order by l.k) filter (g.k is null) end as text from l left join g on g.doc_id = l.doc_id and g.page = l.page and g.k = l.k group by all),
q as (select doc_id, page, {_SQUEEZE.format(x='text')} as x from s),
w as (select doc_id, length(rtrim(l)) as w from (select doc_id, unnest(string_split(x, chr(10))) as l from q) where length(trim(l)) > 20),
m as (select doc_id, case when count(*) >= 5 then list_sort(list(w))[cast(floor(count(*) * 0.9) as integer) + 1] else 0 end as measure from w group by 1),
h as (select doc_id, page, {_HYPHENS.format(x='x')} as x, coalesce(measure, 0) as measure from q left join m using (doc_id)),
c as (select doc_id, page, case when measure > 0 then {_JOIN.format(measure='measure')} else x end as x from h),
o as (select doc_id, page, {_COLLAPSE.format(x='x')} as x from c)
select doc_id, md5(string_agg(x, chr(10) || chr(10) order by page) filter (trim(x) <> '')) as digest from o group by 1""",
)
def clean_pages(spark, sf_dir):
    """Every source as a book with a running head, cleaned with all steps."""
    head = F.concat(F.lit("Book of "), F.col("source"), F.lit("  "), F.col("doc_id").cast("string"), F.lit("\n"))
    pages = fx.table(spark, sf_dir, "documents").where("source is not null")
    pages = pages.select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page"), F.concat(head, F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n"))).alias("text"))
    return clean.clean_pages(pages)[0].select("doc_id", _md5(F.col("text")).alias("digest"))


@query("paged_chunks", f"with {fx.STATUTES_SQL} select id, cast(least(5, char_start // 150 + 1) as integer) as page, path || ' (p. ' || least(5, char_start // 150 + 1) || ')' as path from chunks")
def paged_chunks(spark, sf_dir):
    chunks = r._acts(spark, sf_dir, once=True)
    spans = chunks.select("doc_id").distinct().withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("char_start", (F.col("page") - 1) * 150)
    return segment.stamp_pages(chunks, spans).select("id", "page", "path")


# Extraction and the closed schema


@query("prompts", f"""with {fx.STATUTES_SQL} select id, md5('Find entities and relations of this schema only. Labels: Region, Nation, Customer, Supplier, Part. Triples: (Nation)-[IN_REGION]->(Region); (Customer)-[IN_NATION]->(Nation); (Supplier)-[IN_NATION]->(Nation); (Part)-[SUPPLIED_BY]->(Supplier). Quote the words behind every relation. Leave out these relations, which are known: none.' || chr(10) || chr(10) || txt) as digest from chunks""")
def prompts(spark, sf_dir):
    return r._acts(spark, sf_dir).select("id", _md5(graph.prompt(F.col("text"), fx.trade_profile())).alias("digest"))


@query(
    "extracted_records",
    f"""with {fx.STATUTES_SQL}
select id as chunk_id, 'supplier' as node, 'Party' as label, cast(null as varchar) as error from chunks where clause <> 2 union all select id, 'modifie', 'Change', null from chunks where clause = 1
union all select id, null, null, 'ValueError: no' from chunks where clause = 2""",
)
def extracted_records(spark, sf_dir):
    """By a gazetteer, as JSON lines and back; chunks at which the extractor fails are rows with their error."""
    found = providers.get(providers.EXTRACTORS, "gazetteer")({"supplier": "Party", "modifie": "Change"})

    def extractor(chunk_id: str, text: str) -> dict:
        if ", voir" in text:
            raise ValueError("no")
        return found(chunk_id, text)

    records = materialize(spark, graph.extract(r._acts(spark, sf_dir), extractor), "records")
    path = storage.new_path(spark, "record_files")
    sinks.write_records(records.drop("error"), path)
    nodes = corpus.read_records(spark, path).select("chunk_id", F.explode("nodes").alias("n")).select("chunk_id", F.col("n.id").alias("node"), F.col("n.label").alias("label"), F.lit(None).cast("string").alias("error"))
    failed = records.where("error is not null").select("chunk_id", F.lit(None).cast("string").alias("node"), F.lit(None).cast("string").alias("label"), "error")
    return nodes.unionByName(failed)


@query(
    "prompted_graph",
    f"""with {fx.STATUTES_SQL} select id || ':s' as id, 'Supplier' as label, id as chunk_id, 'quoted' as quote from chunks union all select id || ':p', 'Part', id, 'quoted' from chunks""",
)
def prompted_graph(spark, sf_dir):
    """A model's answers (here a stand-in that reads its prompt) as nodes, edges and mentions."""

    def complete(text: str) -> str:
        import json

        part = text.split("Part ", 1)[1].split("\n", 1)[0]
        record = {"nodes": [{"id": "s", "label": "Supplier", "properties": {"name": "s"}}, {"id": "p", "label": "Part", "properties": {"name": part}}], "relationships": [{"start_node_id": "p", "end_node_id": "s", "type": "SUPPLIED_BY", "properties": {"quote": "quoted"}}]}
        return f"Here it is: {json.dumps(record)}."

    records = graph.extract(r._acts(spark, sf_dir), providers.get(providers.EXTRACTORS, "prompted")(complete), strict=True)
    nodes, edges, mentions = graph.records_to_graph(materialize(spark, records, "records"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), F.col("properties")["quote"].alias("quote"))
    return nodes.select("id", F.col("labels")[0].alias("label")).join(mentions.withColumnRenamed("node_id", "id"), "id").join(ends, "id").select("id", "label", "chunk_id", "quote")


@query(
    "closed_schema",
    f"""{_GRAPH},
k as (select id, label, 'name' as keys from nodes where label in ('Region', 'Nation', 'Supplier', 'Customer') union all select 'part:' || p_partkey, 'Part', 'name,p_brand' from part where p_partkey % 7 <> 0),
t as (select e.* from edges e join k a on a.id = e.src join k b on b.id = e.dst where (a.label, rel, b.label) in (('Nation','IN_REGION','Region'), ('Customer','IN_NATION','Nation'), ('Supplier','IN_NATION','Nation'), ('Part','SUPPLIED_BY','Supplier')))
select 'node' as kind, label as name, keys, count(*) as n from k group by all union all select 'edge', rel, case when rel = 'SUPPLIED_BY' then '' else 'quote' end, count(*) from t group by all""",
)
def closed_schema(spark, sf_dir):
    """Closed kinds lose what is undeclared, parts without their required name go; so do nodes without id, label or property, and edges without type or end."""
    closed = (Kind("Part", (("name", "STRING", True), ("p_brand", "STRING", False)), True), Kind("Customer", (("name", "STRING", False),), True))
    supplied = Kind("SUPPLIED_BY", (("since", "STRING", False),), True)
    base = fx.trade_profile()
    own = with_limits(base, labels=tuple(k for k in base.labels if k.label not in ("Part", "Customer")) + closed, relations=tuple(k for k in base.relations if k.label != "SUPPLIED_BY") + (supplied,))
    nodes, edges = r._graph(spark, sf_dir)
    nameless = F.array_contains("labels", "Part") & (F.pmod(F.element_at(F.split("id", ":"), -1).cast("long"), F.lit(7)) == 0)
    nodes = nodes.withColumn("properties", F.when(nameless, F.map_filter("properties", lambda k, v: k != "name")).otherwise(F.col("properties")))
    odd = [("", ["Part"], {"name": "x"}), (None, ["Part"], {"name": "x"}), ("region:none", ["Region"], {}), ("region:null", ["Region"], None), ("stray", ["Other"], {"name": "x"}), ("customer:odd", ["Customer"], {"mood": "x"})]
    loose = [("nation:1", "IN_REGION", "region:gone", {}), ("nation:1", "", "region:1", {}), ("nation:1", None, "region:1", {}), ("nation:1", "OTHER", "region:1", {}), ("nation:1", "IN_REGION", "region:none", {})]
    n, e = graph.prune(nodes.unionByName(spark.createDataFrame(odd, graph.NODES)), edges.unionByName(spark.createDataFrame(loose, graph.EDGES)), own)
    keys = lambda: F.array_join(F.array_sort(F.map_keys("properties")), ",").alias("keys")
    label = F.element_at(F.array_except("labels", F.array(F.lit("__Entity__"))), 1)
    counted = lambda df, kind, name: df.select(F.lit(kind).alias("kind"), name.alias("name"), keys()).groupBy("kind", "name", "keys").agg(F.count(F.lit(1)).alias("n"))
    return counted(n, "node", label).unionByName(counted(e, "edge", F.col("rel")))


# Resolution


@query(
    "fuzzy_classes",
    f"""with recursive {r._NAMES},
l as (select x.id as a, y.id as b from k x join k y on x.key <> y.key and abs(length(x.key) - length(y.key)) <= 0.2 * greatest(length(x.key), length(y.key)) + 1 where 1 - levenshtein(x.key, y.key) / greatest(length(x.key), length(y.key)) >= 0.8),
c as (select id as a, id as b from k union select c.a, l.b from c join l on l.a = c.b),
m as (select a, min(b) as canonical from c group by 1)
select 'part:' || p_partkey as id, m.canonical from part join k on k.key = lower(trim(p_name)) join m on m.a = k.id""",
)
def fuzzy_classes(spark, sf_dir):
    return resolve.fuzzy(spark, resolve.scoped(fx.trade_nodes(spark, sf_dir), ("Part",)), 0.8)


_NEAR = """v as (select cast(vec_id as varchar) as id, cast(vec_id % 3 as varchar) as label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
p as (select x.id as a, y.id as b, list_cosine_similarity(x.e, y.e) as score from v x join v y on x.label = y.label and x.id < y.id where list_cosine_similarity(x.e, y.e) >= 0.35)"""


def _sorts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    own = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.pmod("vec_id", F.lit(3)).cast("string").alias("label"), F.col("vec_id").cast("string").alias("name"), "embedding")
    return own.select("id", "label", "name"), own.select("id", "embedding")


@query("semantic_pairs", f"with {_NEAR} select a, b, round(score, 5) as score from p")
def semantic_pairs(spark, sf_dir):
    return resolve.semantic_pairs(*_sorts(spark, sf_dir), 0.35).select("a", "b", F.round("score", 5).alias("score"))


@query("semantic_classes", f"""with recursive {_NEAR}, l as (select a, b from p union select b, a from p), c as (select id as a, id as b from v union select c.a, l.b from c join l on l.a = c.b) select a as id, min(b) as canonical from c group by 1""")
def semantic_classes(spark, sf_dir):
    return resolve.semantic(spark, *_sorts(spark, sf_dir), 0.35)


@query(
    "merged_nodes",
    """with c as (select p_partkey, p_name, p_brand, min('part:' || p_partkey) over (partition by p_name) as canonical from part),
g as (select canonical, count(*) as n, max(p_name) as name, max(p_brand) filter ('part:' || p_partkey = canonical) as brand from c group by 1)
select canonical as id, name, brand, 'Part,__Entity__' || case when n > 1 then ',Resolved' else '' end as labels from g""",
)
def merged_nodes(spark, sf_dir):
    nodes = fx.trade_nodes(spark, sf_dir).where(F.array_contains("labels", "Part"))
    merged, _ = resolve.merge(nodes, fx.trade_edges(spark, sf_dir).limit(0), resolve.exact(resolve.scoped(nodes, ("Part",))))
    return merged.select("id", F.col("properties")["name"].alias("name"), F.col("properties")["p_brand"].alias("brand"), F.array_join("labels", ",").alias("labels"))


_VOTES = ", ".join(
    f"v{k} as (select b.a as node, l.community, count(*) as n from b join l{k - 1} l on l.node = b.b group by all), l{k} as (select node, arg_min(community, {{'n': -n, 'c': community}}) as community from v{k} group by 1)" for k in range(1, 9)
)
_COMMUNITIES = f"""{_GRAPH}, e as (select src, dst from edges where rel in ('IN_REGION', 'IN_NATION') and src not like 'part:%'),
b as (select src as a, dst as b from e union select dst, src from e), l0 as (select distinct a as node, a as community from b), {_VOTES}"""


def _places(spark, sf_dir) -> DataFrame:
    return fx.trade_edges(spark, sf_dir).where("rel in ('IN_REGION', 'IN_NATION') and src not like 'part:%'")


@query("communities", f"{_COMMUNITIES} select node, community from l8")
def communities(spark, sf_dir):
    return resolve.communities(spark, _places(spark, sf_dir))


@query(
    "community_summaries",
    f"""{_COMMUNITIES},
d as (select node, count(*) as degree from (select src as node from e union all select dst from e) group by 1),
r as (select community, name, row_number() over (partition by community order by degree desc nulls last, l8.node) as k from l8 left join d using (node) left join nodes on nodes.id = l8.node),
i as (select x.community, count(*) as n from e join l8 x on x.node = src join l8 y on y.node = dst where x.community = y.community group by 1)
select c.community, c.size, coalesce(i.n, 0) as inner_edges, (select string_agg(name, '|' order by k) from r where r.community = c.community and k <= 5) as names from (select community, count(*) as size from l8 group by 1) c left join i on i.community = c.community""",
)
def community_summaries(spark, sf_dir):
    edges = materialize(spark, _places(spark, sf_dir), "places")
    out = resolve.community_summaries(fx.trade_nodes(spark, sf_dir), edges, resolve.communities(spark, edges))
    return out.select("community", "size", F.col("inner").alias("inner_edges"), F.array_join("names", "|").alias("names"))


# Retrieval


def _library(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents as chunks, each but every third with a recipe of its source's ingredient; ingredients of sources with an even number of letters hold an allergen."""
    docs = fx.table(spark, sf_dir, "documents").where("source is not null")
    i = F.col("doc_id").cast("string")
    props = lambda **p: F.create_map(*(x for k, v in p.items() for x in (F.lit(k), v))).alias("properties")
    none = F.create_map().cast("map<string,string>").alias("properties")
    label = lambda name: F.array(F.lit(name)).alias("labels")
    recipe, source = F.concat(F.lit("recipe:"), i), F.concat(F.lit("source:"), F.col("source"))
    nodes = fx.table(spark, sf_dir, "documents").select(i.alias("id"), label("Chunk"), props(text=F.left(F.coalesce("text", F.lit("")), F.lit(20)), path=F.concat(F.lit("p"), i)))
    nodes = nodes.unionByName(docs.where("doc_id % 3 <> 0").select(recipe.alias("id"), label("Recipe"), props(name=recipe, servings=F.lit("2"))))
    nodes = nodes.unionByName(docs.select("source").distinct().select(source.alias("id"), label("Ingredient"), props(name=F.col("source"))))
    nodes = nodes.unionByName(spark.createDataFrame([("even", ["Allergen"], {"name": "even"})], graph.NODES))
    edges = docs.where("doc_id % 3 <> 0").select(recipe.alias("src"), F.lit("PART_OF_CHUNK").alias("rel"), i.alias("dst"), none)
    edges = edges.unionByName(docs.where("doc_id % 3 <> 0").select(recipe.alias("src"), F.lit("USES_INGREDIENT").alias("rel"), source.alias("dst"), props(amount=F.lit("1"), unit=F.lit("g"))))
    even = docs.select("source").distinct().where(F.length("source") % 2 == 0)
    return nodes, edges.unionByName(even.select(source.alias("src"), F.lit("CONTAINS_ALLERGEN").alias("rel"), F.lit("even").alias("dst"), none))


def _search(spark, sf_dir, mode: str) -> DataFrame:
    nodes, edges = _library(spark, sf_dir)
    postings, lengths = r._texts(spark, sf_dir)
    found = retrieve.search(nodes, edges, r._vectors(spark, sf_dir), postings, lengths, r.QUESTION, r._probe(spark, sf_dir), COOKBOOK, 10, mode, {"exclude_allergens": ["even"]})
    return found.select("chunk_id", F.md5("text").alias("digest"), "recipe", F.array_join("ingredients", "|").alias("ingredients"), F.round("similarity", 5).alias("similarity"))


_FOUND = """select s.id as chunk_id, md5(left(coalesce(d.text, ''), 20)) as digest, case when d.doc_id % 3 <> 0 and d.source is not null then 'recipe:' || s.id end as recipe,
  case when d.doc_id % 3 <> 0 and d.source is not null then d.source || ' 1 g' else '' end as ingredients, round(s.score, 5) as similarity
from s join documents d on cast(d.doc_id as varchar) = s.id where d.doc_id % 3 = 0 or d.source is null or length(d.source) % 2 <> 0"""


@query("search_vector", f"with {r._V}, s as (select * from vt) {_FOUND}")
def search_vector(spark, sf_dir):
    return _search(spark, sf_dir, "vector")


@query("search_text", f"with {r._B}, s as (select * from bt) {_FOUND}")
def search_text(spark, sf_dir):
    return _search(spark, sf_dir, "text")


@query(
    "search_hybrid",
    f"""with {r._V}, {r._B}, f as (select coalesce(vt.id, bt.id) as id, greatest(coalesce(vt.score / (select max(score) from vt), 0), coalesce(bt.score / (select max(score) from bt), 0)) as score from vt full join bt on vt.id = bt.id),
s as (select id, score from f order by score desc, id limit 10) {_FOUND}""",
)
def search_hybrid(spark, sf_dir):
    return _search(spark, sf_dir, "hybrid")


@query("answered_question", f"with {r._B}, t2 as (select row_number() over (order by bt.score desc, bt.id) as k, left(coalesce(d.text, ''), 20) as t from bt join documents d on cast(d.doc_id as varchar) = bt.id) select string_agg('[' || k || '] ' || t, chr(10) order by k) as answer from t2")
def answered_question(spark, sf_dir):
    """The best chunks' texts given to the answerer that quotes them."""
    nodes, edges = _library(spark, sf_dir)
    postings, lengths = r._texts(spark, sf_dir)
    found = retrieve.search(nodes, edges, r._vectors(spark, sf_dir), postings, lengths, r.QUESTION, [1.0], COOKBOOK, 10, "text")
    return spark.createDataFrame([(retrieve.answer(found, r.QUESTION, providers.get(providers.ANSWERERS, "quoting")()),)], "answer string")


@query("template_counts", f"""{_GRAPH} select 'label' as kind, label as name, count(*) as n from nodes group by 2 union all select 'label', '__Entity__', count(*) from nodes
union all select 'relation', rel, count(*) from edges group by 2 union all select 'from', label, count(*) from nodes join edges on id = src group by 2 union all select 'from', '__Entity__', count(*) from nodes join edges on id = src""")  # fmt: skip
def template_counts(spark, sf_dir):
    nodes, edges = r._graph(spark, sf_dir)
    run = lambda kind, template: retrieve.count(nodes, edges, template).select(F.lit(kind).alias("kind"), "name", "n")
    return run("label", "count nodes by label").unionByName(run("relation", "count edges by relation")).unionByName(run("from", "count edges from nodes by label"))


@query(
    "routed_questions",
    """with q as (select conv_id, turn, coalesce(text, '') || case turn % 4 when 0 then ' How many?' when 1 then ' article 12' when 2 then ' why so' else '' end as q from conversations)
select conv_id, turn, case when regexp_matches(lower(q), '\\b(how many|count|number of|combien|total|average|most|least)\\b') then 'count'
  when regexp_matches(lower(q), '\\b(related|depends?|connected|exceptions?|refers?|why|lien)\\b') then 'expand' when regexp_matches(lower(q), '"[^"]+"|\\b(article|section|chapter)\\s+\\d+') then 'text' else 'hybrid' end as tool from q""",
)
def routed_questions(spark, sf_dir):
    tail = F.element_at(F.array(F.lit(" How many?"), F.lit(" article 12"), F.lit(" why so"), F.lit("")), (F.pmod("turn", F.lit(4)) + 1).cast("int"))
    rows = fx.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", retrieve.routes(F.concat(F.coalesce("text", F.lit("")), tail)).alias("tool"))


@query("reranked", "select * from (select 'order:' || o_orderkey as id, cast(o_orderkey % 10 as double) as score, cast(o_custkey % 3 as integer) as hop from orders) order by score desc, hop, id limit 100")
def reranked(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), F.pmod("o_orderkey", F.lit(10)).cast("double").alias("score"), F.pmod("o_custkey", F.lit(3)).cast("int").alias("hop"))
    return retrieve.rerank(rows, 100)


@query("visible_rows", "select 'order:' || o_orderkey as id from orders where o_orderstatus = 'F' or (o_custkey % 5 = 0 and (o_orderkey % 4 = 0 or cast(o_orderdate as date) > date '1996-01-01'))")
def visible_rows(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    end = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate").cast("date"))
    rows = orders.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), F.pmod("o_custkey", F.lit(5)).cast("string").alias("owner"), (F.col("o_orderstatus") == "F").alias("public"), end.alias("valid_to"))
    return retrieve.visible(rows, "0", datetime.date(1996, 1, 1)).select("id")


@query(
    "embedded_names",
    """with n as (select p_partkey, ' ' || lower(p_name) || ' ' as t from part where p_name is not null),
g as (select p_partkey, cast('0x' || substr(md5(substr(t, cast(i as integer), 3)), 1, 15) as bigint) as h from (select p_partkey, t, unnest(range(1, length(t) - 1)) as i from n)),
s as (select p_partkey, h % 16 as k, cast(sum(case when h // 16 % 2 = 1 then 1 else -1 end) as double) as x from g group by all),
z as (select p_partkey, sqrt(sum(x * x)) as size from s group by 1)
select cast(p_partkey as varchar) as id, cast(k as integer) as place, round(x / size, 5) as value from s join z using (p_partkey) where x <> 0""",
)
def embedded_names(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "part").where("p_name is not null").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("text"))
    out = index.embed(rows, providers.get(providers.EMBEDDERS, "hashed")(16))
    return out.select("id", F.posexplode("embedding").alias("place", "value")).where("value <> 0").select("id", "place", F.round(F.col("value").cast("double"), 5).alias("value"))


@query(
    "searched_recall",
    f"""with t as (select cast(doc_id as varchar) as id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') as t from documents),
z as (select count(*) as n, avg(len(t)) as mean from t),
p as (select id, w as term, count(*) as tf from (select id, unnest(t) as w from t) where w in ('the', 'nation', 'und', 'los') group by all),
df as (select term, count(*) as df from p group by 1),
s as (select p.term, p.id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t.t) / mean)) as score from p join df using (term) join t using (id) cross join z),
k as (select term, id, row_number() over (partition by term order by score desc, id) as rank from s),
g as (select term, min(id) as gold from s group by 1 union all select 'thing', 'none')
select 5 as k, count(*) as questions, round(avg(case when exists (select 1 from k where k.term = g.term and rank <= 5 and k.id = g.gold) then 1.0 else 0.0 end), 6) as recall from g""",
)
def searched_recall(spark, sf_dir):
    """Recall of searches that are run: each question's gold chunk is the first by id that has its word."""
    postings, lengths = (materialize(spark, x, "words") for x in r._texts(spark, sf_dir))
    questions = ("the", "nation", "und", "los")
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # at most five rows
    found = None
    for q in questions:
        top = index.bm25(postings, lengths, q, 5).select(F.lit(q).alias("question"), place.alias("rank"), F.col("id").alias("chunk_id"))
        found = top if found is None else found.unionByName(top)
    gold = postings.where(F.col("term").isin(*questions)).groupBy(F.col("term").alias("question")).agg(F.min("id").alias("chunk_id"))
    gold = gold.unionByName(spark.createDataFrame([("thing", "none")], "question string, chunk_id string"))
    return retrieve.recall_at_k(found, gold, 5).withColumn("recall", F.round("recall", 6))


@query(
    "capped_neighbourhood",
    f"""{_GRAPH}, b as (select src, dst from edges where rel in ('IN_REGION', 'IN_NATION') union select dst, src from edges where rel in ('IN_REGION', 'IN_NATION')),
s as (select id as node from nodes where label = 'Region'), h1 as (select distinct s.node as seed, b.dst as node from s join b on b.src = s.node), h2 as (select distinct h1.seed, b.dst as node from h1 join b on b.src = h1.node),
w as (select seed, node, min(hop) as hop from (select node as seed, node, 0 as hop from s union all select seed, node, 1 from h1 union all select seed, node, 2 from h2) group by 1, 2),
k as (select *, row_number() over (partition by seed order by hop, node) as k from w)
select seed, node, cast(hop as integer) as hop from k where k <= 12""",
)
def capped_neighbourhood(spark, sf_dir):
    nodes, edges = r._graph(spark, sf_dir)
    return graph.neighbourhood(edges, nodes.where(F.array_contains("labels", "Region")).select("id"), 2, ("IN_REGION", "IN_NATION"), limit=12)


@query("profile_files", "select 'written' as profile, 5 as levels, true as same")
def profile_files(spark, sf_dir):
    """A profile as YAML in the shared folder's stead (a file of the driver's), found by its name and checked; its marks are the preset's."""
    import os
    import tempfile

    import yaml

    from tessera import profile as pf

    own = {"name": "written", "segmentation": {"hierarchy": [{"level": x.name, "pattern": x.pattern} for x in STATUTES.levels], "chunk_at": STATUTES.chunk_at, "xref_patterns": [{"name": x.name, "pattern": x.pattern, "target_level": x.target_level, "relation": x.relation} for x in STATUTES.references]}}
    with tempfile.TemporaryDirectory() as folder:
        with open(os.path.join(folder, "written.yml"), "w", encoding="utf-8") as f:
            yaml.safe_dump(own, f, allow_unicode=True)
        loaded = pf.load("written", (folder,))
    acts = fx.statutes(spark, sf_dir)
    marks = lambda p: segment.heading_marks(acts, p).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc_id", "pos", "level", "number", "title")).alias("x"))
    a, b = marks(loaded).withColumnsRenamed({"n": "n2", "x": "x2"}).withColumn("one", F.lit(1)), marks(STATUTES).withColumn("one", F.lit(1))
    return a.join(b, "one").select(F.lit(loaded.name).alias("profile"), F.lit(len(loaded.levels)).alias("levels"), ((F.col("n") == F.col("n2")) & (F.col("x") == F.col("x2"))).alias("same"))


