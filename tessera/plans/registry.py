"""Every registered query and, where SQL can say it, its twin for an independent engine."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import clean, cost, graph, index, resolve, retrieve, segment, validate, xref
from tessera.plans import fixtures as fx
from tessera.profile import STATUTES, with_limits
from tessera.sources.storage import materialize

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict:
    from tessera.plans import more  # noqa: F401  registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from tessera.plans import more  # noqa: F401

    return dict(_SQL)


# Segmentation


def _acts(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """The acts' chunks; once: written as a table, for plans that read them several times."""
    chunks = segment.segment(fx.statutes(spark, sf_dir), STATUTES)
    return materialize(spark, chunks, "chunks") if once else chunks


@query("segment_chunks", f"with {fx.STATUTES_SQL} select id, doc_id, path, number, title, txt as text, char_start, char_end from chunks")
def segment_chunks(spark, sf_dir):
    return _acts(spark, sf_dir).select("id", "doc_id", "path", "number", "title", "text", "char_start", "char_end")


@query(
    "heading_marks",
    f"""with {fx.STATUTES_SQL}
select doc_id, cast(char_start - 1 as integer) as pos, 'article' as level, number, title from chunks
union all select distinct doc_id, 0, 'titre', 'I', 'Order ' || l_orderkey from worded""",
)
def heading_marks(spark, sf_dir):
    return segment.heading_marks(fx.statutes(spark, sf_dir), STATUTES).drop("rank")


@query(
    "oversize_split",
    f"""with {fx.STATUTES_SQL},
cut as (select doc_id, path, char_start + o as char_start, substr(txt, cast(o + 1 as integer), 40) as text from (select *, unnest(range(0, length(txt), 40)) as o from chunks where length(txt) > 40)
  union all select doc_id, path, char_start, txt from chunks where length(txt) <= 40)
select substr(sha1(doc_id || '||' || path || '||' || char_start), 1, 16) as id, doc_id, cast(char_start as integer) as char_start, cast(char_start + length(text) as integer) as char_end, text from cut""",
)
def oversize_split(spark, sf_dir):
    return segment.segment(fx.statutes(spark, sf_dir), with_limits(STATUTES, max_chars=40, split_at=None)).select("id", "doc_id", "char_start", "char_end", "text")


@query(
    "fallback_chunk",
    """select substr(sha1(doc_id || '||0'), 1, 16) as id, cast(doc_id as varchar) as doc_id, cast(doc_id as varchar) as path, 'document' as level, 0 as char_start,
  cast(length(coalesce(text, '')) as integer) as char_end, md5(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) as digest from documents""",
)
def fallback_chunk(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return segment.segment(docs, STATUTES).select("id", "doc_id", "path", "level", "char_start", "char_end", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "markup_segments",
    """with p as (select page_id, html, unnest(range(2, len(string_split(html, '<p>')) + 1)) as k from pages),
b as (select page_id, k, string_split(html, '<p>')[k] as body, length(array_to_string(list_slice(string_split(html, '<p>'), 1, k - 1), '<p>')) as pos from p)
select cast(page_id as varchar) as doc_id, cast(pos as integer) as pos, md5(regexp_extract(body, '^([^<]*)', 1)) as digest from b""",
)
def markup_segments(spark, sf_dir):
    """Every paragraph of the pages with its place and its whole text up to the first tag in it."""
    docs = fx.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.col("html").alias("text"))
    marks = segment.heading_marks(docs, fx.markup_profile()).where("level = 'paragraph'").select("doc_id", "pos")
    whole = F.regexp_extract(F.substring("text", F.col("pos") + 4, F.length("text")), "^([^<]*)", 1)
    return marks.join(docs, "doc_id").select("doc_id", "pos", F.md5(whole.cast("binary")).alias("digest"))


@query(
    "chunk_statistics",
    f"""with {fx.XREFS_SQL.replace('xrefs as (', 'unused as (')},
refs as (select c.id as chunk_id, c.doc_id, case c.clause when 0 then 'EXCEPTION_TO' when 1 then 'AMENDS' else 'REFERS_TO' end as relation, c.cited as raw, t.id as target
  from chunks c left join chunks t on t.doc_id = c.doc_id and t.number = c.cited where c.clause < 3 and t.id is distinct from c.id)
select count(distinct doc_id) as documents, count(*) as chunks, cast(max(length(txt)) as integer) as max_chars, cast(0 as bigint) as paged_chunks,
  cast((select list_sort(list(length(txt)))[cast(floor(count(*) / 2) as integer) + 1] from chunks) as integer) as median_chars,
  (select count(*) from refs) as xrefs, (select count(target) from refs) as resolved, count(distinct doc_id) = count(*) as one_chunk_per_document from chunks""",
)
def chunk_statistics(spark, sf_dir):
    chunks = _acts(spark, sf_dir, once=True)
    return segment.statistics(chunks, xref.cross_references(chunks, STATUTES, "document"))


# Cross-references

_ALL_REFS = f"""with {fx.STATUTES_SQL},
refs as (select id as chunk_id, doc_id, 'REFERS_TO' as relation, number as raw, 0 as k from chunks
  union all select id, doc_id, 'REFERS_TO', cited, 1 from chunks where clause < 3
  union all select id, doc_id, 'EXCEPTION_TO', cited, 2 from chunks where clause = 0
  union all select id, doc_id, 'AMENDS', cited, 2 from chunks where clause = 1)"""


@query("xref_scan", f"{_ALL_REFS} select chunk_id, relation, raw, count(*) as n from refs group by all")
def xref_scan(spark, sf_dir):
    return xref.scan(_acts(spark, sf_dir), STATUTES).groupBy("chunk_id", "relation", "raw").agg(F.count(F.lit(1)).alias("n"))


@query(
    "xref_resolve",
    f"""{_ALL_REFS},
targets as (select number, arg_max(id, doc_id) as target_chunk_id from chunks group by number),
met as (select r.*, t.target_chunk_id from refs r left join targets t on t.number = r.raw where t.target_chunk_id is distinct from r.chunk_id)
select distinct chunk_id, doc_id, relation, raw, target_chunk_id from met m
where relation <> 'REFERS_TO' or not exists (select 1 from met s where s.chunk_id = m.chunk_id and s.raw = m.raw and s.relation <> 'REFERS_TO')""",
)
def xref_resolve(spark, sf_dir):
    return xref.cross_references(_acts(spark, sf_dir, once=True), STATUTES).select("chunk_id", "doc_id", "relation", "raw", "target_chunk_id")


_SCOPED = f"""with {fx.STATUTES_SQL},
refs as (select c.id as chunk_id, c.doc_id, case c.clause when 0 then 'EXCEPTION_TO' when 1 then 'AMENDS' else 'REFERS_TO' end as relation, c.cited as raw, t.id as target_chunk_id
  from chunks c left join chunks t on t.doc_id = c.doc_id and t.number = c.cited where c.clause < 3 and t.id is distinct from c.id)"""


@query("xref_in_document", f"{_SCOPED} select * from refs")
def xref_in_document(spark, sf_dir):
    return xref.cross_references(_acts(spark, sf_dir, once=True), STATUTES, "document").select("chunk_id", "doc_id", "relation", "raw", "target_chunk_id")


@query("xref_attached", f"{_SCOPED} select c.id, (select count(*) from refs r where r.chunk_id = c.id) as n_xrefs, coalesce((select min(relation || ':' || raw) from refs r where r.chunk_id = c.id), '') as first_xref from chunks c")
def xref_attached(spark, sf_dir):
    chunks = _acts(spark, sf_dir, once=True)
    out = xref.attach(chunks, xref.cross_references(chunks, STATUTES, "document"))
    first = F.array_min(F.transform("xrefs", lambda x: F.concat_ws(":", x["relation"], x["raw"])))
    return out.select("id", F.size("xrefs").cast("long").alias("n_xrefs"), F.coalesce(first, F.lit("")).alias("first_xref"))


@query("parser_edges", f"{_SCOPED} select chunk_id as src, relation as rel, target_chunk_id as dst, raw, 'parser' as source from refs where target_chunk_id is not null")
def parser_edges(spark, sf_dir):
    chunks = _acts(spark, sf_dir, once=True)
    edges = graph.parser_edges(xref.cross_references(chunks, STATUTES, "document"), chunks)
    return edges.select("src", "rel", "dst", F.col("properties")["raw"].alias("raw"), F.col("properties")["source"].alias("source"))


@query("next_chunk", f"with {fx.STATUTES_SQL} select * from (select id as src, lead(id) over (partition by doc_id order by char_start) as dst from chunks) where dst is not null")
def next_chunk(spark, sf_dir):
    return graph.lexical_graph(_acts(spark, sf_dir))[1].where("rel = 'NEXT_CHUNK'").select("src", "dst")


@query("lexical_graph", f"with {fx.STATUTES_SQL} select 'Document' as label, doc_id as id, doc_id as path from (select distinct doc_id from chunks) union all select 'Chunk', id, path from chunks")
def lexical_graph(spark, sf_dir):
    return graph.lexical_graph(_acts(spark, sf_dir, once=True))[0].select(F.col("labels")[0].alias("label"), "id", F.col("properties")["path"].alias("path"))


@query(
    "cost_estimate",
    f"""with {fx.STATUTES_SQL}, s as (select count(*) as chunks, cast(sum(length(txt)) as bigint) as body_chars from chunks),
t as (select *, chunks * (1300 + 700) / 4.0 + body_chars / 4.0 as input_tokens, body_chars / 4.0 * 0.35 as output_tokens, chunks * (1300 + 700) / 4.0 as fixed from s)
select chunks, body_chars, round(cast(input_tokens as double), 4) as input_tokens, round(cast(output_tokens as double), 4) as output_tokens, round(cast(fixed / input_tokens as double), 6) as schema_share, fixed / input_tokens > 0.4 as schema_heavy from t""",
)
def cost_estimate(spark, sf_dir):
    return cost.estimate(_acts(spark, sf_dir), 1300).withColumns({"input_tokens": F.round("input_tokens", 4), "output_tokens": F.round("output_tokens", 4), "schema_share": F.round("schema_share", 6)})


# Pages

_LINES = """l as (select source as doc_id, doc_id as page, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as k from documents where source is not null),
f as (select *, lower(trim(regexp_replace(line, '[0-9]+', '#', 'g'))) as fp from l where trim(line) <> ''),
r as (select *, row_number() over (partition by doc_id, page order by k) as a, row_number() over (partition by doc_id, page order by k desc) as z from f),
prints as (select doc_id, fp as fingerprint, count(distinct page) as pages from r where (a <= 3 or z <= 3) and length(fp) > 3 group by all),
n as (select source as doc_id, count(*) as n_pages from documents where source is not null group by 1),
running as (select p.doc_id, fingerprint, pages from prints p join n using (doc_id) where n_pages >= 2 and pages >= greatest(2, floor(n_pages * 0.02)))"""


@query("running_lines", f"with {_LINES} select * from running")
def running_lines(spark, sf_dir):
    return clean.running_lines(fx.source_pages(spark, sf_dir), 0.02)


@query(
    "strip_running_lines",
    f"""with {_LINES},
gone as (select r.doc_id, r.page, count(*) as n, sum(length(r.line) + 1) as chars from r join running u on u.doc_id = r.doc_id and u.fingerprint = r.fp where r.a <= 3 or r.z <= 3 group by all)
select d.source as doc_id, cast(d.doc_id as integer) as page, cast(length(coalesce(d.text, '')) - coalesce(g.chars, 0)
  + case when g.n = len(string_split(d.text, chr(10))) then 1 else 0 end as integer) as chars from documents d left join gone g on g.doc_id = d.source and g.page = d.doc_id where d.source is not null""",
)
def strip_running_lines(spark, sf_dir):
    pages = fx.source_pages(spark, sf_dir)
    return clean.strip_running(pages, clean.running_lines(pages, 0.02)).select("doc_id", "page", F.length("text").alias("chars"))


@query(
    "full_measure",
    """with w as (select source as doc_id, length(rtrim(l)) as w from (select source, unnest(string_split(coalesce(text, ''), chr(10))) as l from documents where source is not null) where length(trim(l)) > 20),
m as (select doc_id, list_sort(list(w)) as s from w group by 1)
select d.doc_id, cast(case when len(s) >= 5 then s[cast(floor(len(s) * 0.9) as integer) + 1] else 0 end as integer) as measure from (select distinct source as doc_id from documents where source is not null) d left join m using (doc_id)""",
)
def full_measure(spark, sf_dir):
    return clean.full_measure(fx.source_pages(spark, sf_dir))


_TALK = """t as (select cast(conv_id as varchar) as doc_id, cast(turn as integer) as page, text from conversations where trim(coalesce(text, '')) <> ''),
m as (select doc_id, page, text, coalesce(sum(length(text) + 2) over (partition by doc_id order by page rows between unbounded preceding and 1 preceding), 0) as s from t),
pm as (select doc_id, page, cast(s as integer) as char_start, cast(s + length(text) as integer) as char_end from m)"""


@query("page_map", f"with {_TALK} select * from pm")
def page_map(spark, sf_dir):
    return clean.assemble(fx.conversation_pages(spark, sf_dir))[1]


@query("assembled_pages", f"with {_TALK} select doc_id, md5(string_agg(text, chr(10) || chr(10) order by page)) as digest from t group by 1")
def assembled_pages(spark, sf_dir):
    docs = clean.assemble(fx.conversation_pages(spark, sf_dir))[0]
    return docs.where("text <> ''").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "page_asof",
    f"""with {_TALK}, o as (select doc_id, unnest(range(0, 3000, 250)) as pos from (select distinct doc_id from pm))
select doc_id, cast(pos as integer) as pos, (select page from pm where pm.doc_id = o.doc_id and pm.char_start <= o.pos order by char_start desc limit 1) as page from o""",
)
def page_asof(spark, sf_dir):
    spans = clean.assemble(fx.conversation_pages(spark, sf_dir))[1]
    per = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("char_start", "page"))).alias("pages"))
    return per.select("doc_id", "pages", F.explode(F.sequence(F.lit(0), F.lit(2750), F.lit(250))).alias("pos")).select("doc_id", "pos", segment.page_of(F.col("pages"), F.col("pos")).alias("page"))


@query("squeeze_spaces", """select doc_id, md5(array_to_string(list_transform(string_split(replace(coalesce(text, ''), ' ', '  '), chr(10)),
  lambda x: case when trim(x) = '' then '' else repeat(' ', cast(least(4, length(x) - length(ltrim(x))) as integer)) || regexp_replace(trim(x), ' {2,}', ' ', 'g') end), chr(10))) as digest from documents""")  # fmt: skip
def squeeze_spaces(spark, sf_dir):
    wide = F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit("  "))
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.md5(clean.squeeze(wide).cast("binary")).alias("digest"))


_BROKEN = "regexp_replace(coalesce(text, ''), '([a-z])([a-z])([a-z]{2})', '\\1-' || chr(10) || '\\2\\3', 'g')"
_HYPHEN = r"([\pL\pN_])[-‐‑]\n([a-zà-ÿ])"


@query("dehyphenate", f"select doc_id, md5(regexp_replace(regexp_replace({_BROKEN}, '{_HYPHEN}', '\\1\\2', 'g'), '{_HYPHEN}', '\\1\\2', 'g')) as digest from documents")
def dehyphenate(spark, sf_dir):
    """All documents, with more words broken than they have."""
    broken = F.regexp_replace(F.coalesce("text", F.lit("")), "([a-z])([a-z])([a-z]{2})", "$1-\n$2$3")
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.md5(clean.dehyphenate(broken).cast("binary")).alias("digest"))


# The graph

_G = f"with {fx.GRAPH_SQL}"


def _graph(spark, sf_dir):
    return fx.trade_nodes(spark, sf_dir), fx.trade_edges(spark, sf_dir)


@query("label_hist", f"{_G} select label, count(*) as n from nodes group by 1 union all select '__Entity__', count(*) from nodes")
def label_hist(spark, sf_dir):
    return graph.label_histogram(fx.trade_nodes(spark, sf_dir))


@query("rel_hist", f"{_G} select rel, count(*) as n from edges group by 1")
def rel_hist(spark, sf_dir):
    return graph.relation_histogram(fx.trade_edges(spark, sf_dir))


@query("triple_hist", f"{_G} select a.label as src_label, e.rel, b.label as dst_label, count(*) as n from edges e join nodes a on a.id = e.src join nodes b on b.id = e.dst group by all")
def triple_hist(spark, sf_dir):
    own = lambda c: F.array_join(F.array_except(c, F.array(F.lit("__Entity__"))), "+")
    return graph.triples(*_graph(spark, sf_dir)).select(own("src_labels").alias("src_label"), "rel", own("dst_labels").alias("dst_label"), "n")


@query("stray_labels", f"{_G} select label, count(*) as n from nodes where label = 'Purchase' group by 1")
def stray_labels(spark, sf_dir):
    return validate.stray_labels(fx.trade_nodes(spark, sf_dir), fx.trade_profile())


@query("stray_relations", f"{_G} select rel, count(*) as n from edges where rel = 'PLACED_OPEN' group by 1")
def stray_relations(spark, sf_dir):
    return validate.stray_relations(fx.trade_edges(spark, sf_dir), fx.trade_profile())


@query(
    "pattern_violations",
    f"""{_G} select a.label as src_label, e.rel, b.label as dst_label, count(*) as n from edges e join nodes a on a.id = e.src join nodes b on b.id = e.dst
where a.label <> 'Purchase' and b.label <> 'Purchase' and rel <> 'PLACED_OPEN' and (a.label, e.rel, b.label) not in (('Nation','IN_REGION','Region'), ('Customer','IN_NATION','Nation'), ('Supplier','IN_NATION','Nation'), ('Part','SUPPLIED_BY','Supplier')) group by all""",
)
def pattern_violations(spark, sf_dir):
    own = lambda c: F.array_join(F.array_except(c, F.array(F.lit("__Entity__"))), "+")
    return validate.pattern_violations(*_graph(spark, sf_dir), fx.trade_profile()).select(own("src_labels").alias("src_label"), "rel", own("dst_labels").alias("dst_label"), "n")


@query(
    "hub_nodes",
    f"""{_G}, d as (select id, count(*) as degree from (select src as id from edges union all select dst from edges where src <> dst) group by 1)
select n.id, n.name, d.degree from nodes n join d using (id) where degree > 40 and lower(coalesce(name, '')) not in ('japan', 'china') order by degree desc, id limit 20""",
)
def hub_nodes(spark, sf_dir):
    return validate.hubs(*_graph(spark, sf_dir), fx.trade_profile(), top=20).select("id", "name", "degree")


@query("orphans", f"{_G} select label, count(*) as n from nodes n where label in ('Part', 'Supplier') and not (label = 'Part' and cast(split_part(id, ':', 2) as bigint) % 3 = 0) group by 1")
def orphans(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    part = nodes.where(F.array_contains("labels", "Part") & (F.pmod(F.element_at(F.split("id", ":"), 2).cast("long"), F.lit(3)) == 0))
    linked = part.select(F.col("id").alias("src"), F.lit("PART_OF_CHUNK").alias("rel"), F.lit("c").alias("dst"), F.create_map().cast("map<string,string>").alias("properties"))
    return validate.orphans(nodes, edges.unionByName(linked), fx.trade_profile())


@query("provenance_coverage", f"{_G} select count(*) as total, count(*) filter (quote <> '') as covered, round(count(*) filter (quote <> '') / count(*), 9) as coverage from edges")
def provenance_coverage(spark, sf_dir):
    return validate.provenance(fx.trade_edges(spark, sf_dir)).withColumn("coverage", F.round("coverage", 9))


@query("duplicate_names", f"{_G} select label, lower(trim(name)) as key, count(*) as n, string_agg(distinct name, '|' order by name) as names from nodes where name is not null group by all having count(*) > 1")
def duplicate_names(spark, sf_dir):
    found = validate.duplicate_names(fx.trade_nodes(spark, sf_dir))
    return found.select(F.array_join(F.array_except("labels", F.array(F.lit("__Entity__"))), "+").alias("label"), "key", "n", F.array_join("names", "|").alias("names"))


@query("unique_violations", f"{_G} select name as value, count(*) as n from nodes where label = 'Part' and name is not null group by 1 having count(*) > 1")
def unique_violations(spark, sf_dir):
    return index.unique_violations(fx.trade_nodes(spark, sf_dir), "Part", "name")


@query("missing_indexes", "select 'part_name_unique' as name where not exists (select 1 from region where r_name = 'part_name_unique')")
def missing_indexes(spark, sf_dir):
    return validate.missing_indexes(fx.table(spark, sf_dir, "region").select(F.col("r_name").alias("name")), fx.trade_profile())


@query(
    "validation_report",
    f"""{_G}, t as (select a.label as x, e.rel, b.label as y from edges e join nodes a on a.id = e.src join nodes b on b.id = e.dst),
d as (select id, count(*) as g from (select src as id from edges union all select dst from edges where src <> dst) group by 1),
dup as (select count(*) as n from nodes where name is not null group by label, lower(trim(name)) having count(*) > 1),
o as (select 'undeclared labels' as "check", (select count(*) from nodes where label = 'Purchase')::double as observed, 0.0 as threshold union all
 select 'undeclared relations', (select count(*) from edges where rel = 'PLACED_OPEN'), 0 union all
 select 'pattern violations', (select count(*) from t where x <> 'Purchase' and y <> 'Purchase' and rel <> 'PLACED_OPEN' and (x, rel, y) not in (('Nation','IN_REGION','Region'), ('Customer','IN_NATION','Nation'), ('Supplier','IN_NATION','Nation'), ('Part','SUPPLIED_BY','Supplier'))), 0 union all
 select 'hubs', (select coalesce(max(g), 0) from d join nodes using (id) where g > 40 and lower(coalesce(name, '')) not in ('japan', 'china')), 40 union all
 select 'orphans', (select count(*) from nodes where label in ('Part', 'Supplier')), 0 union all
 select 'provenance', (select count(*) filter (quote <> '') / count(*) from edges), 0.5 union all
 select 'duplicate names', (select coalesce(sum(n), 0) from (select n from dup order by n desc limit 10)), 0)
select "check", case "check" when 'provenance' then observed >= threshold else observed <= threshold end as ok, round(observed, 6) as observed, cast(threshold as double) as threshold from o""",
)
def validation_report(spark, sf_dir):
    return validate.validate(*_graph(spark, sf_dir), fx.trade_profile()).select("check", "ok", F.round("observed", 6).alias("observed"), "threshold")


@query("schema_prune", f"""{_G} select 'node' as kind, label as name, count(*) as n from nodes where label <> 'Purchase' group by 2
union all select 'edge', rel, count(*) from (select e.rel from edges e join nodes a on a.id = e.src join nodes b on b.id = e.dst where (a.label, e.rel, b.label) in (('Nation','IN_REGION','Region'), ('Customer','IN_NATION','Nation'), ('Supplier','IN_NATION','Nation'), ('Part','SUPPLIED_BY','Supplier'))) group by 2""")  # fmt: skip
def schema_prune(spark, sf_dir):
    nodes, edges = graph.prune(*_graph(spark, sf_dir), fx.trade_profile())
    a = nodes.groupBy(F.element_at(F.array_except("labels", F.array(F.lit("__Entity__"))), 1).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    return a.unionByName(edges.groupBy(F.col("rel").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "name", "n"))


@query("reverse_fix", "select 'nation:' || n_nationkey as src, 'IN_REGION' as rel, 'region:' || n_regionkey as dst from nation")
def reverse_fix(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    odd = F.pmod(F.xxhash64("src"), F.lit(2)) == 1
    own = edges.where("rel = 'IN_REGION'").select(F.when(odd, F.col("dst")).otherwise(F.col("src")).alias("src"), "rel", F.when(odd, F.col("src")).otherwise(F.col("dst")).alias("dst"), "properties")
    return graph.fix_direction(nodes, own, fx.trade_profile()).select("src", "rel", "dst")


@query(
    "upsert_edges",
    """with o as (select distinct 'purchase:' || l_orderkey as src, 'part:' || l_partkey as dst from lineitem),
n as (select 'purchase:' || l_orderkey as src, 'part:' || l_partkey as dst, 'line ' || max(l_linenumber) as quote from lineitem where l_linenumber % 2 = 1 group by 1, 2)
select src, dst, 'kept' as origin, coalesce(quote, 'old') as quote from o left join n using (src, dst)""",
)
def upsert_edges(spark, sf_dir):
    items = fx.table(spark, sf_dir, "lineitem")
    ends = (F.concat(F.lit("purchase:"), F.col("l_orderkey").cast("string")).alias("src"), F.lit("CONTAINS").alias("rel"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dst"))
    old = items.select(*ends, F.create_map(F.lit("quote"), F.lit("old"), F.lit("origin"), F.lit("kept")).alias("properties"))
    new = items.where("l_linenumber % 2 = 1").select(*ends, F.create_map(F.lit("quote"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string"))).alias("properties"), "l_linenumber")
    out = graph.upsert_edges(old, new, F.col("l_linenumber"))
    return out.select("src", "dst", F.col("properties")["origin"].alias("origin"), F.col("properties")["quote"].alias("quote"))


@query(
    "khop",
    f"""{_G}, b as (select src, dst from edges where rel in ('IN_REGION', 'IN_NATION') union select dst, src from edges where rel in ('IN_REGION', 'IN_NATION')),
s as (select id as node from nodes where label = 'Region'),
h1 as (select distinct s.node as seed, b.dst as node from s join b on b.src = s.node),
h2 as (select distinct h1.seed, b.dst as node from h1 join b on b.src = h1.node),
w as (select node as seed, node, 0 as hop from s union all select seed, node, 1 from h1 union all select seed, node, 2 from h2)
select seed, node, cast(min(hop) as integer) as hop from w group by 1, 2""",
)
def khop(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.neighbourhood(edges, nodes.where(F.array_contains("labels", "Region")).select("id"), 2, ("IN_REGION", "IN_NATION"))


# Resolution


@query("exact_resolve", "select 'part:' || p_partkey as id, min('part:' || p_partkey) over (partition by p_name) as canonical from part where p_name is not null")
def exact_resolve(spark, sf_dir):
    return resolve.exact(resolve.scoped(fx.trade_nodes(spark, sf_dir), ("Part",)))


_NAMES = "k as (select lower(trim(p_name)) as key, min('part:' || p_partkey) as id from part where p_name is not null group by 1)"


@query(
    "fuzzy_pairs",
    f"""with {_NAMES} select least(x.id, y.id) as a, greatest(x.id, y.id) as b, round(1 - levenshtein(x.key, y.key) / greatest(length(x.key), length(y.key)), 6) as score
from k x join k y on x.key < y.key and abs(length(x.key) - length(y.key)) <= 0.2 * greatest(length(x.key), length(y.key)) + 1 where 1 - levenshtein(x.key, y.key) / greatest(length(x.key), length(y.key)) >= 0.8""",
)
def fuzzy_pairs(spark, sf_dir):
    return resolve.fuzzy_pairs(resolve.scoped(fx.trade_nodes(spark, sf_dir), ("Part",)), 0.8).select("a", "b", F.round("score", 6).alias("score"))


@query("merged_graph", """with c as (select 'part:' || p_partkey as id, min('part:' || p_partkey) over (partition by p_name) as canonical from part)
select distinct 'purchase:' || l_orderkey as src, c.canonical as dst from lineitem l join c on c.id = 'part:' || l_partkey""")  # fmt: skip
def merged_graph(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    mapping = resolve.exact(resolve.scoped(nodes, ("Part",)))
    return resolve.merge(nodes, edges.where("rel = 'CONTAINS'"), mapping)[1].select("src", "dst")


@query(
    "vocab_normalize",
    """with v as (select distinct p_brand as c from part)
select c as name, c as canonical, 1 as tier from v union all select ' ' || upper(c) || ' ', c, 2 from v union all select lower(c) || 's', c, 3 from v union all select replace(lower(c), 'a', ''), c, 4 from v union all select 'nothing like it', null, 0""",
)
def vocab_normalize(spark, sf_dir):
    brands = fx.table(spark, sf_dir, "part").select("p_brand").distinct()
    names = brands.select(F.explode(F.array("p_brand", F.concat(F.lit(" "), F.upper("p_brand"), F.lit(" ")), F.concat(F.lower("p_brand"), F.lit("s")), F.replace(F.lower("p_brand"), F.lit("a"), F.lit("")), F.lit("nothing like it"))).alias("name"))
    terms = resolve.vocabulary_terms(brands.select(F.col("p_brand").alias("canonical"), F.lit("").alias("aliases")))
    return resolve.normalize(names, terms, 0.85)


# Retrieval


def _vectors(spark, sf_dir):
    return fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")


def _probe(spark, sf_dir, vec_id: int = 7) -> list[float]:
    return fx.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


_V = """q as (select list_transform(embedding, lambda x: cast(x as double)) as q from embeddings where vec_id = 7),
v as (select cast(vec_id as varchar) as id, list_cosine_similarity(list_transform(embedding, lambda x: cast(x as double)), (select q from q)) as score from embeddings),
vt as (select id, score from v order by score desc, id limit 10)"""
_B = """t as (select cast(doc_id as varchar) as id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as t from documents),
z as (select count(*) as n, avg(len(t)) as mean from t),
p as (select id, w as term, count(*) as tf from (select id, unnest(t) as w from t) where w in ('the', 'thing', 'nation') group by all),
df as (select term, count(*) as df from p group by 1),
bt as (select p.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t.t) / mean))) as score from p join df using (term) join t using (id) cross join z group by 1 order by score desc, id limit 10)"""
QUESTION = "the thing nation"


@query("vector_topk", f"with {_V} select id, round(score, 5) as score from vt")
def vector_topk(spark, sf_dir):
    return index.vector_topk(_vectors(spark, sf_dir), _probe(spark, sf_dir), 10).select("id", F.round("score", 5).alias("score"))


def _texts(spark, sf_dir):
    return index.fulltext_index(fx.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"))


@query("bm25_topk", f"with {_B} select id, round(score, 5) as score from bt")
def bm25_topk(spark, sf_dir):
    return index.bm25(*_texts(spark, sf_dir), QUESTION, 10).select("id", F.round("score", 5).alias("score"))


@query(
    "hybrid_topk",
    f"""with {_V}, {_B}, f as (select coalesce(vt.id, bt.id) as id, greatest(coalesce(vt.score / (select max(score) from vt), 0), coalesce(bt.score / (select max(score) from bt), 0)) as score from vt full join bt on vt.id = bt.id)
select id as chunk_id, round(score, 5) as score from f order by f.score desc, id limit 10""",
)
def hybrid_topk(spark, sf_dir):
    return retrieve.seeds(_vectors(spark, sf_dir), *_texts(spark, sf_dir), QUESTION, _probe(spark, sf_dir), 10).select("chunk_id", F.round("score", 5).alias("score"))


@query("inverted_index", "select w as term, count(*) as df, cast(sum(tf) as bigint) as tf from (select doc_id, w, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) as w from documents) group by 1, 2) group by 1")
def inverted_index(spark, sf_dir):
    return _texts(spark, sf_dir)[0].groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query("asof_valid", "select 'order:' || o_orderkey as id from orders where o_orderstatus = 'O' or cast(o_orderdate as date) > date '1995-06-15'")
def asof_valid(spark, sf_dir):
    end = F.when(F.col("o_orderstatus") == "O", F.lit(None)).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    nodes = fx.table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), F.create_map(F.lit("in_force_to"), end).alias("properties"))
    return retrieve.valid_at(nodes, datetime.date(1995, 6, 15)).select("id")


def _kitchen(spark, sf_dir):
    """Orders as recipes of chunks, parts as ingredients, brands as allergens, sizes as diets, suppliers as techniques."""
    part, items, orders = (fx.table(spark, sf_dir, n) for n in ("part", "lineitem", "orders"))
    s = lambda p, c: F.concat(F.lit(p + ":"), F.col(c).cast("string"))
    node = lambda df, i, label, **props: df.select(i.alias("id"), F.array(F.lit(label)).alias("labels"), F.create_map(*(x for k, v in props.items() for x in (F.lit(k), v.cast("string")))).alias("properties")).dropDuplicates(["id"])
    edge = lambda df, a, r, b, **props: df.select(a.alias("src"), F.lit(r).alias("rel"), b.alias("dst"), (F.create_map(*(x for k, v in props.items() for x in (F.lit(k), v.cast("string")))) if props else F.create_map().cast("map<string,string>")).alias("properties"))
    nodes = [
        node(orders, s("chunk", "o_orderkey"), "Chunk", text=s("text of", "o_orderkey"), path=s("p", "o_orderkey")),
        node(orders, s("recipe", "o_orderkey"), "Recipe", name=s("recipe", "o_orderkey"), servings=F.pmod("o_orderkey", F.lit(8))),
        node(part, s("part", "p_partkey"), "Ingredient", name=F.col("p_name")),
        node(part, s("brand", "p_brand"), "Allergen", name=F.col("p_brand")),
        node(part, s("size", "p_size"), "DietTag", name=F.col("p_size")),
        node(items, s("supplier", "l_suppkey"), "Technique", name=F.concat(F.lit("way "), F.col("l_suppkey").cast("string"))),
    ]
    edges = [
        edge(orders.where("o_orderkey % 5 <> 0"), s("recipe", "o_orderkey"), "PART_OF_CHUNK", s("chunk", "o_orderkey")),
        edge(items, s("recipe", "l_orderkey"), "USES_INGREDIENT", s("part", "l_partkey"), amount=F.col("l_quantity").cast("int")),
        edge(items.select("l_orderkey", "l_suppkey").distinct(), s("recipe", "l_orderkey"), "REQUIRES_TECHNIQUE", s("supplier", "l_suppkey")),
        edge(part, s("part", "p_partkey"), "CONTAINS_ALLERGEN", s("brand", "p_brand")),
        edge(part, s("part", "p_partkey"), "EXCLUDED_BY", s("size", "p_size")),
    ]
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(nodes), union(edges)


_BAD = "bad as (select distinct l_orderkey as k from lineitem join part on p_partkey = l_partkey where p_brand in ('Brand#11', 'Brand#22') or p_size in (3))"


@query("hard_filter_exclude", f"with {_BAD} select 'recipe:' || k as r from bad")
def hard_filter_exclude(spark, sf_dir):
    return retrieve.excluded_recipes(*_kitchen(spark, sf_dir), ["Brand#11", "Brand#22"], ["3"]).select("r")


def _cookbook_sql(strict: bool) -> str:
    keep = "where o_orderkey % 5 = 0 or bad.k is null" if strict else ""
    return f"""with {_BAD},
i as (select l_orderkey as k, string_agg(p_name || ' ' || cast(l_quantity as integer) || ' ', '|' order by p_name || ' ' || cast(l_quantity as integer) || ' ') as ingredients from lineitem join part on p_partkey = l_partkey group by 1),
t as (select l_orderkey as k, string_agg('way ' || l_suppkey, '|' order by 'way ' || l_suppkey) as techniques from (select distinct l_orderkey, l_suppkey from lineitem) group by 1)
select 'chunk:' || o_orderkey as chunk_id, 'text of:' || o_orderkey as text, case when o_orderkey % 5 <> 0 and bad.k is null then 'recipe:' || o_orderkey end as recipe,
  case when o_orderkey % 5 <> 0 and bad.k is null then coalesce(ingredients, '') else '' end as ingredients, case when o_orderkey % 5 <> 0 and bad.k is null then coalesce(techniques, '') else '' end as techniques
from orders left join bad on bad.k = o_orderkey left join i on i.k = o_orderkey left join t on t.k = o_orderkey {keep}"""


def _cookbook(spark, sf_dir, strict):
    nodes, edges = (materialize(spark, x, "kitchen") for x in _kitchen(spark, sf_dir))
    seeds = nodes.where(F.array_contains("labels", "Chunk")).select(F.col("id").alias("chunk_id"), F.lit(1.0).alias("score"))
    out = retrieve.expand_cookbook(seeds, nodes, edges, ["Brand#11", "Brand#22"], ["3"], strict)
    return out.select("chunk_id", "text", "recipe", F.array_join("ingredients", "|").alias("ingredients"), F.array_join("techniques", "|").alias("techniques"))


@query("expand_cookbook", _cookbook_sql(True))
def expand_cookbook(spark, sf_dir):
    return _cookbook(spark, sf_dir, True)


@query("expand_cookbook_lenient", _cookbook_sql(False))
def expand_cookbook_lenient(spark, sf_dir):
    return _cookbook(spark, sf_dir, False)


@query(
    "expand_statutes",
    f"""{_SCOPED}, c as (select *, cast(regexp_extract(doc_id, '([0-9]+)[.]txt', 1) as bigint) % 3 as m from chunks),
x as (select r.chunk_id, string_agg(distinct relation || '>' || t.path, '|' order by relation || '>' || t.path) as cites, count(distinct relation || t.id) as n from refs r join chunks t on t.id = r.target_chunk_id group by 1)
select id as chunk_id, path as citation, coalesce(cites, '') as cited, cast(coalesce(n, 1) as bigint) as n_cited, case when m = 0 then 'pay ' || number else '' end as obligations, case when m = 0 then 'actor ' || length(number) else '' end as actors,
  case when m = 0 and cast(number as integer) % 2 = 0 then 'fine ' || number else '' end as sanctions, case when m = 0 then case when cast(number as integer) % 3 = 0 then 'out ' || id || '|over ' || id else 'over ' || id end else '' end as exceptions
from c left join x on x.chunk_id = c.id where m <> 1""",
)
def expand_statutes(spark, sf_dir):
    chunks = _acts(spark, sf_dir, once=True)
    nodes, edges = graph.lexical_graph(chunks)
    m = lambda c: F.pmod(F.regexp_extract(c, r"([0-9]+)\.txt", 1).cast("long"), F.lit(3))
    ended = F.array_contains("labels", "Chunk") & (m(F.col("properties")["doc_id"]) == 1)
    nodes = nodes.withColumn("properties", F.when(ended, F.map_concat("properties", F.create_map(F.lit("in_force_to"), F.lit("2001-01-01")))).otherwise(F.col("properties")))
    refs = graph.parser_edges(xref.cross_references(chunks, STATUTES, "document"), chunks)
    own = chunks.where(m(F.col("doc_id")) == 0)
    clause, duty, actor = F.concat(F.lit("clause:"), F.col("id")), F.concat(F.lit("duty:"), F.col("number")), F.concat(F.lit("actor:"), F.length("number").cast("string"))
    # Fines of even articles; an exception that points at a clause, and of every third article one that the clause points at.
    fine, out_, over = F.concat(F.lit("fine:"), F.col("number")), F.concat(F.lit("out:"), F.col("id")), F.concat(F.lit("over:"), F.col("id"))
    even, third = own.where(F.col("number").cast("int") % 2 == 0), own.where(F.col("number").cast("int") % 3 == 0)
    # What is named after a chunk's id is one row a chunk; what is named after a number is made one row.
    each = lambda df, *columns: df.select(*columns)
    once = lambda df, *columns: df.select(*columns).distinct()
    named = lambda held, df, label, i, n: held(df, i.alias("id"), n.alias("n")).select("id", F.array(F.lit(label), F.lit("__Entity__")).alias("labels"), F.create_map(F.lit("name"), F.col("n")).alias("properties"))
    for held, df, label, i, n in (
        (each, own, "Clause", clause, clause), (once, own, "Obligation", duty, F.concat(F.lit("pay "), F.col("number"))), (once, own, "Actor", actor, F.concat(F.lit("actor "), F.length("number").cast("string"))),
        (once, even, "Sanction", fine, F.concat(F.lit("fine "), F.col("number"))), (each, own, "Clause", over, F.concat(F.lit("over "), F.col("id"))), (each, third, "Clause", out_, F.concat(F.lit("out "), F.col("id"))),
    ):
        nodes = nodes.unionByName(named(held, df, label, i, n))
    none = F.create_map().cast("map<string,string>").alias("properties")
    edges = edges.unionByName(refs)
    for held, df, a, rel, b in (
        (once, even, duty, "SANCTIONED_BY", fine), (each, own, over, "EXCEPTION_TO", clause), (each, third, clause, "DEROGATES_FROM", out_),
        (each, own, clause, "PART_OF_CHUNK", F.col("id")), (each, own, clause, "IMPOSES", duty), (once, own, duty, "APPLIES_TO", actor),
    ):
        edges = edges.unionByName(held(df, a.alias("src"), F.lit(rel).alias("rel"), b.alias("dst")).withColumn("properties", none))
    nodes, edges = materialize(spark, nodes, "nodes"), materialize(spark, edges, "edges")
    out = retrieve.expand_statutes(chunks.select(F.col("id").alias("chunk_id"), F.lit(1.0).alias("score")), nodes, edges, datetime.date(2020, 1, 1))
    cited = F.array_join(F.array_sort(F.filter(F.transform("cited_clauses", lambda c: F.concat(c["ref"], F.lit(">"), c["path"])), lambda x: x.isNotNull())), "|")
    return out.select("chunk_id", "citation", cited.alias("cited"), F.size("cited_clauses").cast("long").alias("n_cited"), *(F.array_join(c, "|").alias(c) for c in ("obligations", "actors", "sanctions", "exceptions")))


@query(
    "expand_handbook",
    """with m as (select l_orderkey as k, string_agg(distinct p_name || ' (' || l_linestatus || ')', '|' order by p_name || ' (' || l_linestatus || ')') as materials from lineitem join part on p_partkey = l_partkey group by 1),
h as (select l_orderkey as k, string_agg(distinct 'hazard ' || l_suppkey, '|' order by 'hazard ' || l_suppkey) as hazards, string_agg(distinct 'rule ' || (l_suppkey % 4), '|' order by 'rule ' || (l_suppkey % 4)) as safety_rules from lineitem where l_returnflag = 'R' group by 1)
select 'chunk:' || o_orderkey as chunk_id, 'p:' || o_orderkey as citation, 'lay:' || o_orderkey as subjects, coalesce(materials, '') as materials, coalesce(hazards, '') as hazards, coalesce(safety_rules, '') as safety_rules,
  'way ' || (o_custkey % 3) as techniques, case when o_orderkey % 2 = 0 then 'tool ' || (o_custkey % 5) else '' end as tools, 'warm' as purposes, 'dry' as works_when, case when o_orderkey % 3 = 0 then 'wet' else '' end as avoid_when
from orders left join m on m.k = o_orderkey left join h on h.k = o_orderkey""",
)
def expand_handbook(spark, sf_dir):
    part, items, orders = (fx.table(spark, sf_dir, n) for n in ("part", "lineitem", "orders"))
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    one = lambda df, i, label, **props: df.select(i.alias("id"), F.array(F.lit(label)).alias("labels"), F.create_map(*(x for k, v in props.items() for x in (F.lit(k), v))).alias("properties")).dropDuplicates(["id"])
    link = lambda df, a, r, b, props=None: df.select(a.alias("src"), F.lit(r).alias("rel"), b.alias("dst"), (props if props is not None else F.create_map().cast("map<string,string>")).alias("properties"))
    risky = items.where("l_returnflag = 'R'").withColumn("rule", F.pmod("l_suppkey", F.lit(4)))
    nodes = one(orders, s("chunk:", "o_orderkey"), "Chunk", text=s("t:", "o_orderkey"), path=s("p:", "o_orderkey")).unionByName(one(orders, s("lay:", "o_orderkey"), "FireLay", name=s("lay:", "o_orderkey")))
    nodes = nodes.unionByName(one(part, s("part:", "p_partkey"), "Material", name=F.col("p_name"))).unionByName(one(risky, s("hazard:", "l_suppkey"), "Hazard", name=s("hazard ", "l_suppkey"))).unionByName(one(risky, s("rule:", "rule"), "SafetyRule", rule=s("rule ", "rule")))
    edges = link(orders, s("lay:", "o_orderkey"), "PART_OF_CHUNK", s("chunk:", "o_orderkey")).unionByName(link(items, s("lay:", "l_orderkey"), "REQUIRES_MATERIAL", s("part:", "l_partkey"), F.create_map(F.lit("stage"), F.col("l_linestatus"))))
    edges = edges.unionByName(link(risky, s("lay:", "l_orderkey"), "HAS_HAZARD", s("hazard:", "l_suppkey"))).unionByName(link(risky.select("l_suppkey", "rule").distinct(), s("hazard:", "l_suppkey"), "MITIGATED_BY", s("rule:", "rule")))
    by = lambda c, n: F.pmod(c, F.lit(n)).cast("string")
    rest = (
        (orders, "BUILT_WITH", "Technique", F.concat(F.lit("way "), by("o_custkey", 3))), (orders.where("o_orderkey % 2 = 0"), "REQUIRES_TOOL", "Tool", F.concat(F.lit("tool "), by("o_custkey", 5))),
        (orders, "SERVES_PURPOSE", "Purpose", F.lit("warm")), (orders, "SUITED_FOR", "Condition", F.lit("dry")), (orders.where("o_orderkey % 3 = 0"), "UNSUITED_FOR", "Condition", F.lit("wet")),
    )
    for df, rel, label, name in rest:
        nodes, edges = nodes.unionByName(one(df, name, label, name=name)), edges.unionByName(link(df, s("lay:", "o_orderkey"), rel, name))
    seeds = orders.select(s("chunk:", "o_orderkey").alias("chunk_id"), F.lit(1.0).alias("score"))
    out = retrieve.expand_handbook(seeds, nodes, edges)
    return out.select("chunk_id", "citation", *(F.array_join(c, "|").alias(c) for c in ("subjects", "materials", "hazards", "safety_rules", "techniques", "tools", "purposes", "works_when", "avoid_when")))


@query(
    "recall_at_k",
    """with g as (select cast(doc_id as varchar) as q, cast(doc_id as varchar) as c from labels where quality is not null), r as (select doc_id as q, doc_id + (doc_id % 5) as c from labels)
select 3 as k, count(distinct q) as questions, round(avg(hit), 6) as recall from (select g.q, max(case when exists (select 1 from r where cast(r.q as varchar) = g.q and cast(r.c as varchar) = g.c) then 1.0 else 0.0 end) as hit from g group by 1)""",
)
def recall_at_k(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "labels").where("quality is not null")
    text = lambda c: c.cast("string")
    gold = rows.select(text(F.col("doc_id")).alias("question"), text(F.col("doc_id")).alias("chunk_id"))
    found = fx.table(spark, sf_dir, "labels").select(text(F.col("doc_id")).alias("question"), (F.pmod("doc_id", F.lit(3)) + 1).alias("rank"), text(F.col("doc_id") + F.pmod("doc_id", F.lit(5))).alias("chunk_id"))
    return retrieve.recall_at_k(found, gold, 3).withColumn("recall", F.round("recall", 6))


@query(
    "dry_run_summary",
    """with n as (select o_orderstatus as s, count(*) as c from orders group by 1), t as (select event_type as s, count(*) as c, count(*) filter (event_id % 3 = 0) as u from events group by 1)
select 'node' as kind, s as name, cast(c as double) as n from n union all select 'edge', s, c from t union all select 'unquoted', s, u from t
union all select 'quoted_share', '', (select round(1 - sum(u) / sum(c), 6) from t)""",
)
def dry_run_summary(spark, sf_dir):
    empty_n, empty_r = F.array().cast("array<struct<id:string,label:string,properties:map<string,string>>>"), F.array().cast("array<struct<start_node_id:string,end_node_id:string,type:string,properties:map<string,string>>>")
    none = F.create_map().cast("map<string,string>")
    nodes = fx.table(spark, sf_dir, "orders").select(F.array(F.struct(F.lit("x").alias("id"), F.col("o_orderstatus").alias("label"), none.alias("properties"))).alias("nodes"), empty_r.alias("relationships"))
    quote = F.create_map(F.lit("quote"), F.when(F.pmod("event_id", F.lit(3)) == 0, "").otherwise("words"))
    edges = fx.table(spark, sf_dir, "events").select(empty_n.alias("nodes"), F.array(F.struct(F.lit("a").alias("start_node_id"), F.lit("b").alias("end_node_id"), F.col("event_type").alias("type"), quote.alias("properties"))).alias("relationships"))
    return graph.dry_run_summary(nodes.unionByName(edges)).withColumn("n", F.round("n", 6))
