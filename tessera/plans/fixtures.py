"""Views of the driver's tables as documents, pages and a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.profile import Kind, Level, Profile


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One act for each order: its line items are articles, in order of line, part and supplier, that may cite another by number."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    # What follows a document costs far more than its bytes tell: keep as many partitions as are asked for.
    items = items.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey").distinct()
    held = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("items"))
    cited = lambda x: (F.pmod(x["l_partkey"], F.lit(7)) + 1).cast("string")
    clause = lambda x: (
        F.when(F.pmod(x["l_partkey"], F.lit(4)) == 0, F.concat(F.lit(" sous réserve de l'article "), cited(x)))
        .when(F.pmod(x["l_partkey"], F.lit(4)) == 1, F.concat(F.lit(" et modifie l'article "), cited(x)))
        .when(F.pmod(x["l_partkey"], F.lit(4)) == 2, F.concat(F.lit(", voir article "), cited(x)))
        .otherwise("")
    )
    article = lambda x, i: F.concat(F.lit("Article "), (i + 1).cast("string"), F.lit(" - Part "), x["l_partkey"].cast("string"), F.lit("\nSupplier "), x["l_suppkey"].cast("string"), F.lit(" delivers "), x["l_quantity"].cast("int").cast("string"), F.lit(" units"), clause(x), F.lit("."))
    head = F.concat(F.lit("TITRE I - Order "), F.col("l_orderkey").cast("string"), F.lit("\n\n"))
    doc_id = F.concat(F.lit("acts/order-"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), F.lit(".txt"))
    return held.select(doc_id.alias("doc_id"), F.concat(head, F.array_join(F.transform("items", article), "\n\n")).alias("text"))


#: The same articles as rows, for SQL: doc_id, n (number), title, txt, path, char_start, id, clause, cited.
STATUTES_SQL = """
items as (select distinct l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity from lineitem),
numbered as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as n,
    l_partkey % 4 as clause, cast(l_partkey % 7 + 1 as varchar) as cited from items),
worded as (select 'acts/order-' || lpad(cast(l_orderkey as varchar), 10, '0') || '.txt' as doc_id, l_orderkey, n, clause, cited, 'Part ' || l_partkey as title,
    'Article ' || n || ' - Part ' || l_partkey || chr(10) || 'Supplier ' || l_suppkey || ' delivers ' || cast(l_quantity as integer) || ' units'
      || case clause when 0 then ' sous réserve de l''article ' || cited when 1 then ' et modifie l''article ' || cited when 2 then ', voir article ' || cited else '' end || '.' as txt from numbered),
placed as (select *, length('TITRE I - Order ' || l_orderkey) + 2
    + coalesce(sum(length(txt) + 2) over (partition by l_orderkey order by n rows between unbounded preceding and 1 preceding), 0) as char_start,
    'titre I Order ' || l_orderkey || ' > article ' || n || ' ' || title as path from worded),
chunks as (select substr(sha1(doc_id || '||' || path || '||' || cast(char_start as integer)), 1, 16) as id, doc_id, path, cast(n as varchar) as number, title, txt,
    cast(char_start as integer) as char_start, cast(char_start + length(txt) as integer) as char_end, clause, cited from placed)
"""

#: References of the articles, resolved over all acts: the last act with an article of that number has it.
XREFS_SQL = (
    STATUTES_SQL
    + """,
targets as (select number, arg_max(id, doc_id) as target_chunk_id from chunks group by number),
xrefs as (select c.id as chunk_id, c.doc_id, case c.clause when 0 then 'EXCEPTION_TO' when 1 then 'AMENDS' else 'REFERS_TO' end as relation, c.cited as raw, t.target_chunk_id
    from chunks c left join targets t on t.number = c.cited where c.clause < 3 and t.target_chunk_id is distinct from c.id)
"""
)


def markup_profile() -> Profile:
    """Headings of the raw pages: h1 a section, p a paragraph."""
    return Profile(name="markup", levels=(Level("section", r"<h1>([^<]*)</h1>"), Level("paragraph", r"<p>([^<]*)")), chunk_at="paragraph", max_chars=400).check()


def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source of the documents as a document whose pages are its texts, in order of id."""
    return table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page"), "text")


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("page"), "text")


def _node(df: DataFrame, label: str, key: str, *extra: str, name: str | None = None) -> DataFrame:
    props = [F.lit("name"), F.col(name or key).cast("string")] + [x for c in extra for x in (F.lit(c), F.col(c).cast("string"))]
    return df.select(F.concat(F.lit(label.lower() + ":"), F.col(key).cast("string")).alias("id"), F.array(F.lit(label), F.lit("__Entity__")).alias("labels"), F.create_map(*props).alias("properties"))


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    out = _node(t("region"), "Region", "r_regionkey", name="r_name")
    out = out.unionByName(_node(t("nation"), "Nation", "n_nationkey", name="n_name"))
    out = out.unionByName(_node(t("customer"), "Customer", "c_custkey", "c_mktsegment", name="c_name"))
    out = out.unionByName(_node(t("supplier"), "Supplier", "s_suppkey", name="s_name"))
    out = out.unionByName(_node(t("part"), "Part", "p_partkey", "p_brand", name="p_name"))
    return out.unionByName(_node(t("orders"), "Purchase", "o_orderkey", "o_orderstatus"))


def _edge(df: DataFrame, rel: str, a: str, x: str, b: str, y: str, quote=None) -> DataFrame:
    props = F.create_map(F.lit("quote"), quote) if quote is not None else F.create_map().cast("map<string,string>")
    return df.select(F.concat(F.lit(a + ":"), F.col(x).cast("string")).alias("src"), F.lit(rel).alias("rel"), F.concat(F.lit(b + ":"), F.col(y).cast("string")).alias("dst"), props.alias("properties"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the tables' keys. Line items of an odd number carry a quote; order status P makes an undeclared relation, parts of size 1 an illegal triple."""
    t = lambda n: table(spark, sf_dir, n)
    items = t("lineitem")
    out = _edge(t("nation"), "IN_REGION", "nation", "n_nationkey", "region", "n_regionkey", F.lit("key"))
    out = out.unionByName(_edge(t("customer"), "IN_NATION", "customer", "c_custkey", "nation", "c_nationkey", F.lit("key")))
    out = out.unionByName(_edge(t("supplier"), "IN_NATION", "supplier", "s_suppkey", "nation", "s_nationkey", F.lit("key")))
    out = out.unionByName(_edge(t("orders").where("o_orderstatus <> 'P'"), "PLACED", "customer", "o_custkey", "purchase", "o_orderkey", F.lit("key")))
    out = out.unionByName(_edge(t("orders").where("o_orderstatus = 'P'"), "PLACED_OPEN", "customer", "o_custkey", "purchase", "o_orderkey"))
    quote = F.when(F.pmod("l_linenumber", F.lit(2)) == 1, F.concat(F.lit("line "), F.col("l_linenumber").cast("string"))).otherwise("")
    out = out.unionByName(_edge(items, "CONTAINS", "purchase", "l_orderkey", "part", "l_partkey", quote))
    out = out.unionByName(_edge(items, "SUPPLIED_BY", "part", "l_partkey", "supplier", "l_suppkey", F.lit("")))
    return out.unionByName(_edge(t("part").where("p_size = 1"), "IN_NATION", "part", "p_partkey", "region", "p_size", F.lit("odd")))


GRAPH_SQL = """
nodes as (
  select 'region:' || r_regionkey as id, 'Region' as label, r_name as name from region union all
  select 'nation:' || n_nationkey, 'Nation', n_name from nation union all
  select 'customer:' || c_custkey, 'Customer', c_name from customer union all
  select 'supplier:' || s_suppkey, 'Supplier', s_name from supplier union all
  select 'part:' || p_partkey, 'Part', p_name from part union all
  select 'purchase:' || o_orderkey, 'Purchase', cast(o_orderkey as varchar) from orders),
edges as (
  select 'nation:' || n_nationkey as src, 'IN_REGION' as rel, 'region:' || n_regionkey as dst, 'key' as quote from nation union all
  select 'customer:' || c_custkey, 'IN_NATION', 'nation:' || c_nationkey, 'key' from customer union all
  select 'supplier:' || s_suppkey, 'IN_NATION', 'nation:' || s_nationkey, 'key' from supplier union all
  select 'customer:' || o_custkey, case when o_orderstatus = 'P' then 'PLACED_OPEN' else 'PLACED' end, 'purchase:' || o_orderkey, case when o_orderstatus = 'P' then '' else 'key' end from orders union all
  select 'purchase:' || l_orderkey, 'CONTAINS', 'part:' || l_partkey, case when l_linenumber % 2 = 1 then 'line ' || l_linenumber else '' end from lineitem union all
  select 'part:' || l_partkey, 'SUPPLIED_BY', 'supplier:' || l_suppkey, '' from lineitem union all
  select 'part:' || p_partkey, 'IN_NATION', 'region:' || p_size, 'odd' from part where p_size = 1)
"""


def trade_profile() -> Profile:
    """A closed schema of the trade graph that leaves out one label and one relation."""
    return Profile(
        name="trade",
        levels=(Level("any", "x"),),
        chunk_at="any",
        labels=tuple(map(Kind, "Region Nation Customer Supplier Part".split())),
        relations=tuple(map(Kind, "IN_REGION IN_NATION PLACED CONTAINS SUPPLIED_BY".split())),
        patterns=(("Nation", "IN_REGION", "Region"), ("Customer", "IN_NATION", "Nation"), ("Supplier", "IN_NATION", "Nation"), ("Part", "SUPPLIED_BY", "Supplier")),
        max_degree=40,
        exempt=("japan", "CHINA"),
        min_coverage=0.5,
        no_orphans=("Part", "Supplier"),
        constraints=(("Part", "name"),),
    ).check()
