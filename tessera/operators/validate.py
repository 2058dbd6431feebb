"""Checks of a graph against its profile: one row each, and the rows that break them.

Every check is an aggregation or an anti-join; the suite is one DataFrame (check, ok, observed, threshold, detail).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.profile import Profile


def _declared_relations(profile: Profile) -> list[str]:
    return sorted({*(k.label for k in profile.relations), *profile.parser_relations})


def stray_labels(nodes: DataFrame, profile: Profile) -> DataFrame:
    known = [k.label for k in profile.labels] + list(graph.INFRASTRUCTURE)
    return graph.label_histogram(nodes.select(F.filter("labels", lambda x: ~x.isin(known)).alias("labels")))


def stray_relations(edges: DataFrame, profile: Profile) -> DataFrame:
    return graph.relation_histogram(edges.where(~F.col("rel").isin(_declared_relations(profile) + list(graph.LEXICAL))))


def pattern_violations(nodes: DataFrame, edges: DataFrame, profile: Profile) -> DataFrame:
    """Counts of illegal triples between declared labels, by label sets. Edges of undeclared ends or relations are other checks' business."""
    labels, known = [k.label for k in profile.labels], _declared_relations(profile)
    own = lambda c: F.filter(c, lambda x: x.isin(labels))
    found = graph.triples(nodes, edges.where(F.col("rel").isin(known)))
    found = found.withColumns({"_a": own(F.col("src_labels")), "_b": own(F.col("dst_labels"))}).where((F.size("_a") > 0) & (F.size("_b") > 0))
    return found.where(~graph._is_legal(F.col("_a"), F.col("rel"), F.col("_b"), profile)).drop("_a", "_b").orderBy(F.desc("n"), "rel")


def hubs(nodes: DataFrame, edges: DataFrame, profile: Profile, top: int = 10, exempt_first: bool = True) -> DataFrame:
    """The entities of the highest degree above the profile's limit. Exempt names go before the cut, or, for the older reading, after it."""
    known = [x.lower() for x in profile.exempt]
    exempt = F.coalesce(F.lower("name").isin(known), F.lit(False)) if known else F.lit(False)
    found = graph.degrees(nodes, edges).where(F.col("degree") > profile.max_degree)
    if exempt_first:
        found = found.where(~exempt)
    found = found.orderBy(F.desc("degree"), "id").limit(top)
    return found if exempt_first else found.where(~exempt)


def orphans(nodes: DataFrame, edges: DataFrame, profile: Profile) -> DataFrame:
    """label, n of nodes that should come from a chunk and do not."""
    held = nodes.select("id", F.explode("labels").alias("label")).where(F.col("label").isin(*profile.no_orphans) if profile.no_orphans else F.lit(False))
    return held.join(edges.where(F.col("rel") == "PART_OF_CHUNK").select(F.col("src").alias("id")), "id", "left_anti").groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label")


def provenance(edges: DataFrame) -> DataFrame:
    """total, covered, coverage over edges outside the lexical layer: those that quote their words or come from the parser; 1 of none."""
    has = lambda key: F.coalesce(F.try_element_at("properties", F.lit(key)), F.lit(""))
    good: Column = (has("quote") != "") | (has("source") == "parser")
    own = edges.where(~F.col("rel").isin(*graph.LEXICAL)).agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("covered"))
    return own.withColumn("coverage", F.when(F.col("total") == 0, 1.0).otherwise(F.col("covered") / F.col("total")))


def duplicate_names(nodes: DataFrame, top: int | None = None) -> DataFrame:
    """labels, key, names, n of entities whose names differ in case and outer spaces at most.

    Names are counted first, and only those that are there twice are collected.
    """
    own = nodes.where(F.array_contains("labels", graph.ENTITY)).select(F.array_sort("labels").alias("labels"), F.try_element_at("properties", F.lit("name")).alias("name")).where("name is not null")
    own = own.withColumn("key", F.lower(F.trim("name")))
    order = (F.desc("n"), "key", "labels")
    twice = own.groupBy("labels", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(*order)
    if top is not None:
        twice = F.broadcast(twice.limit(top))
    return own.join(twice, ["labels", "key"]).groupBy("labels", "key", "n").agg(F.array_sort(F.collect_set("name")).alias("names")).select("labels", "key", "names", "n").orderBy(*order)


def missing_indexes(catalog: DataFrame, profile: Profile) -> DataFrame:
    """name of the indexes that the profile asks for and the catalogue (name) does not have."""
    wanted = [x["name"] for x in (profile.vector, profile.fulltext) if x.get("name")] + [f"{a.lower()}_{b.lower()}_unique" for a, b in profile.constraints]
    return catalog.sparkSession.createDataFrame([(n,) for n in sorted(set(wanted))], "name string").join(catalog.select("name"), "name", "left_anti")


def validate(nodes: DataFrame, edges: DataFrame, profile: Profile, catalog: DataFrame | None = None) -> DataFrame:
    """All checks: check, ok, observed, threshold, detail."""

    def row(name: str, counted: DataFrame, observed: Column, ok, threshold: float, detail: Column) -> DataFrame:
        return counted.agg(observed.cast("double").alias("observed"), detail.alias("detail")).select(F.lit(name).alias("check"), ok(F.col("observed")).alias("ok"), "observed", F.lit(float(threshold)).alias("threshold"), "detail")

    def listed(name: str, found: DataFrame, n: str, words: Column) -> DataFrame:
        top = F.array_join(F.slice(F.array_sort(F.collect_list(words)), 1, 10), ", ")
        return row(name, found, F.coalesce(F.sum(n), F.lit(0)), lambda x: x == 0, 0, top)

    checks = [
        listed("undeclared labels", stray_labels(nodes, profile), "n", F.col("label")),
        listed("undeclared relations", stray_relations(edges, profile), "n", F.col("rel")),
        listed("pattern violations", pattern_violations(nodes, edges, profile), "n", F.concat_ws(" ", F.concat_ws("+", "src_labels"), "rel", F.concat_ws("+", "dst_labels"))),
        row("hubs", hubs(nodes, edges, profile), F.coalesce(F.max("degree"), F.lit(0)), lambda x: x <= profile.max_degree, profile.max_degree, F.array_join(F.array_sort(F.collect_list(F.coalesce("name", "id"))), ", ")),
        listed("orphans", orphans(nodes, edges, profile), "n", F.col("label")),
        row("provenance", provenance(edges), F.first("coverage"), lambda x: x >= profile.min_coverage, profile.min_coverage, F.concat(F.first("covered").cast("string"), F.lit(" of "), F.first("total").cast("string"))),
        listed("duplicate names", duplicate_names(nodes, 10), "n", F.col("key")),
    ]
    if catalog is not None:
        checks.append(listed("missing indexes", missing_indexes(catalog, profile).withColumn("n", F.lit(1)), "n", F.col("name")))
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out
