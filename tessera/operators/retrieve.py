"""Retrieval: vector, full text and hybrid seeds; expansion over the graph with hard filters; routing and recall.

Each branch of an expansion is collected for itself and joined to its seeds, so branches never multiply.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graph, index
from tessera.profile import Profile

DEFAULT_K = 5


def parse_params(pairs: list[str]) -> dict:
    """key=value pairs; a value is JSON, or else the string itself."""
    out = {}
    for pair in pairs:
        key, mark, value = pair.partition("=")
        if not mark:
            raise ValueError(f"not a key=value pair: {pair!r}")
        try:
            out[key] = json.loads(value)
        except ValueError:
            out[key] = value
    return out


def fuse(vector: DataFrame, text: DataFrame, k: int) -> DataFrame:
    """id, score: each list's scores over its largest, the better of both."""
    one = Window.partitionBy(F.lit(1))
    unit = lambda df, c: df.select("id", (F.col("score") / F.nullif(F.max("score").over(one), F.lit(0.0))).alias(c))  # noqa: E731  k rows each
    both = unit(vector, "a").join(unit(text, "b"), "id", "full")
    return both.select("id", F.greatest(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def seeds(chunks_vectors: DataFrame, postings: DataFrame, lengths: DataFrame, question: str, query_vector: list[float], k: int = DEFAULT_K, mode: str = "hybrid") -> DataFrame:
    """chunk_id, score by mode vector, text or hybrid."""
    if mode == "vector":
        found = index.vector_topk(chunks_vectors, query_vector, k)
    elif mode == "text":
        found = index.bm25(postings, lengths, question, k)
    elif mode == "hybrid":
        found = fuse(index.vector_topk(chunks_vectors, query_vector, k), index.bm25(postings, lengths, question, k), k)
    else:
        raise ValueError(f"no mode {mode!r}")
    return found.select(F.col("id").alias("chunk_id"), "score")


def valid_at(nodes: DataFrame, as_of: datetime.date | None = None) -> DataFrame:
    """Nodes in force: without an end, or with an end after the day."""
    end = F.try_to_date(F.try_element_at("properties", F.lit("in_force_to")), "yyyy-MM-dd")
    return nodes.where(end.isNull() | (end > (F.lit(as_of) if as_of else F.current_date())))


def _prop(name: str, c: str = "properties") -> Column:
    return F.try_element_at(F.col(c), F.lit(name))


def _labelled(nodes: DataFrame, label: str, name: str = "dst", *props: str) -> DataFrame:
    """Nodes with a label, and of their properties those asked for, as p: a chunk's text does not move where a name is wanted."""
    own = props or ("name",)
    return nodes.where(F.array_contains("labels", label)).select(F.col("id").alias(name), F.create_map(*(x for k in own for x in (F.lit(k), _prop(k)))).alias("p"))


def _entities(seeds_: DataFrame, edges: DataFrame) -> DataFrame:
    """chunk_id, e of the entities of the seeds' chunks."""
    part = edges.where("rel = 'PART_OF_CHUNK'").select(F.col("src").alias("e"), F.col("dst").alias("chunk_id"))
    return part.join(seeds_.select("chunk_id").distinct(), "chunk_id", "left_semi")


def _branch(start: DataFrame, at: str, edges: DataFrame, rels: tuple[str, ...], nodes: DataFrame, label: str, both_ways: bool = False, prop: str = "name") -> DataFrame:
    """start with dst, p (its properties) and ep (the edge's) of what the relations lead to from column ``at``."""
    own = edges.where(F.col("rel").isin(*rels)).select("src", "dst", F.col("properties").alias("ep"))
    if both_ways:
        own = own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "ep"))
    return start.join(own, F.col(at) == F.col("src")).drop("src").join(_labelled(nodes, label, "dst", prop), "dst")


def _names(found: DataFrame, column: str, value: Column | None = None) -> DataFrame:
    return found.groupBy("chunk_id").agg(F.array_sort(F.collect_set(_prop("name", "p") if value is None else value)).alias(column))


def _joined(base: DataFrame, branches: list[DataFrame]) -> DataFrame:
    for b in branches:
        names = [c for c in b.columns if c != "chunk_id"]
        base = base.join(b, "chunk_id", "left")
        base = base.withColumns({c: F.coalesce(F.col(c), F.array().cast(b.schema[c].dataType)) for c in names if b.schema[c].dataType.typeName() == "array"})
    return base


def _chunks(seeds_: DataFrame, nodes: DataFrame) -> DataFrame:
    own = nodes.where(F.array_contains("labels", "Chunk")).select(F.col("id").alias("chunk_id"), "properties")
    return seeds_.join(own, "chunk_id").select("chunk_id", "score", _prop("text").alias("text"), _prop("path").alias("path"))


def expand_statutes(seeds_: DataFrame, nodes: DataFrame, edges: DataFrame, as_of: datetime.date | None = None) -> DataFrame:
    """text, citation, cited_clauses, obligations, actors, sanctions, exceptions, similarity of the seeds in force.

    A chunk that cites nothing has one entry of nulls in cited_clauses, as optional matches do.
    """
    own = seeds_.join(valid_at(nodes, as_of).select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    ents = _entities(own, edges)
    cites = ("REFERS_TO", "EXCEPTION_TO", "DEROGATES_FROM", "AMENDS")
    short = nodes.where(F.array_contains("labels", "Chunk")).select(F.col("id").alias("dst"), _prop("path").alias("path"), F.left(_prop("text"), F.lit(500)).alias("text"))
    refs = edges.where(F.col("rel").isin(*cites)).select(F.col("src").alias("chunk_id"), "rel", "dst").join(own.select("chunk_id"), "chunk_id", "left_semi").join(short, "dst")
    entry = F.struct(F.col("rel").alias("ref"), "path", "text")
    cited = refs.groupBy("chunk_id").agg(F.array_sort(F.collect_set(entry)).alias("cited_clauses"))
    duties = _branch(ents, "e", edges, ("IMPOSES",), nodes, "Obligation")
    after = duties.select("chunk_id", F.col("dst").alias("o"))
    out = _joined(
        _chunks(own, nodes),
        [
            cited,
            _names(duties, "obligations"),
            _names(_branch(after, "o", edges, ("APPLIES_TO",), nodes, "Actor"), "actors"),
            _names(_branch(after, "o", edges, ("SANCTIONED_BY",), nodes, "Sanction"), "sanctions"),
            _names(_branch(ents, "e", edges, ("EXCEPTION_TO", "DEROGATES_FROM"), nodes, "Clause", both_ways=True), "exceptions"),
        ],
    )
    nothing = F.array(F.struct(*(F.lit(None).cast("string").alias(c) for c in ("ref", "path", "text"))))
    cited_ = F.when(F.size("cited_clauses") == 0, nothing).otherwise(F.col("cited_clauses"))
    return out.select("chunk_id", "text", F.col("path").alias("citation"), cited_.alias("cited_clauses"), "obligations", "actors", "sanctions", "exceptions", F.col("score").alias("similarity"))


def excluded_recipes(nodes: DataFrame, edges: DataFrame, allergens: list[str], diets: list[str]) -> DataFrame:
    """r of the recipes with an ingredient that holds one of the allergens, or that one of the diets excludes."""
    uses = edges.where("rel = 'USES_INGREDIENT'").select(F.col("src").alias("r"), F.col("dst").alias("i"))
    parts = []
    for rel, label, names in (("CONTAINS_ALLERGEN", "Allergen", allergens), ("EXCLUDED_BY", "DietTag", diets)):
        if names:
            bad = edges.where(F.col("rel") == rel).select(F.col("src").alias("i"), "dst").join(_labelled(nodes, label).where(_prop("name", "p").isin(*names)), "dst")
            parts.append(uses.join(bad.select("i").distinct(), "i", "left_semi").select("r"))
    if not parts:
        return uses.select("r").limit(0)
    return (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).distinct()


def expand_cookbook(seeds_: DataFrame, nodes: DataFrame, edges: DataFrame, exclude_allergens: list[str] | None = None, diet_tags: list[str] | None = None, strict: bool = True) -> DataFrame:
    """text, recipe, servings, ingredients, techniques, similarity of the seeds; one row for each recipe of a chunk.

    Recipes with an excluded allergen or diet are left out: with their chunk's row where strict, else only as
    the recipe of the row, whose text stays. A chunk without any recipe stays either way.
    """
    recipes = _labelled(nodes, "Recipe", "e", "name", "servings")
    linked = _entities(seeds_, edges).join(recipes, "e").select("chunk_id", F.col("e").alias("r"), _prop("name", "p").alias("recipe"), _prop("servings", "p").alias("servings"))
    bad = excluded_recipes(nodes, edges, exclude_allergens or [], diet_tags or [])
    good = linked.join(bad, "r", "left_anti")
    base = _chunks(seeds_, nodes)
    if strict:
        had = linked.select("chunk_id").distinct().withColumn("had", F.lit(True))
        base = base.join(had, "chunk_id", "left")
        rows = base.join(good, "chunk_id", "left").where("had is null or r is not null").drop("had")
    else:
        rows = base.join(good, "chunk_id", "left")
    own = good.select("r").distinct()
    used = edges.where("rel = 'USES_INGREDIENT'").select(F.col("src").alias("r"), "dst", F.col("properties").alias("ep")).join(own, "r", "left_semi").join(_labelled(nodes, "Ingredient"), "dst")
    amount = F.concat(_prop("name", "p"), F.lit(" "), F.coalesce(_prop("amount", "ep"), F.lit("")), F.lit(" "), F.coalesce(_prop("unit", "ep"), F.lit("")))
    ingredients = used.groupBy("r").agg(F.array_sort(F.collect_list(amount)).alias("ingredients"))
    how = edges.where("rel = 'REQUIRES_TECHNIQUE'").select(F.col("src").alias("r"), "dst").join(own, "r", "left_semi").join(_labelled(nodes, "Technique"), "dst")
    techniques = how.groupBy("r").agg(F.array_sort(F.collect_list(_prop("name", "p"))).alias("techniques"))
    out = rows.join(ingredients, "r", "left").join(techniques, "r", "left")
    empty = F.array().cast("array<string>")
    return out.select("chunk_id", "text", "recipe", "servings", F.coalesce("ingredients", empty).alias("ingredients"), F.coalesce("techniques", empty).alias("techniques"), F.col("score").alias("similarity"))


def expand_handbook(seeds_: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """text, citation, subjects and what surrounds them; hazards and what not to do always come along."""
    ents = _entities(seeds_, edges)
    named = ents.join(nodes.select(F.col("id").alias("e"), F.create_map(F.lit("name"), _prop("name")).alias("p")), "e")
    step = lambda rel, label: _branch(ents, "e", edges, (rel,), nodes, label)
    material = step("REQUIRES_MATERIAL", "Material")
    hazards = step("HAS_HAZARD", "Hazard")
    rules = _branch(hazards.select("chunk_id", F.col("dst").alias("h")), "h", edges, ("MITIGATED_BY",), nodes, "SafetyRule", prop="rule")
    out = _joined(
        _chunks(seeds_, nodes),
        [
            _names(named, "subjects"),
            _names(material, "materials", F.concat(_prop("name", "p"), F.lit(" ("), F.coalesce(_prop("stage", "ep"), F.lit("?")), F.lit(")"))),
            _names(step("BUILT_WITH", "Technique"), "techniques"),
            _names(step("REQUIRES_TOOL", "Tool"), "tools"),
            _names(step("SERVES_PURPOSE", "Purpose"), "purposes"),
            _names(step("SUITED_FOR", "Condition"), "works_when"),
            _names(step("UNSUITED_FOR", "Condition"), "avoid_when"),
            _names(hazards, "hazards"),
            _names(rules, "safety_rules", _prop("rule", "p")),
        ],
    )
    return out.withColumnsRenamed({"path": "citation", "score": "similarity"})


def expand(seeds_: DataFrame, nodes: DataFrame, edges: DataFrame, profile: Profile, params: dict | None = None) -> DataFrame:
    """The profile's expansion of seeds (chunk_id, score). Parameters that are not given count as empty."""
    params = params or {}
    if profile.expansion == "statutes":
        day = params.get("as_of")
        return expand_statutes(seeds_, nodes, edges, datetime.date.fromisoformat(day) if isinstance(day, str) else day)
    if profile.expansion == "cookbook":
        return expand_cookbook(seeds_, nodes, edges, params.get("exclude_allergens"), params.get("diet_tags"), params.get("strict", True))
    if profile.expansion == "handbook":
        return expand_handbook(seeds_, nodes, edges)
    near = graph.neighbourhood(edges, seeds_.select(F.col("chunk_id").alias("id")), profile.hops, limit=params.get("max_nodes", 100))
    return seeds_.join(near.groupBy("seed").agg(F.array_sort(F.collect_set("node")).alias("nodes")), F.col("chunk_id") == F.col("seed"), "left").drop("seed")


def search(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, postings: DataFrame, lengths: DataFrame, question: str, query_vector: list[float], profile: Profile, k: int = DEFAULT_K, mode: str = "hybrid", params: dict | None = None) -> DataFrame:
    """The k best chunks of a question by mode, each with what the profile's expansion finds around it."""
    return expand(seeds(vectors, postings, lengths, question, query_vector, k, mode), nodes, edges, profile, params)


def answer(rows: DataFrame, question: str, answerer: Callable[[str, list[str]], str], most: int = 20) -> str:
    """What an answerer says of the texts of the best rows (text, similarity), at most so many of them."""
    best = rows.orderBy(F.desc("similarity"), "chunk_id").limit(most).select("text").collect()
    return answerer(question, [r.text or "" for r in best])


def count(nodes: DataFrame, edges: DataFrame, template: str) -> DataFrame:
    """A counting question by one of TEMPLATES, over the graph as tables nodes and edges."""
    if template not in TEMPLATES:
        raise ValueError(f"no template {template!r}; there are {sorted(TEMPLATES)}")
    return nodes.sparkSession.sql(TEMPLATES[template], nodes=nodes, edges=edges)


def visible(rows: DataFrame, user: str, today: datetime.date | None = None) -> DataFrame:
    """Rows (owner, public, valid_to) that are public, or the user's and not past their day."""
    day = F.lit(today) if today else F.current_date()
    return rows.where(F.col("public") | ((F.col("owner") == user) & (F.col("valid_to").isNull() | (F.col("valid_to") > day))))


def rerank(rows: DataFrame, k: int | None = None) -> DataFrame:
    """Rows (score, hop, id) by score, then by nearness."""
    out = rows.orderBy(F.desc("score"), "hop", "id")
    return out if k is None else out.limit(k)


_ROUTES = (("count", r"\b(how many|count|number of|combien|total|average|most|least)\b"), ("expand", r"\b(related|depends?|connected|exceptions?|refers?|why|lien)\b"), ("text", r"\"[^\"]+\"|\b(article|section|chapter)\s+\d+"))


def routes(question: Column) -> Column:
    """route of each row."""
    out = F.lit("hybrid")
    for tool, pattern in reversed(_ROUTES):
        out = F.when(question.rlike(f"(?i){pattern}"), F.lit(tool)).otherwise(out)
    return out


def route(question: str) -> str:
    """Which tool answers a question: count (a template query), expand (graph), text (full text) or hybrid."""
    return next((tool for tool, pattern in _ROUTES if re.search(pattern, question, re.I)), "hybrid")


TEMPLATES = {
    "count nodes by label": "select label as name, count(*) as n from {nodes} lateral view explode(labels) as label group by label order by n desc, name",
    "count edges by relation": "select rel as name, count(*) as n from {edges} group by rel order by n desc, name",
    "count edges from nodes by label": "select label as name, count(*) as n from {nodes} join {edges} on id = src lateral view explode(labels) as label group by label order by n desc, name",
}


def recall_at_k(results: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """k, questions, recall: how often a question's gold chunk is among its first k results (question, rank, chunk_id)."""
    top = results.where(F.col("rank") <= k).select("question", "chunk_id").distinct().withColumn("hit", F.lit(1.0))
    met = gold.select("question", "chunk_id").join(top, ["question", "chunk_id"], "left").groupBy("question").agg(F.max(F.coalesce("hit", F.lit(0.0))).alias("hit"))
    return met.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("questions"), F.avg("hit").alias("recall"))
