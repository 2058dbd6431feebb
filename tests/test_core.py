"""Goldens and edge cases of the operators, on small fixtures."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from tessera import profile as pf
from tessera import providers
from tessera.functions.text import cosine, find_all, stable_id, strip
from tessera.operators import clean, cost, graph, index, resolve, retrieve, segment, validate, xref
from tessera.sources import corpus, sinks

LAW = """TITRE I - REGLES COMMUNES

CHAPITRE 1 - Champ

Article 1 - Objet
Le texte fixe les règles du marché.

Article 2 - Termes
On entend par vendeur toute personne qui vend.

CHAPITRE 2 - Devoirs

Article 12 - Déclaration
Le vendeur déclare chaque vente, sous reserve des dispositions de l'article 2.

Article 13 - Peines
Le manquement à l'article 12 est puni.

Article 14 - Exceptions
Les petits vendeurs ont trente jours malgré l'article 12. Le présent article modifie l'article 12."""

RECIPES = """# Week

## Lemon Pasta
Boil. See "Butter Shrimp" for more.

## Butter Shrimp
### Ingredients
- shrimp
"""


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id string, text string")


def test_statute_chunks_and_references(spark):
    df = docs(spark, ("a/law.txt", LAW))
    chunks = segment.segment(df, pf.STATUTES)
    rows = chunks.orderBy("char_start").collect()
    assert [r.number for r in rows] == ["1", "2", "12", "13", "14"]
    assert rows[0].path == "titre I REGLES COMMUNES > chapitre 1 Champ > article 1 Objet"
    assert rows[2].path.startswith("titre I REGLES COMMUNES > chapitre 2 Devoirs > article 12")
    assert all(LAW[r.char_start : r.char_end] == r.text for r in rows)
    import hashlib

    assert rows[0].id == hashlib.sha1(f"a/law.txt||{rows[0].path}||{rows[0].char_start}".encode()).hexdigest()[:16]
    number = {r.id: r.number for r in rows}
    refs = xref.cross_references(chunks, pf.STATUTES).collect()
    assert sorted((number[r.chunk_id], r.relation, r.raw, number[r.target_chunk_id]) for r in refs) == [("12", "EXCEPTION_TO", "2", "2"), ("13", "REFERS_TO", "12", "12"), ("14", "AMENDS", "12", "12")]
    held = {r.number: r for r in xref.attach(chunks, xref.cross_references(chunks, pf.STATUTES)).collect()}
    assert held["14"].xrefs[0].relation == "AMENDS" and held["1"].xrefs == []


def test_recipes(spark):
    chunks = segment.segment(docs(spark, ("r/week.md", RECIPES)), pf.COOKBOOK)
    rows = chunks.orderBy("char_start").collect()
    assert [r.title for r in rows] == ["Lemon Pasta", "Butter Shrimp"] and rows[0].number == ""
    ref = xref.cross_references(chunks, pf.COOKBOOK).first()
    assert (ref.relation, ref.chunk_id, ref.target_chunk_id) == ("PAIRS_WITH", rows[0].id, rows[1].id)


def test_odd_documents(spark):
    texts = {
        "no/heading.v2.txt": "  plain \xa0text\n", "only/outer.txt": "TITRE I - A\nbody", "null.txt": None, "emoji.txt": "😀😀\nArticle 1 - x\nbody", "next.txt": "Article 7\nThe title\nbody",
        "upper.txt": "Article 3 - y\nSOUS RÉSERVE DE L'ARTICLE\xa09 et alinéa premier, article 3",
    }
    chunks = segment.segment(docs(spark, *texts.items()), pf.STATUTES)
    by = {}
    for r in chunks.collect():
        by.setdefault(r.doc_id, []).append(r)
    plain = by["no/heading.v2.txt"][0]
    assert (plain.level, plain.path, plain.text, plain.char_start, plain.char_end) == ("document", "heading.v2", "plain \xa0text", 0, len(texts["no/heading.v2.txt"]))
    assert "only/outer.txt" not in by and by["null.txt"][0].text == ""
    assert by["emoji.txt"][0].char_start == 3
    assert by["next.txt"][0].title == "The title"
    refs = {(r.relation, r.raw, r.target_chunk_id) for r in xref.cross_references(chunks, pf.STATUTES).where("doc_id = 'upper.txt'").collect()}
    assert refs == {("EXCEPTION_TO", "9", None), ("REFERS_TO", "premier", None)}


def test_oversize_pages_and_limits(spark):
    body = "Article 1 - t\nhead text\n1) first item is here\n2) second item is here"
    df = docs(spark, ("d", body))
    cut = segment.segment(df, pf.with_limits(pf.STATUTES, max_chars=30)).orderBy("char_start").collect()
    assert [r.text for r in cut] == ["Article 1 - t\nhead text", "1) first item is here", "2) second item is here"]
    spans = spark.createDataFrame([("d", 1, 5, 20), ("d", 2, 24, 80)], "doc_id string, page int, char_start int, char_end int")
    paged = segment.segment(df, pf.with_limits(pf.STATUTES, max_chars=30), spans).orderBy("char_start").collect()
    assert [r.page for r in paged] == [1, 2, 2] and paged[0].path.endswith("(p. 1)") and paged[0].id == cut[0].id
    stats = segment.statistics(segment.segment(df, pf.STATUTES), xref.cross_references(segment.segment(df, pf.STATUTES), pf.STATUTES)).first()
    assert (stats.documents, stats.chunks, stats.median_chars, stats.one_chunk_per_document) == (1, 1, len(body), True)
    assert segment.first_chunks(segment.segment(df, pf.STATUTES), 1).count() == 1


def test_handbook_levels_that_meet(spark):
    rows = segment.heading_marks(docs(spark, ("d", "CHAPTER ONE\nDRY WOOD\ntext see page 3 and See Chapter IV")), pf.HANDBOOK).orderBy("pos", "rank").collect()
    assert [(r.level, r.title) for r in rows] == [("section", "CHAPTER ONE"), ("section", "DRY WOOD")] or rows[0].level in ("chapter", "section")
    refs = xref.scan(segment.segment(docs(spark, ("d", "DRY WOOD\ntext see page 3 and See Chapter IV")), pf.HANDBOOK), pf.HANDBOOK).collect()
    assert {(r.target_level, r.raw) for r in refs} == {("page", "3"), ("chapter", "IV")}


def test_find_all_against_re(spark):
    import re

    for text in ["", "a1b22", "11", "x", "😀1é2", "1x1"]:
        got = spark.createDataFrame([(text,)], "t string").select(find_all(F.col("t"), "([0-9])([0-9])?", 2).alias("m")).first().m
        assert [(m.pos, m.end, m.g1, m.g2) for m in got] == [(m.start(), m.end(), m[1], m[2] or "") for m in re.finditer("([0-9])([0-9])?", text)]


def paged(spark):
    head = lambda i: f"Code of trade {i}   2024"
    wide = "This line of the page runs to the right margin of it all and so was"
    pages = [
        f"{head(1)}\n\nArticle 1 - One\nThe   sel-\nler  has duties.\n{wide}\nwrapped here.\nShort end\nArticle 2 - Two\nMore text that is long enough to count\nPage 1 sur 3",
        f"{head(2)}\n\nArticle 12 - Twelve\nText of the second page, which is long enough\n{wide}\n(so it is)\n\n\n\nArticle 13 - T\nbody of it\nPage 2 sur 3",
        "   \n ",
        f"{head(3)}\n\nArticle 14 - Last\nText of the last page, which is long as well\n{wide}\nPage 3 sur 3",
    ]
    return spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(pages)], "doc_id string, page int, text string")


def test_find_all_where_texts_hold_the_signs_that_part_matches(spark):
    for text in ("a1b2", "a\x011\x02b2", "\x01\x0212\x01", "1\x02", "$1 \\2", "1", "12" * 20):
        got = spark.createDataFrame([(text,)], "t string").select(find_all(F.col("t"), "([0-9])([a-z\x02])?", 2).alias("m")).first().m
        assert [tuple(x) for x in got] == [(m.start(), m.end(), m[1], m[2] or "") for m in re.finditer("([0-9])([a-z\x02])?", text)]


def test_white_space_goes_as_a_pattern_says(spark):
    every = "".join(map(chr, (*range(1, 0xD800), *range(0xE000, 0x10000))))
    df = spark.createDataFrame([(f"{c}x{c}",) for c in every], "t string")
    assert df.where(strip(F.col("t")) != F.regexp_replace("t", r"(?U)\A[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", "")).count() == 0
    # A trim is compiled with the rest of a row's work, a pattern is searched twice.
    assert "regexp" not in df.select(strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def _shuffles(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_references_are_told_in_their_row_and_common_keys_by_broadcast(spark, monkeypatch):
    law = lambda k: f"TITRE I - A\n\nArticle 1 - x\nvoir article 2 et article 2, modifie l'article 2, article {k}.\nArticle 2 - y\nsous réserve de l'article 1, article 1. Article 1\nArticle 2 - z\nvoir article 9{k}, article 2."
    chunks = segment.segment(docs(spark, *((f"d{k}.txt", law(k)) for k in range(1, 8))), pf.STATUTES).localCheckpoint()
    for scope in ("document", "corpus"):
        want = xref.dedupe(xref.resolve(xref.scan(chunks, pf.STATUTES), xref.index(chunks, scope), scope))
        for least in (1, 8, 10_000):
            monkeypatch.setattr(xref, "COMMON_REFERENCES", least)
            got = xref.cross_references(chunks, pf.STATUTES, scope)
            assert got.columns == want.columns and got.count() == want.count() > 20
            assert got.exceptAll(want).isEmpty()
    monkeypatch.setattr(xref, "COMMON_REFERENCES", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan, n = _shuffles(xref.cross_references(chunks, pf.STATUTES, "document"))
        assert n == 1 and "Join" not in plan
        assert "BroadcastHashJoin" in _shuffles(xref.cross_references(chunks, pf.STATUTES))[0]
        edges = graph.parser_edges(xref.cross_references(chunks, pf.STATUTES, "document"), chunks)
        assert _shuffles(edges)[1] == 5  # the window's, two for each end, none for the edges
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_chunks_that_are_read_twice_are_made_once(spark):
    from tessera.plans import registry

    for name in ("paged_chunks", "lexical_graph"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "LIVRE" not in plan and "regexp" not in plan, name


def test_statute_graph_moves_no_chunk_for_its_making(spark, monkeypatch):
    from tessera.plans import registry

    plans, real = {}, registry.materialize
    monkeypatch.setattr(registry, "materialize", lambda s, df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or real(s, df, name))
    registry.queries()["expand_statutes"](spark, "/root/testdata/sf0.001")
    assert "Join" not in plans["nodes"]


def test_page_cleanup(spark):
    texts, spans = clean.clean_pages(paged(spark))
    text = texts.first().text
    assert "Code of trade" not in text and "sur 3" not in text
    assert "The seller has duties." in text and "so was wrapped here." in text and "so was (so it is)" in text
    assert "\nShort end\nArticle 2" in text and "\n\n\n" not in text
    assert [r.page for r in spans.orderBy("page").collect()] == [1, 2, 4]
    for r in spans.collect():
        assert text[r.char_start : r.char_end].strip("\n") == text[r.char_start : r.char_end]
    chunks = segment.segment(texts.select("doc_id", "text"), pf.STATUTES, spans)
    assert {r.number: r.page for r in chunks.collect()} == {"1": 1, "2": 1, "12": 2, "13": 2, "14": 4}
    kept = clean.clean_pages(paged(spark), keep_headers=True, no_reflow=True)[0].first().text
    assert "Code of trade" in kept and "so was\nwrapped" in kept


def test_squeeze_and_measure(spark):
    got = spark.createDataFrame([("      a   b \n \t \n  c  d",)], "t string").select(clean.squeeze(F.col("t")).alias("s")).first().s
    assert got == "    a b\n\n  c d"
    lines = ["x" * n for n in (30, 31, 32, 33, 34, 35, 36, 37, 38, 39)] + ["short"]
    df = spark.createDataFrame([("d", 1, "\n".join(lines)), ("e", 1, "few")], "doc_id string, page int, text string")
    assert {r.doc_id: r.measure for r in clean.full_measure(df).collect()} == {"d": 39, "e": 0}


def graph_of(spark, nodes, edges):
    n = spark.createDataFrame([(i, labels, props) for i, labels, props in nodes], graph.NODES)
    return n, spark.createDataFrame([(a, r, b, p) for a, r, b, p in edges], graph.EDGES)


def test_pruning(spark):
    own = pf.from_dict(
        {
            "name": "p", "segmentation": {"hierarchy": [{"level": "x", "pattern": "x(.)"}], "chunk_at": "x"},
            "schema": {"node_types": ["A", {"label": "B", "properties": [{"name": "name", "type": "STRING", "required": True}]}], "relationship_types": ["R"], "patterns": [["A", "R", "B"]]},
        }
    )
    nodes, edges = graph_of(
        spark,
        [("a", ["A"], {"name": "a", "free": "1"}), ("b", ["B"], {"name": "b", "odd": "1"}), ("b2", ["B"], {"odd": "1"}), ("c", ["C"], {"name": "c"}), ("", ["A"], {"name": "x"}), ("e", ["A"], {}), ("n", [""], {"name": "n"})],
        [("a", "R", "b", {}), ("b", "R", "a", {"quote": "q"}), ("a", "S", "b", {}), ("a", "", "b", {}), ("a", "R", "gone", {}), ("a", "R", "a", {})],
    )
    n, e = graph.prune(nodes, edges, own)
    assert {r.id: r.properties for r in n.collect()} == {"a": {"name": "a", "free": "1"}, "b": {"name": "b"}}
    assert sorted((r.src, r.rel, r.dst) for r in e.collect()) == [("a", "R", "b"), ("a", "R", "b")]


def test_validation(spark):
    nodes, edges = graph_of(
        spark,
        [("d1", ["Obligation", "__Entity__"], {"name": "Pay "}), ("d2", ["Obligation", "__Entity__"], {"name": "pay"}), ("c", ["Chunk"], {}), ("c2", ["Chunk"], {}), ("x", ["Odd", "__Entity__"], {}), ("k", ["Actor", "__Entity__"], {"name": "k"})],
        [("d1", "PART_OF_CHUNK", "c", {}), ("c", "REFERS_TO", "c2", {"source": "parser"}), ("k", "IMPOSES", "d1", {"quote": ""}), ("d1", "APPLIES_TO", "k", {"quote": "w"}), ("d1", "WRONG", "k", {})],
    )
    catalog = index.catalog(spark, pf.STATUTES).where("name <> 'chunk_words'")
    rows = {r.check: r for r in validate.validate(nodes, edges, pf.STATUTES, catalog).collect()}
    assert {k: (r.ok, r.observed) for k, r in rows.items()} == {
        "undeclared labels": (False, 1.0), "undeclared relations": (False, 1.0), "pattern violations": (False, 1.0), "hubs": (True, 0.0), "orphans": (False, 1.0),
        "provenance": (False, 0.5), "duplicate names": (False, 2.0), "missing indexes": (False, 1.0),
    }
    none = graph_of(spark, [("c", ["Chunk"], {})], [("c", "NEXT_CHUNK", "c", {})])
    assert validate.provenance(none[1]).first().coverage == 1.0


def test_edges_are_dealt_by_their_number(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"n{k}", [f"L{k % 3}"], {"name": "x"}) for k in range(30)], graph.NODES)
    edges = spark.createDataFrame([(f"n{k % 30}", "R", f"n{k * k % 30}", {}) for k in range(100)], graph.EDGES)
    monkeypatch.setattr(graph, "PART_ROWS", 5)
    found = graph.triples(nodes, edges)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2 and ", 20\n" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sum(r.n for r in found.collect()) == 100


def test_hubs_and_exemptions(spark):
    own = pf.with_limits(pf.HANDBOOK, max_degree=2, exempt=("fire",))
    names = ["Fire", "hub"] + [f"n{i}" for i in range(4)]
    nodes, edges = graph_of(spark, [(n, ["Tool", "__Entity__"], {"name": n}) for n in names], [(h, "X", f"n{i}", {}) for h in ("Fire", "hub") for i in range(4)] + [("hub", "X", "hub", {})])
    assert [(r.id, r.degree) for r in validate.hubs(nodes, edges, own).collect()] == [("hub", 5)]
    assert validate.hubs(nodes, edges, own, top=1, exempt_first=False).count() == 1


def test_upsert_is_idempotent_and_the_graph_reloads(spark, tmp_path):
    nodes, edges = graph_of(spark, [("a", ["A"], {"name": "a"}), ("b", ["A"], {"name": "b"})], [("a", "R", "b", {"raw": "1", "old": "x"})])
    path = str(tmp_path / "g")
    for _ in range(2):
        sinks.write_graph(spark, nodes, edges, path)
    more = graph_of(spark, [("b", ["A"], {"name": "bb"})], [("a", "R", "b", {"raw": "2"})])
    sinks.write_graph(spark, *more, path)
    n, e = corpus.read_graph(spark, path)
    assert {r.id: r.properties["name"] for r in n.collect()} == {"a": "a", "b": "bb"}
    assert [(r.src, r.properties) for r in e.collect()] == [("a", {"raw": "2", "old": "x"})]
    sinks.reset_graph(spark, path)
    assert corpus.read_graph(spark, path)[0].count() == 0


def test_extraction_and_summary(spark):
    chunks = spark.createDataFrame([("c1", "Salt and olive oil"), ("c2", None), ("c3", "bad")], "id string, text string")
    found = providers.get(providers.EXTRACTORS, "gazetteer")({"salt": "Ingredient", "olive oil": "Ingredient"})

    def extractor(i, text):
        if text == "bad":
            raise ValueError("no")
        return found(i, text)

    rows = {r.chunk_id: r for r in graph.extract(chunks, extractor).collect()}
    assert [n.id for n in rows["c1"].nodes] == ["salt", "olive oil"] and rows["c2"].nodes == [] and "no" in rows["c3"].error
    with pytest.raises(Exception, match="no"):
        graph.extract(chunks, extractor, strict=True).collect()
    nodes, edges, mentions = graph.records_to_graph(graph.extract(chunks, extractor))
    assert {r.node_id for r in mentions.collect()} == {"c1:salt", "c1:olive oil"} and edges.count() == 0
    assert "salt" in graph.prompt(F.lit("salt"), pf.COOKBOOK)._jc.toString()


def test_resolution(spark):
    names = ["Alpha Board", "alpha board", "Alpha Boards", "Beta", "Betas Group Ltd", "Beta Group Ltd", "Gamma"]
    nodes, edges = graph_of(spark, [(f"n{i}", ["Actor", "__Entity__"], {"name": n}) for i, n in enumerate(names)] + [("z", ["Actor", "Resolved"], {"name": "Beta"})], [("n2", "R", "n6", {"quote": "q"}), ("n0", "R", "n6", {"w": "1"})])
    own = resolve.scoped(nodes, ("Actor",))
    mapping = {r.id: r.canonical for r in resolve.fuzzy(spark, own, 0.88).collect()}
    assert mapping == {"n0": "n0", "n1": "n0", "n2": "n0", "n3": "n3", "n4": "n4", "n5": "n4", "n6": "n6"}
    n, e = resolve.resolve(spark, nodes, edges, pf.STATUTES)
    assert sorted(r.id for r in n.collect()) == ["n0", "n3", "n4", "n6", "z"]
    assert [(r.src, r.dst) for r in e.collect()] == [("n0", "n6")]


def test_fuzzy_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(2)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    names = sorted({x for b in base for x in (b, b[:-1] + "x", "y" + b, b[: len(b) // 2] + b[len(b) // 2 + 1 :]) if x})
    ents = spark.createDataFrame([(f"i{k:04d}", "L", n) for k, n in enumerate(names)], "id string, label string, name string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for t in (0.6, 0.8, 0.9):
        want = {(f"i{i:04d}", f"i{j:04d}") for i in range(len(names)) for j in range(i + 1, len(names)) if 1 - distance(names[i], names[j]) / max(len(names[i]), len(names[j])) >= t}
        assert {(r.a, r.b) for r in resolve.fuzzy_pairs(ents, t).collect()} == want


def test_semantic_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(8)
    rows = []
    for g in range(80):
        base = [rng.gauss(0, 1) for _ in range(16)]
        size = sum(x * x for x in base) ** 0.5
        rows += [(f"v{g:02d}{k}", f"L{g % 2}", [x + rng.gauss(0, 0.12) * size for x in base]) for k in range(3)]

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    want = {(a, b) for a, la, x in rows for b, lb, y in rows if a < b and la == lb and cos(x, y) >= 0.8}
    df = spark.createDataFrame(rows, "id string, label string, embedding array<double>")
    assert len(want) > 50
    got = resolve.semantic_pairs(df.select("id", "label", F.col("id").alias("name")), df.select("id", "embedding"), 0.8)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_semantic_pairs_move_once_a_block_and_forests_connect_the_same(spark):
    import random

    rng = random.Random(3)
    rows = [(f"v{k:03d}", "L", [rng.gauss(0, 1) for _ in range(4)]) for k in range(300)]
    rows += [("zero", "L", [0.0] * 4), ("tiny", "L", [1e-150, 0.0, 0.0, 0.0]), ("short", "L", [1.0]), ("none", "L", None), ("hole", "L", [1.0, None, 0.0, 0.0]), ("v000", "L", [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, label string, embedding array<double>")
    ents, vectors = df.select("id", "label"), df.select("id", "embedding")
    met = df.alias("p").join(df.alias("q"), F.expr("p.label = q.label and p.id < q.id"))
    score = cosine(F.col("p.embedding"), F.col("q.embedding"))
    want = {(r.a, r.b): r.s for r in met.groupBy(F.col("p.id").alias("a"), F.col("q.id").alias("b")).agg(F.max(score).alias("s")).where("s >= 0.9").collect()}
    for blocks in (1, 5, None):
        found = resolve.semantic_pairs(ents, vectors, 0.9, blocks)
        got = found.collect()
        assert len(got) == len(want) and {(r.a, r.b): r.score for r in got} == want
    # Rows are not joined to rows: all pairs as rows are what made the work grow out of bounds.
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    links = resolve._compared(ents, vectors, 0.9, 5, True).collect()
    assert len(links) < len(want) and len(links) <= 6 * len(rows)
    root = {i: i for i, _, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in want:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    assert {r.id: r.canonical for r in resolve.semantic(spark, ents, vectors, 0.9).collect()} == {i: top(i) for i in root}


def test_semantic_and_vocabulary(spark):
    ents = spark.createDataFrame([("a", "M", "oak"), ("b", "M", "oak tree"), ("c", "M", "stone")], "id string, label string, name string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0, 0.1]), ("b", [1.0, 0.02, 0.1]), ("c", [-1.0, 1.0, 0.0])], "id string, embedding array<float>")
    assert {r.id: r.canonical for r in resolve.semantic(spark, ents, vectors, 0.95).collect()} == {"a": "a", "b": "a", "c": "c"}
    terms = resolve.vocabulary_terms(spark.createDataFrame([("Scallion", "spring onion|green onion"), ("Tomato", "tomatoes")], "canonical string, aliases string"))
    names = spark.createDataFrame([("Scallion",), (" Green Onion",), ("scallions",), ("spring onoin",), ("brick",), (None,)], "name string")
    assert {r.name: (r.canonical, r.tier) for r in resolve.normalize(names, terms, 0.8).collect()} == {"Scallion": ("Scallion", 1), " Green Onion": ("Scallion", 2), "scallions": ("Scallion", 3), "spring onoin": ("Scallion", 4), "brick": (None, 0)}


def test_communities(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(4) for j in range(i)]
    edges = spark.createDataFrame(clique("a") + clique("b") + [("a0", "b0")], "src string, dst string")
    found = {r.node: r.community for r in resolve.communities(spark, edges).collect()}
    assert len({found[f"a{i}"] for i in range(4)}) == 1 and found["a1"] != found["b1"]


def test_hard_filters_of_recipes(spark):
    nodes, edges = graph_of(
        spark,
        [("c1", ["Chunk"], {"text": "t1"}), ("c2", ["Chunk"], {"text": "t2"}), ("r", ["Recipe"], {"name": "pie"}), ("i", ["Ingredient"], {"name": "nut"}), ("al", ["Allergen"], {"name": "nuts"}), ("dt", ["DietTag"], {"name": "vegan"})],
        [("r", "PART_OF_CHUNK", "c1", {}), ("r", "USES_INGREDIENT", "i", {"amount": "2"}), ("i", "CONTAINS_ALLERGEN", "al", {}), ("i", "EXCLUDED_BY", "dt", {})],
    )
    seeds = spark.createDataFrame([("c1", 0.9), ("c2", 0.8)], "chunk_id string, score double")
    run = lambda **k: {r.chunk_id: (r.text, r.recipe) for r in retrieve.expand(seeds, nodes, edges, pf.COOKBOOK, k).collect()}
    assert run() == {"c1": ("t1", "pie"), "c2": ("t2", None)}
    assert run(exclude_allergens=["nuts"]) == run(diet_tags=["vegan"]) == {"c2": ("t2", None)}
    assert run(exclude_allergens=["nuts"], strict=False) == {"c1": ("t1", None), "c2": ("t2", None)}
    assert retrieve.expand_cookbook(seeds, nodes, edges).where("chunk_id = 'c1'").first().ingredients == ["nut 2 "]


def test_statute_expansion(spark):
    nodes, edges = graph_of(
        spark,
        [("c1", ["Chunk"], {"text": "t", "path": "p1"}), ("c2", ["Chunk"], {"text": "u" * 600, "path": "p2"}), ("c3", ["Chunk"], {"text": "old", "in_force_to": "2020-01-01"}), ("e", ["Clause"], {"name": "e"}), ("x", ["Clause"], {"name": "x"})],
        [("c1", "AMENDS", "c2", {}), ("e", "PART_OF_CHUNK", "c1", {}), ("x", "EXCEPTION_TO", "e", {})],
    )
    seeds = spark.createDataFrame([("c1", 0.9), ("c2", 0.8), ("c3", 0.7)], "chunk_id string, score double")
    rows = {r.chunk_id: r for r in retrieve.expand_statutes(seeds, nodes, edges, datetime.date(2020, 1, 1)).collect()}
    assert set(rows) == {"c1", "c2"} and rows["c1"].exceptions == ["x"]
    assert [tuple(c) for c in rows["c1"].cited_clauses] == [("AMENDS", "p2", "u" * 500)]
    assert [tuple(c) for c in rows["c2"].cited_clauses] == [(None, None, None)] and rows["c2"].obligations == []


def test_search_modes_and_small_parts(spark):
    texts = spark.createDataFrame([("a", "red apple tree"), ("b", "green apple"), ("c", None)], "id string, text string")
    postings, lengths = index.fulltext_index(texts)
    assert [r.id for r in index.bm25(postings, lengths, "red apple", 5).collect()] == ["a", "b"]
    vectors = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.0]), ("c", [0.0, 0.0])], "id string, embedding array<float>")
    assert [r.id for r in index.vector_topk(vectors, [1.0, 0.1], 5).collect()] == ["b", "a"]
    assert {r.chunk_id for r in retrieve.seeds(vectors, postings, lengths, "red", [1.0, 0.0], 2).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        retrieve.seeds(vectors, postings, lengths, "q", [1.0], mode="other")
    with pytest.raises(Exception, match="dimensions"):
        index.vector_index(vectors, 3).collect()
    assert retrieve.parse_params(["k=3", "names=[\"a\"]", "q=free text"]) == {"k": 3, "names": ["a"], "q": "free text"}
    assert retrieve.route("how many recipes?") == "count" and retrieve.route("tell me of salt") == "hybrid"
    rows = spark.createDataFrame([("u", False, None), ("v", True, None), ("u", False, datetime.date(2000, 1, 1))], "owner string, public boolean, valid_to date")
    assert retrieve.visible(rows, "u", datetime.date(2020, 1, 1)).count() == 2
    embed = providers.get(providers.EMBEDDERS, "hashed")(16)
    assert embed("salt") == embed("salt") and abs(sum(x * x for x in embed("salt")) - 1) < 1e-9
    near = graph.neighbourhood(spark.createDataFrame([("a", "R", "b"), ("b", "R", "c"), ("c", "R", "d")], "src string, rel string, dst string"), spark.createDataFrame([("a",)], "id string"), 2)
    assert sorted((r.node, r.hop) for r in near.collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_cost(spark):
    chunks = spark.createDataFrame([("a", "x" * 400), ("b", None)], "id string, text string")
    r = cost.estimate(chunks, 1300).first()
    assert (r.chunks, r.input_tokens, r.output_tokens, r.schema_heavy) == (2, 1100.0, 35.0, True)
    prices = spark.createDataFrame([("m", 2.0, 4.0)], "model string, input_price double, output_price double")
    assert cost.estimate(chunks, 1300, prices).first().cost == 2340.0


def test_files(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_bytes(b"caf\xe9")
    (folder / "b.md").write_text("é", encoding="utf-8")
    (folder / "c.bin").write_text("no")
    rows = {r.doc_id.rsplit("/", 1)[-1]: r.text for r in corpus.read_corpus(spark, str(tmp_path / "in")).collect()}
    assert rows == {"a.txt": "caf�", "b.md": "é"}
    assert corpus.read_corpus(spark, str(folder / "c.bin")).first().text == "no"
    (folder / "p.pdf").write_text("one\ftwo\f \n")
    (folder / "q.pdf").write_bytes(b"x")

    def picky(content):
        if content == b"x":
            raise ValueError("odd")
        return providers.text_pages(content)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(str(folder))
    pages = corpus.extract_pages(files, {"first": picky, "second": lambda c: ["fallback"]}).collect()
    assert sorted((r.page, r.text, r.engine_used) for r in pages) == [(1, "fallback", "second"), (1, "one", "first"), (2, "two", "first")]
    assert corpus.extract_pages(files, {"none": lambda c: 1 / 0}).where("error is not null and page is null").count() == 2
    seen = files.select("path", "modificationTime")
    assert corpus.changed_files(seen, seen).count() == 0 and corpus.changed_files(seen, seen.limit(0)).count() == 2
    split = corpus.split_form_feeds(docs(spark, ("d", "a\fb\f ")))
    assert [(r.page, r.text) for r in split.orderBy("page").collect()] == [(1, "a"), (2, "b")]
    assert corpus.diagnose(split).first().has_text is False
    chunks = xref.attach(segment.segment(docs(spark, ("d", LAW)), pf.STATUTES), xref.cross_references(segment.segment(docs(spark, ("d", LAW)), pf.STATUTES), pf.STATUTES))
    sinks.write_chunks(chunks, str(tmp_path / "chunks"))
    assert corpus.read_chunks(spark, str(tmp_path / "chunks"), 2).count() == 2
    (folder / "m.pages.json").write_text('[{"page": 1, "char_start": 0, "char_end": 5}]')
    (folder / "n.pages.json").write_text("not json")
    assert [(r.page, r.char_end) for r in corpus.read_page_map(spark, str(folder)).collect()] == [(1, 5)]


def test_streamed_documents(spark, tmp_path):
    from tessera.streaming.ingest import ingest

    src, dst, ck = (str(tmp_path / x) for x in ("src", "dst", "ck"))
    docs(spark, ("a", LAW)).write.parquet(src)
    for _ in range(2):
        ingest(spark, src, dst, ck, pf.STATUTES).awaitTermination()
    docs(spark, ("b", LAW)).write.mode("append").parquet(src)
    ingest(spark, src, dst, ck, pf.STATUTES).awaitTermination()
    nodes, edges = corpus.read_graph(spark, dst)
    assert nodes.where("array_contains(labels, 'Chunk')").count() == 10
    assert edges.groupBy("rel").count().where("rel = 'AMENDS'").first()["count"] == 2


def test_profiles(tmp_path):
    good = {"name": "x", "segmentation": {"hierarchy": [{"level": "a", "pattern": "^(A)"}], "chunk_at": "a"}, "schema": {"node_types": ["N"], "relationship_types": ["R"], "patterns": [["N", "R", "N"]]}}
    assert pf.from_dict(good).chunk_rank == 0
    import copy

    import yaml

    breaks = [("segmentation", "chunk_at", "b"), ("schema", "patterns", [["N", "R", "M"]]), ("schema", "patterns", [["N", "S", "N"]]), ("schema", "additional_patterns", True), ("schema", "node_types", ["N", "bad label"]), ("schema", "node_types", ["N", {"label": "M", "properties": []}]), ("segmentation", "hierarchy", [{"level": "a", "pattern": "x*"}])]
    for part, key, value in breaks:
        bad = copy.deepcopy(good)
        bad[part][key] = value
        with pytest.raises(pf.ProfileError):
            pf.from_dict(bad)
    (tmp_path / "own.yml").write_text(yaml.safe_dump(good))
    assert pf.load("own", (str(tmp_path),)).name == "x" and pf.load("cookbook").name == "cookbook"
    with pytest.raises(pf.ProfileError):
        pf.load("none")
    for p in pf.PRESETS.values():
        assert p.expansion and not any(p.additional)


def test_stable_id(spark):
    assert spark.range(1).select(stable_id(F.lit("a"), F.lit("é")).alias("i")).first().i == __import__("hashlib").sha1("a||é".encode()).hexdigest()[:16]
