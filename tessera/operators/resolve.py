"""Entity resolution: exact, fuzzy, semantic and by vocabulary; classes are connected components.

Fuzzy pairs come from blocks of a key, never from all pairs of a label; semantic ones are all compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.profile import Profile
from tessera.sources.storage import materialize


def scoped(nodes: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """id, label, name of named entities with one of the labels that no resolution has seen yet."""
    own = nodes.where(~F.array_contains("labels", "Resolved")).select("id", F.explode("labels").alias("label"), F.try_element_at("properties", F.lit("name")).alias("name"))
    return own.where(F.col("label").isin(*labels) & F.col("name").isNotNull())


def exact(entities: DataFrame) -> DataFrame:
    """id, canonical: of the entities with one label and name, the least id."""
    least = entities.groupBy("label", "name").agg(F.min("id").alias("canonical"))
    return entities.join(least, ["label", "name"]).select("id", "canonical")


def similarity(a, b):
    """One less the edit distance over the longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def fuzzy_pairs(entities: DataFrame, threshold: float) -> DataFrame:
    """a, b, score of names of one label that are so similar.

    Names within the threshold share one of a few keys: with at most d edits allowed by the longer name's
    length, d + 1 disjoint pieces of the shorter name leave one untouched, at an offset of at most d. The
    keys are those pieces with their number, the shorter name's length and the label. A common
    piece ("inc") makes as large a group as there are names with it at that place.
    """
    key = F.lower(F.trim("name"))
    names = entities.select("label", key.alias("key"), "id").groupBy("label", "key").agg(F.min("id").alias("id"))
    n = F.length("key")
    # The longest partner of a name of n signs has n / threshold; its edits are bounded by (1 - threshold) of that.
    edits = F.greatest(F.lit(1), F.floor((1 - threshold) * n / threshold + 1e-9)).cast("int")
    pieces = F.least(edits + 1, n).cast("int")
    held = names.where(n > 0).withColumns({"n": n, "edits": edits, "pieces": pieces})

    def cut(i):  # the i-th of the pieces, counted from 0
        start = F.floor(F.col("n") * i / F.col("pieces")).cast("int")
        return start, F.floor(F.col("n") * (i + 1) / F.col("pieces")).cast("int") - start

    left = held.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    start, size = cut(F.col("i"))
    left = left.select("label", "id", "key", "n", F.col("n").alias("of"), "pieces", "i", F.substring("key", start + 1, size).alias("piece"), start.alias("start"))
    # The longer name looks for the shorter one's pieces: lengths from threshold * n to n, at offsets within the edits.
    right = held.withColumn("of", F.explode(F.sequence(F.greatest(F.lit(1), F.ceil(F.col("n") * threshold - 1e-9).cast("int")), F.col("n"))))
    of_edits = F.greatest(F.lit(1), F.floor((1 - threshold) * F.col("of") / threshold + 1e-9)).cast("int")
    right = right.withColumn("of_pieces", F.least(of_edits + 1, F.col("of")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("of_pieces") - 1)))
    begin = F.floor(F.col("of") * F.col("i") / F.col("of_pieces")).cast("int")
    length = F.floor(F.col("of") * (F.col("i") + 1) / F.col("of_pieces")).cast("int") - begin
    right = right.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), begin - of_edits), F.least(F.col("n") - length, begin + of_edits))))
    right = right.select("label", F.col("id").alias("id2"), F.col("key").alias("key2"), "of", "i", F.substring("key", F.col("at") + 1, length).alias("piece")).distinct()
    met = left.join(right, ["label", "of", "i", "piece"]).where("key <> key2").select("label", "id", "key", "id2", "key2").distinct()
    score = similarity(F.col("key"), F.col("key2"))
    return met.select("label", F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), score.alias("score")).where(F.col("score") >= threshold).distinct()


def fuzzy(spark: SparkSession, entities: DataFrame, threshold: float) -> DataFrame:
    """id, canonical over links of similar or (but for case and outer spaces) equal names."""
    key = F.lower(F.trim("name"))
    reps = entities.withColumn("key", key)
    least = reps.groupBy("label", "key").agg(F.min("id").alias("rep"))
    labels = components(spark, fuzzy_pairs(entities, threshold).select("a", "b"))
    return reps.join(least, ["label", "key"]).join(labels, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("component", "rep").alias("canonical"))


#: Rows of a block at most, and the numbers in it.
BLOCK_ROWS, BLOCK_NUMBERS = 16384, 1 << 22


def _comparison(threshold: float, forest: bool) -> Callable:
    """A group's rows (label, id, embedding, side) to what reaches the threshold: every pair and its cosine, or a forest that connects the same rows.

    A matrix product proposes what may reach it; sums in the order of the vectors' places, as functions.text.cosine
    has them, decide. Rows of side 0 meet those of side 1, or each other where a block meets itself.
    All is nested, so that executors need no package.
    """

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = pa.Table.from_batches(list(batches))
        label, ids = table.column("label")[0].as_py(), table.column("id").to_pylist()
        held = table.column("embedding").combine_chunks()
        n = len(ids)
        rows = np.asarray(held.flatten(), dtype=np.float64).reshape(n, -1)
        place = np.argsort(np.asarray(table.column("side")), kind="stable")
        rows, names = rows[place], np.array(ids, dtype=object)[place]
        cut = int((np.asarray(table.column("side")) == 0).sum())
        own = table.column("x")[0] == table.column("y")[0]
        columns = np.ascontiguousarray(rows.T)

        def dot(i, j):
            out = np.zeros(len(i))
            for c in columns:
                out += c[i] * c[j]
            return out

        every = np.arange(n)
        with np.errstate(all="ignore"):
            square = dot(every, every)
            size = np.sqrt(square)
            unit = rows / size[:, None]
            unit[~((square > 1e-200) & (square < 1e200))] = np.nan  # not told by a product: decided below
        root = every.copy()

        def unite(i, j):
            while len(i):
                a, b = root[i], root[j]
                apart = a != b
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while (root[root] != root).any():
                    root[:] = root[root]

        def batch(a, b, score):
            fields = [pa.array([label] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(score, pa.float64())]
            return pa.RecordBatch.from_arrays(fields, ["label", "a", "b", "score"])

        with np.errstate(all="ignore"):
            for x in range(0, cut, 1024):
                for y in range(x if own else cut, n, 2048):
                    i, j = np.nonzero(~(unit[x : min(x + 1024, cut)] @ unit[y : y + 2048].T < threshold - 1e-9))
                    i, j = i + x, j + y
                    told = root[i] != root[j] if forest else names[i] != names[j]
                    told &= i < j
                    i, j = i[told], j[told]
                    for k in range(0, len(i), 1 << 16):
                        p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                        both = size[p] * size[q]
                        score = dot(p, q) / both
                        kept = (both != 0) & ~(score < threshold)
                        if forest:
                            unite(p[kept], q[kept])
                        elif kept.any():
                            yield batch(names[p[kept]], names[q[kept]], score[kept])
        if forest:
            k = np.nonzero(root != every)[0]
            yield batch(names[k], names[root[k]], np.ones(len(k)))

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _compared(entities: DataFrame, vectors: DataFrame, threshold: float, blocks: int | None, forest: bool) -> DataFrame:
    """label, a, b, score by _comparison: rows of a label fall into blocks by a hash of the id, and each two blocks meet in a group of their own."""
    number = F.col("embedding") if vectors.schema["embedding"].dataType.elementType.typeName() in ("float", "double") else F.col("embedding").cast("array<double>")
    held = entities.select("id", F.col("label").cast("string").alias("label")).distinct().join(vectors.select("id", number.alias("embedding")), "id")
    held = held.where(F.col("label").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull()))
    held = materialize(entities.sparkSession, held.withColumn("dims", F.size("embedding")), "vectors")
    if blocks is None:
        # As few as hold a block in bounds: each row moves once a block.
        most = F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(1024), F.floor(F.lit(BLOCK_NUMBERS) / F.col("dims"))))
        blocks = max(4, held.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.ceil(F.col("n") / most))).first()[0] or 1)
    mine = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least(mine, k).alias("x"), F.greatest(mine, k).alias("y"), (mine > k).cast("int").alias("side")))
    dealt = held.withColumn("m", F.explode(met)).select("label", "dims", "m.x", "m.y", "m.side", F.col("id").cast("string").alias("id"), "embedding")
    # More parts than cores, whatever their bytes: the work is in the pairs.
    parts = max(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2000, blocks * (blocks + 1) // 2))
    return dealt.repartition(parts, "label", "dims", "x", "y").groupBy("label", "dims", "x", "y").applyInArrow(_comparison(threshold, forest), "label string, a string, b string, score double")


def semantic_pairs(entities: DataFrame, vectors: DataFrame, threshold: float, blocks: int | None = None) -> DataFrame:
    """a, b, score of names of one label whose vectors (id, embedding) have such a cosine: every pair, compared exactly.

    Blocks of a label's rows meet two by two as matrices, so the work is quadratic in a label's rows, spread over
    tasks, each within the memory of two blocks.
    """
    found = _compared(entities, vectors, threshold, blocks, False)
    return found.select("label", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").groupBy("label", "a", "b").agg(F.max("score").alias("score"))


def semantic(spark: SparkSession, entities: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """id, canonical over links of such vectors; of each two blocks' links a forest is enough."""
    links = _compared(entities, vectors, threshold, None, True).where("a <> b").select("a", "b")
    labels = components(spark, links)
    return entities.select("id").distinct().join(labels, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("canonical"))


def vocabulary_terms(table: DataFrame) -> DataFrame:
    """term, canonical of a vocabulary (canonical, aliases separated by | or ;): one canonical a term, the first by name."""
    own = table.select("canonical", F.explode(F.concat(F.array("canonical"), F.split(F.coalesce("aliases", F.lit("")), r"[|;]"))).alias("term"))
    own = own.withColumn("term", F.lower(F.trim("term"))).where("term <> ''")
    return own.groupBy("term").agg(F.min("canonical").alias("canonical"))


def normalize(names: DataFrame, terms: DataFrame, threshold: float = 0.88) -> DataFrame:
    """name, canonical, tier: the first of exact (1), without case and outer spaces (2), singular (3), most similar (4); null and 0 of none."""
    own = names.select("name").where("name is not null").distinct()
    canon = terms.select(F.col("canonical").alias("c1")).distinct()
    low = own.withColumn("low", F.lower(F.trim("name")))
    single = F.regexp_replace(F.regexp_replace("low", "ies$", "y"), r"(?<=[^s])s$|(?<=(?:x|ch|sh|ss))es$", "")
    low = low.withColumn("single", single)
    t2, t3 = terms.select(F.col("term").alias("low"), F.col("canonical").alias("c2")), terms.select(F.col("term").alias("single"), F.col("canonical").alias("c3"))
    met = low.join(canon, F.col("name") == F.col("c1"), "left").join(t2, "low", "left").join(t3, "single", "left")
    left = met.where("coalesce(c1, c2, c3) is null").select(F.lit("v").alias("label"), F.concat(F.lit("n:"), F.col("name")).alias("id"), F.col("low").alias("name"))
    right = terms.select(F.lit("v").alias("label"), F.concat(F.lit("t:"), F.col("term")).alias("id"), F.col("term").alias("name"))
    pairs = fuzzy_pairs(left.unionByName(right), threshold).where("a like 'n:%' and b like 't:%'")
    best = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    near = pairs.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(F.substring("a", 3, 1 << 20).alias("name"), F.substring("b", 3, 1 << 20).alias("term")).join(terms, "term").select("name", F.col("canonical").alias("c4"))
    out = met.join(near, "name", "left")
    tier = F.when(F.col("c1").isNotNull(), 1).when(F.col("c2").isNotNull(), 2).when(F.col("c3").isNotNull(), 3).when(F.col("c4").isNotNull(), 4).otherwise(0)
    return out.select("name", F.coalesce("c1", "c2", "c3", "c4").alias("canonical"), tier.alias("tier"))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, component of all nodes of links (a, b): the least node of what links lead to.

    Labels fall to the least neighbour's and then to their label's label, so their number of rounds grows
    with the logarithm of a chain's length; each round is a table of its own.
    """
    both = materialize(spark, links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        low = labels.join(near, "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        jump = low.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = materialize(spark, low.join(jump, "component", "left").select("node", F.least("component", F.coalesce("far", "component")).alias("component"), "was"), "labels")
        if new.where("component <> was").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def merge(nodes: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with each node replaced by its canonical one: labels and properties of all (the canonical's first), edges re-pointed and made one."""
    to = mapping.groupBy("id").agg(F.min("canonical").alias("canonical"))
    held = nodes.join(to, "id", "left").withColumn("canonical", F.coalesce("canonical", "id"))
    pairs = held.select("canonical", (F.col("id") != F.col("canonical")).alias("later"), "id", F.explode_outer(F.map_entries(F.coalesce("properties", F.create_map().cast("map<string,string>")))).alias("e"))
    props = pairs.where("e is not null").groupBy("canonical", F.col("e.key").alias("k")).agg(F.min_by("e.value", F.struct("later", "id")).alias("v"))
    props = props.groupBy("canonical").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    labels = held.groupBy("canonical").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels"), F.count(F.lit(1)).alias("n"))
    merged = labels.join(props, "canonical", "left").select(F.col("canonical").alias("id"), F.when(F.col("n") > 1, F.array_union("labels", F.array(F.lit("Resolved")))).otherwise(F.col("labels")).alias("labels"), F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"))
    a, b = to.select(F.col("id").alias("src"), F.col("canonical").alias("_a")), to.select(F.col("id").alias("dst"), F.col("canonical").alias("_b"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("_a", "src").alias("src"), "rel", F.coalesce("_b", "dst").alias("dst"), "properties")
    none = moved.limit(0)
    return merged, graph.upsert_edges(none, moved)


def resolve(spark: SparkSession, nodes: DataFrame, edges: DataFrame, profile: Profile, vectors: DataFrame | None = None, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply the profile's resolution rules, one after another."""
    for rule in profile.resolution:
        own = scoped(nodes, rule.labels)
        if rule.strategy == "exact":
            mapping = exact(own)
        elif rule.strategy == "fuzzy":
            mapping = fuzzy(spark, own, rule.threshold)
        elif rule.strategy == "semantic":
            if vectors is None:
                raise ValueError(f"rule for {rule.labels} needs vectors")
            mapping = semantic(spark, own, vectors, rule.threshold)
        elif rule.strategy == "vocabulary":
            if terms is None:
                raise ValueError(f"rule for {rule.labels} needs a vocabulary")
            named = own.join(normalize(own, terms), "name")
            least = named.where("canonical is not null").groupBy("label", "canonical").agg(F.min("id").alias("least"))
            mapping = named.join(least, ["label", "canonical"]).select("id", F.col("least").alias("canonical"))
        else:
            raise ValueError(f"no strategy {rule.strategy!r}")
        nodes, edges = merge(nodes, edges, materialize(spark, mapping, "mapping"))
    return nodes, edges


def communities(spark: SparkSession, edges: DataFrame, rounds: int = 8) -> DataFrame:
    """node, community by label propagation: each round a node takes its neighbours' most frequent label, the least of equals."""
    both = materialize(spark, edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct(), "both")
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels, both.dst == labels.node).groupBy("src", "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(F.col("src").alias("node")).agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("community"))
        labels = materialize(spark, best, "communities")
    return labels


def community_summaries(nodes: DataFrame, edges: DataFrame, labels: DataFrame, most: int = 5) -> DataFrame:
    """community, size, inner (edges within), names (the most linked members, at most so many): what a summary of each has to tell."""
    a, b = labels.select(F.col("node").alias("src"), F.col("community").alias("ca")), labels.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    inner = edges.join(a, "src").join(b, "dst").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("inner"))
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    named = labels.join(ends, "node", "left").join(nodes.select(F.col("id").alias("node"), F.try_element_at("properties", F.lit("name")).alias("name")), "node", "left")
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc_nulls_last("degree"), "node"))
    top = named.withColumn("place", place).where(F.col("place") <= most).groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"))
    return labels.groupBy("community").agg(F.count(F.lit(1)).alias("size")).join(top, "community").join(inner, "community", "left").select("community", "size", F.coalesce("inner", F.lit(0)).alias("inner"), "names")
