"""Mixing sources to target weights by a low-discrepancy schedule.

Slot n of the schedule has the n-th van der Corput point, which cumulative weights map to a source. A slot's
rank among its source's slots has a closed form, so no source is ordered in one task. The r-th slot of a
source takes the r-th block of its documents, which a hash shuffles and whose words are cut into blocks of
equal size; a source with more slots than blocks starts again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import cluster
from tessera.llm.quality_rules import count_words

WEIGHTS = (5.0, 2.0, 1.0)
MOST_PASSES = 3
#: Points are multiples of 2 ** -BITS; sources meet slots in cells, so many that a cell has few sources, 2 ** LEAST_CELL_BITS at least.
BITS, LEAST_CELL_BITS = 44, 12
#: Words in a block at most, blocks in a source at least (where it has the words), and documents a cell.
MOST_WORDS, LEAST_BLOCKS, DOCS_A_CELL = 512, 256, 4096
#: Sources that a task orders.
ROWS_A_RANGE = 100_000


def source_key(source: Column) -> Column:
    """A key that is never null: null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def running(spark: SparkSession, rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with place (from 0 in this order, which must be total) and, by name, each sum over the rows before.

    Ranges of rows are summed by themselves, then the ranges' sums, so that no task has all rows.
    """
    part = cluster.fresh_names("part")[0]
    rows = rows.withColumns({"place": F.lit(1).cast("long"), **sums})
    parts = max(1, -(-rows.count() // ROWS_A_RANGE))
    rows = cluster.materialize(spark, rows.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()), "ranges")
    names = ["place", *sums]
    per = rows.groupBy(part).agg(*(F.sum(c).alias(c) for c in names))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    per = per.select(F.col(part), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{part}_{c}") for c in names))
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(per), part)
    return out.withColumns({c: F.col(f"{part}_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in names}).drop(part, *(f"{part}_{c}" for c in names))


def targets(spark: SparkSession, sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Per source of sized (source, size, n: so many alike): key, n_docs, source_size, target.

    Sources by code point, null last, take the weights in turn. Targets share the sum of all sizes by weight
    but stop at ``most`` times the source's size; the excess goes to the others by weight. With the sources
    by cap over weight, all before some place stop at their caps: running sums find it.
    """
    per = sized.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    per = running(spark, per, [F.col("source").asc_nulls_last()], {})
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))).withColumnRenamed("place", "number")
    per = per.withColumn("cap", (F.col("source_size") * most).cast("double"))
    per = cluster.materialize(spark, running(spark, per, [F.col("cap") / F.col("weight"), F.col("number")], {"capped": F.col("cap"), "weights": F.col("weight")}), "shares")
    size, weight = per.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(float(size or 0)) - F.col("capped")) / (F.lit(float(weight or 0)) - F.col("weights"))
    free = per.select(level.alias("level"), "place").where(level * F.col("weight") <= F.col("cap")).agg(F.min_by("level", "place")).first()[0]
    target = F.col("cap") if free is None else F.least(F.col("cap"), F.lit(free) * F.col("weight"))
    return per.select("source", source_key(F.col("source")).alias("key"), "n_docs", "source_size", target.alias("target"))


def points_below(n: np.ndarray, t: np.ndarray, bits: int = BITS) -> np.ndarray:
    """How many of the first n van der Corput points (as integers of so many bits) lie below t."""
    total = np.zeros(len(n), np.int64)
    turned = np.zeros(len(n), np.int64)  # of the bits of n above the present one
    for i in range(bits - 1, -1, -1):
        on = (n >> i) & 1
        if not on.any():
            continue
        step = np.int64(1) << np.int64(bits - i)
        k = np.clip(-((turned - t) // step), 0, np.int64(1) << np.int64(i))  # ceil((t - turned) / step)
        total += np.where(on == 1, k, 0)
        turned += on << (bits - 1 - i)
    return total


def schedule(spark: SparkSession, per: DataFrame) -> DataFrame:
    """The slots in order: slot, key, block, pass. per: key, source_size, target."""
    per = per.where("source_size > 0 and target > 0")
    per = per.withColumn("words", F.greatest(F.lit(1), F.least(F.lit(MOST_WORDS), F.floor(F.col("source_size") / LEAST_BLOCKS)))).withColumns(
        {"quota": F.round(F.col("target") / F.col("words")).cast("long"), "blocks": F.ceil(F.col("source_size") / F.col("words"))}
    )
    per = per.where("quota > 0")
    per = cluster.materialize(spark, running(spark, per, [F.col("key")], {"before": F.col("quota")}), "quotas")
    slots, sources = per.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count(F.lit(1))).first()
    total, upto = F.lit(slots), F.col("before") + F.col("quota")
    edge = lambda c: F.floor(c / total * F.lit(float(1 << BITS))).cast("long")
    per = per.withColumns({"low": edge(F.col("before")), "high": F.when(upto == total, F.lit(1 << BITS)).otherwise(edge(upto))})
    cell_bits = max(LEAST_CELL_BITS, min(BITS, int(sources).bit_length() + 1))
    if slots >= 1 << (BITS - 1):
        raise ValueError("more slots than points; let MOST_WORDS be larger")
    n = slots + slots // 256 + 2 * BITS if slots else 0  # past the end, until each source has had its quota
    point = F.conv(F.reverse(F.lpad(F.bin("id"), BITS, "0")), 2, 10).cast("long")
    run = spark.range(0, n, 1, max(1, min(n // 50_000 + 1, 100_000))).select(F.col("id").alias("slot"), point.alias("point"))
    run = run.withColumn("cell", F.shiftright("point", BITS - cell_bits))
    cells = per.withColumn("cell", F.explode(F.sequence(F.shiftright("low", BITS - cell_bits), F.shiftright(F.greatest(F.col("low"), F.col("high") - 1), BITS - cell_bits))))
    met = run.join(cells, "cell").where("low <= point and point < high").select("slot", "key", "quota", "blocks", "low", "high")

    def rank(batches):
        for b in batches:
            slot, low, high = (b.column(k).to_numpy() for k in (0, 4, 5))
            r = points_below(slot, high) - points_below(slot, low)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(r)], ["slot", "key", "quota", "blocks", "rank"])

    cluster.ship(spark)
    ranked = met.mapInArrow(rank, "slot long, key string, quota long, blocks long, rank long").where("rank < quota")
    return ranked.select("slot", "key", F.pmod("rank", "blocks").alias("block"), F.expr("rank div blocks").alias("pass"))


def _each(spark: SparkSession, rows: DataFrame, run: int = 4096) -> DataFrame:
    """Each of n alike as a row with its number j; large groups are dealt out in runs first."""
    upto = F.col("n") - 1
    few = rows.where(F.col("n") <= run).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), upto)))
    many = rows.where(F.col("n") > run).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), upto, F.lit(run).cast("long")))).repartition(cluster.shuffle_partitions(spark))
    many = many.withColumn("j", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + run - 1, upto)))).drop("run")
    return few.unionByName(many)


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mix of all documents: (sized documents, segments).

    Sized documents: row (a number of the document in its source's shuffled order), id, key, size,
    source_size, target, one for each row of docs. Segments: slot, key, row, first_word, n_words: what each
    slot takes of which document, in the mix's order.

    A null or empty text has size 0 and no segment. A null id or source is a value like others; repeated
    rows are documents of their own. Other columns are not read. Reruns agree: the order is a hash of id,
    seed and size. An empty table gives empty ones.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col)).alias("size"))
    # Rows of one id, source and size are alike: one row with their number, however many there are, until the end.
    sized = cluster.materialize(spark, sized.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    per = cluster.materialize(spark, targets(spark, sized), "targets")
    slots = schedule(spark, per)

    # Running sums of words, in two steps: over cells of a source's shuffled order, then within a cell.
    known = per.select("key", "n_docs", "source_size", "target", F.greatest(F.lit(1), F.least(F.lit(MOST_WORDS), F.floor(F.col("source_size") / LEAST_BLOCKS))).alias("words"))
    order = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f" {seed}")).cast("binary"))
    placed = sized.withColumn("key", source_key(F.col("source"))).join(known, "key")
    placed = placed.withColumn("order", order).withColumn("cell", F.pmod(F.conv(F.substring("order", 1, 12), 16, 10).cast("long"), F.ceil(F.col("n_docs") / DOCS_A_CELL)))
    by_cell = placed.groupBy("key", "cell").agg(F.sum(F.col("size") * F.col("n")).alias("cell_words"), F.sum("n").alias("cell_docs"))
    upto = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    by_cell = by_cell.select("key", "cell", F.coalesce(F.sum("cell_words").over(upto), F.lit(0)).alias("base_words"), F.coalesce(F.sum("cell_docs").over(upto), F.lit(0)).alias("base_docs"))
    within = Window.partitionBy("key", "cell").orderBy("order", "size")
    placed = placed.join(by_cell, ["key", "cell"]).withColumns(
        {
            "at": F.col("base_words") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "row": F.col("base_docs") + F.coalesce(F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    placed = cluster.materialize(spark, _each(spark, placed).select((F.col("row") + F.col("j")).alias("row"), "id", "key", "size", "source_size", "target", (F.col("at") + F.col("j") * F.col("size")).alias("at"), "words"), "placed")

    parts = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr("at div words"), F.expr("(at + size - 1) div words"))))
    first = F.greatest(F.col("at"), F.col("block") * F.col("words"))
    parts = parts.select("key", "block", "row", (first - F.col("at")).alias("first_word"), (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("words")) - first).alias("n_words"))
    segments = slots.join(parts, ["key", "block"]).select("slot", "key", "row", "first_word", "n_words")
    return placed.drop("at", "words"), segments


def taken(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, size, source_size, target (its source's), and taken, the words that the mix takes of it."""
    sized, segments = mix(spark, docs, id_col, source_col, text_col)
    per = segments.groupBy("key", "row").agg(F.sum("n_words").alias("taken"))
    out = sized.join(per, ["key", "row"], "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def repeat_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with each row as often as the mix takes its words, to the nearest whole number (0 to 3); all columns stay, of any name.

    Rows of one id are repeated alike. A document without words has none to take, and goes.
    """
    own, copies, copy = cluster.fresh_names("id", "copies", "copy")
    per = taken(spark, docs, id_col, source_col, text_col).groupBy(F.col(id_col).alias(own)).agg(F.sum("taken").alias("t"), F.sum("size").alias("s"))
    per = per.where("s > 0").select(own, F.round(F.col("t") / F.col("s")).cast("int").alias(copies)).where(F.col(copies) > 0)
    out = docs.join(per, docs[id_col].eqNullSafe(F.col(own))).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return out.select(*(docs[c] for c in docs.columns))
