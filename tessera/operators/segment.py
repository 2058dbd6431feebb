"""Segmentation: headings of every level, breadcrumbs, chunk bodies, stable ids, pages.

A document is one row throughout. Marks of all levels are found in one projection and folded in place, so no
window shuffles documents and the text never moves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import find_all, let, lstrip, running, stable_id, strip
from tessera.profile import Profile

#: Flags that give Java's patterns the meaning of multi-line Unicode patterns with \n as the line's end.
HEADING_FLAGS = "(?mdU)"
NO_XREFS = "array<struct<relation:string,raw:string,target_level:string,target_chunk_id:string,char_start:int,char_end:int>>"


def file_stem(doc_id: Column) -> Column:
    name = F.regexp_extract(doc_id, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def _mark(rank: int, groups: int) -> Callable[[Column], Column]:
    """A match as a mark: of two groups or more, the first is the number and the second the title; one group is the title."""

    def made(m: Column) -> Column:
        number = strip(m["g1"]) if groups > 1 else F.lit("")
        title = strip(m["g2"]) if groups > 1 else strip(m["g1"]) if groups else F.lit("")
        return F.struct(m["pos"].alias("pos"), F.lit(rank).alias("rank"), number.alias("number"), title.alias("title"))

    return made


def marks_of(text: Column, profile: Profile) -> Column:
    """All headings as (pos, rank, number, title), by place; of two at one place the outer comes first."""
    every = []
    for rank, level in enumerate(profile.levels):
        n = level.groups
        every.append(F.transform(find_all(text, HEADING_FLAGS + level.pattern, min(n, 2)), _mark(rank, n)))
    return F.sort_array(F.concat(*every))


def heading_marks(docs: DataFrame, profile: Profile) -> DataFrame:
    """doc_id, pos, rank, level, number, title of every heading."""
    names = F.array(*(F.lit(x.name) for x in profile.levels))
    marks = docs.select("doc_id", F.explode(marks_of(F.coalesce("text", F.lit("")), profile)).alias("m"))
    return marks.select("doc_id", "m.pos", "m.rank", F.element_at(names, F.col("m.rank") + 1).alias("level"), "m.number", "m.title")


def _label(name: Column, m: Column) -> Column:
    return F.concat_ws(" ", name, F.nullif(m["number"], F.lit("")), F.nullif(m["title"], F.lit("")))


_CRUMB = "array<struct<set:boolean,label:string>>"


def bodies_of(marks: Column, size: Column, profile: Profile) -> Column:
    """Chunks as (pos, end, number, title, path): to the next heading of the chunk's level or an outer one.

    A heading sets its level's part of the breadcrumbs, clears the inner ones and leaves the outer ones; what
    two after one another do is of the same form, so breadcrumbs are running results. A chunk's own heading is the
    last part and leaves all others, so only the outer headings, mostly few, run; chunks count how many of them came before.
    """
    names = F.array(*(F.lit(x.name) for x in profile.levels[: profile.chunk_rank]))
    edges = F.filter(marks, lambda m: m["rank"] <= profile.chunk_rank)
    here = profile.levels[profile.chunk_rank].name

    def own(m: Column) -> Column:
        return F.transform(names, lambda name, r: F.struct((r >= m["rank"]).alias("set"), F.when(r == m["rank"], _label(name, m)).alias("label")))

    def paths(edge: Column) -> Column:
        outer = F.filter(edge, lambda m: m["rank"] < profile.chunk_rank)
        merged = lambda a, b: F.zip_with(a, b, lambda x, y: F.when(y["set"], y).otherwise(x))
        return F.transform(running(F.transform(outer, own), merged, _CRUMB), lambda crumbs: F.concat_ws(" > ", F.transform(crumbs, lambda c: c["label"])))

    def walk(edge: Column) -> Column:
        def body(above: Column, before: Column) -> Column:
            every = F.transform(
                edge,
                lambda m, i: F.when(
                    m["rank"] == profile.chunk_rank,
                    F.struct(
                        m["pos"].alias("pos"), F.coalesce(F.get(edge, i + 1)["pos"], size).alias("end"), m["number"].alias("number"), m["title"].alias("title"),
                        F.concat_ws(" > ", F.get(above, F.get(before, i) - 1), _label(F.lit(here), m)).alias("path"),
                    ),
                ),
            )
            return F.filter(every, lambda x: x.isNotNull())

        counts = running(F.transform(edge, lambda m: (m["rank"] < profile.chunk_rank).cast("int")), lambda x, y: x + y)
        above = paths(edge) if profile.chunk_rank else F.array().cast("array<string>")
        return let(above, lambda a: let(counts, lambda c: body(a, c)))

    none = F.array().cast("array<struct<pos:int,end:int,number:string,title:string,path:string>>")
    return let(edges, lambda edge: F.when(F.size(edge) > 0, walk(edge)).otherwise(none))


def split_oversized(whole_body: Column, profile: Profile) -> Column:
    """(text, off) of a body: itself within the limit, else pieces from the split points, else windows of the limit."""
    return let(whole_body, lambda body: _split(body, profile))


def _split(body: Column, profile: Profile) -> Column:
    size, most = F.length(body), profile.max_chars
    whole = F.array(F.struct(body.alias("text"), F.lit(0).alias("off")))
    windows = F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(most)), lambda o: F.struct(F.substring(body, o + 1, F.lit(most)).alias("text"), o.alias("off")))
    if not profile.split_at:
        return F.when(size <= most, whole).otherwise(windows)

    def pieces(found: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.filter(F.transform(found, lambda m: m["pos"]), lambda p: p > 0))
        cut = let(starts, lambda s: F.transform(s, lambda o, i: F.struct(strip(F.substring(body, o + 1, F.coalesce(F.get(s, i + 1), size) - o)).alias("text"), o.alias("off"))))
        return F.when(F.size(found) > 0, F.filter(cut, lambda p: p["text"] != "")).otherwise(windows)

    return F.when(size <= most, whole).otherwise(let(find_all(body, HEADING_FLAGS + profile.split_at, 0), pieces))


#: The level of a document without headings. A profile's own levels should have other names.
FALLBACK = "document"


def _chunks_of(text: Column, doc_id: Column, profile: Profile) -> Column:
    """All chunks of a document as one array, so that marks are found once and no row carries more than its own text."""

    def chunk(path: Column, level: str, number: Column, title: Column, body: Column, start: Column, end: Column) -> Column:
        return F.struct(path.alias("path"), F.lit(level).alias("level"), number.alias("number"), title.alias("title"), body.alias("text"), start.alias("char_start"), end.alias("char_end"))

    def parts(b: Column) -> Column:
        def placed(raw: Column) -> Column:
            at = b["pos"] + F.length(raw) - F.length(lstrip(raw))
            return F.transform(split_oversized(strip(raw), profile), lambda p: chunk(b["path"], profile.chunk_at, b["number"], b["title"], p["text"], at + p["off"], at + p["off"] + F.length(p["text"])))

        return let(F.substring(text, b["pos"] + 1, b["end"] - b["pos"]), placed)

    stem = file_stem(doc_id)
    whole = F.array(chunk(stem, FALLBACK, F.lit(""), stem, strip(text), F.lit(0), F.length(text)))
    return let(marks_of(text, profile), lambda marks: F.when(F.size(marks) == 0, whole).otherwise(F.flatten(F.transform(bodies_of(marks, F.length(text), profile), parts))))


def segment(docs: DataFrame, profile: Profile, page_map: DataFrame | None = None) -> DataFrame:
    """Chunks of documents (doc_id, text): id, doc_id, path, level, number, title, text, char_start, char_end, page, seq.

    A document without any heading is one chunk of level "document"; one with headings but none at the
    chunk's level has no chunk. seq numbers a document's chunks. A null text is empty. With a page map
    (doc_id, page, char_start), each chunk has the last page that starts at or before it, or else the first.
    """
    rows = docs.select("doc_id", F.explode(_chunks_of(F.coalesce(F.col("text"), F.lit("")), F.col("doc_id"), profile)).alias("c")).select("doc_id", "c.*")
    key = F.when(F.col("level") == FALLBACK, stable_id(F.col("doc_id"), F.lit("0"))).otherwise(stable_id(F.col("doc_id"), F.col("path"), F.col("char_start").cast("string")))
    chunks = rows.select(key.alias("id"), "doc_id", "path", "level", "number", "title", "text", "char_start", "char_end", F.lit(None).cast("int").alias("page"))
    return chunks if page_map is None else stamp_pages(chunks, page_map)


def page_of(pages: Column, offset: Column) -> Column:
    """From an array of (char_start, page) by start: the last page at or before the offset, else the first, else null."""
    before = F.filter(pages, lambda p: p["char_start"] <= offset)
    return F.coalesce(F.get(before, F.size(before) - 1)["page"], F.get(pages, F.lit(0))["page"])


def stamp_pages(chunks: DataFrame, page_map: DataFrame) -> DataFrame:
    """Chunks with their page, and the page in their path; the id stays as it was."""
    maps = page_map.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("char_start", "page"))).alias("_pages"))
    out = chunks.join(maps, "doc_id", "left").withColumn("page", page_of(F.coalesce("_pages", F.array().cast("array<struct<char_start:int,page:int>>")), F.col("char_start")))
    path = F.when(F.col("page").isNotNull(), F.concat("path", F.lit(" (p. "), F.col("page").cast("string"), F.lit(")"))).otherwise(F.col("path"))
    return out.withColumn("path", path).select(chunks.columns)


def first_chunks(chunks: DataFrame, n: int) -> DataFrame:
    """The first n chunks by document and place."""
    return chunks.orderBy("doc_id", "char_start", "id").limit(n)


def statistics(chunks: DataFrame, xrefs: DataFrame) -> DataFrame:
    """One row: documents, chunks, upper median and largest size, references found and resolved, chunks with a page, and whether no document was cut."""
    size = F.length("text")
    # The upper median is the value at a fixed rank: found in the histogram of sizes, which is small at any scale.
    sizes = chunks.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"))
    held = sizes.agg(F.sort_array(F.collect_list(F.struct("size", "n"))).alias("h"), F.sum("n").alias("total"))
    fold = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at")), lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["at"], F.when(a["seen"] + x["n"] > F.floor(F.col("total") / 2), x["size"])).alias("at")), lambda a: a["at"])
    median = held.select(fold.alias("median_chars"), F.lit(1).alias("one"))
    main = chunks.agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("chunks"), F.max(size).alias("max_chars"), F.count("page").alias("paged_chunks")).withColumn("one", F.lit(1))
    refs = xrefs.agg(F.count(F.lit(1)).alias("xrefs"), F.count("target_chunk_id").alias("resolved")).withColumn("one", F.lit(1))
    return main.join(median, "one").join(refs, "one").drop("one").withColumn("one_chunk_per_document", F.col("documents") == F.col("chunks"))
