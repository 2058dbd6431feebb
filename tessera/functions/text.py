"""Text as columns: matches with their places, white space as Unicode has it, stable ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, control separators included.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once a row: the end of a fold over nothing, which, unlike a transform, copies neither."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE))


def blank(c: Column) -> Column:
    return strip(c) == ""


def stable_id(*parts: Column) -> Column:
    """Sixteen hex digits of the SHA-1 of the parts, joined by a double bar."""
    return F.substring(F.sha1(F.concat_ws("||", *parts).cast("binary")), 1, 16)


def reference_key(c: Column) -> Column:
    """How numbers and titles are compared: without spaces, in lower case."""
    return F.lower(F.replace(c, F.lit(" "), F.lit("")))


def running(values: Column, join: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """Running results of an associative join over an array of this type.

    A fold that appends copies its result at each step; so runs of about the root of the number fold by
    themselves, then the runs' ends, and each run goes on from the end of those before it.
    """

    def fold(part: Column) -> Column:
        step = lambda acc, x: F.array_append(acc, F.when(F.size(acc) == 0, x).otherwise(join(F.element_at(acc, -1), x)))
        return F.aggregate(part, F.array().cast(f"array<{kind}>"), step)

    def whole(v: Column) -> Column:
        length = F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / length).cast("int") - 1), lambda c: fold(F.slice(v, c * length + 1, length)))

        def joined_up(r: Column) -> Column:
            ends = fold(F.transform(r, lambda x: F.element_at(x, -1)))
            return let(ends, lambda e: F.flatten(F.transform(r, lambda x, c: F.when(c == 0, x).otherwise(F.transform(x, lambda y: join(F.get(e, c - 1), y))))))

        return let(runs, joined_up)

    return let(values, lambda v: F.when(F.size(v) <= 16, fold(v)).otherwise(whole(v)))


#: Signs that part a text's matches and their groups while they are found; a text that has one of them is searched once for each group.
_AROUND, _WITHIN = "\x01", "\x02"


def find_all(text: Column, pattern: str, groups: int) -> Column:
    """Every match of a Java pattern as (pos, end, g1 ... gn), in code points; a group without a match is ''.

    The pattern may not match nothing: places are running sums of the lengths of matches and of what lies between them.
    """
    names = range(1, groups + 1)
    fields = "".join(f",g{g}:string" for g in names)
    none = F.array().cast(f"array<struct<pos:int,end:int{fields}>>")

    def placed(held: Column) -> Column:
        """From (size of what lies before, size, groups) of every match."""

        def found(ends: Column) -> Column:
            return F.transform(held, lambda m, i: F.struct((F.get(ends, i) - m["n"]).alias("pos"), F.get(ends, i).alias("end"), *(m[f"g{g}"].alias(f"g{g}") for g in names)))

        return let(running(F.transform(held, lambda m: m["before"] + m["n"]), lambda x, y: x + y), found)

    def once() -> Column:
        marked = F.regexp_replace(text, F.lit(pattern), F.lit(_AROUND + _WITHIN.join(["$0", *(f"${g}" for g in names)]) + _AROUND))

        def match(parts: Column, k: Column) -> Column:
            return let(F.split(F.get(parts, 2 * k + 1), _WITHIN, -1), lambda m: F.struct(F.length(F.get(parts, 2 * k)).alias("before"), F.length(F.get(m, F.lit(0))).alias("n"), *(F.get(m, F.lit(g)).alias(f"g{g}") for g in names)))

        return let(F.split(marked, _AROUND, -1), lambda parts: F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), lambda k: match(parts, k)))

    def again() -> Column:
        held = F.struct(F.split(text, pattern, -1).alias("between"), *(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(groups + 1)))
        return let(held, lambda h: F.transform(h["g0"], lambda m, i: F.struct(F.length(F.get(h["between"], i)).alias("before"), F.length(m).alias("n"), *(F.get(h[f"g{g}"], i).alias(f"g{g}") for g in names))))

    plain = ~text.contains(_AROUND) & ~text.contains(_WITHIN)
    return F.when(text.rlike(pattern), let(F.when(plain, once()).otherwise(again()), placed)).otherwise(none)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
