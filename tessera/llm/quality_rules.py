"""Quality rules: a threshold table compiled into one projection of built-in functions.

No row meets another: counts and verdicts come from the row's own text. Windows of three words that may repeat
are found by sorting the row's window hashes, each packed with its place, and these are then sorted by their
words, so the count is exact and the work grows as n log n.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of the four languages of the corpus, as they stand inside a sentence.
STOP_WORDS = sorted(
    set(
        "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will no more if out so what up said about into than them can only other"
        " le la les de des du et en un une que qui dans pour pas est sur au avec il elle ne se plus par ce son sa ses nous vous ils sont mais ou leur"
        " der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über"
        " el la de que y a en un ser se no por con su para como estar tener le lo todo pero más hacer o poder este otro ese si me ya ver porque dar cuando muy sin los las del una es al".split()
    )
)


@dataclass(frozen=True)
class Rule:
    """A document fails where the measure lies outside [low, high]."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Ratios to words, lines or characters; the measures are those of MEASURES.
RULES = (
    Rule("length", "n_words", low=50),
    Rule("word_length", "mean_word_chars", low=2.0, high=14.0),
    Rule("symbols", "symbol_ratio", high=0.2),
    Rule("stop_words", "stop_ratio", low=0.04),
    Rule("repeated_lines", "dup_line_ratio", high=0.3),
    Rule("repeated_words", "repeat_ratio", high=0.5),
)

#: Each measure from the counts; a ratio to nothing is 0.
MEASURES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "n_words": lambda c: c("n_words").cast("double"),
    "mean_word_chars": lambda c: _ratio(c("word_chars"), c("n_words")),
    "symbol_ratio": lambda c: _ratio(c("n_symbols"), c("n_words")),
    "stop_ratio": lambda c: _ratio(c("n_stop_words"), c("n_words")),
    "dup_line_ratio": lambda c: _ratio(c("n_dup_lines"), c("n_lines")),
    "repeat_ratio": lambda c: _ratio(c("n_repeat_words"), c("n_words")),
}


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(words: Column, places: Column) -> Column:
    """Words in those windows of three at these places that equal another of them."""

    def repeated(windows: Column) -> Column:
        same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        beside = lambda i, x: F.coalesce(same(F.get(windows, i), x), F.lit(False))
        twice = F.filter(windows, lambda x, i: beside(i - 1, x) | beside(i + 1, x))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"))
        return F.aggregate(F.sort_array(F.transform(twice, lambda x: x["at"])), start, step, lambda a: a["n"])

    window = lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("at"))
    return _let(F.sort_array(F.transform(places, window)), repeated)


def _repeat_words(words: Column) -> Column:
    """Words that stand in a window of three words found twice or more in the row."""

    def windows(h: Column) -> Column:
        n = F.size(h)
        room = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long"))))

        def packed(p: Column) -> Column:
            def pack(x: Column, i: Column) -> Column:
                whole = F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))
                return whole - F.pmod(whole, p) + i

            def repeated(keys: Column) -> Column:
                group = lambda x: x - F.pmod(x, p)
                beside = lambda i, step, x: group(F.get(keys, i + step)).eqNullSafe(group(x))
                twice = F.filter(keys, lambda x, i: beside(i, -1, x) | beside(i, 1, x))
                return _let(F.transform(twice, lambda x: F.pmod(x, p).cast("int")), lambda places: F.when(F.size(places) == 0, F.lit(0).cast("long")).otherwise(_covered(words, places)))

            return _let(F.sort_array(F.transform(F.slice(h, F.lit(1), F.greatest(n - 2, F.lit(0))), pack)), repeated)

        return _let(room, packed)

    return _let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the counts of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words.

    A null or empty text has no words and all counts 0. Lines without a word do not count.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.select(
        F.col(id_col),
        text.alias("_text"),
        F.array_remove(F.split(text, SEPARATORS, -1), "").alias("_words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    words, lines = F.col("_words"), F.col("_lines")
    return split.select(
        F.col(id_col),
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col("_text"), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )


def failed_rules(rules: tuple[Rule, ...], column: Callable[[str], Column] = F.col) -> Column:
    """The names of the rules that a row fails, as one expression."""
    tests = []
    for rule in rules:
        value = MEASURES[rule.measure](column)
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (value < F.lit(float(rule.low)))
        if rule.high is not None:
            bad = bad | (value > F.lit(float(rule.high)))
        tests.append(F.when(bad, F.lit(rule.name)))
    return F.array_compact(F.array(*tests))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every text, base_failed, failed (rule names) and kept.

    base_failed: fewer than 50 words, or more than half of them in repeated windows. kept: neither
    base_failed nor any rule failed. Repeated rows are judged alike, each by itself; other columns of docs
    are not read. An empty table gives an empty one.
    """
    counted = measure(docs, id_col, text_col)
    base = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    judged = counted.withColumns({"base_failed": base, "failed": failed_rules(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
