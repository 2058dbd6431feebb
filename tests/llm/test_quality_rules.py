import random

import brute

from tessera.llm import quality_rules


def test_counts_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "  \n\t ", "one", "a b", "a b c", "a b c a b c", "x " * 400, "l\nl\n\n \nl", *(brute.prose(rng, rng.randrange(1, 200)) for _ in range(60))]
    texts += [" ".join(rng.choice("ab") for _ in range(70)), "é # * $ % & | < > \x0b\x0cz\x85q"] * 2 + ["the dog and cat " * 6000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in quality_rules.judge(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.rule_counts(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.base_failed and r.kept) and r.kept == (not r.base_failed and not r.failed)
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_no_python_and_no_exchange_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality_rules.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_a_rule_table_of_ones_own(spark):
    df = spark.createDataFrame([(1, "word " * 20 + "end here now " + " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    assert quality_rules.judge(df, (quality_rules.Rule("short", "n_words", high=10),)).first().failed == ["short"]


def test_windows_that_only_share_a_hash_are_told_apart(spark):
    """Every place proposed, as if all windows had one hash: the words decide."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (3, 4, 9, 30, 200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", F.split("t", " "))
    got = df.select("t", quality_rules._covered(F.col("w"), F.sequence(F.lit(0), F.size("w") - 3)).alias("n")).collect()
    assert all(r.n == brute.rule_counts(r.t)[4] for r in got)


def test_a_very_long_text(spark):
    rng = random.Random(5)
    text = " ".join(str(rng.randrange(400)) for _ in range(300_000))
    r = quality_rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.rule_counts(text)
