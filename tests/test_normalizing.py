"""Texts are normalized once where they are read, and the pattern that skips single spaces gives what the whole one gives."""

import random
import re

from pyspark.sql import functions as F

from lamina.functions.text import UNEVEN, normalized
from lamina.operators import generation, splitting

WHITE = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_normalized_against_split(spark):
    r = random.Random(5)
    texts = ["".join(r.choices([" ", *WHITE, "a", "é", "𝔄", "~", "!", "\x7f", "​"], [20, *[1] * len(WHITE), 15, 5, 3, 2, 2, 1, 1], k=40)) for _ in range(400)] + ["", " ", "\n", " a", "a  ", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", normalized("t").alias("n"), F.regexp_count("t", F.lit(UNEVEN)).alias("c")).orderBy("k").collect()
    white = f"[{''.join(WHITE)}]+"
    assert [x["n"] for x in rows] == [None if t is None else re.sub(white, " ", t).strip(" ") for t in texts]
    # runs that are one space already aren't touched
    assert [x["c"] for x in rows if x["c"] is not None] == [sum(m[0] != " " for m in re.finditer(white, t)) for t in texts if t is not None]


def test_unchanged_normalizes_each_side_once(spark):
    cand = spark.createDataFrame([(1, 10, "a  b"), (2, 10, "a c"), (3, 11, None), (4, 12, " x"), (5, 10, "a\tb ")], "id int, base_text_id int, text string")
    base = spark.createDataFrame([(10, " a b"), (11, None), (12, "x"), (13, "y")], "base_text_id int, text string")
    out = splitting.unchanged(cand, base)
    assert sorted(map(tuple, out.collect())) == [(1, 10, "a  b"), (4, 12, " x"), (5, 10, "a\tb ")]
    assert optimized(out.select("id")).count("regexp_replace") == 2


def test_edits_share_the_words(spark):
    out = generation.rule_outputs(spark.createDataFrame([(1, "a b  c d"), (2, "a a")], "k int, text string"), ["swap", "deletion", "repetition"], "all", F.col("k"))
    assert optimized(out).count("regexp_replace") == 1
    assert {(r["k"], r["rule"]) for r in out.collect()} >= {(1, "swap"), (1, "repetition"), (2, "repetition")} and (2, "swap") not in {(r["k"], r["rule"]) for r in out.collect()}
