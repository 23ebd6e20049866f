"""Rules as a table function."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lamina.operators.rules import Rule, chosen_rules, rule_failures, rule_picks, rule_results


RULES = [Rule("boom", lambda t: {}[t]), Rule("same", lambda t: f" {t} "), Rule("none", lambda t: None), Rule("up", str.upper), Rule("german", lambda t: t + " ja", ("de",)), Rule("twice", lambda t: t + t)]


def rows(spark):
    return spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("ab c", "en"), ("AB", "de"), (None, "en"), ("", None), ("x" * 50000, "en")])], "id int, text string, lang string")


def test_a_rule_that_raises_leaves_all_others(spark):
    got = rule_results(rows(spark), RULES, F.col("text"), F.col("lang")).collect()
    assert {n: k for n, k in Counter(r["id"] for r in got).items()} == {0: 5, 1: 6, 2: 5, 3: 5, 4: 5}
    by = {(r["id"], r["rule"]): (r["output"], r["fault"]) for r in got}
    assert by[0, "boom"] == (None, "KeyError") and by[0, "same"] == (None, "unchanged_output") and by[0, "none"] == (None, "empty_output")
    assert by[0, "up"] == ("AB C", None) and by[1, "up"] == (None, "unchanged_output") and by[1, "german"] == ("AB ja", None)
    assert by[2, "twice"] == by[3, "twice"] == (None, "empty_output") and by[4, "twice"] == ("x" * 100000, None)
    counts = {(r["rule"], r["fault"]): r["n"] for r in rule_failures(rule_results(rows(spark), RULES, F.col("text"), F.col("lang"))).collect()}
    assert counts["boom", "KeyError"] == 5 and counts["up", "unchanged_output"] == 1 and ("german", "KeyError") not in counts


def test_modes_and_picks(spark):
    first = rule_results(rows(spark), RULES, F.col("text"), F.col("lang"), mode="first_success")
    tried = {i: [r["rule"] for r in sorted(first.where(F.col("id") == i).collect(), key=lambda r: r["place"])] for i in (0, 1)}
    assert tried == {0: ["boom", "same", "none", "up"], 1: ["boom", "same", "none", "up", "german"]}
    picks = {r["id"]: (r["rule"], r["n_tried"], r["n_failed"]) for r in rule_picks(rows(spark), first, "id").collect()}
    assert picks == {0: ("up", 4, 3), 1: ("german", 5, 4), 2: (None, 5, 5), 3: (None, 5, 5), 4: ("up", 4, 3)}
    many = spark.range(300).select("id", F.lit("a b").alias("text"))
    drawn = rule_picks(many, rule_results(many, RULES, F.col("text"), key=F.col("id"), mode="random_success"), "id")
    counts = Counter(r["rule"] for r in drawn.collect())
    assert set(counts) == {"up", "twice"} and min(counts.values()) > 100  # either with the same chance
    none = rule_results(many, [RULES[4]], F.col("text"))
    assert none.count() == 0 and rule_picks(many.where("id = 0"), none, "id").first()["n_tried"] == 0
    assert [r.name for r in chosen_rules(RULES, "de")] == [r.name for r in RULES]
    for bad in ({"mode": "any"}, {"mode": "random_success"}):
        with pytest.raises(ValueError):
            rule_results(many, RULES, F.col("text"), **bad)
    with pytest.raises(ValueError):
        rule_results(many, RULES[:1] * 2, F.col("text"))
