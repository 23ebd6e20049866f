"""Typing errors that leave characters whole."""

from collections import Counter

from pyspark.sql import functions as F

from lamina.functions import edits

#: Words of clusters: marks, a joined family, a flag, Hangul of parts, a keycap, Devanagari with a vowel sign.
WORDS = [["e\u0301", "a", "n", "o\u0308\u0323"], ["\U0001f468\u200d\U0001f469\u200d\U0001f467", "x"], ["\U0001f1e9\U0001f1ea", "b"], ["\u1112\u1161\u11ab", "\u1100\u1173\u11af"], ["1\ufe0f\u20e3"], ["\u0915\u093f", "\u0924"]]


def test_clusters_are_whole(spark):
    df = spark.createDataFrame([(i, "".join(w)) for i, w in enumerate(WORDS)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", edits.clusters(F.col("t")).alias("c")).collect()}
    assert [got[i] for i in range(len(WORDS))] == WORDS


def test_no_cluster_is_split(spark):
    text = " ".join("".join(w) for w in WORDS)
    df = spark.range(400).select("id", F.lit(text).alias("text"))
    source, kinds = Counter(c for w in WORDS for c in w), Counter()
    rows = edits.grapheme_typo(df, F.col("id")).select("edited", edits.clusters(F.replace("edited", F.lit(" "), F.lit(""))).alias("c")).collect()
    for r in rows:
        assert r["edited"] is not None and set(r["c"]) <= set(source)
        kinds[sum((Counter(r["c"]) - source).values()) - sum((source - Counter(r["c"])).values())] += 1
        assert r["edited"].split(" ")[1:] == text.split(" ")[1:]  # the one word of four letters
    assert kinds[-1] > 50 and kinds[0] > 50 and kinds[1] > 120  # deleted, exchanged, doubled or put in


def test_edges(spark):
    texts = ["", None, "12 34", "a", "ab", "a bc", "aa"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    many = df.crossJoin(spark.range(40))
    got = {}
    for r in edits.grapheme_typo(many, F.col("id")).collect():
        got.setdefault(r["i"], set()).add(r["edited"])
    assert got[0] == got[1] == got[2] == {None}
    assert got[3] == {"", "aa", None} and got[4] <= {"b", "a", "aab", "abb", "bab", "ba", "abab", None} | {"aab", "abb", "bab", "abb"}
    assert all(x is None or x.startswith("a ") for x in got[5]) and got[6] == {"a", "aaa", None}
