"""Feature bundles against sets of tags."""

import random

import regex
from pyspark.sql import functions as F

from lamina.functions import features

D = {k: set(v) for k, v in features.DIMENSIONS.items()}


def atoms(text):
    return set(regex.findall(features.TAG, (text or "").upper()))


def points(a, b, out=frozenset()):
    a, b = a - out, b - out
    return 5 * len(a & b) - 6 * len(a - b) - 2 * len(b - a)


def finite(a):
    verb = next((p for p in features.DIMENSIONS["part_of_speech"] if any(t.split(".")[0] == p for t in a)), None) in ("V", "AUX")
    bare = not a & D["nonfinite"] and not any(t.startswith(("V.PTCP", "V.CVB", "V.INF", "V.GER", "V.MSDR")) for t in a)
    return verb and bare and bool(a & (D["finite"] | D["person"] | D["number"] | D["tense"] | D["mood"]))


def test_bundles_against_sets(spark):
    rng = random.Random(3)
    pool = [t for tags in features.DIMENSIONS.values() for t in tags] + ["LGSPEC1", "V.PTCP.PRS", "X-Y", "A1", "12", "{1/2}", "é", "pl+du", "3"]
    texts = [None, "", ";;", "  ", "v;v;V"] + [";".join(rng.choices(pool, k=rng.randint(1, 12))) for _ in range(400)] + [";".join(f"T{i}" for i in range(5000))]
    rows = [(i, a, rng.choice(texts)) for i, a in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, a string, b string").select("i", features.bundle(F.col("a")).alias("x"), features.bundle(F.col("b")).alias("y"))
    x, y = F.col("x"), F.col("y")
    dims = ("tense", "mood", "aspect", "voice", "polarity", "finite")
    got = {r["i"]: r for r in df.select("i", features.similarity(x, y).alias("s"), features.similarity(x, y, "tense", "mood").alias("c"), features.finite_verb(x).alias("f"), features.part_of_speech(x).alias("p"), features.marked(x, "number").alias("n"), features.same_marked(x, y, *dims).alias("m"), (features.agreement(x) == features.agreement(y)).alias("g")).collect()}
    for i, ta, tb in rows:
        a, b, r = atoms(ta), atoms(tb), got[i]
        assert r["s"] == points(a, b) and r["c"] == points(a, b, D["tense"] | D["mood"])
        assert r["f"] == finite(a)
        assert r["p"] == next((p for p in features.DIMENSIONS["part_of_speech"] if any(t.split(".")[0] == p for t in a)), None)
        assert r["n"] == ("+".join(t for t in features.DIMENSIONS["number"] if t in a) or None)
        assert r["m"] == all(not a & D[d] or a & D[d] == b & D[d] for d in dims)
        assert r["g"] == all(a & D[d] == b & D[d] for d in features.AGREEMENT)
    assert len(set(t for v in features.DIMENSIONS.values() for t in v)) == sum(map(len, features.DIMENSIONS.values()))
