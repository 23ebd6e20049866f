"""Parts of an order: what is in them, and what is written to find them."""

import os
import random

from pyspark.sql import functions as F

from lamina.functions.ordering import parts, shared_dir
from lamina.operators import generation, metrics, splitting, suites


def stored(spark):
    root = shared_dir(spark)
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def table(spark, n, width=0):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, *range(9)]), f"{rng.random()}" * width) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id int, x int, text string").repartition(5)


def test_parts_against_lists(spark):
    for n in (0, 2, 60):
        rows, df = table(spark, n)
        ranks = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])))}
        for starts in ([], [1, 1, 3], [n], [5, 30, 31, 500]):
            got = {r["id"]: r["part"] for r in parts(df, [F.col("x"), F.col("id")], F.array(*[F.lit(s) for s in starts]).cast("array<long>")).collect()}
            assert got == {i: sum(s <= k for s in starts) for i, k in ranks.items()}
        k = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: r[0]))}
        assert {r["id"]: r["bin"] for r in metrics.equal_count_bins(df, [F.col("id")], 7).collect()} == {i: ((j + 1) * min(7, n) - 1) // n for i, j in k.items()}
        assert {r["id"]: r["bucket"] for r in splitting.length_buckets(df.select("id"), "id", F.col("id"), 10).collect()} == {i: j * 10 // n for i, j in k.items()}
        for offset, limit in ((3, None), (0, 4), (2, 0), (5, 100)):
            got = sorted(r["id"] for r in generation.source_items(df, ["id"], limit, offset).collect())
            assert got == list(range(n))[offset:][:limit]


def test_rows_that_are_equal_stay_together(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d")], "id int, part string")
    got = parts(df, [F.col("id")], F.array(F.lit(2).cast("long")), "k").collect()
    assert sorted((r["id"] or 0, r["part"], r["k"]) for r in got) == [(0, "d", 0), (1, "a", 1), (1, "a", 1), (1, "b", 1), (2, "c", 1)]
    split = splitting.stratified_split(df, "id", F.col("part"), {"a": 1, "b": 1}).collect()
    assert len(split) == 5 and len({r["split"] for r in split if r["id"] == 1}) == 1 and {r["split"] for r in split} == {"a", "b", "excluded"}
    assert len({r["split"] for r in splitting.train_dev(df, "id", 0.2).collect() if r["id"] == 1}) == 1


def test_capped_against_lists(spark):
    rows, df = table(spark, 150)
    rows = [(*r[:2], r[2] or None) for r in rows]
    want = sorted(i for x in {r[1] for r in rows} for i in sorted(r[0] for r in rows if r[1] == x)[:4])
    assert sorted(r["id"] for r in suites.capped(df, ["x"], "id", 4).collect()) == want
    assert suites.capped(df, ["x"], "id", 0).count() == 0 and suites.capped(df.where("id < 0"), ["x"], "id", 3).count() == 0


def test_texts_are_not_written(spark):
    _, df = table(spark, 400, 200)
    size = sum(len(r["text"]) for r in df.collect())
    runs = [
        lambda: splitting.length_buckets(df, "id", F.length("text")), lambda: splitting.train_dev(df, "id", 0.1), lambda: splitting.stratified_split(df, "id", F.col("x"), {"a": 100, "b": 50}),
        lambda: generation.source_items(df, ["id"], 50, 10), lambda: metrics.equal_count_bins(df, [F.col("id")], 5), lambda: suites.capped(df, ["x"], "id", 3),
    ]
    for run in runs:
        before = stored(spark)
        assert max(len(r["text"]) for r in run().collect()) > 3000
        assert sum(v for p, v in stored(spark).items() if p not in before) < size / 20
