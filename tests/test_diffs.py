"""Edit spans against a quadratic table."""

import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from lamina.functions import diffs


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


def check(a, b):
    spans = diffs.edit_spans(a, b)
    i = j = 0
    out = []
    for tag, i1, i2, j1, j2 in spans:  # spans follow each other and cover both sides
        assert (i1, j1) == (i, j) and (i2 > i1 or j2 > j1)
        i, j = i2, j2
        assert tag == ("equal" if tag == "equal" else "replace" if i2 > i1 and j2 > j1 else "delete" if i2 > i1 else "insert")
        if tag == "equal":
            assert a[i1:i2] == b[j1:j2]
        out += a[i1:i2] if tag == "equal" else b[j1:j2]
    assert (i, j) == (len(a), len(b)) and out == b
    assert not any(x[0] == y[0] == "equal" or "equal" not in (x[0], y[0]) for x, y in zip(spans, spans[1:], strict=False))
    return sum(s[2] - s[1] + s[4] - s[3] for s in spans if s[0] != "equal")


@pytest.mark.parametrize("letters", [1, 2, 4, 30])
def test_spans_are_shortest(letters):
    r = random.Random(letters)
    for _ in range(300):
        a, b = ([r.randrange(letters) for _ in range(r.randint(0, 25))] for _ in range(2))
        assert check(a, b) == len(a) + len(b) - 2 * common(a, b)


def test_long_texts_take_linear_memory():
    r = random.Random(1)
    a = [r.choice("abcdefgh") + str(r.randrange(50)) for _ in range(20_000)]
    b = [w for w in a if r.random() < 0.9]
    for _ in range(2000):
        b.insert(r.randrange(len(b)), "new" + str(r.randrange(9)))
    tracemalloc.start()
    began = time.time()
    n = check(a, b)
    assert 0 < n <= 4100 and time.time() - began < 60
    assert tracemalloc.get_traced_memory()[1] < 40e6  # a table would take 20,000 * 20,000 cells
    tracemalloc.stop()


def test_columns(spark):
    rows = [(1, ["a", "b", "c"], ["a", "x", "c", "d"]), (2, None, ["a"]), (3, ["a"], []), (4, None, None), (4, ["a"] * 5, ["a"] * 5)]
    df = spark.createDataFrame(rows, "id long, l array<string>, r array<string>")
    got = [(r["id"], [tuple(s) for s in r["spans"]]) for r in diffs.with_edit_spans(df, "l", "r", ["id"]).collect()]
    assert got == [
        (1, [("equal", 0, 1, 0, 1), ("replace", 1, 2, 1, 2), ("equal", 2, 3, 2, 3), ("insert", 3, 3, 3, 4)]),
        (2, [("insert", 0, 0, 0, 1)]), (3, [("delete", 0, 1, 0, 0)]), (4, []), (4, [("equal", 0, 5, 0, 5)]),
    ]
    back = diffs.with_edit_spans(df.where("l is not null and r is not null"), "l", "r", ["l", "r"])
    assert back.select(F.sum((diffs.rebuilt("l", "r", "spans") == F.col("r")).cast("int"))).first()[0] == 3
    assert diffs.with_edit_spans(df.limit(0), "l", "r", ["id"]).collect() == []
