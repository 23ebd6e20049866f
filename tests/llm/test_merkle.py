"""Merkle manifest against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lamina.llm import merkle
from tests.llm.test_llm import ODD, long_text


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(values):
    """Levels of a tree from its leaves to its root."""
    levels = [values]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    """Left and right siblings of a leaf and of the nodes above it."""
    out = []
    for level in levels[:-1]:
        run = i - i % 16
        out.append((level[run:i], level[i + 1 : run + 16]))
        i //= 16
    return out


def manifest_of(rows):
    """Contract columns of (doc_id, source, lang, n_chars, text) rows."""
    leaf = lambda r: h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    first = lambda v: (v is not None, v)
    order = sorted(rows, key=lambda r: ((r[1] is not None, (r[1] or "").encode()), (r[0] is not None, r[0] or 0), leaf(r)))
    groups = [list(g) for _, g in itertools.groupby(order, key=lambda r: first(r[1]))]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, (group, levels) in enumerate(zip(groups, trees, strict=True)):
        for i, r in enumerate(group):
            path = siblings(levels, i) + siblings(top, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            folded = leaf((*r[:4], r[4].translate(lower))) if tampered else leaf(r)
            for left, right in path:
                folded = h(*left, folded, *right)
            out.append((r[0], leaf(r), levels[-1][0], top[-1][0], h(*(d for side in path for x in side for d in x)), folded, folded == top[-1][0]))
    return out


def result(spark, rows, columns="doc_id long, source string, lang string, n_chars long, text string, id long, part int, tree long, leaf string, level int"):
    docs = spark.createDataFrame([(*r, None, 1, 2, "x", 3) for r in rows], columns)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", upper, upper.lower()))
    out = merkle.proofs(merkle.document_manifest(docs, changed))
    return [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def random_rows(n, sources, seed):
    r = random.Random(seed)
    return [(r.choice([i, i, i, None, 3]), r.choice(sources), r.choice(["en", None, "é"]), r.choice([None, 0, 12]), r.choice([*ODD[:6], f"Text {i}", f"plain {i}"])) for i in range(n)]


@pytest.mark.parametrize("n,sources,parts", [(1, ["s"], 4), (16, ["s"], 4), (17, [None], 1), (700, ["hot"] * 5 + ["", "é", None, "a b"], 7), (300, [f"s{k}" for k in range(280)], 5), (600, ["one"], 40)])
def test_manifest(spark, n, sources, parts):
    rows = random_rows(n, sources, n)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert Counter(result(spark, rows)) == Counter(manifest_of(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_repeated_rows_empty_and_long(spark):
    assert result(spark, []) == []
    rows = [(5, "s", "en", 1, "A b")] * 20 + [(6, "s", "en", 1, long_text(1, 20000))]
    got = result(spark, rows)
    assert Counter(got) == Counter(manifest_of(rows)) and all(r[-1] for r in got)  # neither id is tampered with
    assert {r[-1] for r in result(spark, [(i, "s", "en", 1, "A b") for i in range(30)])} == {True, False}


def test_forests_add_up_in_any_order():
    sizes = {0: 300, 1: 1, 2: 17}
    leaves = [(t, 0, i, n, h(str((t, i)))) for t, n in sizes.items() for i in range(n)]
    want = tree([tree([x[4] for x in leaves if x[0] == t])[-1][0] for t in sizes])[-1][0]
    r = random.Random(4)
    for _ in range(20):
        r.shuffle(leaves)
        forests = [[]]
        for x in leaves:
            if r.random() < 0.1:
                forests.append([])
            forests[-1].append(x)
        while len(forests) > 1:  # sums of sums
            k = r.randrange(len(forests) - 1)
            forest = merkle.Forest(len(sizes))
            for x in forests[k] + forests[k + 1]:
                forest.add(*x)
            forests[k : k + 2] = [forest.nodes()]
        assert [(x[0], x[3], x[4]) for x in forests[0]] == [(merkle.TOP, 1, want)]
