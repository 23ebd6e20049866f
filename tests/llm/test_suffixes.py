"""Suffix arrays and the removal of repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lamina.llm import suffixes
from tests.llm.test_llm import ODD, docs_of, long_text


def removed(texts, length):
    """n_bytes, n_removed, n_spans and kept bytes, by all strings of all texts."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("letters,n,depth", [(1, 50, 7), (2, 300, 20), (2, 300, 8), (4, 2000, 33), (26, 500, 400), (3, 1, 5)])
def test_suffix_order_and_common_prefixes(letters, n, depth):
    r = random.Random(n)
    data = bytes(r.randrange(letters) for _ in range(n))
    data = data + data[: n // 2]
    order = suffixes.suffix_array(np.frombuffer(data, np.uint8)).tolist()
    assert order == sorted(range(len(data)), key=lambda i: data[i:])
    got = suffixes.common_prefixes(np.frombuffer(data, np.uint8), np.array(order), depth, lane=16).tolist()
    for k in range(1, len(order)):
        a, b = data[order[k - 1] :], data[order[k] :]
        want = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert got[k] == min(want, depth) or (got[k] > want == min(len(a), len(b)))  # zeros beyond the end may fit


def test_equal_strings_share_an_anchor_at_one_distance():
    r = random.Random(8)
    texts = [bytes(r.randrange(3) for _ in range(r.randint(0, 200))) for _ in range(40)] + [b"a" * 90, b"ab" * 60]
    under = defaultdict(set)
    text, first, n, anchor = suffixes.stretches(texts, 12)
    for t, f, k, h in zip(text, first, n, anchor, strict=True):
        for i in range(f, f + k):
            under[texts[t][i : i + 12]].add(int(h))
    assert all(len(x) == 1 for x in under.values())
    assert sum(n) == sum(max(0, len(t) - 11) for t in texts)


@pytest.mark.parametrize("length,limit", [(12, 1024), (12, 2), (5, 3), (40, 1)])
def test_removal_is_that_of_all_strings(spark, length, limit):
    r = random.Random(length)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 9))) for _ in range(200)]
    passages = [" ".join(r.choice(words) for _ in range(30)) for _ in range(4)]
    texts = ODD[:7] + [long_text(3, 3000), "a" * 700, "ab" * 300, "a" * 39, "the same", "the same text " * 9]
    for _ in range(120):
        parts = [" ".join(r.choice(words) + str(r.randrange(99)) for _ in range(r.randint(0, 40))) for _ in range(3)]
        if r.random() < 0.5:
            p = r.choice(passages)
            parts[1] = p[r.randint(0, 20) : len(p) - r.randint(0, 20)]
        texts.append(" ".join(parts))
    texts += texts[30:50]
    rows = suffixes.remove_repeated_bytes(docs_of(spark, texts), length, limit=limit).collect()
    assert {r["doc_id"]: tuple(r)[1:4] + (bytes(r["kept"]),) for r in rows} == dict(enumerate(removed(texts, length)))


def test_shards_of_any_size(spark):
    r = random.Random(2)
    texts = ["x" * r.randint(0, 30) + "0123456789abcdefghij" * r.randint(1, 3) + str(k) for k in range(60)]
    rows = suffixes.remove_repeated_bytes(docs_of(spark, texts), 16, limit=7, shard_bytes=1).collect()
    assert {r["doc_id"]: tuple(r)[1:4] + (bytes(r["kept"]),) for r in rows} == dict(enumerate(removed(texts, 16)))


def test_odd_tables(spark):
    assert suffixes.remove_repeated_bytes(docs_of(spark, [])).collect() == []
    text = long_text(4)
    rows = suffixes.remove_repeated_bytes(docs_of(spark, [(1, text), (1, text), (None, "x" + text), (2, "other"), (None, None)])).collect()
    assert Counter((r["doc_id"], r["n_removed"]) for r in rows) == {(1, len(text)): 2, (None, len(text)): 1, (2, 0): 1, (None, 0): 1}


def test_query(spark):
    from lamina.llm.queries import QUERIES

    rows = QUERIES["op13_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {d["doc_id"]: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for d, w in zip(docs, removed([d["text"] for d in docs], 400), strict=True)}
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want and sum(w[1] > 0 for w in want.values()) > 5
