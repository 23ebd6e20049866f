"""The exchange of two words by structure, against all pairs."""

import random

import numpy as np
import regex
from pyspark.sql import functions as F

from lamina.functions import swaps
from lamina.functions.edits import WORD


def all_pairs(text, first=0, last=None):
    """Every pair's score from the text itself."""
    spans = [m.span() for m in regex.finditer(WORD, text)]
    words, n = [text[a:b] for a, b in spans], len(spans)
    side = lambda i: "," in text[spans[i - 1][1] if i else 0 : spans[i][0]] or "," in text[spans[i][1] : spans[i + 1][0] if i + 1 < n else len(text)]
    lists, found = [side(i) for i in range(n)], {}
    for i in range(n):
        for j in range(i + 1, n):
            if words[i] == words[j] or not any(first <= k <= (n - 1 if last is None else last) for k in (i, j)):
                continue
            between = text[spans[i][1] : spans[j][0]]
            strong = any(c in between for c in ";:!?…()[]{}")
            weak = "," in between and not strong
            if not (lists[i] and lists[j] and weak):
                found[i, j] = 20 * (j - i) + 1000 * (lists[i] != lists[j]) + 250 * strong + 100 * (j - i > 1) - 100 * weak
    top = max(found.values(), default=None)
    return sorted(k for k, v in found.items() if v == top), top


def parts(text):
    spans = [m.span() for m in regex.finditer(WORD, text)]
    gaps = [text[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(text)], strict=True)]
    return [text[a:b] for a, b in spans], np.array(["," in g for g in gaps]), np.array([any(c in g for c in swaps.MARKS) for g in gaps])


def test_best_pairs_are_those_of_all_pairs():
    r, seen = random.Random(5), set()
    for k in range(3000):
        marks = [" ", " ", " ", ", ", "; ", " (", ", 3, "] if k % 3 else [" ", ", "]
        n = r.randrange(0, 14)
        text = r.choice(["", "(", ", "]) + "".join(r.choice("aabcd")[: k % 5 + 1] + r.choice(marks) for _ in range(n)) + r.choice(["", ",", "!"])
        m = len(parts(text)[0])
        first = r.randrange(m) if m and k % 2 else 0
        last = r.randrange(first, m) if m and k % 2 else None
        pairs, score = swaps.best_pairs(*parts(text), first, last)
        want, top = all_pairs(text, first, last)
        assert (sorted(map(tuple, pairs.tolist())), score) == (want, top), (text, first, last)
        seen.add((score or 0) // 250)
    assert len(seen) >= 5


def test_swapped_texts(spark):
    texts = ["one two; three", "a", "", None, "same same same", "red, green, blue", "12, 34", "It’s l’été, isn't it? Yes (we) do"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", swaps.structural_swap(F.col("t"), F.col("i")).alias("s")).collect()}
    assert tuple(got[0]) == ("three two; one", 0, 2, 390, 1)
    assert [tuple(got[i]) for i in (1, 2, 4, 6)] == [(texts[i], None, None, None, 0) for i in (1, 2, 4, 6)] and tuple(got[3]) == (None,) * 5
    assert tuple(got[5]) == (texts[5], None, None, None, 0)  # members of one list
    want, top = all_pairs(texts[7])
    assert (got[7]["first"], got[7]["second"]) in want and got[7]["score"] == top and got[7]["n_best"] == len(want)
    focus = df.where("i = 0").select(swaps.structural_swap(F.col("t"), F.lit(0), F.lit(4), F.lit(6)).alias("s"))
    assert tuple(focus.first()["s"]) == ("one three; two", 1, 2, 270, 1)
    beside = df.where("i = 0").select(swaps.structural_swap(F.col("t"), F.lit(0), F.lit(99), F.lit(None).cast("int")).alias("s"))
    assert beside.first()["s"]["second"] == 2  # the nearest word to a focus behind the text


def test_long_texts_take_linear_time():
    n = 20000
    words = [f"w{i % 97}" for i in range(n)]
    comma, strong = np.arange(n + 1) % 9 == 0, np.arange(n + 1) % 31 == 0
    pairs, score = swaps.best_pairs(words, comma, strong)
    i, j = pairs[0]
    assert score == 20 * (j - i) + 1350 and j - i > n - 40
    many = swaps.best_pairs(["x"] * n, comma, strong)
    assert many[1] is None and len(many[0]) == 0
