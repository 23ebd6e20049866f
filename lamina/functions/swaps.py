"""The exchange of two words that changes a text's structure most.

A pair of words scores by its distance, by strong marks between its words, and by whether one of them alone stands in a list
(beside a comma). Along a text these marks only come in with the distance, so behind a word lie three zones at most (nothing, commas
alone, a strong mark between), and in each the farthest word of a kind scores highest. So a word has twelve pairs that
can be the best, and a text of n words takes time in proportion to n, not to its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.edits import WORD

#: Points of a pair (fixed values): for each place of distance, one word of a list, a strong mark between, no neighbours, commas alone between.
STEP, OUT_OF_LIST, STRONG, APART, WEAK = 20, 1000, 250, 100, -100
#: Marks that part a sentence (fixed values).
MARKS = ";:!?…()[]{}"

SWAP = "text string, first int, second int, score int, n_best int"


def _last_of(kind: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the last place up to it that is of a kind, and the last one before whose word is another; -1 for none."""
    n, own = len(kind), np.flatnonzero(kind)
    if not len(own):
        return np.full(n, -1), np.full(n, -1)
    rank = np.cumsum(kind) - 1
    new = np.r_[True, word[own][1:] != word[own][:-1]]
    begin = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
    other = np.where(begin > 0, own[begin - 1], -1)
    return np.where(rank < 0, -1, own[rank]), np.where(rank < 0, -1, other[rank])


def _next_gap(mark: np.ndarray, n: int) -> np.ndarray:
    """For each word the first word behind it with a mark between (gap g is before word g), n for none."""
    at = np.where(mark[:n], np.arange(n), n)
    return np.r_[np.minimum.accumulate(at[::-1])[::-1][1:], n]


def _behind(word: np.ndarray, comma: np.ndarray, strong: np.ndarray, focus: np.ndarray) -> np.ndarray:
    """Rows (word of the focus, word behind it, score): of each word the best pair of each zone and kind."""
    n = len(word)
    listed = comma[:-1] | comma[1:]
    some, hard = _next_gap(comma, n)[focus], _next_gap(strong, n)[focus]
    zones = [(focus + 1, np.minimum(some, hard) - 1, 0), (some, hard - 1, WEAK), (hard, np.full(len(focus), n - 1), STRONG)]
    out = []
    for kind in (False, True):
        last, other = _last_of(listed == kind, word)
        for low, high, points in zones:
            to = last[high]
            to = np.where((to >= 0) & (word[to] == word[focus]), other[high], to)
            fits = (low <= high) & (to >= low)
            if kind and points == WEAK:
                fits &= ~listed[focus]  # two members of one list
            a, b = focus[fits], to[fits]
            score = STEP * (b - a) + points + np.where(listed[a] != kind, OUT_OF_LIST, 0) + np.where(b - a > 1, APART, 0)
            out.append(np.stack([a, b, score], axis=1))
    return np.concatenate(out)


def best_pairs(words: list[str], comma: np.ndarray, strong: np.ndarray, first: int = 0, last: int | None = None) -> tuple[np.ndarray, int | None]:
    """The pairs of places that score highest, each once and in order, and their score; one of a pair is from first to last. comma
    and strong tell it of each gap: before a word, and behind the last one."""
    n = len(words)
    if n < 2:
        return np.empty((0, 2), dtype=int), None
    word = np.unique(np.array(words, dtype=object), return_inverse=True)[1]
    focus = np.arange(first, n if last is None else last + 1)
    ahead = _behind(word, comma, strong, focus)
    back = _behind(word[::-1], comma[::-1], strong[::-1], n - 1 - focus)
    back[:, :2] = n - 1 - back[:, 1::-1]
    rows = np.concatenate([ahead, back])
    if not len(rows):
        return np.empty((0, 2), dtype=int), None
    top = rows[:, 2].max()
    return np.unique(rows[rows[:, 2] == top][:, :2], axis=0), int(top)


def structural_swap(text: Column, draw: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """A struct SWAP: the text with the two words exchanged, their numbers (from 0), their score and how many pairs score as high, of
    which `draw` (a number of 0 or more, a hash of the row's key) takes one. With a focus from start to end (code points; both null: none) one word
    overlaps it, or is the nearest word to it. Where no pair can be exchanged the text stays, without numbers; null stays null."""
    find, marked = regex.compile(WORD).finditer, regex.compile("[" + regex.escape(MARKS) + "]").search

    def swapped(t: str | None, d: int, low: float | None, high: float | None) -> tuple:
        if not isinstance(t, str):
            return None, None, None, None, None
        spans = [m.span() for m in find(t)]
        gaps = [t[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(t)], strict=True)]
        first, last = 0, len(spans) - 1
        if spans and not (pd.isna(low) and pd.isna(high)):
            low = 0 if pd.isna(low) else min(max(int(low), 0), len(t))
            high = low if pd.isna(high) else min(max(int(high), 0), len(t))
            low, high = min(low, high), max(low, high)
            hits = [i for i, (s, e) in enumerate(spans) if e > low and s < high]
            hits = hits or [min(range(len(spans)), key=lambda i: abs(sum(spans[i]) - low - high))]
            first, last = hits[0], hits[-1]
        pairs, score = best_pairs([t[s:e] for s, e in spans], np.array(["," in g for g in gaps]), np.array([bool(marked(g)) for g in gaps]), first, last)
        if score is None:
            return t, None, None, None, 0
        i, j = map(int, pairs[int(d) % len(pairs)])
        (a, b), (c, e) = spans[i], spans[j]
        return t[:a] + t[c:e] + t[b:c] + t[a:b] + t[e:], i, j, score, len(pairs)

    @F.pandas_udf(SWAP)
    def run(text: pd.Series, draw: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        rows = [swapped(*x) for x in zip(text, draw, low, high, strict=True)]
        out = pd.DataFrame(rows, columns=["text", "first", "second", "score", "n_best"])
        return out.astype({c: "Int32" for c in ("first", "second", "score", "n_best")})

    none = F.lit(None).cast("int")
    return run(text, draw.cast("long"), none if start is None else start.cast("int"), none if end is None else end.cast("int"))
