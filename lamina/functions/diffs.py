"""Shortest edit scripts of two sequences of tokens, in linear memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tag, and the spans of the left and the right tokens that it covers (end exclusive).
Span = tuple[str, int, int, int, int]
SPANS = "array<struct<tag: string, left_from: int, left_to: int, right_from: int, right_to: int>>"


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Of all prefixes of b, from the empty one: how long a longest common subsequence with a is.

    Bit-parallel: bit j of `row` is 0 where the length grows from prefix j to j + 1; a token of a changes the row by
    one addition of long integers."""
    where: dict[int, int] = {}
    for j, t in enumerate(b):
        where[t] = where.get(t, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for t in a:
        match = row & where.get(t, 0)
        row = ((row + match) | (row - match)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_pairs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, ascending on both sides. The longer half problem is cut in two where the
    halves' lengths add up to the most (the first of equal places), so memory stays in proportion to the tokens."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        i, m, j, n = work.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        if m - i == 1:
            k = next((k for k in range(j, n) if b[k] == a[i]), None)
            if k is not None:
                out.append((i, k))
            continue
        mid = (i + m) // 2
        total = _lengths(a[i:mid], b[j:n]) + _lengths(a[mid:m][::-1], b[j:n][::-1])[::-1]
        cut = j + int(np.argmax(total))
        work += [(i, mid, j, cut), (mid, m, cut, n)]
    return sorted(out)


def edit_spans(left: list, right: list) -> list[Span]:
    """equal, replace, delete and insert spans that lead from left to right with the fewest tokens deleted and inserted.
    Between two equal spans there is one other span at most."""
    ids: dict = {}
    a, b = ([ids.setdefault(t, len(ids)) for t in side] for side in (left, right))
    out: list[Span] = []
    i = j = 0
    for x, y in [*common_pairs(a, b), (len(a), len(b))]:
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        if x < len(a):
            if out and out[-1][0] == "equal" and out[-1][2] == x:
                out[-1] = ("equal", out[-1][1], x + 1, out[-1][3], y + 1)
            else:
                out.append(("equal", x, x + 1, y, y + 1))
        i, j = x + 1, y + 1
    return out


def with_edit_spans(df: DataFrame, left: str, right: str, keep: list[str], name: str = "spans") -> DataFrame:
    """keep and the edit spans of two columns of token arrays. A null array has no tokens. No shuffle; rows are worked off one by
    one, so a task holds one pair's tokens and a few bits for each."""
    kept = df.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + f", `{name}` {SPANS}"
    none = F.array().cast("array<string>")
    names = ["tag", "left_from", "left_to", "right_from", "right_to"]
    kind = pa.list_(pa.struct([("tag", pa.string()), *((n, pa.int32()) for n in names[1:])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                spans = [[dict(zip(names, s, strict=True)) for s in edit_spans(x.as_py(), y.as_py())] for x, y in zip(some.column(len(keep)), some.column(len(keep) + 1), strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], pa.array(spans, kind)], names=[*keep, name])

    return df.select(*keep, F.coalesce(left, none).alias("__left"), F.coalesce(right, none).alias("__right")).mapInArrow(run, schema)


def rebuilt(left: str, right: str, spans: str):
    """The right tokens, put together from the left ones and from what the spans replace and insert."""
    part = lambda s: F.when(s["tag"] == "equal", F.slice(left, s["left_from"] + 1, s["left_to"] - s["left_from"])).otherwise(F.slice(right, s["right_from"] + 1, s["right_to"] - s["right_from"]))
    return F.flatten(F.transform(spans, part))
