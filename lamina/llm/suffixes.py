"""Removal of repeated byte strings by suffix arrays.

A string of `length` bytes that starts at two places anywhere goes at both. Which starts are alike is read
from suffix arrays of shards; a corpus doesn't fit one, so starts that can be alike are brought together first:

1. every start is put under an anchor, the least of the hashes of the short grams in its string. Equal strings have equal
   anchors at equal distances. Neighbouring starts share one, so there are some length / 2 times fewer anchors than bytes;
2. anchors are counted in the cluster. Those that occur once have no equal starts and are dropped;
3. the starts of each other anchor with the bytes that their strings take are a *stretch*. Tasks count equal
   stretches and ship one of them; stretches of one anchor meet in one shard;
4. a shard's stretches are put in a row and their suffixes sorted, by Larsson and Sadakane's refinement: first by eight bytes, then
   only groups that aren't told apart yet, by the rank of the suffix behind those bytes. Kasai's pass gives common
   prefixes of neighbours; starts between which these are `length` at least are a class, and classes that occur more than
   once are repeats;
5. an anchor with more than LIMIT stretches is dealt over several shards. Each hands on its classes sorted by a 128-bit digest; shards'
   runs are merged by binary search, range by range of digests;
6. repeated starts go back to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from lamina.llm import windows
from lamina.llm.common import binary_of, bounded_batches, slices, stored, utf8

#: Stretches of one anchor that a shard holds; bytes of a shard; bytes of distinct stretches that a task counts.
LIMIT = 1024
SHARD_BYTES = 1 << 21
HELD_BYTES = 1 << 24
#: Bytes that are hashed at once; a window's place within them takes the low bits of its order.
BLOCK = 1 << 23
_PLACE = np.uint64((1 << 24) - 1)
_LETTER = windows.mixed(np.arange(1, 257, dtype=np.uint64))


# --- suffix arrays ---------------------------------------------------------------------------------


def _eight(data: np.ndarray, more: int) -> np.ndarray:
    """At each place the next eight bytes as a number, for `more` places beyond the end too (zeros)."""
    padded = np.zeros(len(data) + more + 8, np.uint8)
    padded[: len(data)] = data
    out = np.zeros(len(data) + more, np.uint64)
    for k in range(8):
        out |= padded[k : k + len(out)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes, by Larsson and Sadakane's refinement: `known` bytes tell groups apart; only groups
    of several places are sorted again, by the rank of what follows these bytes, and `known` doubles."""
    n = len(data)
    small = np.int32 if n < 1 << 31 else np.int64
    first = _eight(data, 0)
    order = np.argsort(first).astype(small)
    sorted_ = first[order]
    head = np.ones(n, bool)
    head[1:] = sorted_[1:] != sorted_[:-1]
    rank = np.empty(n + 9, small)
    rank[n:] = -1 - np.arange(9)  # beyond the end: the shorter suffix goes first
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    at, known = np.arange(n, dtype=small), 8
    while True:
        single = head & np.append(head[1:], True)
        at = at[~single]
        if not len(at):
            return order
        places = order[at]
        key = rank[places].astype(np.int64) * (n + 16) + rank[places + known] + 10
        by = np.argsort(key, kind="stable")  # runs of equal keys are long
        places, key = places[by], key[by]
        head = np.ones(len(at), bool)
        head[1:] = key[1:] != key[:-1]
        order[at] = places
        rank[places] = at[head][np.cumsum(head) - 1]
        known *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int, lane: int = 64) -> np.ndarray:
    """Bytes, `depth` at most, that each suffix shares with the one before it in the order, by Kasai's pass: from one place
    to the next the common prefix loses one byte at most. Lanes of places run side by side."""
    n = len(data)
    eight = _eight(data, depth + 8)
    before = np.full(n, -1, order.dtype)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int32)
    begin = np.arange(0, n, lane)
    same = np.zeros(len(begin), np.int64)
    for k in range(min(lane, n)):
        if begin[-1] + k >= n:
            begin, same = begin[:-1], same[:-1]
        i = begin + k
        j = before[i]
        same = np.maximum(same - 1, 0)
        same[j < 0] = 0
        left = np.flatnonzero((j >= 0) & (same < depth))
        while len(left):
            differ = eight[i[left] + same[left]] ^ eight[j[left] + same[left]]
            more = _leading_bytes(differ)
            same[left] = np.minimum(same[left] + more, depth)
            left = left[(more == 8) & (same[left] < depth)]
        out[i] = same
    return out[order]


def _leading_bytes(x: np.ndarray) -> np.ndarray:
    """Zero bytes at the upper end of each number."""
    out = np.where(x == 0, 1, 0)
    for bits, n in ((32, 4), (16, 2), (8, 1)):
        low = x < np.uint64(1) << np.uint64(64 - bits)
        out += n * low
        x = np.where(low, x << np.uint64(bits), x)
    return out


def classes(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all starts of strings of `length` bytes in the texts: the text, the place there, and the class of equal strings."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    text, place = windows.places(sizes)
    starts = place + length <= sizes[text]
    order = suffix_array(data)
    number = np.cumsum(common_prefixes(data, order, length) < length)
    order_starts = starts[order]
    at = order[order_starts]
    return text[at], place[at], number[order_starts]


# --- anchors and stretches -------------------------------------------------------------------------


def gram_of(length: int) -> int:
    return max(1, min(32, length // 2))


def stretches(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all stretches of the texts: the text, the first start there, the number of starts, the anchor's hash."""
    gram = gram_of(length)
    span = length - gram + 1
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    found = []
    for low in range(0, max(len(data) - length + 1, 0), BLOCK):
        part = data[low : low + BLOCK + length - 1]
        hashes = windows.run_hashes(_LETTER[part], gram)
        least = hashes & ~_PLACE | np.arange(len(hashes), dtype=np.uint64)
        done = 1
        while done < span:  # the least of `done` grams from each place on
            step = min(done, span - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        anchor = (least & _PLACE).astype(np.int64)
        start = np.arange(low, low + len(anchor))
        text = np.searchsorted(ends, start, "right")
        whole = start + length <= ends[np.minimum(text, len(ends) - 1)]
        start, text, anchor = start[whole], text[whole], anchor[whole]
        if len(start):
            new = np.ones(len(start), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
            first = np.flatnonzero(new)
            found.append((text[first], start[first] - (ends - sizes)[text[first]], np.diff(np.append(first, len(start))), hashes[anchor[first]].view(np.int64)))
    if not found:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _keys(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """id, text (binary) and a key of 128 bits of both: rows that are alike in them share it."""
    docs = bounded_batches(docs).select(F.col(id_col).alias("id"), utf8(text_col).alias("text"), *more)
    return docs.withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64(F.lit(7), "text", "id")})


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """The distinct anchors of every row, with the stretches under each: h, k1, k2, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text, _, _, anchor = stretches(batch.column(2).to_pylist(), length)
            if len(text):
                by = np.lexsort((anchor, text))
                text, anchor = text[by], anchor[by]
                new = np.ones(len(by), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                first = np.flatnonzero(new)
                of = pa.array(text[first])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[first]), batch.column(0).take(of), batch.column(1).take(of), pa.array(np.diff(np.append(first, len(by))))], names=["h", "k1", "k2", "n"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "h long, k1 long, k2 long, n long")


_STRETCH = "h long, part int, parts int, d1 long, d2 long, n long, text binary, k1 long, k2 long, places binary"


def _stretch_rows(docs: DataFrame, length: int) -> DataFrame:
    """Rows of two kinds. With text: a distinct stretch of the task, how often it occurs there, and the part (of how many) of
    its anchor's shards. With places: where a row's text has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list] = {}
        size = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            h, part, parts, d1, d2, n, text, k1, k2, places = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(part, pa.int32()), pa.array(parts, pa.int32()), *(pa.array(c, pa.int64()) for c in (d1, d2, n)), pa.array(text, pa.binary()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(places, pa.binary())], names=["h", "part", "parts", "d1", "d2", "n", "text", "k1", "k2", "places"])

        def flushed() -> Iterator[pa.RecordBatch]:
            items = [(h, part, parts, d1, d2, n, text, None, None, None) for (h, text), (d1, d2, part, parts, n) in held.items()]
            held.clear()
            for k in range(0, len(items), 1024):
                yield batch_of(items[k : k + 1024])

        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            text, first, n, anchor = stretches(texts, length)
            shared, wide = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            rows = []
            cuts = np.searchsorted(text, np.arange(len(texts) + 1))
            for k, raw in enumerate(texts):
                own = slice(cuts[k], cuts[k + 1])
                keep = np.isin(anchor[own], np.array(shared[k], np.int64))
                many = {w["h"]: w["parts"] for w in wide[k]}
                where: dict[tuple[int, int, int], list[int]] = {}
                for at, count, h in zip(first[own][keep].tolist(), n[own][keep].tolist(), anchor[own][keep].tolist(), strict=True):
                    piece = raw[at : at + count + length - 1]
                    known = held.get((h, piece))
                    if known is None:
                        digest = xxhash.xxh3_128_digest(piece)
                        d1, d2 = (int.from_bytes(digest[a : a + 8], "big", signed=True) for a in (0, 8))
                        parts = many.get(h, 1)
                        known = held[h, piece] = [d1, d2, d2 % parts, parts, 0]
                        size += len(piece)
                    known[4] += 1
                    where.setdefault((h, known[0], known[1]), []).append(at)
                k1, k2 = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                rows += [(h, None, None, d1, d2, None, None, k1, k2, np.array(at, "<i4").tobytes()) for (h, d1, d2), at in where.items()]
            if rows:
                yield batch_of(rows)
            if size > HELD_BYTES:
                yield from flushed()
                size = 0
        yield from flushed()

    return docs.mapInArrow(run, _STRETCH)


def _runs(of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of texts as runs of neighbours: text, first, last."""
    by = np.lexsort((at, of))
    of, at = of[by], at[by]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return of[first], at[first], at[np.append(first[1:] - 1, len(of) - 1)] if len(of) else at


#: A class of a shard: the digest of its string, and the stretch and start that it has there if it has one alone (else -1).
_CLASS = np.dtype([("w1", "<i8"), ("w2", "<i8"), ("d1", "<i8"), ("d2", "<i8"), ("at", "<i4")])
_FOUND = "h long, d1 long, d2 long, first int, last int, share int, run binary"
_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _shards(length: int, shard_bytes: int):
    """Of stretches ordered by anchor and part: runs of starts that repeat within a shard, and, of anchors with several parts, runs of
    classes in the order of their digests, one for each range of digests (share)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: dict[tuple[int, bytes], list[int]] = {}
        at, size = None, 0

        def batch_of(columns: list) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_FOUND_NAMES)

        def searched() -> Iterator[pa.RecordBatch]:
            kinds: dict[int, int] = {}
            for h, _ in shard:
                kinds[h] = kinds.get(h, 0) + 1
            whole = [(h, v[1], v[2], 0, len(t) - length) for (h, t), v in shard.items() if v[0] > 1]
            if whole:  # a stretch that occurs more than once repeats from end to end
                yield batch_of([*zip(*whole, strict=True), *[[None] * len(whole)] * 2])
            open_ = {h for (h, _), v in shard.items() if v[3] > 1 or (v[0] == 1 and kinds[h] > 1)}
            rest = [(h, t, v) for (h, t), v in shard.items() if h in open_]
            if not rest:
                return
            texts = [t for _, t, _ in rest]
            text, place, number = classes(texts, length)
            weight = np.array([v[0] for *_, v in rest])
            _, number, members = np.unique(number, return_inverse=True, return_counts=True)
            total = np.bincount(number, weight[text])
            hit = (total[number] > 1) & (weight[text] == 1)
            of, first, last = _runs(text[hit], place[hit])
            if len(of):
                names = [rest[k] for k in of.tolist()]
                yield batch_of([[h for h, *_ in names], [v[1] for *_, v in names], [v[2] for *_, v in names], first, last, *[[None] * len(of)] * 2])
            member = np.full(len(members), -1)
            member[number] = np.arange(len(number))
            runs: dict[tuple[int, int], list[tuple]] = {}
            for k, n in zip(member.tolist(), total.tolist(), strict=True):
                h, raw, v = rest[text[k]]
                if v[3] > 1:
                    at = int(place[k])
                    digest = xxhash.xxh3_128_digest(raw[at : at + length])
                    w1, w2 = (int.from_bytes(digest[a : a + 8], "big", signed=True) for a in (0, 8))
                    runs.setdefault((h, w2 % v[3]), []).append((w1, w2, v[1], v[2], at if n == 1 else -1))
            for names in (list(runs)[k : k + 256] for k in range(0, len(runs), 256)):
                none = [None] * len(names)
                yield batch_of([[h for h, _ in names], *[none] * 4, [share for _, share in names], [np.sort(np.array(runs[x], _CLASS), order=["w1", "w2"]).tobytes() for x in names]])

        for batch in slices(batches):
            for h, part, parts, d1, d2, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h, part) != at:
                    at = h, part
                    if size > shard_bytes:
                        yield from searched()
                        shard, size = {}, 0
                known = shard.get((h, text))
                if known is None:
                    shard[h, text] = [n, d1, d2, parts]
                    size += len(text)
                else:
                    known[0] += n
        if shard:
            yield from searched()

    return run


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    """Of the runs of all shards for one range of digests: starts alone in their shard whose class another shard has too."""
    runs = [np.frombuffer(r, _CLASS) for r in table.column("run").to_pylist()]
    every = np.sort(np.concatenate(runs)[["w1", "w2"]].copy())
    found = []
    for run in runs:
        own = run[["w1", "w2"]].copy()
        found.append(run[(np.searchsorted(every, own, "right") - np.searchsorted(every, own, "left") > 1) & (run["at"] >= 0)])
    out = np.concatenate(found)
    return pa.table({"h": pa.array(np.full(len(out), key[0].as_py())), "d1": out["d1"], "d2": out["d2"], "first": out["at"], "last": out["at"]})


def repeated_runs(docs: DataFrame, length: int, limit: int = LIMIT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """k1, k2 (keys of rows) and stretches: the places of repeated stretches with runs of starts. docs: k1, k2, text."""
    anchors = stored(_anchor_rows(docs, length), "anchors")
    shared = anchors.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h", F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    wide = F.when(F.col("parts") > 1, F.struct("h", "parts"))
    lists = anchors.select("h", "k1", "k2").join(stored(shared, "shared-anchors"), "h").groupBy("k1", "k2").agg(F.collect_set("h").alias("shared"), F.collect_set(wide).alias("wide"))
    rows = stored(_stretch_rows(docs.select("k1", "k2", "text").join(lists, ["k1", "k2"]).select("k1", "k2", "text", "shared", "wide"), length), "stretches")

    texts = rows.where("text is not null").select("h", "part", "parts", "d1", "d2", "n", "text")
    found = texts.repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(_shards(length, shard_bytes), _FOUND)
    found = stored(found, "repeated-starts")
    more = found.where("run is not null").select("h", "share", "run").groupBy("h", "share").applyInArrow(_merged, "h long, d1 long, d2 long, first int, last int")
    runs = found.where("run is null").select("h", "d1", "d2", "first", "last").unionByName(more)
    runs = runs.groupBy("h", "d1", "d2").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    places = rows.where("text is null").select("h", "d1", "d2", "k1", "k2", "places")
    return places.join(stored(runs, "runs"), ["h", "d1", "d2"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("places", "runs")).alias("stretches"))


def _gone(stretches_: list[dict] | None, n: int, length: int) -> np.ndarray:
    """Which of n bytes repeated strings cover."""
    step = np.zeros(n + 1, np.int64)
    for s in stretches_ or ():
        at = np.frombuffer(s["places"], "<i4")
        for r in s["runs"]:
            np.add.at(step, at + r["first"], 1)
            np.add.at(step, at + r["last"] + length, -1)
    return np.cumsum(step)[:n] > 0


def remove_repeated_bytes(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Texts, as UTF-8 bytes, without the bytes that a string of `length` bytes covers which starts anywhere else too, in the
    same text or another. Overlaps count, all places lose it, and strings are judged on the input.

    Returns id_col, n_bytes, n_removed, n_spans (longest removed runs) and kept (binary, the remaining bytes joined; cuts may
    fall inside a character). One row for each input row; rows that are alike are documents of their own, so each removes the
    other's text. Null texts are empty; rows without an id take part. Other columns don't matter.
    """
    keyed = _keys(docs, id_col, text_col)
    runs = stored(repeated_runs(keyed, length, limit, shard_bytes), "document-runs")
    joined = keyed.join(runs, ["k1", "k2"], "left").select("id", "text", "stretches")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, kept = [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone = _gone(found, len(text), length)
                n = int(gone.sum())
                rows.append((len(text), n, int((gone & ~np.append(False, gone[:-1])).sum()) if n else 0))
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes() if n else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), binary_of(kept)], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = StructType([joined.schema["id"], *(StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")), StructField("kept", BinaryType())])
    return joined.mapInArrow(remove, out).withColumnRenamed("id", id_col)
