"""Removal of repeated word sequences, found by difference-cover anchors.

Only windows that begin at cover places (modulo a period) of a document are hashed. By the cover's
property any two equal sequences of `length` words have such a place at the same distance from their
begin, whatever their own places; the anchor there lies inside both and has the same hash. Around
anchors that two documents share, the sequences of full length are compared; all others can't repeat.

1. anchor hashes are counted by document (tasks combine first);
2. the shared ones go to all tasks as a bit table of fixed size, so what passes it is a superset;
3. passing anchors are extended on both sides to the sequences of full length around them, and these are
   grouped: the smallest document of each;
4. sequences that a smaller document has as well mark their words.

Sequences are told apart by 96 bits: a group is found by 64, and where its other 32 differ, its sequences
are grouped anew by all of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from lamina.llm import windows
from lamina.llm.common import bounded_batches, slices, stored, utf8

#: Period -> places that hold every difference modulo the period (perfect difference sets; fixed values).
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Size of a bit table: 2^27 bits are 16 MB, at any size of the input. A fuller table lets more pass.
BITS = 27


def cover_of(length: int) -> tuple[int, tuple[int, ...], int]:
    """Period, places and anchor length for sequences of `length` words: the longest period that leaves
    anchors of half the length."""
    period = max((p for p in COVERS if p <= (length + 1) // 2), default=1)
    return period, COVERS.get(period, (0,)), length - period + 1


def bit_table(hashes: DataFrame, bits: int = BITS) -> Broadcast:
    """A table of 2^bits bits in which each hash (column h) has its bit set."""
    cell = F.shiftrightunsigned("h", 64 - bits)
    rows = hashes.select(F.shiftrightunsigned(cell, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(cell, F.lit(64)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(table)


def passing(table: np.ndarray, hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    cell = hashes >> np.uint64(64 - bits)
    return (table[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) == 1


def _anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of anchors, the place (in all words in a row) of each; and of words: hashes, text, rest of
    the text from there on."""
    period, cover, size = cover_of(length)
    hashes, counts, _ = windows.word_hashes(texts)
    text, place = windows.places(counts)
    left = counts[text] - place
    runs = windows.run_hashes(hashes, size)
    n = len(runs)
    keep = np.flatnonzero(np.isin(place[:n] % period, cover) & (left[:n] >= size) & (counts[text[:n]] >= length))
    return runs[keep], keep, hashes, text, left


def repeated_starts(docs: DataFrame, length: int) -> DataFrame:
    """Begins of sequences of `length` words that a document with a smaller id has as well: id,
    version, start. docs: id (not null), version (of the texts that share an id) and text (binary)."""
    kind = docs.schema["id"].dataType.simpleString()
    period = cover_of(length)[0]

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, at, _, text, _ = _anchors(batch.column(0).to_pylist(), length)
            if len(found):  # once for each document
                by = np.lexsort((found, text[at]))
                new = np.ones(len(by), bool)
                new[1:] = (found[by][1:] != found[by][:-1]) | (text[at][by][1:] != text[at][by][:-1])
                once, n = np.unique(found[by][new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(once.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])

    shared = docs.select("text").mapInArrow(anchors, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    near = bit_table(stored(shared, "shared-anchors"))

    def sequences(known: Broadcast | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found, at, hashes, text, left = _anchors(batch.column(2).to_pylist(), length)
                at = at[passing(near.value, found)]
                begin = np.zeros(len(hashes) + 1, bool)
                for back in range(period):
                    begin[(at - back)[at >= back]] = True
                begin = np.flatnonzero(begin[: len(hashes)] & (left >= length))
                full, more = full_hashes(hashes, length, begin)
                if known is not None:
                    keep = passing(known.value, full)
                    begin, full, more = begin[keep], full[keep], more[keep]
                if len(begin):
                    start = begin - np.searchsorted(text, text[begin])
                    of = pa.array(text[begin])
                    yield pa.RecordBatch.from_arrays([pa.array(full.view(np.int64)), pa.array(more), batch.column(0).take(of), batch.column(1).take(of), pa.array(start.astype(np.int32))], names=["h", "more", "id", "version", "start"])

        return docs.select("id", "version", "text").mapInArrow(run, f"h long, more int, id {kind}, version long, start int")

    least, most = F.min("id").alias("least"), F.max("id").alias("most")
    first = sequences(None).groupBy("h").agg(least, most, (F.min("more") == F.max("more")).alias("alike")).where("least < most")
    first = stored(first.select("h", "least", "alike"), "shared-sequences")
    known = bit_table(first.select("h"))
    again = sequences(known).join(first.where("alike"), "h").where("id > least").select("id", "version", "start")
    mixed = first.where("not alike")
    if not mixed.isEmpty():
        rows = stored(sequences(bit_table(mixed.select("h"))).join(mixed.select("h"), "h", "left_semi"), "mixed-sequences")
        of = rows.groupBy("h", "more").agg(least, most).where("least < most")
        again = again.unionByName(rows.join(of, ["h", "more"]).where("id > least").select("id", "version", "start"))
    return again


def full_hashes(hashes: np.ndarray, length: int, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of hashes of the sequences that begin at some places."""
    more = windows.run_hashes(windows.mixed(hashes ^ np.uint64(0x5EED)), length)[begin]
    return windows.run_hashes(hashes, length)[begin], (more >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _covered(starts: list[int] | None, n: int, length: int) -> np.ndarray:
    out = np.zeros(n + 1, np.int32)
    if starts:
        at = np.unique(np.array(starts))
        at = at[at + length <= n]
        np.add.at(out, at, 1)
        np.add.at(out, at + length, -1)
    return np.cumsum(out)[:n] > 0


def remove_repeats(docs: DataFrame, length: int, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Texts without the words covered by a sequence of `length` words that also starts in a document
    with a smaller id. Sequences are judged on the input, not on what is left.

    Returns id_col, n_words, n_removed, kept (the kept words with one space between) and cleaned (the
    text as it was but for the removed words and the white space after each; unchanged if nothing
    goes), both binary UTF-8, and with `carry` a struct `row` of these columns of the input row. One row for
    each input row. Null texts have no words and empty results. Rows that share an id count as one document,
    so they don't remove each other's words, but each loses only what its own text repeats. Rows without an
    id keep all words and remove none. Other columns of docs don't matter.
    """
    import re

    row = [F.struct(*carry).alias("row")] if carry else []
    docs = bounded_batches(docs).select(F.col(id_col).alias("id"), utf8(text_col).alias("text"), *row).withColumn("version", F.xxhash64("text"))
    # rows may be repeated: a set of starts is no longer for it
    starts = repeated_starts(docs.where("id is not null"), length).groupBy("id", "version").agg(F.collect_set("start").alias("starts"))
    starts = stored(starts, "repeated-starts")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
        for batch in slices(batches):
            n_words, n_removed, kept, cleaned = [], [], [], []
            for text, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts = text.split()
                gone = _covered(at, len(parts), length)
                n_words.append(len(parts))
                n_removed.append(int(gone.sum()))
                if n_removed[-1]:
                    parts = [p for p, g in zip(parts, gone.tolist(), strict=True) if not g]
                    text = b"".join(m for m, g in zip(word.findall(text), gone.tolist(), strict=True) if not g)
                kept.append(b" ".join(parts))
                cleaned.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(cleaned, pa.binary()), *batch.columns[3:]], names=["id", "n_words", "n_removed", "kept", "cleaned", *batch.schema.names[3:]])

    joined = docs.join(starts, ["id", "version"], "left").select("id", "text", "starts", *(["row"] if carry else []))
    out = StructType([joined.schema["id"], *(StructField(n, LongType()) for n in ("n_words", "n_removed")), *(StructField(n, BinaryType()) for n in ("kept", "cleaned")), *joined.schema.fields[3:]])
    return joined.mapInArrow(remove, out).withColumnRenamed("id", id_col)
