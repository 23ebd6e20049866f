"""Alignment of two tokenizers' tokens, through a dictionary of token groups.

Both tokenizers' tokens cut a text's bytes. Where both cut at once, a group ends: some ids of A and some of B
that stand for the same bytes. Texts hold few distinct groups, so all work on links (pairs of an A
and a B token of one group) is done once for each distinct group:

1. each text is encoded and cut into groups; its distinct groups are kept with their frequencies. Words are
   encoded once in each worker, since both tokenizers cut before a space that follows a word;
2. distinct groups are interned in a dictionary. How many documents hold an id pair linked is counted over each document's
   distinct groups, in tasks before the shuffle;
3. the dictionary's groups are expanded to links once, which meet the counts of their pairs and are added up by group;
4. sums by group times frequencies give the documents' sums. The most frequent groups (at most HOT, a fixed number) reach
   tasks as a broadcast table, since each is in most documents; all others join by their key.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import bounded_batches, slices, stored, utf8

#: Words, groups and id pairs that a worker remembers; groups that go to tasks as a table.
MEMORY = 1 << 18
HOT = 1 << 17
#: Keys of this many bytes are built once for the frequent short groups; longer ones aren't remembered.
SHORT = 64
SPACE = "▁"

def _byte_letters() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 bytes are themselves, the others
    follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Two vocabularies: a byte-level one of the tokenizers library (A) and one of sentencepiece (B)."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        self._a_text = {i: bytes(letters.get(c, 63) for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self._a_length = np.zeros(max(self._a_text) + 1, np.int64)
        self._a_length[list(self._a_text)] = [len(t) for t in self._a_text.values()]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        n = self.b.vocab_size()
        self._b_text = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self._b_length = np.array([len(t) for t in self._b_text])
        self._digits = [str(i) for i in range(max(n, len(self._a_length)))]
        self._known: dict[str, list[int] | None] = {}
        self._number: dict[str, int] = {}
        self.names: list[str] = []
        self.sides = np.zeros((1 << 12, 2), np.int64)
        if any(" " in t.decode().lstrip(" ") for i, t in enumerate(self._b_text) if not self.b.is_byte(i)):
            raise ValueError("pieces with a space after another character can't be encoded by words")
        probe = "a b  c\n d"
        if self.groups(probe) != [g for w in self.words(" " + probe) for g in self.groups(w[1:])]:
            raise ValueError("a tokenizer doesn't cut before a space that follows a word")

    #: A space after what is no white space, for either tokenizer, begins a word.
    _cut = re.compile(r"(?<=\S)(?= )").split

    _loose = re.compile(r"[^\S ] ").search

    def words(self, text: str) -> list[str]:
        """The words of a text that begins with a space."""
        if "  " not in text and text[-1] != " " and not self._loose(text):  # every space begins one
            return [" " + w for w in text[1:].split(" ")]
        return self._cut(text)

    def encoded(self, text: str) -> tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and B of a text to which both put a space in front, and of each group: the end in bytes and in the ids
        of A and of B. None where tokens don't give back the bytes."""
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids  # no offsets are asked for
        b = self.b.encode(text) if text else [self.b.piece_to_id(SPACE)]  # the space that a text ends with
        raw = (" " + text).encode()
        if b"".join([self._a_text.get(i, b"") for i in a]) != raw or b"".join([self._b_text[i] for i in b]) != raw:
            return None
        ends_a, ends_b = np.cumsum(self._a_length[a]), np.cumsum(self._b_length[b])
        at = np.minimum(np.searchsorted(ends_b, ends_a), len(b) - 1)
        both = np.flatnonzero(ends_b[at] == ends_a)
        return a, b, ends_a[both], both + 1, at[both] + 1

    def groups(self, text: str) -> list[str] | None:
        """A text's groups as `a1,a2|b1`."""
        found = self.encoded(text)
        return None if found is None else self._keys(*found)

    def _keys(self, a: list[int], b: list[int], _, to_a: np.ndarray, to_b: np.ndarray) -> list[str]:
        x, y = [self._digits[i] for i in a], [self._digits[i] for i in b]
        out, i, j = [], 0, 0
        for k, m in zip(to_a.tolist(), to_b.tolist(), strict=True):
            out.append(f"{x[i]}|{y[j]}" if k - i == m - j == 1 else f"{','.join(x[i:k])}|{','.join(y[j:m])}")
            i, j = k, m
        return out

    def interned(self, words: set[str]) -> dict[str, list[int] | None]:
        """The groups of words, by their numbers in the worker's dictionary (names, sides). New words are encoded as one text,
        in which they stand one behind the other."""
        known = self._known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > MEMORY:
            kept = {w: [self.names[k] for k in known[w]] for w in words if known.get(w) is not None}  # frequent words among them
            known.clear()
            self._number.clear()
            self.names.clear()
            known.update((w, self._numbers(keys)) for w, keys in kept.items())
            new = [w for w in words if w not in known]
        for k in range(0, len(new), 2048):
            some = new[k : k + 2048]
            found = self.encoded("".join(some)[1:]) if not any(w[-1].isspace() for w in some) else None
            if found is None:  # white space at a text's end, or a word that isn't given back
                for w in some:
                    keys = self.groups(w[1:])
                    known[w] = None if keys is None else self._numbers(keys)
                continue
            numbers = self._numbers(self._keys(*found))
            cuts = np.searchsorted(found[2], np.cumsum([len(w.encode()) for w in some])) + 1
            at = 0
            for w, cut in zip(some, cuts.tolist(), strict=True):
                known[w] = numbers[at:cut]
                at = cut
        return known

    def _numbers(self, keys: list[str]) -> list[int]:
        number, names, out = self._number, self.names, []
        for key in keys:
            k = number.get(key)
            if k is None:
                k = number[key] = len(names)
                names.append(key)
                if k >= len(self.sides):
                    self.sides = np.concatenate([self.sides, np.zeros_like(self.sides)])
                a, b = key.split("|")
                self.sides[k] = a.count(",") + 1, b.count(",") + 1
            out.append(k)
        return out

    def forget(self, words: Iterable[str]) -> None:
        """Long words aren't remembered."""
        for w in words:
            if len(w) >= SHORT:
                self._known.pop(w, None)


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def links_of(key: str) -> Counter:
    """Links of a group by id pair (A's id times 2^32 plus B's), with how often each occurs."""
    a, b = (Counter(map(int, side.split(","))) for side in key.split("|"))
    return Counter({x << 32 | y: n * m for x, n in a.items() for y, m in b.items()})


def grouped(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups (the text of all groups in order), keys (the distinct groups) and times
    (the frequency of each) of every row. Texts that are null or empty, or whose tokens don't give back their bytes, have
    none of these."""
    docs = bounded_batches(docs).select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        for batch in slices(batches):
            rows = []
            texts = [both.words(" " + raw.decode()) if raw else [] for raw in batch.column(1).to_pylist()]
            every = set().union(*texts)
            known = both.interned(every)
            for words in texts:
                found = [known[w] for w in words]
                numbers = [] if None in found else list(chain.from_iterable(found))
                once, n = np.unique(np.array(numbers, np.int64), return_counts=True)
                a, b = both.sides[once].T
                name = both.names
                rows.append((int(a @ n), int(b @ n), len(numbers), int((a * b) @ n), ";".join([name[k] for k in numbers]), [name[k] for k in once.tolist()], n))
            both.forget(every)
            types = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=["id", "n_a", "n_b", "n_groups", "n_links", "groups", "keys", "times"])

    return docs.mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, keys array<string>, times array<long>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair and n: in how many rows (keys) some group links the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: dict[str, int] = {}  # groups of one A and one B token, which most are
        more: dict[str, list[int]] = {}
        held, size = [], 0

        def pairs(keys: list[str]) -> np.ndarray:
            out, rest = [], []
            for k in keys:
                p = one.get(k)
                if p is None:
                    rest.append(k)
                else:
                    out.append(p)
            for k in rest:
                found = more.get(k)
                if found is None:
                    found = list(links_of(k))
                    if len(k) < SHORT:
                        if len(one) + len(more) >= MEMORY:
                            one.clear()
                            more.clear()
                        if len(found) == 1:
                            one[k] = found[0]
                        else:
                            more[k] = found
                out += found
            return np.unique(np.array(out, np.int64))

        def flushed() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

        for batch in slices(batches):
            for keys in batch.column(0).to_pylist():
                if keys:
                    held.append(pairs(keys))
                    size += len(held[-1])
                if size > 8 * MEMORY:
                    yield flushed()
                    held, size = [], 0
        if held:
            yield flushed()

    return rows.select("keys").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def group_values(rows: DataFrame) -> DataFrame:
    """The dictionary: key, frequency (over all rows), n_best (links whose pair's count is the highest of their A id) and
    count_sum (the pairs' counts over all links)."""
    words = stored(rows.select(F.explode(F.arrays_zip("keys", "times")).alias("g")).groupBy("g.keys").agg(F.sum("g.times").alias("frequency")).withColumnRenamed("keys", "key"), "groups")
    counts = stored(pair_counts(rows), "pairs")
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    counts = counts.withColumn("a", F.shiftright("pair", 32)).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for part in range(0, batch.num_rows, 64):
                some = batch.slice(part, 64)
                links = [links_of(k) for k in some.column(0).to_pylist()]
                of = np.repeat(np.arange(some.num_rows), [len(x) for x in links])
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(of)), pa.array([p for x in links for p in x], pa.int64()), pa.array([m for x in links for m in x.values()], pa.int64())], names=["key", "pair", "m"])

    links = words.select("key").mapInArrow(run, "key string, pair long, m long")
    # a pair may be in many groups: each part of its links meets a copy of its count
    parts = 8
    links = links.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    counts = counts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    values = links.join(counts, ["pair", "part"]).groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
    return words.join(values, "key")


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Groups and links of every text, and how its links fare in the whole corpus.

    Returns id_col, n_a, n_b (tokens), n_groups, n_links (pairs of an A and a B token of one group), n_best (links
    whose id pair is linked in as many documents as any pair of their A id, ties included), count_sum (over links, the documents in
    which their id pair is linked) and groups (`a1,a2|b1;a3|b2,b3`). One row for each input row: rows that share an id, or
    are alike, count as documents of their own; rows without an id too. Null and empty texts, and texts whose tokens don't give
    back a space and the text, have zeros and empty groups. Other columns don't matter.
    """
    spark = docs.sparkSession
    rows = stored(grouped(docs, a_path, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "token-groups")
    values = stored(group_values(rows), "group-values")
    frequent = list(values.orderBy(F.desc("frequency"), "key").limit(hot).select("key", "n_best", "count_sum").toLocalIterator())
    numbers = {r[0]: k for k, r in enumerate(frequent)}
    sums = np.array([(r[1], r[2]) for r in frequent] + [(0, 0)], np.int64)  # the last is of all others
    table = spark.sparkContext.broadcast((numbers, sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with the sums over frequent groups, and one for each other group."""
        known, sums = table.value
        for batch in slices(batches):
            of, best, count, key, n = [], [], [], [], []
            freq, cuts = batch.column(2).flatten().to_numpy(), np.cumsum([0, *pa.compute.fill_null(pa.compute.list_value_length(batch.column(2)), 0).to_pylist()])
            for k, (row, keys) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                at = np.array([known.get(x, -1) for x in keys], np.int64)
                times = freq[cuts[k] : cuts[k + 1]]
                x, y = (sums[at] * times[:, None]).sum(axis=0).tolist()
                rest = np.flatnonzero(at < 0).tolist()
                of += [row] * (1 + len(rest))
                best += [x] + [0] * len(rest)
                count += [y] + [0] * len(rest)
                key += [None, *(keys[i] for i in rest)]
                n += [0, *times[rest].tolist()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (of, best, count)), pa.array(key, pa.string()), pa.array(n, pa.int64())], names=["row", "n_best", "count_sum", "key", "times"])

    parts = rows.select("row", "keys", "times").mapInArrow(run, "row long, n_best long, count_sum long, key string, times long")
    # rows of documents have no group: they get a key of their own, so that they don't meet in one task
    parts = parts.withColumn("key", F.coalesce("key", F.concat(F.lit("#"), F.col("row").cast("string"))))
    joined = parts.join(values.select("key", F.col("n_best").alias("b"), F.col("count_sum").alias("c")), "key", "left")
    share = lambda name, of: F.sum(F.col(name) + F.col("times") * F.coalesce(of, F.lit(0))).alias(name)
    added = joined.groupBy("row").agg(share("n_best", "b"), share("count_sum", "c"))
    return rows.select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups").join(added, "row").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
