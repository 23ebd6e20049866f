"""Token counts without token ids.

Each distinct pre-token of the corpus is cut into pieces once; a document's count is the sum, over
its own pre-tokens, of frequency times pieces. The most frequent pre-tokens (at most `hot` of them,
a fixed number) go to the tasks as a broadcast table, since each is in most documents and would make
a hot join key; all others join by a shuffle.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import bounded_batches, slices, stored, utf8

#: Distinct chunks that a worker remembers, and pre-tokens that it counts before it hands them on.
MEMORY = 1 << 18
HOT = 1 << 17


#: A normalizer and splitter (fixed values) whose work on ASCII and precomposed Latin-1 letters a plain
#: regular expression does as well; all other texts and tokenizers go through the library.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall


class PreTokens:
    """A tokenizer's pre-tokens, as they are after normalization. ASCII white space never lies inside
    one, so texts are cut there first, and each distinct chunk is split once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split_special = lru_cache(1)(self._pattern)
        spec = json.loads(self.tokenizer.to_str())
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self._simple = spec["normalizer"] == _NORMALIZER and split[0].get("pattern") == {"Regex": _SPLIT} and split[0].get("invert") is True
        self._known: dict[bytes, tuple[tuple[str, ...], int]] = {}
        if self.tokenizer.normalizer and any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens are to be taken from the text as it is")
        for text in ("a b", "a \t\n\r\x0b\x0c b"):
            if self._split(text) != [p for c in text.split() for p in self._split(c)]:
                raise ValueError("the tokenizer keeps white space")

    def _pattern(self):
        return re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _split(self, text: str) -> list[str]:
        if self._simple and _SIMPLE(text):
            return _PARTS(text.lower())
        t = self.tokenizer
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        return [text[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(text)]

    def chunk(self, raw: bytes) -> tuple[tuple[str, ...], int]:
        """Pre-tokens of a text without ASCII white space, and the number of special tokens in it."""
        known = self._known.get(raw)
        if known is None:
            text, special = raw.decode(), 0
            parts = [text]
            if any(s in text for s in self.special):
                parts = self.split_special().split(text)
                special = len(parts) - 1
            known = tuple(p for part in parts if part for p in self._split(part)), special
            if len(raw) < 64:
                if len(self._known) >= MEMORY:
                    self._known.clear()
                self._known[raw] = known
        return known

    def pieces(self, pre_token: str) -> int:
        return sum(len(self.tokenizer.model.tokenize(p)) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(pre_token))


@lru_cache(maxsize=2)
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


def vocabulary(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """The corpus's distinct pre-tokens: pre_token, n (occurrences) and n_pieces, counted once each.
    Tasks count before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, chunks, found = pre_tokens(tokenizer_path), Counter(), Counter()

        def flush(into: Counter) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(into.keys()), pa.string()), pa.array(list(into.values()), pa.int64())], names=["pre_token", "n"])
            into.clear()
            return out

        def fold() -> None:
            for raw, n in chunks.items():
                for p in split.chunk(raw)[0]:
                    found[p] += n
            chunks.clear()

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                chunks.update(text.split())
            if len(chunks) >= MEMORY:
                fold()
            if len(found) >= 2 * MEMORY:
                yield flush(found)
        fold()
        if found:
            yield flush(found)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pre_tokens(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([split.pieces(p) for p in batch.column(0).to_pylist()], pa.int64())], names=["pre_token", "n", "n_pieces"])

    counted = bounded_batches(docs).select(utf8(text_col).alias("text")).mapInArrow(count, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(pieces, "pre_token string, n long, n_pieces long")


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Tokens of every text, as the library counts them without added special tokens.

    Returns id_col, n_bytes (UTF-8) and n_tokens. Special strings inside texts are one token each, as
    the library takes them by default. One row for each distinct id: rows that share an id are added
    up, rows with a null id together as well. Null texts are empty and have no bytes and no tokens;
    an empty table gives an empty result; other columns of docs don't matter.
    """
    spark = docs.sparkSession
    docs = bounded_batches(docs).select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    known = stored(vocabulary(docs, tokenizer_path), "pre-tokens")
    most = {r[0]: r[1] for r in known.orderBy(F.desc("n"), "pre_token").limit(hot).select("pre_token", "n_pieces").toLocalIterator()}
    table = spark.sparkContext.broadcast(most)
    kind = docs.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with the sum over hot pre-tokens, and one for each other pre-token."""
        split, hot_pieces, chunk = pre_tokens(tokenizer_path), table.value, {}
        for batch in slices(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            rows, bytes_, fixed, tokens, freq = [], [], [], [], []
            for k, text in enumerate(texts):
                total, rest = 0, {}
                for raw, n in Counter(text.split()).items():
                    known = chunk.get(raw)
                    if known is None:
                        parts, special = split.chunk(raw)
                        known = special + sum(hot_pieces.get(p, 0) for p in parts), tuple(p for p in parts if p not in hot_pieces)
                        if len(raw) < 64:
                            if len(chunk) >= MEMORY:
                                chunk.clear()
                            chunk[raw] = known
                    total += n * known[0]
                    for p in known[1]:
                        rest[p] = rest.get(p, 0) + n
                rows += [k] * (1 + len(rest))
                bytes_ += [len(text)] + [0] * len(rest)
                fixed += [total] + [0] * len(rest)
                tokens += [None, *rest.keys()]
                freq += [0, *rest.values()]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int32())), pa.array(bytes_, pa.int64()), pa.array(fixed, pa.int64()), pa.array(tokens, pa.string()), pa.array(freq, pa.int64())], names=["id", "n_bytes", "fixed", "pre_token", "freq"])

    parts = docs.mapInArrow(count, f"id {kind}, n_bytes long, fixed long, pre_token string, freq long")
    parts = stored(parts, "pre-token-counts")
    rest = parts.where("pre_token is not null").join(known.select("pre_token", "n_pieces"), "pre_token")
    rest = rest.select("id", F.lit(0).cast("long").alias("n_bytes"), (F.col("freq") * F.col("n_pieces")).alias("n"))
    fixed = parts.where("pre_token is null").select("id", "n_bytes", F.col("fixed").alias("n"))
    total = fixed.unionByName(rest).groupBy("id").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return total.withColumnRenamed("id", id_col)
