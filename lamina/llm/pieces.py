"""SentencePiece encoding and decoding (merge-type vocabularies with byte fallback).

The encoder finds the result of the merges without doing them: it takes the longest piece at each
place (an Aho-Corasick automaton gives these), keeps it if it is compatible with the piece before
it, and else tries shorter prefixes or goes back. Two neighbours are compatible if merging their
joined characters anew gives just these two. Places from which no way led on are marked in a
bitfield, so no place is tried twice and the work stays in proportion to the text.

Only the vocabulary is read through the sentencepiece library; ids and texts are made here.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import binary_of, bounded_batches, slices

SPACE = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Distinct words, and pairs of pieces, that a Python worker remembers.
MEMORY = 1 << 19

codecs.register_error("lamina.bytewise", lambda e: ("�" * (e.end - e.start), e.end))


def _clean(text: str) -> bool:
    try:
        text.encode()
        return True
    except UnicodeEncodeError:
        return False


class PieceModel:
    """One vocabulary. Raises ValueError for a model that isn't of this kind: with user-defined
    pieces, a normalizer that changes texts, or pieces with a space inside."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.size, self.bos, self.eos = n, sp.bos_id(), sp.eos_id()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.byte_ids) != 256 or sp.bos_id() < 0 or sp.eos_id() < 0:
            raise ValueError("the vocabulary needs 256 byte pieces and begin and end ids")
        plain = [i for i in range(n) if i not in special and not sp.is_byte(i)]
        self.pieces = {i: sp.id_to_piece(i) for i in plain}
        self.ids = {p: i for i, p in self.pieces.items()}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces with a space after another character can't be encoded by words")
        self.known = {p for p in self.ids if len(p) == 1}
        if any(c not in self.known for p in self.ids for c in p):
            raise ValueError("a piece holds a character that is no piece")
        probe = "A é é ａ ﬁ  x"
        if sp.decode(sp.encode(probe)) != probe:
            raise ValueError("the model's normalizer changes texts")

        # No piece holds a character before a space, none a line break, and most no ASCII sign after
        # a Latin letter: texts fall apart there, so words are the same more often.
        held = {m[1] for p in self.ids for m in re.finditer(f"(?<=[{LATIN}])([!-@[-`{{-~])", p)}
        signs = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalpha() and c not in held)
        early = f"{SPACE}*[^{SPACE}\n{LATIN}]*[{LATIN}]+(?=[{signs}{SPACE}\n]|$)|" if signs else ""
        self._cut = re.compile(f"{early}{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall

        automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) == 1 or self._merged(p) == [i]:  # what no merges lead to is never a result
                automaton.add_word(p, (i, len(p) - 1))
        automaton.make_automaton()
        self._automaton = automaton
        self._shorter = [self._prefix(self.pieces[i]) if i in self.pieces else -1 for i in range(n)]
        self._fits: dict[int, bool] = {}
        self._length = [len(self.pieces.get(i, "")) for i in range(n)]
        self._splits = {p: self._split(p) for p in self.ids if len(p) > 1}
        self._right = {i: self._edge(self.pieces[i], 1) for i in self.pieces}
        self._left = {i: self._edge(self.pieces[i], 0) for i in self.pieces}
        self._words: dict[str, bytes] = {}
        self._texts = [""] * n
        for i, p in self.pieces.items():
            self._texts[i] = p.replace(SPACE, " ")
        self._texts[sp.unk_id()] = sp.decode([sp.unk_id()])
        for b, i in self.byte_ids.items():  # bytes over 127 wait as lone surrogates for their neighbours
            self._texts[i] = chr(b) if b < 128 else chr(0xDC00 + b)

    def _prefix(self, piece: str) -> int:
        """The longest reachable piece that is a proper prefix, or -1."""
        k = len(piece) - 1
        while k > 0:
            p = piece[:k]
            if p in self._automaton:
                return self.ids[p]
            k -= 1
        return -1

    def _merged(self, text: str) -> list[int]:
        """The ids by merging: the best scored pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def _split(self, piece: str) -> tuple[str, str] | None:
        """The two parts of a piece's last merge; None if merges don't lead to it."""
        parts, last = list(piece), None
        while len(parts) > 1:
            scored = [(-s, k) for k in range(len(parts) - 1) if (s := self.scores.get(parts[k] + parts[k + 1])) is not None]
            if not scored:
                return None
            k = min(scored)[1]
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return last

    def _edge(self, piece: str, side: int) -> list[tuple[str, float, float]] | None:
        """What stands at a piece's left (0) or right (1) end while it is merged, from one character
        to the whole: each part with the negative scores of the merges that make it and end it. None
        if these don't rise, so that the order of the merges doesn't follow from them."""
        chain, end = [], float("inf")
        while True:
            made = -self.scores[piece] if len(piece) > 1 else float("-inf")
            if not made < end:
                return None
            chain.append((piece, made, end))
            if len(piece) == 1:
                return chain[::-1]
            split = self._splits[piece]
            if split is None or any(len(x) > 1 and not -self.scores[x] < made for x in split):
                return None
            piece, end = split[side], made

    def _compatible(self, a: int, b: int) -> bool:
        if len(self._fits) >= MEMORY:
            self._fits.clear()
        fits = self._fits[a << 32 | b] = self._checked(a, b)
        return fits

    def _checked(self, a: int, b: int) -> bool:
        """Replays the merges on both sides of the border, in order: no part left of it may meet one
        right of it with which it would merge before either is merged away from the border."""
        left, right = self._right[a], self._left[b]
        if left is None or right is None:
            return self._merged(self.pieces[a] + self.pieces[b]) == [a, b]
        scores, j, k = self.scores, 0, 0
        while True:
            (x, x_made, x_end), (y, y_made, y_end) = left[j], right[k]
            score = scores.get(x + y)
            if score is not None:
                due = max(x_made, y_made, -score)
                if due < x_end and due <= y_end and due != float("inf"):
                    return False
            if x_end <= y_end:  # of equal merges the left one goes first
                j += 1
                if j == len(left):
                    return True  # both are whole
            else:
                k += 1

    def _run(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        n = len(text)
        longest = [-1] * n
        for end, (i, before) in self._automaton.iter(text):
            longest[end - before] = i  # a longer one ends later
        failed = bytearray((n >> 3) + 1)  # a bit for each place
        out: list[int] = []
        length, shorter, fits, last = self._length, self._shorter, self._fits, -1
        at, i = 0, longest[0]
        while True:
            while i >= 0:
                to = at + length[i]
                if not failed[to >> 3] >> (to & 7) & 1:
                    if last < 0:
                        break
                    fit = fits.get(last << 32 | i)
                    if self._compatible(last, i) if fit is None else fit:
                        break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                last, at = i, to
                if at == n:
                    return out
                i = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                i = out.pop()  # the merges have a result, so there is a way
                last = out[-1] if out else -1
                at -= length[i]
                i = shorter[i]

    def _word(self, word: str) -> bytes:
        if self.known.issuperset(word):
            return np.array(self._run(word), "<u4").tobytes()
        ids: list[int] = []
        run = 0
        for k, c in enumerate(word):
            if c not in self.known:
                if run < k:
                    ids += self._run(word[run:k])
                ids += [self.byte_ids[b] for b in c.encode()]
                run = k + 1
        if run < len(word):
            ids += self._run(word[run:])
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text, begin and end ids included, as little-endian unsigned 32-bit integers."""
        words, parts = self._words, [np.array([self.bos], "<u4").tobytes()]
        if text:
            for w in self._cut(SPACE + text.replace(" ", SPACE)):
                ids = words.get(w)
                if ids is None:
                    ids = self._word(w)
                    if len(w) < 64:
                        if len(words) >= MEMORY:
                            words.clear()
                        words[w] = ids
                parts.append(ids)
        parts.append(np.array([self.eos], "<u4").tobytes())
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids. Control ids give nothing; bytes that are no UTF-8 give U+FFFD each;
        the one space before the first piece goes. ValueError for an id outside the vocabulary."""
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and int(numbers.max()) >= self.size:
            raise ValueError(f"no piece has id {int(numbers.max())}")
        ends = np.flatnonzero((numbers == self.bos) | (numbers == self.eos)).tolist()
        runs, begin = [], 0
        for end in [*ends, len(numbers)]:  # bytes don't join over a control id
            if begin < end:
                runs.append("".join([self._texts[i] for i in numbers[begin:end].tolist()]))
                if len(runs) == 1 and int(numbers[begin]) in self.pieces and runs[0][:1] == " ":
                    runs[0] = runs[0][1:]
            begin = end + 1
        return "".join(r if _clean(r) else r.encode("utf-8", "surrogateescape").decode("utf-8", "lamina.bytewise") for r in runs)


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's ids.

    Returns id_col, n_tokens (begin and end ids count) and ids_le, the ids as little-endian unsigned
    32-bit integers in one binary. One row for each input row, repeated ids too; a null text is an
    empty one (begin and end id alone); other columns of docs don't matter. No shuffle.
    """
    kind = bounded_batches(docs).schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in slices(batches):
            packed = [model.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), binary_of(packed)], names=[id_col, "n_tokens", "ids_le"])

    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_le binary")


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids_le") -> DataFrame:
    """Texts of packed ids: id_col, n_tokens (null if the input has none), ids_le and decoded.
    Null ids are none and give an empty text. No shuffle."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in slices(batches):
            texts = [model.decode(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[id_col, "n_tokens", "ids_le", "decoded"])

    n = F.col("n_tokens") if "n_tokens" in encoded.columns else F.lit(None).cast("long")
    return encoded.select(id_col, n.alias("n_tokens"), F.coalesce(ids_col, F.lit(b"")).alias("ids_le")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_le binary, decoded string")


def unpacked(ids_le: str = "ids_le"):
    """A column of packed ids as array<int>, by SQL functions alone."""
    text = F.hex(ids_le)
    at = F.sequence(F.lit(0), F.shiftright(F.octet_length(ids_le), 2) - 1)
    one = lambda k: F.conv(F.concat(*[F.substring(text, (k * 8 + b).cast("int"), F.lit(2)) for b in (7, 5, 3, 1)]), 16, 10).cast("int")
    return F.when(F.octet_length(ids_le) >= 4, F.transform(at, one)).otherwise(F.array().cast("array<int>"))
