"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shapes of its own text and of the lines next to it; the
chain's forward-backward marginals, weighted by line length, add up to the document's score, which a
logistic curve fitted on the same documents sets on the scale of the labels. Labels are of documents, so
the lines' own are latent: a good document is one in which good lines make up SHARE of the length at
least, a bad one has that of bad lines, and expectation maximisation finds the likeliest lines under
that. The fit runs on the driver over line features (never texts) of at most `sample` labelled documents
with at most SAMPLE_LINES lines each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import bounded_batches, slices, utf8

#: Labelled documents that a fit reads at most; which ones, a hash of the id says.
SAMPLE = 4000
#: Lines in a row that a fit takes of a document; of longer ones a hash of the text says which.
SAMPLE_LINES = 400
#: Share of a document's length that lines of its label have at least.
SHARE = 0.8
#: Lines, with those that fill up shorter texts, of the texts that are taken together.
CELLS = 1 << 15

_KINDS = 8  # of bytes
_KIND = np.full(256, 7, np.uint8)  # 7: part of a character outside ASCII
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"!", b".,;:?'\"-()")):
    _KIND[list(_chars)] = _k
_KIND[[b for b in range(128) if _KIND[b] == 7]] = 6  # 6: other signs

FEATURES = _KINDS + 13


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and the number of lines of each text (1 at least)."""
    rows, lengths, counts = [], [], []
    for text in texts:
        lines = text.split(b"\n")
        kinds = _KIND[np.frombuffer(text + b"\n", np.uint8)]
        ends = np.cumsum([len(x) + 1 for x in lines])
        starts = ends - [len(x) + 1 for x in lines]
        n = (ends - starts - 1).astype(np.float64)
        share = np.empty((len(lines), FEATURES), np.float32)
        for k in range(_KINDS):
            share[:, k] = np.add.reduceat(kinds == k, starts, dtype=np.int64)
        share[:, 6] -= 1  # the line break
        share[:, :_KINDS] /= np.maximum(n, 1)[:, None]
        seen: set[bytes] = set()
        for i, line in enumerate(lines):
            words = line.split()
            w, own = len(words), share[i]
            distinct = len(set(words))
            own[_KINDS:] = (
                np.log1p(n[i]),
                np.log1p(w),
                n[i] / (w + 1) / 10,
                distinct / w if w else 1,
                w > 0 and line[:1].isupper(),
                line[-1:] in b".!?" and n[i] > 0,
                w == 0,
                line in seen and w > 0,
                sum(map(bytes.isupper, words)) / w if w else 0,
                max(map(len, words)) / 40 if w else 0,
                line.count(b".") / (w + 1),
                line.count(b"|") / (w + 1),
                line.count(b"http") / (w + 1),
            )
            seen.add(line)
        rows.append(share)
        lengths.append(n)
        counts.append(len(lines))
    if not rows:
        return np.empty((0, FEATURES), np.float32), np.empty(0), np.empty(0, int)
    return np.concatenate(rows), np.concatenate(lengths), np.array(counts)


def _with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features, then: is first, is last, 1."""
    n = len(own)
    ends = np.cumsum(counts)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[ends - counts], last[ends - 1] = True, True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.column_stack([own, before, after, first, last, np.ones(n)])


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(node: np.ndarray, counts: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and of every line but a text's first the 2x2 probabilities of its and the
    line before's labels. node: log odds of good; edge[a, b]: score of label b after a. Texts are taken
    together in the order of their length."""
    good, pair = np.empty(len(node)), np.zeros((len(node), 2, 2))
    starts = np.cumsum(counts) - counts
    order = np.argsort(counts, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * counts[order[hi]] <= CELLS:
            hi += 1
        docs, lo = order[lo:hi], hi
        longest = int(counts[docs].max())
        at = starts[docs][:, None] + np.arange(longest)
        there = np.arange(longest) < counts[docs][:, None]
        at = np.where(there, at, 0)
        e = np.where(there, node[at], 0.0)
        ahead = np.zeros((len(docs), longest, 2))
        ahead[:, 0, 1] = e[:, 0]
        for t in range(1, longest):
            p = ahead[:, t - 1]
            ahead[:, t, 0] = _log_add(p[:, 0] + edge[0, 0], p[:, 1] + edge[1, 0])
            ahead[:, t, 1] = _log_add(p[:, 0] + edge[0, 1], p[:, 1] + edge[1, 1]) + e[:, t]
        back = np.zeros((len(docs), longest, 2))
        for t in range(longest - 2, -1, -1):
            q = back[:, t + 1] + np.stack([np.zeros(len(docs)), e[:, t + 1]], 1)
            new = np.stack([_log_add(edge[a, 0] + q[:, 0], edge[a, 1] + q[:, 1]) for a in (0, 1)], 1)
            back[:, t] = np.where(there[:, t + 1][:, None], new, 0.0)
        both = ahead + back
        total = _log_add(both[..., 0], both[..., 1])
        good[at[there]] = np.exp(both[..., 1] - total)[there]
        if longest > 1:
            emit = np.stack([np.zeros_like(e), e], 2)
            joint = ahead[:, :-1, :, None] + edge + (back + emit)[:, 1:, None, :] - total[:, 1:, None, None]
            keep = there[:, 1:]
            pair[at[:, 1:][keep]] = np.exp(joint)[keep]
    return good, pair


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edge: np.ndarray
    curve: tuple[float, float]

    def lines(self, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = _with_neighbours((own - self.mean) / self.scale, counts)
        return marginals(x @ self.weights, counts, self.edge)[0]

    def mixed(self, good: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Length-weighted means, as log odds."""
        starts = np.cumsum(counts) - counts
        weight = lengths + 1.0
        share = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
        share = np.clip(share, 1e-6, 1 - 1e-6)
        return np.log(share / (1 - share))

    def documents(self, good: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return np.round(1 / (1 + np.exp(-np.clip(a * self.mixed(good, lengths, counts) + b, -30, 30))), 12)


def given_labels(node: np.ndarray, counts: np.ndarray, edge: np.ndarray, weight: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `marginals`, given the documents' labels: where the expected share of lines of a document's
    label is below SHARE, the same odds are added to all its lines until it isn't."""
    starts = np.cumsum(counts) - counts
    toward = np.where(labels > 0.5, 1.0, -1.0)

    def enough(good: np.ndarray) -> np.ndarray:
        share = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
        return np.where(labels > 0.5, share, 1 - share) >= SHARE

    low, high = np.zeros(len(counts)), np.full(len(counts), 16.0)
    high[enough(marginals(node, counts, edge)[0])] = 0.0
    for _ in range(7):
        mid = (low + high) / 2
        fine = enough(marginals(node + np.repeat(mid * toward, counts), counts, edge)[0])
        low, high = np.where(fine, low, mid), np.where(fine, mid, high)
    return marginals(node + np.repeat(high * toward, counts), counts, edge)


def fit(own: np.ndarray, lengths: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: tuple[int, ...] = (70, 20, 20, 30), penalty: float = 1e-3) -> QualityModel:
    """Maximum likelihood with a quadratic penalty, by Adam, in rounds of so many steps: in the first one
    all lines have their document's label, in the others the labels expected by the round before. The first
    learns from lines' own features alone, as neighbours would only tell it which document a line is in.
    A document of n lines weighs as the root of n. Without documents every score is 0.5."""
    width = 3 * FEATURES + 3
    mean, scale = np.zeros(FEATURES), np.ones(FEATURES)
    theta = np.zeros(width + 4)
    if len(labels):
        mean, scale = own.mean(axis=0).astype(float), own.std(axis=0).astype(float) + 1e-3
        x = _with_neighbours((own - mean) / scale, counts)
        y = np.repeat(labels, counts).astype(float)
        weight = np.repeat(1 / np.sqrt(counts), counts)
        inner = np.ones(len(y), bool)
        inner[np.cumsum(counts) - counts] = False
        both = np.zeros((len(y), 2, 2))
        both[np.arange(len(y)), y.astype(int), y.astype(int)] = 1
        m, v, step = np.zeros_like(theta), np.zeros_like(theta), 0
        alone = np.zeros(width + 4)
        alone[:FEATURES] = alone[width - 1] = 1
        for k, steps in enumerate(rounds):
            if k:
                y, both = given_labels(x @ theta[:width], counts, theta[width:].reshape(2, 2), lengths + 1.0, labels)
            for _ in range(steps):
                step += 1
                good, pair = marginals(x @ theta[:width], counts, theta[width:].reshape(2, 2))
                edges = ((both - pair) * (weight * inner)[:, None, None]).sum(axis=0).ravel()
                slope = np.concatenate([x.T @ ((y - good) * weight), edges]) / len(labels) - penalty * theta
                slope = slope if k else slope * alone
                m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
                theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    model = QualityModel(mean, scale, theta[:width], theta[width:].reshape(2, 2), (1.0, 0.0))
    if len(labels):
        z, a, b = model.mixed(model.lines(own, counts), lengths, counts), 1.0, 0.0
        for _ in range(50):  # Newton's steps
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            r, d = labels - p, p * (1 - p) + 1e-6
            h = np.array([[(d * z * z).sum() + 1, (d * z).sum()], [(d * z).sum(), d.sum() + 1e-3]])
            da, db = np.linalg.solve(h, [(r * z).sum() - (a - 1), r.sum()])
            a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
        model = QualityModel(model.mean, model.scale, model.weights, model.edge, (max(float(a), 1e-3), float(b)))
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Fits on the documents of `docs` that `labels` (id_col, label_col 0 or 1) marks.

    Null labels don't count; of several labels of one id the rounded mean holds; of several texts of one
    id one takes part. Only ids, labels and texts are read, and only texts become features.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    few = marked.orderBy(F.xxhash64("id"), "id").limit(sample)  # at most `sample` rows, so fit to broadcast
    texts = bounded_batches(docs).select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).join(F.broadcast(few), "id").select("id", "y", "text")
    kind = texts.schema["id"].dataType.simpleString()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own, lengths, counts = line_features(batch.column(2).to_pylist())
            ends = np.cumsum(counts)
            begin = ends - counts + np.array([zlib.crc32(t) for t in batch.column(2).to_pylist()]) % -(-counts // SAMPLE_LINES) * SAMPLE_LINES
            cut = list(zip(begin.tolist(), np.minimum(begin + SAMPLE_LINES, ends).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([own[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([lengths[a:b].tobytes() for a, b in cut], pa.binary())], names=["id", "y", "own", "lengths"])

    rows = texts.mapInArrow(features, f"id {kind}, y int, own binary, lengths binary")
    rows = rows.groupBy("id").agg(F.min(F.struct("own", "y", "lengths")).alias("r")).select("r.*", "id").orderBy("id").collect()
    lengths = [np.frombuffer(r["lengths"]) for r in rows]
    own = [np.frombuffer(r["own"], np.float32).reshape(-1, FEATURES) for r in rows]
    none = line_features([])
    return fit(np.concatenate(own) if own else none[0], np.concatenate(lengths) if own else none[1], np.array([len(x) for x in lengths], int), np.array([r["y"] for r in rows], float))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (0 to 1), n_lines and bad_lines (lines that are likelier bad than good) of every
    whole text. One row for each input row, repeated ids too. A null text is an empty one; an empty
    text is one empty line and gets a score as well. Other columns of docs don't matter. No shuffle.
    """
    kind = bounded_batches(docs).schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own, lengths, counts = line_features(batch.column(1).to_pylist())
            good = model.lines(own, counts)
            bad = np.add.reduceat(good < 0.5, np.cumsum(counts) - counts, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.documents(good, lengths, counts)), pa.array(counts, pa.int64()), pa.array(bad, pa.int64())], names=[id_col, "score", "n_lines", "bad_lines"])

    return docs.select(id_col, utf8(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double, n_lines long, bad_lines long")


def label_lines(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line's label: id_col, line (from 0), n_bytes and p_good. Nulls and empty texts as in `score_quality`."""
    kind = bounded_batches(docs).schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own, lengths, counts = line_features(batch.column(1).to_pylist())
            lines = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(lines, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(model.lines(own, counts))], names=[id_col, "line", "n_bytes", "p_good"])

    return docs.select(id_col, utf8(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, line long, n_bytes long, p_good double")


def training_part(id_col: str = "doc_id"):
    """Whether a row may be learned from: crc32 of the id as text, modulo 3, isn't 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1
