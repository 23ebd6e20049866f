"""Exact top-k inner products by ball trees.

Space is halved by cuts learned from a bounded sample, so that near rows share a cell. A cell is a ball
around a fixed centre that holds all its rows; cells of many rows are dealt to shards of a bounded size,
each of which is a ball tree. A query first searches one shard of the cell with the highest upper bound
|q| * radius + q . centre, and then all cells whose bound reaches the kth score found there. Within a
shard nodes come in the order of their bound, and the kth score so far is shared by all. What is at
least as good as the kth is kept, and a window merges the shards' lists.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import slices, stored

LEAF = 128
#: Rows of a shard, which a task holds as one tree, and queries that pass by it in one task.
SHARD_ROWS, BLOCK_ROWS = 8192, 1 << 16
#: Rows from which cuts are learned, and cells of a dimension at most: tasks get a table of their centres.
SAMPLE, MOST_CELLS = 1 << 13, 1024
#: Below this all products and sums are whole numbers that float64 holds exactly.
EXACT = float(1 << 53)


class BallTree:
    """Ball tree over whole-number vectors (as float64)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order, self.nodes = np.arange(len(ids)), []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            part = rows[order[lo:hi]]
            centre = part.mean(axis=0)
            radius = float(np.sqrt(((part - centre) ** 2).sum(axis=1).max()))
            self.nodes.append([centre, radius, lo, hi, -1, -1])
            if parent >= 0:
                self.nodes[parent][4 + side] = len(self.nodes) - 1
            if hi - lo > LEAF and radius > 0:
                axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(part[:, axis], mid)]
                me = len(self.nodes) - 1
                todo += [(lo, lo + mid, me, 0), (lo + mid, hi, me, 1)]
        self.ids, self.rows, self._whole = ids[order], rows[order], None
        self.norm, self.most = float(np.sqrt((rows**2).sum(axis=1).max())), float(np.abs(rows).max(initial=0))
        self.centres = np.array([n[0] for n in self.nodes])
        self.radii = np.array([n[1] for n in self.nodes])

    def scores(self, lo: int, hi: int, q: np.ndarray) -> np.ndarray:
        if len(q) * self.most * float(np.abs(q).max(initial=0)) < EXACT:
            return self.rows[lo:hi] @ q
        if self._whole is None:
            self._whole = np.array([[int(x) for x in r] for r in self.rows.tolist()], dtype=object).reshape(self.rows.shape)
        return self._whole[lo:hi] @ np.array([int(x) for x in q.tolist()], dtype=object)

    def search(self, query_id: int, q: np.ndarray, k: int, least: float) -> list[tuple[int, int]]:
        """The k best (score, id) with a score of `least` at least; of equal scores the smaller ids."""
        bounds = upper_bounds(q[None], self.centres, self.radii, self.norm)[0]
        queue, best, kth = [(-bounds[0], 0)], [], least
        while queue and -queue[0][0] >= kth:
            _, at = heapq.heappop(queue)
            _, _, lo, hi, left, right = self.nodes[at]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= kth:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            scores = self.scores(lo, hi, q)
            for j in np.flatnonzero(scores >= kth).tolist():
                i = int(self.ids[lo + j])
                if i != query_id:
                    item = (int(scores[j]), -i)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            if len(best) == k:
                kth = max(kth, best[0][0])
        return [(s, -i) for s, i in best]


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray, norm: float) -> np.ndarray:
    """For each query and ball no less than any inner product with a row there; norm: of the longest row."""
    size = np.sqrt((queries**2).sum(axis=1))
    slack = 1e-9 * (size * norm + 1) * queries.shape[1]  # bounds are rounded, scores are not
    return queries @ centres.T + size[:, None] * radii + slack[:, None]


@dataclass(frozen=True)
class Cells:
    """Cuts of a space in the order of a heap (1 the first, 2i and 2i + 1 below i), and the cells' centres."""

    axis: np.ndarray
    cut: np.ndarray
    centres: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray, rows: int) -> Cells:
        n = 1
        while 2 * n <= min(MOST_CELLS, rows // SHARD_ROWS, len(sample) // 16):
            n *= 2
        axis, cut, parts = np.zeros(n, np.int64), np.zeros(n), {1: sample}
        for at in range(1, n):
            part = parts.pop(at)
            axis[at] = np.argmax(part.max(axis=0) - part.min(axis=0)) if len(part) else 0
            cut[at] = np.median(part[:, axis[at]]) if len(part) else 0.0
            up = part[:, axis[at]] > cut[at]
            parts[2 * at], parts[2 * at + 1] = part[~up], part[up]
        zero = np.zeros(sample.shape[1])
        return cls(axis, cut, np.array([parts[at].mean(axis=0) if len(parts[at]) else zero for at in range(n, 2 * n)]))

    def find(self, rows: np.ndarray) -> np.ndarray:
        at = np.ones(len(rows), np.int64)
        while len(at) and at[0] < len(self.centres):
            at = 2 * at + (rows[np.arange(len(rows)), self.axis[at]] > self.cut[at])
        return at - len(self.centres)


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """id_col and v, an array of floor(scale * x) as double. Rows whose id or vector is null, or that
    hold a null or non-finite component, are left out."""
    x = lambda c: c.cast("double")
    ok = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")))
    floor = lambda c: F.rint((x(c) * scale) - F.lit(0.5))
    # floor() would turn large values into longs; this keeps doubles
    down = lambda c: F.when(floor(c) > x(c) * scale, floor(c) - 1).when(floor(c) + 1 <= x(c) * scale, floor(c) + 1).otherwise(floor(c))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(vector_col, down).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _of_each_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """For each query (id, v) the k rows of vectors (id, v; whole numbers as doubles) with the highest
    inner product, the query's own id left out, ties to the smaller id.

    Returns query_id, rank (from 1), vec_id and score (long). Fewer than k rows give fewer results.
    Only vectors of equal length are compared. Ids are to be distinct; a repeated id is a row of its
    own. An OverflowError is raised if a score doesn't fit a long.
    """
    if k < 1:
        raise ValueError("k is to be 1 or more")
    spark = vectors.sparkSession
    vectors, queries = (df.select(F.col("id").cast("long").alias("id"), "v", F.size("v").alias("dim")) for df in (vectors, queries))
    counts = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).toLocalIterator()}
    queries = stored(queries, "queries")
    blocks = -(-queries.count() // BLOCK_ROWS)
    if not counts or not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample: dict[int, list] = {d: [] for d in counts}
    for r in vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toLocalIterator():
        sample[r["dim"]].append(r["v"])
    cells = {d: Cells.of(np.array(rows, np.float64).reshape(len(rows), d), counts[d]) for d, rows in sample.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for dim, part in _of_each_dim(batch):
                rows = _matrix(part.column("v"), dim)
                cell = cells[dim].find(rows)
                far = np.sqrt(((rows - cells[dim].centres[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(far), pa.array(np.sqrt((rows**2).sum(axis=1)))], names=[*part.schema.names, "cell", "far", "norm"])

    vectors = stored(vectors.mapInArrow(deal, "id long, v array<double>, dim int, cell int, far double, norm double"), "dealt-vectors")
    parts = vectors.groupBy("dim", "cell").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("parts"), F.max("far").alias("far"), F.max("norm").alias("norm"))
    parts = stored(parts, "cells")  # MOST_CELLS rows for each dimension
    balls: dict[int, tuple] = {}
    for r in parts.orderBy("dim", "cell").toLocalIterator():
        at, radius, norm = balls.setdefault(r["dim"], ([], [], []))
        at.append(r["cell"])
        radius.append(r["far"])
        norm.append(r["norm"])
    balls = {d: (np.array(at), cells[d].centres[at], np.array(radius), max(norm)) for d, (at, radius, norm) in balls.items()}

    def visits(every: bool):
        """Of each query its best cell, or all cells that its kth score so far leaves, with the best as home."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                for dim, part in _of_each_dim(batch):
                    if dim not in balls:
                        continue
                    at, centres, radii, norm = balls[dim]
                    bounds = upper_bounds(_matrix(part.column("v"), dim), centres, radii, norm)
                    home = bounds.argmax(axis=1)
                    if every:
                        least = part.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                        who, cell = np.nonzero(~(bounds < least[:, None]))
                    else:
                        who, cell = np.arange(len(home)), home
                    rows = part.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("v"), rows.column("dim"), rows.column("least"), pa.array(at[cell].astype(np.int32)), pa.array(cell == home[who])], names=["id", "v", "dim", "least", "cell", "home"])

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of shards, in each the vectors before the queries."""
        shard, held, tree = None, [], None
        for batch in slices(batches):
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("dim", "cell", "part", "block", "asks")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            out: list[tuple[int, int, int]] = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part, key = batch.slice(lo, hi - lo), keys[lo].tolist()
                ids, rows = part.column("id").to_numpy(), _matrix(part.column("v"), key[0])
                if key[:4] != shard:
                    shard, held, tree = key[:4], [], None
                if not key[4]:
                    held.append((ids, rows))
                elif held or tree:
                    if tree is None:
                        tree, held = BallTree(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])), []
                    least = part.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                    for i, q, kth in zip(ids.tolist(), rows, np.where(np.isnan(least), -np.inf, least).tolist(), strict=True):
                        out += [(i, j, s) for s, j in tree.search(i, q, k, kth)]
            if out and max(abs(s) for _, _, s in out) >> 63:
                raise OverflowError("a score doesn't fit a long")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 3)], names=["query_id", "vec_id", "score"])

    dealt = vectors.join(F.broadcast(parts.select("dim", "cell", "parts")), ["dim", "cell"])
    dealt = dealt.select("id", "v", F.lit(None).cast("double").alias("least"), "dim", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("asks"))

    def searched(asked: DataFrame, every: bool) -> DataFrame:
        asked = asked.mapInArrow(visits(every), "id long, v array<double>, dim int, least double, cell int, home boolean")
        asked = asked.join(F.broadcast(parts.select("dim", "cell", "parts")), ["dim", "cell"])
        own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int")
        if every:
            asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where(~F.col("home") | (F.col("part") != own))
        else:
            asked = asked.withColumn("part", own)
        asked = asked.select("id", "v", "least", "dim", "cell", "part", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("asks"))
        place = ["dim", "cell", "part", "block"]
        used = dealt.join(asked.select(*place).distinct(), place, "left_semi") if not every else dealt
        return used.unionByName(asked).repartition(*place).sortWithinPartitions(*place, "asks").mapInArrow(search, "query_id long, vec_id long, score long")

    first = stored(searched(queries.withColumn("least", F.lit(None).cast("double")), False), "first-shard")
    least = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") >= k)
    rest = searched(queries.join(least.select(F.col("query_id").alias("id"), "least"), "id", "left"), True)
    # a shard's list has k rows at most, so a query's group has k times the number of shards
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
