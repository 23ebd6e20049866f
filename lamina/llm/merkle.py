"""Merkle manifest of a data set: a digest tree for each group of rows, and one tree over the groups.

A tree's nodes stand at (tree, level, index); up to FANOUT neighbours make a run, and a run's digests in
order give the node above it. As the number of nodes of each level is known, so is the arity of each
run, the last one's too. A *forest* is a set of nodes whose runs aren't complete yet. Two forests add up
to the union of their nodes, in which each run that became complete gives way to its parent; this is
associative and commutative and the empty forest is neutral, so forests can be built anywhere and
added in any order:

1. leaves are range-partitioned by group and order; counts of the ranges give each leaf's index;
2. each range adds its leaves to a forest. What stays unresolved lies at the range's two ends: FANOUT - 1
   nodes for each level and end at most;
3. a tree reduction adds forests of neighbouring ranges, ARITY at once, until one is left: the root.
   Neighbours resolve most of each other's nodes, so a sum of many ranges is no larger than one range's
   forest;
4. each range gets the nodes next to its ends from the reduction and then has the whole path of each of
   its leaves: siblings on all levels, and the root folded from a leaf and its siblings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.ordering import numbered
from lamina.llm.common import broadcast_below, stored

FANOUT = 16
#: Forests that one task of the reduction adds.
ARITY = 16
#: The tree over the groups' roots.
TOP = -1
NODE = "tree long, level int, index long, size long, digest string"
_NAMES = ["tree", "level", "index", "size", "digest"]


def digest(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value that ends where its length says: `-` for null, else the UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


class Forest:
    """Unresolved nodes by run. `made` holds the nodes that sums brought about since it was cleared."""

    def __init__(self, trees: int):
        self.trees = trees
        self.runs: dict[tuple[int, int, int], tuple[int, dict[int, str]]] = {}
        self.made: list[tuple[int, int, int, int, str]] = []

    def add(self, tree: int, level: int, index: int, size: int, value: str) -> None:
        """Adds a node of a level of `size` nodes, and what becomes complete by it."""
        while True:
            if size == 1 and tree != TOP:
                tree, level, index, size = TOP, 0, tree, self.trees
                self.made.append((tree, level, index, size, value))
            run = index // FANOUT
            held = self.runs.setdefault((tree, level, run), (size, {}))[1]
            held[index] = value
            if size == 1 or len(held) < min(FANOUT, size - FANOUT * run):
                return
            del self.runs[tree, level, run]
            value = digest([held[i] for i in sorted(held)])
            level, index, size = level + 1, run, -(-size // FANOUT)
            self.made.append((tree, level, index, size, value))

    def nodes(self) -> list[tuple[int, int, int, int, str]]:
        return [(tree, level, i, size, value) for (tree, level, _), (size, held) in self.runs.items() for i, value in held.items()]


def _beside(tree: int, first: int, last: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """The nodes outside of first..last that their paths need: tree, level, index, size."""
    level = 0
    while size > 1:
        low, high = first - first % FANOUT, min(size, last - last % FANOUT + FANOUT)
        yield from ((tree, level, i, size) for i in (*range(low, first), *range(last + 1, high)))
        first, last, size, level = first // FANOUT, last // FANOUT, -(-size // FANOUT), level + 1


def _levels(tree: int, first: int, values: list[str], size: int, outer: dict[tuple[int, int, int], str]) -> tuple[list[tuple[int, list[str]]], str]:
    """Whole runs around the nodes from `first` on, level by level (index of the first, digests), and the tree's root."""
    out = []
    while size > 1:
        last = first + len(values) - 1
        low, high = first - first % FANOUT, min(size, last - last % FANOUT + FANOUT)
        row = [*(outer[tree, len(out), i] for i in range(low, first)), *values, *(outer[tree, len(out), i] for i in range(last + 1, high))]
        out.append((low, row))
        values = [digest(row[k : k + FANOUT]) for k in range(0, len(row), FANOUT)]
        first, size = low // FANOUT, -(-size // FANOUT)
    return out, values[0]


def _path(levels: list[tuple[int, list[str]]], index: int) -> list[tuple[list[str], list[str]]]:
    """Siblings to the left and right of a node and of each node above it."""
    out = []
    for low, row in levels:
        at = index - low
        run = at - at % FANOUT
        out.append((row[run:at], row[at + 1 : run + FANOUT]))
        index //= FANOUT
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)


_FRAGMENT = pa.schema([("range", pa.int64()), ("kind", pa.string()), ("tree", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("size", pa.int64()), ("digest", pa.string())])


def _fragments(trees: int):
    """Of leaves ordered by range, tree and index: each range's unresolved nodes (open) and the nodes that its
    paths need from elsewhere (need)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, spans, at = Forest(trees), {}, None

        def closed() -> pa.RecordBatch:
            rows = [(at, "open", *node) for node in forest.nodes()]
            ends = list(spans.items())
            for tree, (first, last, size) in dict([ends[0], ends[-1]]).items():
                rows += [(at, "need", *n, None) for n in _beside(tree, first, last, size)]
            rows += [(at, "need", *n, None) for n in _beside(TOP, min(spans), max(spans), trees)]
            return _batch(rows, _FRAGMENT)

        for batch in batches:
            for part, tree, first, size, leaf in zip(*(batch.column(n).to_pylist() for n in ("part", "tree", "first", "size", "leaf")), strict=True):
                if part != at:
                    if at is not None:
                        yield closed()
                    forest, spans, at = Forest(trees), {}, part
                begin, last, _ = spans.get(tree, (first, first - 1, size))
                spans[tree] = begin, last + 1, size
                forest.add(tree, 0, last + 1, size, leaf)
            forest.made.clear()
        if at is not None:
            yield closed()

    return run


def _sums(trees: int):
    """The sum of the forests of one group: its unresolved nodes (open) and those that it brought about (made)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        forest = Forest(trees)
        for node in zip(*(table.column(n).to_pylist() for n in _NAMES), strict=True):
            forest.add(*node)
        rows = [(key[0].as_py(), "open", *n) for n in forest.nodes()] + [(key[0].as_py(), "made", *n) for n in forest.made]
        return pa.Table.from_batches([_batch(rows, _FRAGMENT)])

    return run


@dataclass
class Manifest:
    """leaves: part (its range), tree, first (index of the range's first leaf of the tree), size (leaves of the
    tree), id, leaf, changed. nodes: what joins the ranges. beside: the nodes that a range's paths need."""

    leaves: DataFrame
    trees: int
    nodes: DataFrame
    beside: DataFrame
    root: str | None


def build_manifest(leaves: DataFrame, id_col: str = "doc_id", group_col: str = "source", leaf_col: str = "leaf", changed_col: str | None = None) -> Manifest:
    """The manifest of leaves (digests as hex text): groups in the order of their names (null first, bytewise), leaves in the
    order of id, then of digest, so rows that share an id, or are alike, have a place of their own.

    changed_col: digests that proofs() folds instead of the leaves where not null. Null ids come first.
    A table without rows has no root. Other columns don't matter.
    """
    changed = F.col(changed_col) if changed_col else F.lit(None)
    rows = leaves.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), F.col(leaf_col).alias("leaf"), changed.cast("string").alias("changed"))
    order = [F.col(c).asc_nulls_first() for c in ("group", "id", "leaf")]
    rows = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "leaves")
    counts = stored(rows.groupBy("group", "part").agg(F.count("*").alias("n")), "ranges")
    by_group = Window.partitionBy("group")
    before = F.coalesce(F.sum("n").over(by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.select("group", "part", before.alias("first"), F.sum("n").over(by_group).alias("size"))
    trees = stored(numbered(counts.select("group").distinct(), F.col("group").asc_nulls_first(), name="tree"), "trees")
    n_trees, n_parts = trees.count(), counts.agg(F.max("part")).first()[0]
    spans = spans.join(broadcast_below(trees.withColumnRenamed("group", "g"), 200_000), F.col("group").eqNullSafe(F.col("g"))).select("group", "part", "first", "size", "tree")
    s = broadcast_below(stored(spans.withColumnRenamed("part", "p").withColumnRenamed("group", "g"), "spans"), 200_000)
    rows = rows.join(s, (F.col("part") == F.col("p")) & F.col("group").eqNullSafe(F.col("g"))).select("part", "tree", "first", "size", "id", "leaf", "changed")
    if n_parts is None:
        empty = rows.sparkSession.createDataFrame([], f"range long, kind string, {NODE}")
        return Manifest(rows, 0, empty, empty, None)

    fragment = "range long, kind string, " + NODE
    found = rows.repartitionByRange(n_parts + 1, "part").sortWithinPartitions("part", "tree", "id", "leaf").select("part", "tree", "first", "size", "leaf").mapInArrow(_fragments(n_trees), fragment)
    found = stored(found, "forests")
    needs, forests = found.where("kind = 'need'"), found.where("kind = 'open'")
    nodes, left = forests, n_parts + 1
    while True:
        left = -(-left // ARITY)
        summed = forests.select(F.expr(f"range div {ARITY}").alias("of"), *_NAMES).groupBy("of").applyInArrow(_sums(n_trees), fragment)
        summed = stored(summed, "forests")
        nodes = nodes.unionByName(summed.where("kind = 'made'"))
        forests = summed.where("kind = 'open'")
        if left == 1:
            break
    root = forests.first()
    if root["size"] != 1 or root["tree"] != TOP:
        raise RuntimeError("a run of the manifest is not complete")
    known = broadcast_below(stored(nodes.select("tree", "level", "index", "digest").distinct(), "nodes"), 200_000)
    beside = needs.drop("digest", "kind").join(known, ["tree", "level", "index"]).select("range", *_NAMES)
    return Manifest(rows, n_trees, nodes, beside, root["digest"])


def proofs(manifest: Manifest, id_name: str = "doc_id") -> DataFrame:
    """id, leaf, subroot (of the group's tree), root, siblings (of the leaf and of each node above it, from the leaf to
    the root, left to right, joined), proof_sha256 (of these), folded_root (from `changed`, else the leaf, and the siblings),
    verified (whether that is the root)."""
    kind = manifest.leaves.schema["id"].dataType.simpleString()
    trees, root = manifest.trees, manifest.root
    if root is None:
        return manifest.leaves.sparkSession.createDataFrame([], f"`{id_name}` {kind}, leaf string, subroot string, root string, siblings string, proof_sha256 string, folded_root string, verified boolean")
    names = ["id", "leaf", "subroot", "siblings", "proof_sha256", "folded_root"]

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, outer, held, rows = None, {}, {}, []

        def closed() -> Iterator[pa.RecordBatch]:
            paths = {tree: _levels(tree, first, [r[1] for r in rows], size, outer) for tree, (first, size, rows) in held.items()}
            above, _ = _levels(TOP, min(paths), [paths[t][1] for t in sorted(paths)], trees, outer)
            out = []
            for tree, (first, _, rows) in held.items():
                levels, subroot = paths[tree]
                over, upper, text = None, [], ""
                for index, (id_, leaf, changed) in enumerate(rows, first):
                    if index // FANOUT != over:
                        over = index // FANOUT
                        upper = _path(levels[1:], over) + _path(above, tree)
                        text = "".join(d for sides in upper for side in sides for d in side)
                    path = _path(levels[:1], index) + upper if levels else upper
                    siblings = "".join([*path[0][0], *path[0][1], text]) if levels else text
                    folded = leaf if changed is None else changed
                    for left, right in path:
                        folded = digest([*left, folded, *right])
                    out.append((id_, leaf, subroot, siblings, sha256(siblings.encode()).hexdigest(), folded))
                    if len(out) == 512:
                        yield flushed(out)
                        out = []
            if out:
                yield flushed(out)

        def flushed(out: list[tuple]) -> pa.RecordBatch:
            ids, *texts = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(t, pa.string()) for t in texts)], names=names)

        for batch in batches:
            id_type = batch.schema.field("id").type
            for part, tree, level, index, size, value, id_, leaf, changed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    if held:
                        yield from closed()
                    at, outer, held = part, {}, {}
                if level is not None:
                    outer[tree, level, index] = value
                else:
                    held.setdefault(tree, (index, size, []))[2].append((id_, leaf, changed))
        if held:
            yield from closed()

    no = F.lit(None)
    inner = manifest.leaves.select("part", "tree", no.cast("int").alias("level"), F.col("first").alias("index"), "size", no.cast("string").alias("digest"), "id", "leaf", "changed")
    outer = manifest.beside.select(F.col("range").cast("int").alias("part"), "tree", "level", "index", "size", "digest", no.cast(kind).alias("id"), no.cast("string").alias("leaf"), no.cast("string").alias("changed"))
    n = manifest.leaves.select(F.max("part")).first()[0] + 1
    both = inner.unionByName(outer).repartitionByRange(n, "part")
    both = both.sortWithinPartitions("part", F.col("level").desc_nulls_last(), "tree", "id", "leaf")
    out = both.mapInArrow(prove, f"id {kind}, leaf string, subroot string, siblings string, proof_sha256 string, folded_root string")
    out = out.select(F.col("id").alias(id_name), "leaf", "subroot", F.lit(root).alias("root"), "siblings", "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))
    return out


def document_manifest(docs: DataFrame, changed_text: Column | None = None) -> Manifest:
    """The manifest of documents: H(doc_id, source, lang, n_chars, text) by source. changed_text: the text to fold
    instead, null where the row is as it was; a null text stays null, so it gives the leaf itself.

    Null values have a mark of their own, so an empty text and a null text differ."""
    keys = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(changed_text.isNotNull(), leaf_digest(*keys, changed_text)) if changed_text is not None else F.lit(None)
    leaves = docs.select("doc_id", "source", leaf_digest(*keys, F.col("text")).alias("leaf"), changed.alias("changed"))
    return build_manifest(leaves, changed_col="changed")
