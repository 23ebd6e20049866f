"""Jaccard similarity join of word shingle sets by PartEnum signatures.

Sets are dealt to size bands. Within a band, sets that are similar enough differ in at most k elements.
The domain is cut by a hash into n1 partitions, of which at least one then holds two differences at
most; that partition is cut into four again, and for each two of these a signature hashes what a set
has there. One of them is equal for both sets. A set also gets the signatures of
each band above that a similar set may be in. Where a signature would be of nothing, the set gets those
of another cut as well; so does a similar set, for which it is of nothing too. The last cut's empty parts
count, so none is lost. Sets of more than `few_cuts` partitions leave empty parts out at once: a pair would be
lost only if all of its many equal parts were empty, which hashes give less than once in 10^15 pairs (the
tests have the sum), more seldom than two shingles share a hash.

Equal sets are one node, by 123 bits of hashes. In each group of nodes that share a signature all are
compared with one of them, the hub, so a group of m gives m - 1 candidates. The hub is the node of whose
signatures the largest share is shared at all: what others were copied from, rather than a copy with
changes. Only nodes that share a signature and are not connected yet are compared with each other after
that, in groups of at most MANY. Larger groups come of text that many documents have in common; their
nodes are cut a second time: a similar pair shares one of its rarest elements, and not too far back in
either's order of rarity, so pairs meet at these alone. The parity of a set's elements in each of 1,024
parts of the domain is a lower bound of differences; as a join condition it drops nearly all false
candidates before they are rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm import windows
from lamina.llm.common import binary_of, bounded_batches, slices, stored, utf8
from lamina.llm.components import components
from lamina.llm.substrings import bit_table, passing

#: Width of a size band.
RATIO = 1.25
#: A partition's parts, and how many of them may differ.
PARTS, DIFFER = 4, 2
SUBSETS = tuple(combinations(range(PARTS), PARTS - DIFFER))
CUTS = 4
#: Nodes that share a signature and are all compared with each other.
MANY = 4096
#: 64-bit words of a sketch.
SKETCH = 16
SALTS = 32


def few_cuts(percent: int) -> int:
    """So many partitions at most need another cut where a part is empty."""
    return 40 if percent >= 80 else 256


@lru_cache(maxsize=8)
def bands(percent: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowest size, highest size and number of partitions of each band up to the size `most`."""
    low, high, cuts = [], [], []
    at = 1
    while at <= most:
        top = max(at, int(at * RATIO))
        low.append(at)
        high.append(top)
        # sets of sizes a, b differ in (100 - p) / (100 + p) of a + b at most
        k = (100 - percent) * 2 * top // (100 + percent)
        cuts.append(-(-(k + 1) // (DIFFER + 1)) if k else 0)
        at = top + 1
    return np.array(low), np.array(high), np.array(cuts)


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-word shingles of all texts in a row, sorted within each text, and the
    size of each set. A text of fewer words is one shingle; one without words has none."""
    hashes, counts, _ = windows.word_hashes(texts, lower=True)
    text, place = windows.places(counts)
    runs = windows.run_hashes(hashes, n)
    keep = counts[text[: len(runs)]] - place[: len(runs)] >= n
    owner, value = text[: len(runs)][keep], runs[keep]
    ends = np.cumsum(counts)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = [windows.run_hashes(hashes[ends[i] - counts[i] : ends[i]], int(counts[i]))[0] for i in short]
        owner, value = np.concatenate([owner, short]), np.concatenate([value, np.array(whole, np.uint64)])
    by = np.lexsort((value, owner))
    owner, value = owner[by], value[by]
    new = np.ones(len(by), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(owner[new], minlength=len(texts))


def fingerprints(values: np.ndarray, sizes: np.ndarray, seed: int = 0xF1) -> np.ndarray:
    """A hash of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(windows.mixed(values ^ np.uint64(seed)), dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return windows.mixed(total[ends] - total[ends - sizes] + sizes.astype(np.uint64))


def signatures(values: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets, and whose each is."""
    none, few = (np.empty(0, np.uint64), np.empty(0, np.int64)), few_cuts(percent)
    if not len(values):
        return none
    low, _, cuts = bands(percent, 1 << int(sizes.max() * 200 // percent).bit_length())
    starts = np.cumsum(sizes) - sizes
    own = np.searchsorted(low, sizes, side="right") - 1
    whose, band = np.arange(len(sizes))[sizes > 0], own[sizes > 0]
    # also every band above that a similar set may be in
    up, above = whose, band
    while len(up):
        near = 100 * sizes[up] >= percent * low[above + 1]
        up, above = up[near], above[near] + 1
        whose, band = np.concatenate([whose, up]), np.concatenate([band, above])
    out_sig, out_set = [], []
    for cut in range(CUTS):
        n1 = cuts[band]
        exact = n1 == 0  # no difference is allowed: the set itself
        if exact.any() and cut == 0:
            out_sig.append(windows.mixed(fingerprints(values, sizes)[whose[exact]] + band[exact].astype(np.uint64)))
            out_set.append(whose[exact])
        whose, band, n1 = whose[~exact], band[~exact], n1[~exact]
        if not len(whose):
            break
        n = sizes[whose]
        pair = np.repeat(np.arange(len(whose)), n)
        element = values[np.repeat(starts[whose] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        first = np.cumsum(n1) - n1
        where = windows.mixed(element + np.uint64(0x51ED + 977 * cut)) % (n1[pair] * PARTS).astype(np.uint64)
        cell = first[pair] * PARTS + where.astype(np.int64)
        cells = int(n1.sum()) * PARTS
        total, filled = np.zeros(cells, np.uint64), np.bincount(cell, minlength=cells).reshape(-1, PARTS)
        np.add.at(total, cell, windows.mixed(element ^ np.uint64(0xA5A5)))
        total = total.reshape(-1, PARTS)
        part_of = np.repeat(np.arange(len(whose)), n1)
        salt = ((band[part_of] * 64 + cut).astype(np.uint64) << np.uint64(32)) + (np.arange(len(part_of)) - first[part_of]).astype(np.uint64)
        empty = np.zeros(len(whose), bool)
        for k, subset in enumerate(SUBSETS):
            inside = sum(total[:, j] * np.uint64(2 * j + 1) for j in subset)
            some = sum(filled[:, j] for j in subset) > 0
            empty[part_of[~some]] = True
            use = some | (cut == CUTS - 1) & (n1[part_of] <= few)
            out_sig.append(windows.mixed(windows.mixed(salt[use] * np.uint64(len(SUBSETS)) + np.uint64(k)) + inside[use]))
            out_set.append(whose[part_of[use]])
        again = empty & (n1 <= few)
        whose, band = whose[again], band[again]
    return (np.concatenate(out_sig), np.concatenate(out_set)) if out_sig else none


def sketches(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each set a bit for each part of the domain: whether the number of its elements there is odd."""
    bits = SKETCH * 64
    cell = np.repeat(np.arange(len(sizes)), sizes) * bits + (windows.mixed(values ^ np.uint64(0xC0)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(cell, minlength=len(sizes) * bits) & 1).astype(np.uint8).reshape(-1, bits)
    return np.packbits(odd, axis=1).view(np.int64).reshape(-1, SKETCH)


def node_ids(values: np.ndarray, sizes: np.ndarray, owner: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A hash of each set, preceded by what share of its signatures is not shared (in sixteenths), so the
    smallest of a group is the best hub; and that with 64 more bits, which names the set."""
    total = np.maximum(np.bincount(owner, minlength=len(sizes)), 1)
    own = np.bincount(owner[~shared], minlength=len(sizes)) * 15 // total
    key = (own.astype(np.int64) << 59) | (fingerprints(values, sizes) >> np.uint64(5)).astype(np.int64)
    raw = np.stack([key.view(np.uint64), fingerprints(values, sizes, 0xE7)], axis=1).astype(">u8").tobytes()
    return key, [raw[at : at + 16] for at in range(0, len(raw), 16)]


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    by = np.argsort(owner, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[by].view(np.int64)))


def _nodes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, Broadcast]:
    """id, n_shingles, key and node (null without words), sketch and the signatures that more than one
    document has, or that look so in a bit table; and that table."""
    kind = docs.schema["id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = signatures(*shingle_sets(batch.column(0).to_pylist(), n), percent)[0]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    shared = docs.select("text").mapInArrow(emit, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    known = bit_table(stored(shared, "shared-signatures"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, sizes = shingle_sets(batch.column(1).to_pylist(), n)
            found, owner = signatures(values, sizes, percent)
            keep = passing(known.value, found)
            key, node = node_ids(values, sizes, owner, keep)
            none = sizes == 0
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * SKETCH), pa.array(sketches(values, sizes).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(key, mask=none), pa.array(node, pa.binary(), mask=none), sketch, _lists(found[keep], owner[keep], len(sizes))], names=["id", "n_shingles", "key", "node", "sketch", "signatures"])

    rows = docs.select("id", "text").mapInArrow(describe, f"id {kind}, n_shingles long, key long, node binary, sketch array<long>, signatures array<long>")
    return stored(rows, "sets"), known


def _possible(percent: int) -> Column:
    """A condition on sizes na, nb and sketches ca, cb that all similar sets meet."""
    apart = sum((F.bit_count(F.get("ca", F.lit(k)).bitwiseXOR(F.get("cb", F.lit(k)))) for k in range(1, SKETCH)), F.bit_count(F.get("ca", F.lit(0)).bitwiseXOR(F.get("cb", F.lit(0)))))
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (apart * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb")))


def _sets(docs: DataFrame, wanted: Broadcast, known: Broadcast, n: int, percent: int) -> DataFrame:
    """node and set of the documents whose id's hash is in a bit table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = passing(wanted.value, batch.column(0).to_numpy().view(np.uint64))
            if keep.any():
                values, sizes = shingle_sets(batch.filter(pa.array(keep)).column(1).to_pylist(), n)
                ends = np.cumsum(sizes)
                some = np.flatnonzero(sizes).tolist()
                found, owner = signatures(values, sizes, percent)
                node = node_ids(values, sizes, owner, passing(known.value, found))[1]
                yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in some], pa.binary()), binary_of([values[ends[i] - sizes[i] : ends[i]].tobytes() for i in some])], names=["node", "set"])

    return docs.select(F.xxhash64("id").alias("h"), "text").mapInArrow(run, "node binary, set binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose sets are similar. A set b goes once to each of at most SALTS
    groups of its partners, which pass by it one by one."""
    salt = F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")
    pairs = pairs.select("a", "b", salt.alias("salt"))
    members = pairs.join(sets, pairs["a"] == sets["node"]).select("b", "salt", F.lit(True).alias("member"), "a", "set")
    heads = pairs.select("b", "salt").distinct()
    heads = heads.join(sets, heads["b"] == sets["node"]).select("b", "salt", F.lit(False).alias("member"), F.col("b").alias("a"), "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for batch in slices(batches):
            a, b = [], []
            for hub, member, other, packed in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                found = np.frombuffer(packed, np.uint64)
                if not member:
                    head, own = hub, found
                elif hub == head:
                    shared = len(np.intersect1d(own, found, assume_unique=True))
                    if 100 * shared >= percent * (len(own) + len(found) - shared):
                        a.append(other)
                        b.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    rows = members.unionByName(heads).repartition("b", "salt").sortWithinPartitions("b", "salt", "member")
    return rows.mapInArrow(run, "a binary, b binary")


def rare_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes (node, label, n, sketch) of different labels that may be similar, by their
    rarest elements.

    In any order of all elements, the first one that two similar sets share stands, in either, before as
    many of its elements as they must share. So it is among the first n - ceil(p n) + 1 of the larger set
    and, as both together bound the share, the first n - ceil(2 p / (1 + p) n) + 1 of the smaller; and
    enough elements follow it in both. The order is by the number of these nodes that have an element, so
    what most of them have in common comes last and hardly any pair meets there.
    """

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            packed = batch.column(1).to_pylist()
            owner = np.repeat(np.arange(len(packed)), [len(p) // 8 for p in packed])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(np.frombuffer(b"".join(packed), np.int64))], names=["node", "e"])

    each = stored(sets.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]).mapInArrow(elements, "node binary, e long"), "elements")
    spread = each.groupBy("e").agg(F.count("*").alias("c"))
    first = lambda n: n - F.ceil(F.lit(percent) * n / 100) + 1
    short = F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / (100 + percent)) + 1
    order = each.join(spread, "e").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "e"))).alias("o"), F.count("*").alias("n"))
    order = order.select("node", "n", F.posexplode(F.slice("o", F.lit(1), first(F.col("n")).cast("int"))).alias("at", "x"))
    order = order.join(nodes.select("node", "label", "sketch"), "node")
    order = stored(order.select("node", "label", "n", "sketch", "at", F.col("x.e").alias("e"), (F.col("at") < short).alias("head")), "rare-elements")
    left, right = (order.where("head" if x == "a" else "true").select("e", F.col("node").alias(x), *[F.col(c).alias(f"{k}{x}") for k, c in (("l", "label"), ("n", "n"), ("c", "sketch"), ("p", "at"))]) for x in "ab")
    smaller = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))
    follow = (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))) * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    pairs = left.alias("l").join(right.alias("r"), (F.col("l.e") == F.col("r.e")) & smaller & follow & (F.col("la") != F.col("lb")) & _possible(percent))
    return pairs.select("a", "b").distinct()


def similar_documents(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose sets of n-word shingles have a Jaccard similarity of percent / 100
    at least (intersection * 100 >= percent * union).

    Returns id_col, n_shingles and component_id, the smallest id that links reach. Words are between
    ASCII white space, A-Z lower-cased. Texts with fewer than n words are one shingle; null texts and
    texts without words have none and link with nothing. One row for each input row; rows without an id
    have no component and link with nothing; rows that share an id are one document in the links of
    each. Other columns of docs don't matter. Sets are compared by 64-bit hashes of their shingles, and
    equal sets recognised by 123 bits of hashes of all of them.
    """
    if not 50 <= percent <= 100:
        raise ValueError("the similarity is to be 50 to 100 percent")
    docs = bounded_batches(docs).select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    rows, known = _nodes(docs, n, percent)
    sets = rows.where("id is not null and node is not null")
    nodes = stored(sets.groupBy("node").agg(F.min("id").alias("id"), F.first("key").alias("key"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("signatures").alias("signatures")), "nodes")
    held = nodes.select("key", "node", F.explode("signatures").alias("h"))
    hubs = stored(held.groupBy("h").agg(F.min("key").alias("hub"), F.max("key").alias("most")).where("hub < most").select("h", "hub"), "hubs")
    star = stored(held.join(hubs, "h").where("key != hub").select(F.col("key").alias("ka"), F.col("hub").alias("kb")).distinct(), "star-pairs")
    twins = nodes.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")  # different sets of one key
    star = star.unionByName(twins.select(F.col("key").alias("ka"), F.col("key").alias("kb")))
    a, b = (nodes.select(F.col("key").alias(f"k{x}"), F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"c{x}")) for x in "ab")
    star = star.join(a, "ka").join(b, "kb").where(F.col("a") != F.col("b")).where(_possible(percent)).select("a", "b")
    star = stored(star, "possible-pairs")

    def sets_of(ends: DataFrame) -> DataFrame:
        wanted = bit_table(nodes.join(ends.distinct(), "node", "left_semi").select(F.xxhash64("id").alias("h")))
        out = stored(_sets(docs, wanted, known, n, percent), "candidate-sets")
        wanted.unpersist()
        return out

    ends_of = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    held_sets = sets_of(ends_of(star))
    first = stored(star.groupBy("a").agg(F.min("b").alias("b")), "first-pairs")
    edges = stored(_linked(first, held_sets, percent), "links")
    labels = components(edges)

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs whose ends no links connect yet."""
        for x in "ab":
            pairs = pairs.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")), x, "left")
        return pairs.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")

    rest = stored(apart(star.join(first, ["a", "b"], "left_anti"), labels), "other-pairs")
    if not rest.isEmpty():
        edges = edges.union(stored(_linked(rest, held_sets, percent), "links"))
        labels = components(edges)
    # whoever shares a signature with a node that isn't connected with it
    label = held.join(hubs.select("h"), "h", "left_semi").join(labels, "node", "left").select("h", "node", F.coalesce("label", "node").alias("label"))
    label = stored(label, "signature-labels")
    mixed = label.groupBy("h").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("m")).where("least < most")
    mixed = stored(mixed.select("h", (F.col("m") > MANY).alias("many")), "mixed-signatures")
    open_ = label.join(mixed, "h").distinct().join(nodes.select("node", "n", "sketch"), "node")
    open_ = stored(open_.select("h", "many", "node", "label", "n", "sketch"), "open-signatures")
    left, right = (open_.where("not many").select("h", F.col("node").alias(x), F.col("label").alias(f"l{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"c{x}")) for x in "ab")
    cross = left.alias("l").join(right.alias("r"), (F.col("l.h") == F.col("r.h")) & (F.col("a") > F.col("b")) & (F.col("la") != F.col("lb")) & _possible(percent)).select("a", "b")
    hot = open_.where("many").select("node", "label", "n", "sketch").dropDuplicates(["node"])
    if not hot.isEmpty():
        hot = stored(hot, "open-nodes")
        cross = cross.unionByName(rare_pairs(hot.select("node", "label", "sketch"), sets_of(hot.select("node")), percent))
    cross = stored(cross.distinct().join(star, ["a", "b"], "left_anti"), "cross-pairs")
    if not cross.isEmpty():
        edges = edges.union(stored(_linked(cross, sets_of(ends_of(cross)), percent), "links"))
        labels = components(edges)
    known.unpersist()
    smallest = nodes.join(labels, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label"))
    lowest = stored(smallest.groupBy("label").agg(F.min("id").alias("least")), "lowest")
    of = stored(smallest.join(lowest, "label").select("node", "least"), "node-components")
    thin = stored(rows.select("id", "n_shingles", "node"), "documents")
    return thin.join(of, "node", "left").select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"))
