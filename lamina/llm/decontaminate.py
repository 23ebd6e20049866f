"""Benchmark decontamination: short test items inside long documents, with DataFrame functions only.

Items are partitioned by the size of their shingle sets. Each partition has its own number of MinHash
values: an item of n shingles that a document contains at the threshold t lacks at most n - ceil(t n)
of them there, so of its n - ceil(t n) + 1 smallest hashes at least one is in the document, and a
partition takes what its largest item needs. Looked up among a document's shingles, these values find
every pair; the exact share of shingles then decides. The short items are what is partitioned and
sketched, not the documents: a document's own few minimum values would hardly ever be an item's.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import broadcast_below, stored

WHITE = " \t\n\x0b\x0c\r"
#: Largest stored tables, in rows, that go to all tasks; larger ones are joined by a shuffle.
SMALL = 200_000


def words(text: Column | str) -> Column:
    """Lower-cased words between ASCII white space; an empty array for null and empty texts."""
    text = F.btrim(F.lower(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))), F.lit(WHITE))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "[ \\x09-\\x0D]+"))


def _hashes(w: str, n: int) -> Column:
    """Hashes of all runs of n words."""
    run = lambda i: F.xxhash64(*[F.get(w, (i + k).cast("int")) for k in range(n)])
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), run)).otherwise(F.array().cast("array<bigint>"))


def _shingles(w: str, n: int) -> Column:
    run = lambda i: F.concat(F.lit(" "), F.array_join(F.slice(w, i + 1, F.lit(n)), " "), F.lit(" "))
    return F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), run))).otherwise(F.array().cast("array<string>"))


def sketched_items(items: DataFrame, n: int, threshold: float, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, size, partition (of sizes up to 2^(partition + 1) - 1), shingles and sketch."""
    out = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), words(text_col).alias("w")).distinct()
    out = out.select("item_id", _shingles("w", n).alias("shingles"), F.array_sort(F.array_distinct(_hashes("w", n))).alias("h")).withColumn("size", F.size("shingles")).where("size > 0")
    out = out.withColumn("partition", F.floor(F.log2("size") + 1e-9).cast("int"))
    top = (F.pow(F.lit(2), F.col("partition") + 1) - 1).cast("int")
    # of all sizes up to the partition's top, the top lacks most; +1e-9 as threshold * size is rounded
    values = top - F.ceil(top * F.lit(threshold) - 1e-9).cast("int") + 1
    return out.select("item_id", "size", "partition", "shingles", F.slice("h", F.lit(1), F.least(F.size("h"), values)).alias("sketch"))


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of a document and an item (columns item_id, text) of whose distinct n-word shingles the
    document has at least the share `threshold`.

    Returns id_col, item_id, n_shared, n_item and containment, one row for each pair. Words are lower-
    cased; all white space is alike. Items with fewer than n words have no shingle and are in no pair;
    so are null and empty texts and rows without an id. Repeated rows give one pair; of several texts
    with the same ids the best pair counts. Other columns don't matter.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is to be over 0 and at most 1")
    known = stored(sketched_items(items, n, threshold), "benchmark-sketches")
    lookup = stored(known.select("item_id", F.explode("sketch").alias("h")), "benchmark-lookup")
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hits = docs.select("id", words("text").alias("w")).select("id", F.explode(_hashes("w", n)).alias("h"))
    pairs = stored(hits.join(broadcast_below(lookup, SMALL), "h").groupBy("id", "item_id").agg(F.count("*").alias("hits")).select("id", "item_id"), "benchmark-candidates")
    found = docs.join(broadcast_below(pairs, SMALL), "id").select("id", "item_id", F.concat(F.lit(" "), F.array_join(words("text"), " "), F.lit(" ")).alias("body"))
    found = found.join(broadcast_below(known.select("item_id", "size", "shingles"), SMALL // 20), "item_id")
    shared = F.size(F.filter("shingles", lambda s: F.contains("body", s)))
    found = found.select("id", "item_id", shared.alias("n_shared"), F.col("size").alias("n_item"))
    found = found.where(F.col("n_shared") >= F.col("n_item") * F.lit(threshold) - 1e-9)
    best = found.groupBy("id", "item_id").agg(F.max_by(F.struct("n_shared", "n_item"), F.col("n_shared") / F.col("n_item")).alias("b"))
    return best.select(F.col("id").alias(id_col), "item_id", F.col("b.n_shared").cast("long").alias("n_shared"), F.col("b.n_item").cast("long").alias("n_item"), (F.col("b.n_shared") / F.col("b.n_item")).alias("containment"))
