"""Chains of candidates: composition, pairs and flat training rows.

Items are rows of one table (a source's candidates and its original), not arrays; a chain is a group of
rows. Columns: dataset_name, base_text_id, candidate_id, text, label (layer), method ("original" for the
original), run_id, parent_candidate_id and any others.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.draws import order_key, weighted_clock
from lamina.functions.ordering import numbered, written

CHAIN = ("dataset_name", "base_text_id")
POLICIES = ("all", "source_exclusive", "fixed_per_source", "balanced", "weighted")


def union_items(originals: DataFrame, candidates: DataFrame) -> DataFrame:
    """Originals as items of label 0 together with candidates."""
    base = originals.withColumns({"label": F.lit(0), "method": F.lit("original"), "run_id": F.lit("original"), "parent_candidate_id": F.lit(None).cast("string")})
    return base.unionByName(candidates, allowMissingColumns=True)


def composed_order() -> list[Column]:
    """The order of a chain's composed items: the original, then label, method and id."""
    return [F.when(F.col("method") == "original", 0).otherwise(1), F.col("label"), F.col("method"), F.col("candidate_id")]


def _weights(weights: dict[str, float] | None, default: float) -> Column:
    if weights is not None and (min(weights.values(), default=0) < 0 or not any(weights.values())):
        raise ValueError("weights are to be 0 or more and not all 0")
    if not weights:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]), F.col("method")), F.lit(default))


def compose(items: DataFrame, policy: str = "all", weights: dict[str, float] | None = None, per_source: int = 1, seed: int = 42) -> DataFrame:
    """The items of each source that a policy takes; originals always stay.

    all: every item. source_exclusive: those of one method, drawn by weight (1 if not given).
    fixed_per_source: at most per_source of each method. balanced: of each method as many as the
    rarest method of the source has. weighted: per_source times the number of methods, drawn by weight
    (0 if not given) without replacement. Draws are hashes of seed and ids.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    if policy == "all":
        return items
    chain = Window.partitionBy(*CHAIN)
    originals, others = items.where("method = 'original'"), items.where("method != 'original'")
    draw = order_key(seed, *[F.col(c) for c in CHAIN], F.col("candidate_id"))
    if policy == "source_exclusive":
        methods = others.select(*CHAIN, "method").distinct().withColumn("__clock", weighted_clock(_weights(weights, 1.0), seed, *[F.col(c) for c in CHAIN], F.col("method")))
        one = methods.groupBy(*CHAIN).agg(F.min_by("method", "__clock").alias("method"))
        return originals.unionByName(others.join(one, [*CHAIN, "method"], "left_semi").select(*items.columns))
    by_method = Window.partitionBy(*CHAIN, "method").orderBy("__draw", "candidate_id")
    if policy == "weighted":
        # a negative log of a uniform number by the weight: the smallest are a weighted draw
        clock = weighted_clock(_weights(weights, 0.0), seed, *[F.col(c) for c in CHAIN], F.col("candidate_id"))
        rows = others.withColumn("__clock", clock)
        counts = others.groupBy(*CHAIN).agg((F.countDistinct("method") * per_source).alias("__most"))
        rows = rows.where("__clock is not null").withColumn("__k", F.row_number().over(chain.orderBy("__clock", "candidate_id"))).join(counts, list(CHAIN))
        return originals.unionByName(rows.where("__k <= __most").select(*items.columns))
    rows = others.withColumn("__draw", draw).withColumn("__k", F.row_number().over(by_method))
    if policy == "fixed_per_source":
        rows = rows.where(F.col("__k") <= per_source)
    else:
        quota = others.groupBy(*CHAIN, "method").agg(F.count("*").alias("__n")).groupBy(*CHAIN).agg(F.min("__n").alias("__quota"))
        rows = rows.join(quota, list(CHAIN)).where("__k <= __quota")
    return originals.unionByName(rows.select(*items.columns))


def _sides(items: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    return tuple(items.select(*CHAIN, *[F.col(c).alias(f"{side}_{c}") for c in columns]) for side in ("left", "right"))


_FIELDS = ["candidate_id", "text", "label", "method", "parent_candidate_id"]


def parent_child_pairs(items: DataFrame) -> DataFrame:
    """Each item with its parent, where both are in the chain: left_ and right_ columns."""
    left, right = _sides(items, _FIELDS)
    return left.join(right, list(CHAIN)).where("right_parent_candidate_id = left_candidate_id")


def original_pairs(items: DataFrame) -> DataFrame:
    """The original of each chain with every other item."""
    left, right = _sides(items, _FIELDS)
    return left.where("left_method = 'original'").join(right.where("right_method != 'original'"), list(CHAIN))


def unequal_pairs(items: DataFrame) -> DataFrame:
    """All pairs of a chain whose labels differ, the lower label first. The result itself is that large."""
    left, right = _sides(items, _FIELDS)
    return left.join(right, list(CHAIN)).where("left_label < right_label")


#: Columns by which items are matched across sources, and items of a dataset that one task may finish.
_MATCHED = ["dataset_name", "base_text_id", "label", "candidate_id"]
FEW = 256


def _pairs_of(pairs: DataFrame) -> DataFrame:
    """Of rows with two items a and b those that fit: one dataset, different sources and labels, not paired before."""
    fits = "a.dataset_name = b.dataset_name and a.base_text_id != b.base_text_id and a.label != b.label and not array_contains(a.met, b.candidate_id)"
    return pairs.where(fits).select(F.col("a.candidate_id").alias("left_candidate_id"), F.col("b.candidate_id").alias("right_candidate_id"))


def _less(waiting: DataFrame, pairs: DataFrame, reuse: int) -> DataFrame:
    """The items that may be in more pairs."""
    l, r = "left_candidate_id", "right_candidate_id"
    used = pairs.select(F.col(l).alias("candidate_id"), F.col(r).alias("__with")).unionByName(pairs.select(F.col(r).alias("candidate_id"), F.col(l).alias("__with")))
    met = F.when(F.col("__with").isNull(), F.col("met")).otherwise(F.array_append("met", F.col("__with")))
    return waiting.join(used, "candidate_id", "left").select(*_MATCHED, met.alias("met")).where(F.size("met") < reuse)


def _neighbours(waiting: DataFrame, *draw) -> DataFrame:
    """Pairs of the items at places 2k and 2k + 1 of a hash order."""
    rows = numbered(waiting.withColumn("__draw", order_key(*draw, F.col("candidate_id"))), F.col("dataset_name"), F.col("__draw"), F.col("candidate_id"), name="__at")
    item = F.struct(*_MATCHED, "met")
    return _pairs_of(rows.groupBy(F.expr("__at div 2").alias("__k")).agg(F.min_by(item, "__at").alias("a"), F.max_by(item, "__at").alias("b")))


def _by_counts(waiting: DataFrame, shift: int, *draw) -> tuple[DataFrame, DataFrame]:
    """Pairs between classes in which every item fits every item, and the items that still have any to fit.

    The classes are those of a dataset's most frequent source and label: 3 has both, 2 the source, 1 the
    label and 0 neither. 3 meets 0 and 2 meets 1 in hash order, one side moved on by `shift`, so either
    class ends up empty (unless they met before). An item of 3 fits those of 0 alone, and without 0 and
    one of 1 and 2 nothing is left that fits.
    """
    of = lambda c: F.broadcast(waiting.groupBy("dataset_name", c).agg(F.count("*").alias("n")).groupBy("dataset_name").agg(F.max_by(c, F.struct("n", c)).alias(f"__{c}")))
    has = lambda c, n: F.when(F.col(c) == F.col(f"__{c}"), n).otherwise(0)
    rows = waiting.join(of("base_text_id"), "dataset_name").join(of("label"), "dataset_name").withColumn("__class", has("base_text_id", 2) + has("label", 1))
    rows = rows.select(*waiting.columns, "__class", order_key(*draw, F.col("candidate_id")).alias("__draw"))
    rows = written(numbered(rows, F.col("dataset_name"), F.col("__class"), F.col("__draw"), F.col("candidate_id"), name="__at"), "classes")
    begins = [F.min(F.when(F.col("__class") == k, F.col("__at"))).alias(f"__b{k}") for k in range(4)]
    sizes = [F.count_if(F.col("__class") == k).alias(f"__n{k}") for k in range(4)]
    rows = rows.join(F.broadcast(rows.groupBy("dataset_name").agg(*begins, *sizes)), "dataset_name")
    begin = F.coalesce(*[F.when(F.col("__class") == k, F.col(f"__b{k}")) for k in range(4)])
    outer = F.col("__class").isin(0, 3)
    most = F.when(outer, F.greatest("__n0", "__n3")).otherwise(F.greatest("__n1", "__n2"))
    place = F.pmod(F.col("__at") - begin + F.when(F.col("__class") < 2, shift).otherwise(0), most)
    item = F.struct(*_MATCHED, "met")
    pairs = rows.groupBy("dataset_name", outer.alias("__outer"), place.alias("__k")).agg(F.min_by(item, "__class").alias("a"), F.max_by(item, "__class").alias("b"))
    lone = "__n0 = 0 and (__class = 3 or __class = 2 and __n1 = 0 or __class = 1 and __n2 = 0)"
    return _pairs_of(pairs), rows.where(f"not ({lone})").select(*waiting.columns)


def _finished(waiting: DataFrame, reuse: int, seed: int) -> DataFrame:
    """All pairs of datasets with few items: one item after another meets those after it."""

    def run(rows: pa.Table) -> pa.Table:
        items = [(r["base_text_id"], r["label"], r["candidate_id"], set(r["met"])) for r in rows.sort_by([("__draw", "ascending"), ("candidate_id", "ascending")]).to_pylist()]
        out = []
        for k, (base, label, name, met) in enumerate(items):
            for other in items[k + 1 :]:
                if len(met) >= reuse:
                    break
                if other[0] != base and other[1] != label and len(other[3]) < reuse and other[2] not in met:
                    out.append((name, other[2]))
                    met.add(other[2])
                    other[3].add(name)
        return pa.table({f"{side}_candidate_id": pa.array([p[k] for p in out], rows.schema.field("candidate_id").type) for k, side in enumerate(("left", "right"))})

    kind = waiting.schema["candidate_id"].dataType.simpleString()
    return waiting.withColumn("__draw", order_key(seed, "few", F.col("candidate_id"))).groupBy("dataset_name").applyInArrow(run, f"left_candidate_id {kind}, right_candidate_id {kind}")


def cross_source_pairs(items: DataFrame, reuse: int = 1, seed: int = 42) -> DataFrame:
    """Pairs of items of different sources and labels of a dataset, each item in `reuse` pairs at most.

    No two items that could still be a pair are left over. Not a maximum matching. Rounds pair neighbours
    in a new hash order each; where these fit too seldom, a round pairs by counts of source and label
    (`_by_counts`), and datasets of few items left are finished in one task each. Rows that share a
    candidate_id are one item, the least of them; rows without source, label or id have no pairs.
    """
    if reuse < 1:
        raise ValueError("reuse is to be 1 or more")
    whole = items.where(" and ".join(f"{c} is not null" for c in _MATCHED))
    fields = [c for c in _FIELDS if c not in _MATCHED]
    one = lambda *more: whole.groupBy("candidate_id").agg(F.min(F.struct("dataset_name", "base_text_id", "label", *more)).alias("i")).select("candidate_id", "i.*")
    kind = whole.schema["candidate_id"].dataType.simpleString()
    waiting = written(one().select(*_MATCHED, F.array().cast(f"array<{kind}>").alias("met")), "unpaired")
    few, found, step, counted = max(FEW, 4 * reuse), [], 0, 0
    by_counts = False
    while True:
        many = waiting.groupBy("dataset_name").agg(F.count("*").alias("n")).where(F.col("n") > few).select("dataset_name")
        found.append(written(_finished(waiting.join(F.broadcast(many), "dataset_name", "left_anti"), reuse, seed), "pairs"))
        waiting = waiting.join(F.broadcast(many), "dataset_name", "left_semi")
        if not (n := waiting.count()):
            break
        if by_counts:
            pairs, waiting = _by_counts(waiting, counted % reuse, seed, "cross", step)
            counted += 1
        else:
            pairs = _neighbours(waiting, seed, "cross", step)
        pairs = written(pairs, "pairs")
        found.append(pairs)
        by_counts = not by_counts and 8 * pairs.count() < n
        waiting = written(_less(waiting, pairs, reuse), "unpaired")
        step += 1
    out = reduce(DataFrame.unionByName, found)
    side = lambda s: one(*fields).select(F.col("dataset_name"), *[F.col(c).alias(f"{s}_{c}") for c in _FIELDS], F.col("base_text_id").alias(f"{s}_base"))
    out = out.join(side("left"), "left_candidate_id").join(side("right").drop("dataset_name"), "right_candidate_id")
    return out.select("dataset_name", *[f"{s}_{c}" for s in ("left", "right") for c in ("base", *_FIELDS)])


def pairwise_rows(pairs: DataFrame) -> DataFrame:
    """Chosen (lower label) and rejected side of each pair of unequal labels, weighted by the difference."""
    first = F.col("left_label") < F.col("right_label")
    pick = lambda c, low: F.when(first if low else ~first, F.col(f"left_{c}")).otherwise(F.col(f"right_{c}"))
    out = pairs.where("left_label != right_label")
    return out.select(
        F.concat_ws("__", "base_text_id", "left_candidate_id", "right_candidate_id").alias("pair_id"), F.col("base_text_id").alias("source_id"), "dataset_name",
        pick("candidate_id", True).alias("chosen_id"), pick("candidate_id", False).alias("rejected_id"), pick("text", True).alias("chosen_text"), pick("text", False).alias("rejected_text"),
        pick("label", True).alias("chosen_layer"), pick("label", False).alias("rejected_layer"), F.abs(F.col("left_label") - F.col("right_label")).cast("double").alias("weight"),
    )


def binary_rows(items: DataFrame) -> DataFrame:
    """Items with label 1.0 for originals, 0.0 for others."""
    return items.withColumn("layer", F.col("label")).withColumn("label", F.when(F.col("method") == "original", 1.0).otherwise(0.0))


def chains_without_one_original(items: DataFrame) -> DataFrame:
    """Chains that don't have exactly one original, with the number they have."""
    return items.groupBy(*CHAIN).agg(F.sum(F.when(F.col("method") == "original", 1).otherwise(0)).alias("n_originals")).where("n_originals != 1")


def regression_rows(items: DataFrame, score: str) -> DataFrame:
    """Items whose score is finite, with it as label and the old label as layer. A score that is no number is an
    error."""
    from lamina.functions.text import finite

    if (kind := items.schema[score].dataType.simpleString()) not in ("tinyint", "smallint", "int", "bigint", "float", "double") and not kind.startswith("decimal"):
        raise TypeError(f"{score} is {kind}, not a number")
    return items.where(finite(score)).withColumn("layer", F.col("label")).withColumn("label", F.col(score).cast("double"))


def min_max(rows: DataFrame, target: str, fit: Column) -> DataFrame:
    """rows with scaled: target on the scale of the finite ones that `fit` marks (0 their least, 1 their most), not
    cut to it. An error if those are all equal, or none."""
    from lamina.functions.text import finite

    limits = rows.where(fit).where(finite(target)).agg(F.min(target).alias("__low"), F.max(target).alias("__high"))
    span = F.col("__high") - F.col("__low")
    constant = F.raise_error(F.lit(f"{target} is constant where it is fitted")).cast("double")
    scaled = F.when(F.coalesce(span, F.lit(0)) == 0, constant).otherwise((F.col(target) - F.col("__low")) / span)
    return rows.crossJoin(F.broadcast(limits)).withColumn("scaled", scaled).drop("__low", "__high")


def chain_arrays(items: DataFrame, score: str | None = None) -> DataFrame:
    """One row for each chain with its items as aligned arrays, ordered by label, method, run and id."""
    fields = ["label", "method", "run_id", "candidate_id", "text", "parent_candidate_id", *([score] if score else [])]
    packed = F.sort_array(F.collect_list(F.struct(*fields)))
    rows = items.groupBy(*CHAIN).agg(packed.alias("__items"))
    plural = {"label": "labels", "method": "perturbation_methods", "run_id": "perturbation_run_ids", "candidate_id": "candidate_ids", "text": "texts", "parent_candidate_id": "parent_candidate_ids"}
    return rows.select(*CHAIN, *[F.col(f"__items.{f}").alias(plural.get(f, f)) for f in fields])

