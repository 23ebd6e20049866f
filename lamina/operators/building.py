"""Training sets from items, scores and split assignments: the whole build, and each of its steps."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions.draws import order_key
from lamina.functions.ordering import written
from lamina.functions.text import finite
from lamina.operators import composing, lineage, scoring, splitting

#: The splits that a training set is to have.
SPLITS = ("train", "dev", "test")
PAIR_POLICIES = ("none", "parent_child", "original_only", "all_unequal_layers", "cross_source_unmatched")
FORMS = ("grouped", "binary", "pairwise", "regression")


class BuildError(ValueError):
    """A training set can't be built from what is given."""


def unknown_values(catalog: DataFrame, wanted: dict[str, list | None]) -> DataFrame:
    """Requested values that the catalog's columns don't have: column and value. None asks for nothing."""
    spark = catalog.sparkSession
    rows = [(c, str(v)) for c, values in wanted.items() for v in values or []]
    asked = spark.createDataFrame(rows, "column string, value string").distinct()
    if not wanted:
        return asked
    known = catalog.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in wanted])).alias("k")).select("k.*").distinct()
    return asked.join(known, ["column", "value"], "left_anti")


def split_faults(assignments: DataFrame, originals: DataFrame, on: str = "base_text_id", splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Assignments that can't be used: on and fault (repeated, unknown for an id that no original has, or
    unsupported for another split). A repeated id is reported once."""
    per = assignments.groupBy(on).agg(F.count("*").alias("__n"), F.min("split").alias("__split"))
    known = originals.select(on, F.lit(True).alias("__known")).distinct()
    rows = per.join(known, on, "left")
    fault = F.when(F.col("__n") > 1, "repeated").when(F.col("__known").isNull(), "unknown").when(~F.coalesce(F.col("__split").isin(*splits), F.lit(False)), "unsupported")
    return rows.select(on, fault.alias("fault")).where("fault is not null")


def read_assignments(spark: SparkSession, path: str, originals: DataFrame) -> DataFrame:
    """base_text_id and split of a JSON lines file, after its ids are known, distinct and in supported splits."""
    from lamina.sources.jsonl import malformed, read_lines

    lines = read_lines(spark, path)
    lineage.enforce(malformed(lines), "assignments are JSON objects")
    get = lambda k: F.try_variant_get("record", f"$.{k}", "string")
    rows = lines.select(get("base_text_id").alias("base_text_id"), get("split").alias("split"))
    lineage.enforce(split_faults(rows, originals), "assignments are of known sources, once each")
    return rows


def in_splits(rows: DataFrame, assignments: DataFrame, wanted: list[str], unassigned: str = "drop", on: str = "base_text_id") -> DataFrame:
    """rows whose source is in one of the wanted splits. A source without an assignment is dropped (as scoring
    does) or, with unassigned "error", an error (as generation does)."""
    if not wanted:
        raise ValueError("no split is asked for")
    if unassigned not in ("drop", "error"):
        raise ValueError("unassigned is to be drop or error")
    of = assignments.select(on, F.col("split").alias("__split"))
    if unassigned == "drop":
        return rows.join(of.where(F.col("__split").isin(wanted)), on, "left_semi")
    fault = F.raise_error(F.concat(F.lit("no split for source "), F.col(on).cast("string"))).cast("string")
    split = F.when(F.coalesce("__split", F.lit("")) == "", fault).otherwise(F.col("__split"))
    return rows.join(of, on, "left").withColumn("__split", split).where(F.col("__split").isin(wanted)).select(*rows.columns)


def policy_pairs(items: DataFrame, policy: str, reuse: int = 5, seed: int = 42) -> DataFrame:
    """Pairs of a policy, with pair_id: {dataset}:{source}__{policy}_{number within the chain}, in the order of
    items (originals, then label, method, id); cross-source pairs are unmatched__{left}__{right}."""
    if policy == "cross_source_unmatched":
        out = composing.cross_source_pairs(items, reuse, seed)
        out = out.withColumn("sources", F.array("left_base", "right_base"))
        return out.withColumn("pair_id", F.concat_ws("__", F.lit("unmatched"), "left_candidate_id", "right_candidate_id"))
    made = {"parent_child": composing.parent_child_pairs, "original_only": composing.original_pairs, "all_unequal_layers": composing.unequal_pairs}
    if policy not in made:
        raise ValueError(f"unknown pair policy {policy!r}")
    out = made[policy](items)
    by_child = [F.col("right_label"), F.col("right_method"), F.col("right_candidate_id"), F.col("left_candidate_id")]
    by_left = [F.col("left_label"), F.col("left_method"), F.col("left_candidate_id"), F.col("right_label"), F.col("right_method"), F.col("right_candidate_id")]
    at = F.row_number().over(Window.partitionBy(*composing.CHAIN).orderBy(*(by_left if policy == "all_unequal_layers" else by_child))) - 1
    chain = F.concat_ws(":", *composing.CHAIN)
    return out.withColumns({"pair_id": F.concat(chain, F.lit(f"__{policy}_"), at.cast("string")), "sources": F.array("base_text_id")})


def shuffled_chains(items: DataFrame, chain_id: Column, sources: Column, scores: list[str], seed: int) -> DataFrame:
    """One row for each chain, its items as aligned arrays in an order drawn by hash of chain and item."""
    fields = [c for c in items.columns if c not in (*composing.CHAIN, "split", "__chain", "__sources")]
    rows = items.withColumns({"__chain": chain_id, "__sources": sources})
    draw = order_key(seed, F.col("__chain"), F.col("candidate_id"))
    packed = F.sort_array(F.collect_list(F.struct(draw.alias("__draw"), *fields)))
    out = rows.groupBy("split", "dataset_name", F.col("__chain").alias("id")).agg(F.min("__sources").alias("source_original_ids"), packed.alias("__items"))
    plural = {"label": "labels", "method": "perturbation_methods", "run_id": "perturbation_run_ids", "candidate_id": "candidate_ids", "text": "texts", "parent_candidate_id": "parent_candidate_ids"}
    named = [F.col(f"__items.{f}").alias(f if f in scores else plural.get(f, f)) for f in fields]
    return out.select("split", "id", "dataset_name", "source_original_ids", *named)


def training_set(items: DataFrame, assignments: DataFrame, scores: DataFrame | None = None, score_names: list[str] | None = None, composition: str = "all", weights: dict[str, float] | None = None, per_source: int = 1, pair_policy: str = "none", form: str = "grouped", reuse: int = 5, downsample: int | None = None, seed: int = 42) -> DataFrame:
    """A training set with a column `split`, each source in one split only.

    items: originals and candidates (composing.py); assignments: base_text_id and split of one dataset's sources;
    scores: candidate_id, scoring_method, score_value. Steps: lineage is checked; scores are attached, and of
    sources only those stay of which an item has all scores asked for; sources get their split; leaks are
    refused; items are composed; pairs are made; rows take their form; every split is to have rows; a downsample
    takes about so many, the splits' sizes made equal as far as they reach.

    Forms: grouped (a row for each chain, or pair, with arrays), binary (an item, label 1.0 for originals),
    pairwise (chosen and rejected; of chains without pairs all items of unequal labels) and regression (an item
    with its first score). Scores that aren't asked for are attached where they are found.
    """
    if composition not in composing.POLICIES or pair_policy not in PAIR_POLICIES or form not in FORMS:
        raise ValueError("unknown composition, pair policy or form")
    if form in ("binary", "regression") and pair_policy != "none":
        raise BuildError(f"the {form} form takes no pairs")
    if form == "regression" and not score_names:
        raise BuildError("the regression form needs a score")
    lineage.enforce(lineage.orphans(items), "parents exist")
    lineage.enforce(lineage.foreign_parents(items), "parents are of the same source")
    lineage.enforce(split_faults(assignments, items), "assignments are of known sources, once each")
    names: list[str] = []
    if scores is not None:
        own = scores if score_names is None else scores.where(F.col("scoring_method").isin(score_names))
        own = own.join(items.select("candidate_id").distinct(), "candidate_id", "left_semi")
        lineage.enforce(scoring.repeated_scores(own, items), "one run scores a candidate with a method")
        names = sorted(r[0] for r in own.select("scoring_method").distinct().limit(1000).collect())
        if lacking := sorted(set(score_names or []) - set(names)):
            raise BuildError(f"no scores for {lacking}")
        items = scoring.attach(items, own, names)
        if score_names:
            items = scoring.eligible_chains(items, score_names, list(composing.CHAIN))
    elif score_names:
        raise BuildError("no scores are given")
    rows = written(items.join(assignments.select("base_text_id", "split"), "base_text_id"), "split-items")
    lineage.enforce(lineage.leaks(rows, list(composing.CHAIN)), "a source is in one split")
    rows = composing.compose(rows, composition, weights, per_source, seed)
    if pair_policy != "none":
        out = written(_of_each_split(rows, pair_policy, reuse, seed), "pairs")
    else:
        out = rows
    if form == "grouped":
        if pair_policy != "none":
            sides = [out.select("split", "dataset_name", "pair_id", "sources", *[F.col(f"{s}_{c}").alias(c) for c in ("candidate_id", "text", "label", "method", "parent_candidate_id")]) for s in ("left", "right")]
            out = shuffled_chains(sides[0].unionByName(sides[1]).withColumn("base_text_id", F.lit(None).cast("string")).withColumnRenamed("pair_id", "__chain").withColumnRenamed("sources", "__sources"), F.col("__chain"), F.col("__sources"), [], seed)
        else:
            out = shuffled_chains(out, F.concat_ws(":", *composing.CHAIN), F.array("base_text_id"), names, seed)
        key = "id"
    elif form == "binary":
        lineage.enforce(composing.chains_without_one_original(out), "a chain has one original")
        out, key = composing.binary_rows(out), "candidate_id"
    elif form == "regression":
        out, key = composing.regression_rows(out, score_names[0]), "candidate_id"
    else:
        pairs = out if pair_policy != "none" else written(_of_each_split(rows, "all_unequal_layers", reuse, seed), "pairs")
        out, key = preferences(pairs), "pair_id"
    out = written(out, "training-set")
    sizes = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}  # three rows
    if any(not sizes.get(s) for s in SPLITS):
        raise BuildError(f"a split has no rows: {sizes}")
    if downsample is not None and downsample < sum(sizes.values()):
        out = downsampled(out, sizes, downsample, key, seed)
    return out


def _of_each_split(rows: DataFrame, policy: str, reuse: int, seed: int) -> DataFrame:
    if policy == "cross_source_unmatched":
        # a pair's sources are of one split, as each split pairs its own items
        each = [policy_pairs(rows.where(F.col("split") == s), policy, reuse, seed).withColumn("split", F.lit(s)) for s in SPLITS]
        return each[0].unionByName(each[1]).unionByName(each[2])
    of = rows.select(*composing.CHAIN, "split").distinct()
    return policy_pairs(rows, policy, reuse, seed).join(of, list(composing.CHAIN))


def preferences(pairs: DataFrame) -> DataFrame:
    """Pairs (with pair_id, sources and split) of unequal labels as chosen, the lower label, and rejected."""
    first = F.col("left_label") < F.col("right_label")
    pick = lambda c, low: F.when(first if low else ~first, F.col(f"left_{c}")).otherwise(F.col(f"right_{c}"))
    sides = [pick(c, low).alias(f"{side}_{name}") for side, low in (("chosen", True), ("rejected", False)) for c, name in (("candidate_id", "id"), ("text", "text"), ("label", "layer"))]
    return pairs.where("left_label != right_label").select("split", "pair_id", F.col("sources").alias("source_original_ids"), "dataset_name", *sides, F.abs(F.col("left_label") - F.col("right_label")).cast("double").alias("weight"))


def downsampled(rows: DataFrame, sizes: dict[str, int], total: int, key: str, seed: int = 42) -> DataFrame:
    """rows with as many of each split as `equal_leftover_quotas` gives, the first in a seeded order of key."""
    quotas = splitting.equal_leftover_quotas({s: sizes[s] for s in SPLITS}, total)
    each = [splitting.hash_limit(rows.where(F.col("split") == s), key, quotas[s], seed) for s in SPLITS]
    return each[0].unionByName(each[1]).unionByName(each[2])


def write_training_set(rows: DataFrame, path: str, metadata: dict | None = None, overwrite: bool = False) -> None:
    """rows as Parquet with a folder for each split, and a row of metadata (the numbers of rows added)."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("split").parquet(f"{path}/rows")
    back = rows.sparkSession.read.parquet(f"{path}/rows").groupBy("split").agg(F.count("*").alias("n")).collect()  # a row for each split
    full = {**(metadata or {}), "num_examples": {r["split"]: r["n"] for r in back}}
    text = json.dumps(full, sort_keys=True, ensure_ascii=False, allow_nan=False)
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(f"{path}/metadata")


def read_training_set(spark: SparkSession, path: str) -> DataFrame:
    """A written training set; all splits are to be there."""
    rows = spark.read.parquet(f"{path}/rows")
    found = {r["split"] for r in rows.select("split").distinct().collect()}  # a row for each split
    if lacking := [s for s in SPLITS if s not in found]:
        raise BuildError(f"the training set lacks {lacking}")
    return rows


def score_statistics(rows: DataFrame, score: str, by: list[str], exclude_layer_zero: bool = False) -> DataFrame:
    """by, accepted, skipped_missing, skipped_invalid (not finite) and excluded_layer_zero of items' scores."""
    zero = (F.col("label") == 0) & F.lit(exclude_layer_zero)
    is_ = lambda c: F.sum(F.when(c, 1).otherwise(0))
    missing = F.col(score).isNull()
    return rows.groupBy(*by).agg(is_(~zero & finite(score)).alias("accepted"), is_(~zero & missing).alias("skipped_missing"), is_(~zero & ~missing & ~finite(score)).alias("skipped_invalid"), is_(zero).alias("excluded_layer_zero"))


def split_ids(assigned: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """by, split and the sorted ids of each: metadata of a build, for sets of a size that one row may have."""
    return assigned.groupBy(*by, "split").agg(F.array_sort(F.collect_set(F.col(id_col).cast("string"))).alias("ids"))
