"""Identity, constraint and lineage checks. Each returns the rows that break a rule; `enforce` acts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.ordering import written


class RuleBroken(ValueError):
    """A check found rows."""


def enforce(violations: DataFrame, rule: str, show: int = 5) -> None:
    """Raises RuleBroken with a few of the rows, if there are any."""
    if rows := violations.limit(show).collect():
        raise RuleBroken(f"{rule}: {rows}")


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that several rows have: key columns and n."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(items: DataFrame, id_col: str = "candidate_id", parent_col: str = "parent_candidate_id") -> DataFrame:
    """Rows whose parent isn't there."""
    known = items.select(F.col(id_col).alias("__known")).distinct()
    return items.where(F.col(parent_col).isNotNull()).join(known, F.col(parent_col) == F.col("__known"), "left_anti")


def foreign_parents(items: DataFrame, id_col: str = "candidate_id", parent_col: str = "parent_candidate_id", base_col: str = "base_text_id") -> DataFrame:
    """Rows whose parent belongs to another source."""
    up = items.select(F.col(id_col).alias("__up"), F.col(base_col).alias("__base"))
    return items.join(up, F.col(parent_col) == F.col("__up")).where(F.col("__base") != F.col(base_col)).select(*items.columns)


def depths(items: DataFrame, id_col: str = "candidate_id", parent_col: str = "parent_candidate_id") -> DataFrame:
    """id, root and depth of every row that a root (a row without parent) reaches.

    Pointers double at each step, so a chain of n layers takes log2(n) joins. While a root reaches any open
    row, some row within twice the distance so far reaches it in the next step; so the first step in which
    none does is the last. Cycles are never reached and so are left out.
    """
    rows = items.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up"), F.when(F.col(parent_col).isNull(), F.col(id_col)).alias("root"), F.when(F.col(parent_col).isNull(), 0).otherwise(1).alias("depth"))
    new = written(rows, "lineage")
    done, waiting = new.where("up is null"), new.where("up is not null")
    while not waiting.isEmpty():
        at = done.unionByName(waiting).select(F.col("id").alias("mid"), F.col("up").alias("next"), F.col("root").alias("top"), F.col("depth").alias("more"))
        new = written(waiting.join(at, F.col("up") == F.col("mid")).select("id", F.col("next").alias("up"), F.col("top").alias("root"), (F.col("depth") + F.col("more")).alias("depth")), "lineage")
        reached, waiting = new.where("up is null"), new.where("up is not null")
        if reached.isEmpty():
            break
        done = done.unionByName(reached)
    return done.select("id", "root", "depth")


def coded(df: DataFrame, rules: dict[str, Column], name: str = "violations") -> DataFrame:
    """df with the names of the rules that a row breaks (a rule is true where it holds; null breaks it)."""
    codes = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in rules.items()]
    return df.withColumn(name, F.array_compact(F.array(*codes)))


def candidate_rules() -> dict[str, Column]:
    """What holds for every candidate row."""
    c = F.col
    return {
        "layer_order": (c("source_layer") >= 0) & (c("target_layer") >= 1) & (c("target_layer") > c("source_layer")),
        "source_given": (c("source_layer") == 0) == c("source_method").isNull(),
        "known_source": c("perturbation_source").isin("LLM", "trad"),
        "edit_count": F.coalesce(c("edit_count") == F.size("perturbation_edits"), F.lit(True)),
        "distinct_dimensions": F.size(F.array_distinct("target_dimensions")) == F.size("target_dimensions"),
        "text": F.length(c("text")) > 0,
    }


def leaks(splits: DataFrame, key: list[str], split_col: str = "split") -> DataFrame:
    """Keys that are in more than one split: key columns and n_splits."""
    return splits.select(*key, split_col).distinct().groupBy(*key).agg(F.count("*").alias("n_splits")).where("n_splits > 1")


def same_ids(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Ids that only one side has, with the side; no rows mean equal sets."""
    x, y = a.select(on).distinct(), b.select(on).distinct()
    return x.join(y, on, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, on, "left_anti").withColumn("side", F.lit("right")))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
