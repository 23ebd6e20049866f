"""Source selection and splits without leakage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.draws import order_key
from lamina.functions.ordering import numbered, parts, written
from lamina.functions.text import normalized


def complete_cases(outputs: dict[str, DataFrame], on: str = "base_text_id") -> DataFrame:
    """Ids that every output has."""
    tagged = [df.select(on, F.lit(name).alias("__method")) for name, df in outputs.items()]
    both = reduce(DataFrame.unionByName, tagged).distinct()
    return both.groupBy(on).agg(F.count("*").alias("__n")).where(F.col("__n") == len(outputs)).select(on)


def complete_groups(rows: DataFrame, kind: str, on: str) -> DataFrame:
    """Ids that have a row of every kind there is."""
    pairs = rows.select(on, kind).distinct()
    n = pairs.select(kind).distinct().agg(F.count("*").alias("__all"))
    return pairs.groupBy(on).agg(F.count("*").alias("__n")).crossJoin(F.broadcast(n)).where("__n = __all").select(on)


def unchanged(candidates: DataFrame, originals: DataFrame, on: str = "base_text_id") -> DataFrame:
    """Candidates whose normalized text is their original's. Each text is normalized once, where it is read, and compared by its
    hash, so originals' texts aren't shuffled; a text that is null is no other's."""
    mark = lambda none: F.coalesce(F.sha2(normalized("text"), 256), F.lit(none))
    base = originals.select(on, mark("no original").alias("__base"))
    return candidates.withColumn("__own", mark("no candidate")).join(base, on).where(F.col("__own") == F.col("__base")).select(*candidates.columns)


def keep_first(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Of rows with equal normalized texts the one with the smallest id (as a string). The groups are
    found by a minimum, which tasks combine before the shuffle, so a large group costs no more."""
    key = F.sha2(normalized(F.coalesce(text_col, F.lit(""))), 256)
    first = written(df.groupBy(key.alias("__key")).agg(F.min(F.col(id_col).cast("string")).alias("__first")), "first")
    return df.join(first, F.col(id_col).cast("string") == F.col("__first"), "left_semi")


def length_buckets(df: DataFrame, id_col: str, length: Column, n: int = 10) -> DataFrame:
    """df with bucket: rows in the order of length, then id, cut to n parts of floor(i * n / rows)."""
    return parts(df, [length, F.col(id_col)], F.expr(f"transform(filter(sequence(0, {n - 1}), b -> b > 0), b -> (b * __n + {n - 1}) div {n})"), "bucket")


def rarity(features: DataFrame, id_col: str, weight: Column) -> DataFrame:
    """Sum over a row's features (id_col, feature, n) of weight by the feature's total: id_col and rarity.
    Rare features are common join keys only rarely, so totals join by shuffle or broadcast as they are."""
    totals = written(features.groupBy("feature").agg(F.sum("n").alias("total")), "totals")
    return features.join(totals, "feature").groupBy(id_col).agg(F.sum(weight / F.col("total")).alias("rarity"))


def hash_split(df: DataFrame, id_col: str, shares: dict[str, int], seed: int = 42) -> DataFrame:
    """df with split, by a hash of the id: shares are parts of their sum. Rows with equal ids stay together."""
    from lamina.functions.draws import below

    out, upto, total = F.lit(None).cast("string"), 0, sum(shares.values())
    at = below(total, seed, "split", F.col(id_col))
    for name, part in shares.items():
        out = F.when(out.isNull() & (at < upto + part), name).otherwise(out)
        upto += part
    return df.withColumn("split", out)


def stratified_split(df: DataFrame, id_col: str, stratum: Column | list[Column], sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """Exactly sizes[s] ids in each split (if there are so many), strata spread over the splits in
    proportion; ids beyond the sizes get "excluded". Rows with equal ids are in one split, by their least stratum.

    Ids and strata alone are written. All ids stand in the order of stratum (one column or several) and hash, so each stratum is a run. Row i of n
    goes to the split whose turn it is in a pattern that repeats over the whole order: the fraction of i times the
    golden ratio is spread evenly over any run, and sorting by it gives each split its rows. No step
    looks at one row after another.
    """
    strata = stratum if isinstance(stratum, list) else [stratum]
    names = [f"__stratum{k}" for k in range(len(strata))]
    ids = df.groupBy(F.col(id_col).alias("__id")).agg(F.min(F.struct(*[s.alias(n) for s, n in zip(strata, names, strict=True)])).alias("__s"))
    rows = ids.select("__id", "__s.*", order_key(seed, "stratum", F.col("__id")).alias("__draw"))
    rows = dealt(rows, [*[F.col(n) for n in names], F.col("__draw"), F.col("__id")], sizes, "__split")
    return df.join(rows.select("__id", "__split"), F.col(id_col).eqNullSafe(F.col("__id"))).select(*df.columns, F.col("__split").alias("split"))


def dealt(rows: DataFrame, order: list[Column], sizes: dict[str, int], name: str = "split") -> DataFrame:
    """rows, in an order that should be total, with their split: every run of them is spread over the splits in proportion to sizes, as
    `stratified_split` has it."""
    columns = rows.columns
    rows = numbered(rows, *order, name="__i")
    turn = F.pmod(F.col("__i") * F.lit(0.6180339887498949), F.lit(1.0))
    rows = numbered(rows.withColumn("__turn", turn), F.col("__turn"), F.col("__i"), name="__k")
    split, at = F.lit("excluded"), 0
    for s, size in sizes.items():
        split = F.when((F.col("__k") >= at) & (F.col("__k") < at + size), s).otherwise(split)
        at += size
    return rows.select(*columns, split.alias(name))


def workflow_faults(outputs: dict[str, DataFrame], originals: DataFrame, on: str = "base_text_id") -> DataFrame:
    """Rows of workflow outputs that break a rule: method, on and fault (repeated, or unknown to the originals)."""
    all_ = reduce(DataFrame.unionByName, [df.select(on, F.lit(name).alias("method")) for name, df in outputs.items()])
    per = all_.groupBy("method", on).agg(F.count("*").alias("__n"))
    rows = per.join(originals.select(on, F.lit(True).alias("__known")).distinct(), on, "left")
    fault = F.when(F.col("__n") > 1, "repeated").when(F.col("__known").isNull(), "unknown")
    return rows.select("method", on, fault.alias("fault")).where("fault is not null")


def exclusions(originals: DataFrame, outputs: dict[str, DataFrame], on: str = "base_text_id") -> DataFrame:
    """Each original with why it can't be split: on and reason (missing_workflow where an output lacks,
    identical_after_normalization where one repeats the original, duplicate_original of a smaller id with the same
    normalized text among those left; null if it can), and same (the methods whose outputs repeat it).

    Each output is joined once by id; duplicates are found by a minimum that tasks combine first."""
    tagged = reduce(DataFrame.unionByName, [df.select(on, F.lit(name).alias("__method"), F.sha2(normalized("text"), 256).alias("__hash")) for name, df in outputs.items()])
    base = originals.select(on, F.sha2(normalized(F.coalesce("text", F.lit(""))), 256).alias("__own"))
    joined = base.join(tagged, on, "left").groupBy(on, "__own").agg(F.countDistinct("__method").alias("__n"), F.array_sort(F.collect_set(F.when(F.col("__hash") == F.col("__own"), F.col("__method")))).alias("same"))
    joined = written(joined.withColumn("reason", F.when(F.col("__n") < len(outputs), "missing_workflow").when(F.size("same") > 0, "identical_after_normalization")), "workflow-sources")
    first = joined.where("reason is null").groupBy("__own").agg(F.min(F.col(on).cast("string")).alias("__first"))
    rows = joined.join(first, "__own", "left")
    reason = F.when(F.col("reason").isNull() & (F.col(on).cast("string") != F.col("__first")), "duplicate_original").otherwise(F.col("reason"))
    return rows.select(on, reason.alias("reason"), F.when(F.col("__n") == len(outputs), F.col("same")).otherwise(F.array().cast("array<string>")).alias("same"))


def exclusion_funnel(excluded: DataFrame, round_to: int) -> DataFrame:
    """Counts in long form: metric and n; sources, each reason, each method's repeats, usable sources, and how many are
    left when these are rounded down."""
    is_ = lambda r: F.count_if(F.col("reason") == r)
    usable = F.count_if(F.col("reason").isNull())
    sums = excluded.agg(F.count("*").alias("original_sources"), *[is_(r).alias(r) for r in ("missing_workflow", "identical_after_normalization", "duplicate_original")], usable.alias("usable_before_rounding"), (F.floor(usable / round_to) * round_to).alias("retained_sources"), (usable - F.floor(usable / round_to) * round_to).alias("excluded_by_rounding"))
    out = sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("n")) for c in sums.columns])))
    by = excluded.select(F.explode("same").alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    return out.unionByName(by.select(F.concat(F.lit("identical_by_method:"), "m").alias("metric"), "n"))


def workflow_split(originals: DataFrame, outputs: dict[str, DataFrame], features: DataFrame, weight: Column, dev: int, test: int, round_to: int, seed: int = 42, on: str = "base_text_id") -> DataFrame:
    """on and split of the sources that can be used: exactly so many of dev and test, the rest of the rounded number
    train, those beyond it excluded (with split "excluded").

    features: on, feature and n of each source. Sources stand in the order of their rarity, the rarest first, and of
    their rarest feature, and are dealt to the splits by a pattern that spreads every run of that order in
    proportion, so that rare features as well as common ones are in every split.
    """
    usable = written(originals.select(on).join(exclusions(originals, outputs, on).where("reason is null"), on, "left_semi"), "usable")
    own = features.join(usable, on, "left_semi")
    totals = written(own.groupBy("feature").agg(F.sum("n").alias("total")), "totals")
    per = own.join(totals, "feature").groupBy(on).agg(F.sum(weight / F.col("total")).alias("__rarity"), F.min(F.struct("total", "feature")).alias("__least"))
    rows = usable.join(per, on, "left")
    sizes = rounded_sizes(rows.count(), dev, test, round_to)
    return stratified_split(rows, on, [-F.coalesce(F.round("__rarity", 12), F.lit(0.0)), F.coalesce("__least.feature", F.lit(""))], sizes, seed).select(on, "split")


def rounded_sizes(usable: int, dev: int, test: int, round_to: int) -> dict[str, int]:
    """Split sizes: usable rows rounded down, dev and test as given, the rest train."""
    if min(dev, test, round_to) < 1:
        raise ValueError("sizes are to be positive")
    train = usable // round_to * round_to - dev - test
    if train < 1:
        raise ValueError(f"{usable} rows are too few")
    return {"train": train, "dev": dev, "test": test}


def equal_leftover_quotas(counts: dict[str, int], total: int) -> dict[str, int]:
    """How many rows of each split a subset of `total` takes: one each, then always from the split with
    most unused rows (the first of equals)."""
    names = [n for n in ("train", "dev", "test") if n in counts]
    if total < len(names) or total > sum(counts.values()):
        raise ValueError("the subset is too small or too large")
    # all splits end with the same number unused, as far as each has that many
    def taken(left: int) -> int:
        return sum(max(1, counts[n] - left) for n in names)

    low, high = 0, max(counts.values())
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if taken(mid) <= total else (mid + 1, high)
    out = {n: max(1, counts[n] - low) for n in names}
    for n in names:
        if sum(out.values()) < total and out[n] < counts[n] and counts[n] - out[n] == low:
            out[n] += 1
    return out


def hash_limit(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the first in a seeded order of ids."""
    return df.orderBy(order_key(seed, F.col(id_col)), F.col(id_col)).limit(n)


def named_rows(df: DataFrame, id_col: str, ids: list) -> DataFrame:
    """The rows with the given ids; an id that no row has is an error."""
    wanted = df.sparkSession.createDataFrame([(i,) for i in ids], f"{id_col} {df.schema[id_col].dataType.simpleString()}").distinct()
    if lacking := [r[0] for r in wanted.join(df.select(id_col), id_col, "left_anti").limit(5).collect()]:
        raise LookupError(f"no rows with the ids {lacking}")
    return df.join(F.broadcast(wanted), id_col, "left_semi")


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    """Each value once, with the smallest place at which it stands: value and `order`, in that order."""
    return df.groupBy(value).agg(F.min(order).alias(order)).orderBy(order, value)


def train_dev(df: DataFrame, id_col: str, share: float, seed: int = 42) -> DataFrame:
    """df with split: dev has max(1, share of the rows, halves to even) rows; rows with equal ids stay together, in train where
    they would be parted."""
    most = F.array(F.greatest(F.lit(1), F.bround(F.col("__n") * F.lit(share))).cast("long"))
    rows = parts(df, [order_key(seed, "dev", F.col(id_col)), F.col(id_col)], most, "__part")
    return rows.select(*df.columns, F.when(F.col("__part") == 0, "dev").otherwise("train").alias("split"))
