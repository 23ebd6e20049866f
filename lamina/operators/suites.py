"""Benchmark suites: records of many dimensions scored once, and the statistics of all dimensions in one job."""

from __future__ import annotations

from functools import reduce
from math import erfc, exp, isfinite, lgamma, log, sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lamina.functions.draws import h32
from lamina.functions.ordering import running_sum, written
from lamina.functions.text import cleaned, finite
from lamina.operators import metrics, scoring


# --- p-values --------------------------------------------------------------------------------------


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    # Lentz's rule for 1 / (1 + d1 / (1 + d2 / ...))
    f, c, d = 1.0, 1.0, 0.0
    for i in range(2000):
        m = i // 2
        if i == 0:
            top = 1.0
        elif i % 2:
            top = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / ((1 + top * d) or 1e-300)
        c = (1 + top / c) or 1e-300
        f *= c * d
        if i and abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1)


def t_probability(r: float, n: int) -> float | None:
    """Two-sided probability of a correlation of at least |r| among n pairs without one, by Student's t."""
    if n < 3 or not isfinite(r):
        return None
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def kendall_probability(tau: float | None, n: int, x_ties: list[int], y_ties: list[int]) -> float | None:
    """Two-sided probability of Kendall's tau-b: exact without ties for up to 33 pairs
    and for at most one discordant (or concordant) pair, else by the normal law with the variance that ties leave. x_ties, y_ties: sizes of groups of equal values."""
    if n < 2 or tau is None or not isfinite(tau):
        return None
    pairs = n * (n - 1) // 2
    two = lambda ts: sum(t * (t - 1) // 2 for t in ts)
    if not two(x_ties) and not two(y_ties):
        worse = round((1 - tau) / 2 * pairs)
        few = min(worse, pairs - worse)
        if n > 33 and few <= 1:  # one permutation is in perfect order, and n - 1 are one exchange away
            return exp(log(2) - lgamma(n + (1 - few)))
        if n <= 33:
            ways = [1]  # permutations of k values by inversions
            for k in range(2, n + 1):
                sums, s = [], 0
                for i in range(len(ways) + k - 1):
                    s += (ways[i] if i < len(ways) else 0) - (ways[i - k] if i >= k else 0)
                    sums.append(s)
                ways = sums
            return min(1.0, 2 * sum(ways[: few + 1]) / sum(ways)) if 2 * few != pairs else 1.0
    three = lambda ts: sum(t * (t - 1) * (t - 2) for t in ts)
    wide = lambda ts: sum(t * (t - 1) * (2 * t + 5) for t in ts)
    free_x, free_y = pairs - two(x_ties), pairs - two(y_ties)
    m = n * (n - 1)
    variance = (m * (2 * n + 5) - wide(x_ties) - wide(y_ties)) / 18 + 2 * two(x_ties) * two(y_ties) / m + (three(x_ties) * three(y_ties) / (9 * m * (n - 2)) if n > 2 else 0)
    if variance <= 0:
        return None
    return erfc(abs(tau * sqrt(free_x) * sqrt(free_y)) / sqrt(variance) / sqrt(2))


@F.pandas_udf(DoubleType())
def spearman_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Of each group's correlation and number of pairs."""
    return pd.Series([None if pd.isna(x) else t_probability(float(x), int(k)) for x, k in zip(r, n, strict=True)], dtype="float64")


def kendall_p(rows: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """by, n, kendall and kendall_p. Ties go into the variance through sums over groups of equal values, so only
    numbers reach the last step: for up to 33 pairs their own list of ties."""
    ok = written(rows.where(finite(label) & finite(score)).select(*by, F.col(label).cast("double").alias("__x"), F.col(score).cast("double").alias("__y")), "pairs")
    out = metrics.kendall(ok, by, "__x", "__y")

    def sums(x: str) -> DataFrame:
        t = F.col("t").cast("double")
        groups = ok.groupBy(*by, x).agg(F.count("*").alias("t"))
        return groups.groupBy(*by).agg(F.sum(t * (t - 1) / 2).alias(f"{x}2"), F.sum(t * (t - 1) * (t - 2)).alias(f"{x}3"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{x}w"))

    for x in ("__x", "__y"):
        out = out.join(sums(x), by) if by else out.crossJoin(F.broadcast(sums(x)))

    @F.pandas_udf("double")
    def p(tau: pd.Series, n: pd.Series, x2: pd.Series, x3: pd.Series, xw: pd.Series, y2: pd.Series, y3: pd.Series, yw: pd.Series) -> pd.Series:
        found = []
        for r, k, a2, a3, aw, b2, b3, bw in zip(tau, n, x2, x3, xw, y2, y3, yw, strict=True):
            if pd.isna(r) or k < 2:
                found.append(None)
            elif not a2 and not b2:
                found.append(kendall_probability(float(r), int(k), [], []))
            else:
                m, pairs = float(k) * (k - 1), float(k) * (k - 1) / 2
                v = (m * (2 * k + 5) - aw - bw) / 18 + 2 * a2 * b2 / m + (a3 * b3 / (9 * m * (k - 2)) if k > 2 else 0)
                found.append(erfc(abs(r * sqrt(pairs - a2) * sqrt(pairs - b2)) / sqrt(v) / sqrt(2)) if v > 0 else None)
        return pd.Series(found, dtype="float64")

    return out.withColumn("kendall_p", p("kendall", F.col("n").cast("double"), *[f"{x}{k}" for x in ("__x", "__y") for k in "23w"])).select(*by, "n", "kendall", "kendall_p")


# --- suites ----------------------------------------------------------------------------------------


def correlations(rows: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """by, n, spearman, spearman_p, kendall and kendall_p of each group."""
    rho = metrics.spearman(rows, by, label, score).withColumn("spearman_p", spearman_p("spearman", F.col("n").cast("double")))
    tau = kendall_p(rows, by, label, score).drop("n")
    both = rho.join(tau, by) if by else rho.crossJoin(F.broadcast(tau))
    return both.select(*by, "n", "spearman", "spearman_p", "kendall", "kendall_p")


def scored_suite(records: DataFrame, scorer: scoring.Scorer, dimension: list[str], label: str = "human_score", context: list[str] | None = None) -> DataFrame:
    """Correlations of all dimensions of a suite. Each distinct text (with its prompt's context) is scored once."""
    rows = scoring.distinct_scored(records, [*(context or []), "text"], scorer)
    return correlations(rows, dimension, label, "score_value")


def preference_suite(pairs: DataFrame, scorer: scoring.Scorer, dimension: list[str], tie: str | None = None) -> DataFrame:
    """Preference statistics of all dimensions: pairs of which a text is blank are left out, texts are cleaned,
    and each distinct one is scored once."""
    rows = pairs.withColumns({"preferred_text": cleaned("preferred_text"), "dispreferred_text": cleaned("dispreferred_text")}).where("preferred_text != '' and dispreferred_text != ''")
    rows = written(rows, "preferences")
    texts = rows.select(F.col("preferred_text").alias("text")).unionByName(rows.select(F.col("dispreferred_text").alias("text"))).distinct()
    scores = written(scoring.distinct_scored(texts, ["text"], scorer), "scores").where("score_value is not null")
    for side in ("preferred", "dispreferred"):
        rows = rows.join(scores.select(F.col("text").alias(f"{side}_text"), F.col("score_value").alias(f"{side}_score")), f"{side}_text", "left")
    return metrics.preference(rows, dimension, "preferred_score", "dispreferred_score", tie)


def capped(records: DataFrame, dimension: list[str], order: str, most: int) -> DataFrame:
    """The first `most` records of each dimension, in the order of a file (a column that should be unique within it). Only dimensions and
    the order are numbered; records are compared with the last one that their dimension keeps."""
    names = [f"__d{i}" for i in range(len(dimension))]
    keys = records.select(*[F.col(d).alias(n) for d, n in zip(dimension, names, strict=True)], F.struct(F.col(order).alias("at")).alias("__at"))
    last = running_sum(keys, names, [F.col("__at")], F.lit(1), "__k").where(F.col("__k") < most).groupBy(*names).agg(F.max("__at").alias("__last"))
    same = reduce(lambda a, b: a & b, [F.col(d).eqNullSafe(F.col(n)) for d, n in zip(dimension, names, strict=True)])
    return records.join(last, same).where(F.struct(F.col(order).alias("at")) <= F.col("__last")).select(*records.columns)


def long_form(wide: DataFrame, by: list[str], prefix: str = "") -> DataFrame:
    """by, key (prefix and the column's name) and value of each number that isn't null."""
    names = [c for c in wide.columns if c not in by]
    each = F.array(*[F.struct(F.lit(f"{prefix}{c}").alias("key"), F.col(c).cast("double").alias("value")) for c in names])
    return wide.select(*by, F.inline(each)).where("value is not null")


def included_specs(specs: DataFrame, review: bool = False) -> DataFrame:
    """Specs without notes; all of them where those under review are asked for."""
    return specs if review else specs.where(F.coalesce(F.trim("notes"), F.lit("")) == "")


def suite_audit(records: DataFrame, specs: DataFrame) -> DataFrame:
    """Counts of a suite's records in long form: kind (spec, benchmark, category or task), name and n. Specs without
    a record count 0. records: spec, benchmark, task_family and fluency_categories (an array)."""
    by = lambda kind, column: records.select(F.lit(kind).alias("kind"), column.alias("name")).groupBy("kind", "name").agg(F.count("*").alias("n"))
    of = specs.select(F.col("name")).distinct().join(by("spec", F.col("spec")), "name", "left").select(F.lit("spec").alias("kind"), "name", F.coalesce("n", F.lit(0)).alias("n"))
    out = of.unionByName(by("benchmark", F.col("benchmark"))).unionByName(by("task", F.col("task_family")))
    return out.unionByName(by("category", F.explode("fluency_categories")))


def split_audit(train: DataFrame, test: DataFrame, on: str) -> DataFrame:
    """What is wrong with two sets of ids: fault (blank, repeated or overlap), side and n; no rows if nothing is."""
    blank = lambda df, side: df.where(F.coalesce(F.trim(F.col(on).cast("string")), F.lit("")) == "").agg(F.count("*").alias("n")).select(F.lit("blank").alias("fault"), F.lit(side).alias("side"), "n")
    again = lambda df, side: df.groupBy(on).agg(F.count("*").alias("m")).where("m > 1").agg(F.count("*").alias("n")).select(F.lit("repeated").alias("fault"), F.lit(side).alias("side"), "n")
    both = scoring.overlap(train, test, on).agg(F.count("*").alias("n")).select(F.lit("overlap").alias("fault"), F.lit("both").alias("side"), "n")
    out = both
    for df, side in ((train, "train"), (test, "test")):
        out = out.unionByName(blank(df, side)).unionByName(again(df, side))
    return out.where("n > 0")


# --- systems and segments --------------------------------------------------------------------------


def system_scores(rows: DataFrame, system: str, metric: str, human: str) -> DataFrame:
    """system, metric and human: means over segments, of the human scores those that are there."""
    return rows.groupBy(system).agg(F.avg(metric).alias("metric"), F.avg(human).alias("human"))


def system_agreement(rows: DataFrame, system: str, metric: str, human: str) -> DataFrame:
    """pearson of systems' means, and accuracy: the share of pairs of systems that both order alike. Systems
    without a human score take no part."""
    means = written(system_scores(rows, system, metric, human).where("human is not null and metric is not null"), "systems")
    a, b = (means.select(F.col(system).alias(f"s{k}"), F.col("metric").alias(f"m{k}"), F.col("human").alias(f"h{k}")) for k in "ab")
    # systems are what takes part in a comparison: tens of rows
    pairs = a.join(b, F.col("sa") < F.col("sb"))
    same = F.when(F.signum(F.col("ma") - F.col("mb")) == F.signum(F.col("ha") - F.col("hb")), 1.0).otherwise(0.0)
    return means.agg(metrics.correlation("metric", "human").alias("pearson")).crossJoin(F.broadcast(pairs.agg(F.count("*").alias("n_pairs"), F.avg(same).alias("accuracy"))))


def segment_pearson(rows: DataFrame, metric: str, human: str, by: list[str] | None = None) -> DataFrame:
    """by, n and pearson over all segments that have a human score."""
    ok = rows.where(finite(metric) & finite(human))
    return ok.groupBy(*(by or [])).agg(F.count("*").alias("n"), metrics.correlation(metric, human).alias("pearson"))


def tie_calibrated(rows: DataFrame, item: str, system: str, metric: str, human: str) -> DataFrame:
    """epsilon and accuracy: the pairs of systems' scores of one item that metric and humans order alike or both
    hold for equal, with metric differences up to epsilon as ties, at the epsilon of the best accuracy (the
    smallest of equals).

    All pairs of an item's systems are made, as the statistic is one of pairs. Of each distinct difference it is
    counted how many pairs it makes right or wrong as a tie; the running sum over all is one of range partitions.
    """
    ok = rows.where(finite(metric) & finite(human)).select(item, F.col(system).alias("s"), F.col(metric).cast("double").alias("m"), F.col(human).cast("double").alias("h"))
    a, b = (ok.select(item, *[F.col(c).alias(f"{c}{k}") for c in "smh"]) for k in "ab")
    pairs = a.join(b, item).where("sa < sb").select(F.abs(F.col("ma") - F.col("mb")).alias("d"), F.signum(F.col("ma") - F.col("mb")).alias("sm"), F.signum(F.col("ha") - F.col("hb")).alias("sh"))
    right, tied = (F.col("sm") == F.col("sh")) & (F.col("d") > 0), F.col("sh") == 0
    each = written(pairs.groupBy("d").agg(F.count("*").alias("n"), F.count_if(right).alias("ordered"), F.count_if(tied).alias("tied")), "differences")
    total = each.agg(F.sum("n").alias("pairs"), F.sum("ordered").alias("all_ordered"))
    gain = running_sum(each, [], [F.col("d")], F.col("tied") - F.col("ordered"), "before").withColumn("gain", F.col("before") + F.col("tied") - F.col("ordered"))
    zero = gain.sparkSession.createDataFrame([(0.0, 0)], "d double, gain long")
    best = gain.select("d", "gain").unionByName(zero).agg(F.max(F.struct("gain", (-F.col("d")).alias("d"))).alias("b"))
    return best.crossJoin(F.broadcast(total)).select((-F.col("b.d")).alias("epsilon"), ((F.col("all_ordered") + F.col("b.gain")) / F.col("pairs")).alias("accuracy"), F.col("pairs").alias("n_pairs"))


def soft_pairwise_accuracy(rows: DataFrame, item: str, system: str, metric: str, human: str, draws: int = 1024, seed: int = 42) -> DataFrame:
    """n_systems, n_items, n_pairs and accuracy: the mean over all pairs of systems of 1 - |p - q|, with p and q the one-sided p-values
    of the metric's and of humans' difference between two systems.

    p-values come from a paired permutation test: in each draw every item's difference keeps or changes its sign, by a hash of seed, item and
    draw, and p is the share of draws whose sum is no smaller than the sum there is. Signs are the same for all pairs, so a pair's
    sum is the difference of two systems' sums: each row is added to its system's sum of every draw, in tasks before the
    shuffle (32 draws from one hash), and pairs are made of systems alone. Items count that every system has both finite scores
    of; systems without any take no part. Draws are rounded up to whole hashes. Rows of one item and system are averaged.
    """
    blocks = -(-draws // 32)
    ok = rows.where(finite(metric) & finite(human)).groupBy(F.col(item).alias("item"), F.col(system).alias("system")).agg(F.avg(metric).alias("m"), F.avg(human).alias("h"))
    ok = written(ok, "segments")
    n = ok.agg(F.countDistinct("system").alias("__n"))
    whole = ok.groupBy("item").agg(F.count("*").alias("__k")).join(F.broadcast(n), F.expr("__k = __n")).select("item")
    ok = ok.join(whole, "item").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    bits = h32(seed, "sign", F.col("item"), F.col("block"))
    sums = []
    for name in ("m", "h"):
        sums.append(F.array(*[F.sum(F.when(F.shiftright("bits", k).bitwiseAND(1) == 1, F.col(name)).otherwise(-F.col(name))) for k in range(32)]).alias(f"{name}s"))
    sums = written(ok.withColumn("bits", bits).groupBy("system", "block").agg(*sums, F.sum("m").alias("m"), F.sum("h").alias("h"), F.count("*").alias("k")), "signed-sums")
    a, b = (sums.select("block", *[F.col(c).alias(f"{c}_{k}") for c in ("system", "ms", "hs", "m", "h", "k")]) for k in "ab")
    # systems are what takes part in a comparison: tens of rows for each block
    pairs = a.join(b, "block").where("system_a < system_b")
    above = lambda c: F.size(F.filter(F.zip_with(f"{c}s_a", f"{c}s_b", lambda x, y: x - y), lambda d: d >= F.col(f"{c}_a") - F.col(f"{c}_b")))
    per = pairs.groupBy("system_a", "system_b").agg((F.sum(above("m")) / (32 * blocks)).alias("p"), (F.sum(above("h")) / (32 * blocks)).alias("q"), F.max("k_a").alias("k"))
    out = per.agg(F.count("*").alias("n_pairs"), F.max("k").alias("n_items"), F.avg(1 - F.abs(F.col("p") - F.col("q"))).alias("accuracy"))
    return out.crossJoin(F.broadcast(sums.agg(F.countDistinct("system").alias("n_systems")))).select("n_systems", "n_items", "n_pairs", "accuracy")


def history(evaluations: DataFrame, run: str, step: str, values: list[str]) -> DataFrame:
    """evaluations with number (from 1 in each run, in the order of steps) and values as finite numbers or null."""
    from lamina.functions.text import finite_or_null

    rows = running_sum(evaluations.select(run, step, *[v for v in values if v not in (run, step)]), [run], [F.col(step)], F.lit(1), "__k").withColumn("number", F.col("__k") + 1)
    return rows.select(run, step, "number", *[finite_or_null(v).alias(v) for v in values])


def directed_accuracy(pairs: DataFrame, by: list[str], chosen: str, rejected: str, chosen_text: str, rejected_text: str) -> DataFrame:
    """Accuracy by whether the better text is the shorter one: by, direction (shorter, longer or equal), n and
    accuracy (equal scores count half)."""
    a, b = F.length(chosen_text), F.length(rejected_text)
    rows = pairs.withColumn("direction", F.when(a < b, "shorter").when(a > b, "longer").otherwise("equal"))
    return metrics.pairwise_accuracy(rows, [*by, "direction"], chosen, rejected, 0.0).drop("tie_rate")
