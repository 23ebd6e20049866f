"""Ranking, correlation, preference and aggregate statistics, by group.

Degenerate groups give null where a statistic isn't defined. Group columns may be empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.draws import below
from lamina.functions.ordering import numbered, parts, quantiles, running_sum, written
from lamina.functions.text import finite, finite_or_null, length_difference

#: Checks of a run that one task folds at once.
CHECKS = 4096


def average_ranks(cells: DataFrame, by: list[str], x: str, n: str, name: str, descending: bool = False) -> DataFrame:
    """by, x and rank of each distinct value, of cells with a count n: from 1, equal values share the mean of
    their ranks. Counts are summed in order by range partitions, so no task holds a group."""
    values = cells.groupBy(*by, x).agg(F.sum(n).alias("__m"))
    order = F.col(x).desc() if descending else F.col(x).asc()
    return running_sum(values, by, [order], F.col("__m"), "__b").select(*by, x, (F.col("__b") + (F.col("__m") + 1) / 2).alias(name))


def correlation(a: str, b: str) -> Column:
    """Pearson's, null where a side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def _on(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return a.join(b, by) if by else a.crossJoin(F.broadcast(b))


def _finite_pairs(rows: DataFrame, by: list[str], a: str, b: str, weight: str | None = None) -> DataFrame:
    """by, __x, __y and their number __c, of finite pairs; a row counts as often as its weight says."""
    n = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    ok = rows.where(finite(a) & finite(b)).select(*by, F.col(a).cast("double").alias("__x"), F.col(b).cast("double").alias("__y"), n.alias("__w"))
    return ok.groupBy(*by, "__x", "__y").agg(F.sum("__w").alias("__c"))


def spearman(rows: DataFrame, by: list[str], label: str, score: str, weight: str | None = None) -> DataFrame:
    """by, n and spearman of each group's pairs of finite numbers, each as often as its weight (a column of whole numbers above 0) says;
    null for fewer than two or a constant side. Equal pairs are counted first; ranks are those of distinct values."""
    cells = written(_finite_pairs(rows, by, label, score, weight), "cells")
    for x in ("__x", "__y"):
        cells = cells.join(average_ranks(cells, by, x, "__c", f"__r{x}"), [*by, x])
    totals = cells.groupBy(*by).agg(F.sum("__c").alias("n"))
    cells = _on(cells, totals, by)
    # the mean of all ranks is (n + 1) / 2: sums of what is left are exact enough at any n
    a, b = (F.col(f"__r{x}") - (F.col("n") + 1) / 2 for x in ("__x", "__y"))
    c = F.col("__c")
    sums = cells.groupBy(*by).agg(F.max("n").alias("n"), F.sum(c * a * b).alias("__ab"), F.sum(c * a * a).alias("__aa"), F.sum(c * b * b).alias("__bb"))
    sums = sums if by else sums.where("n is not null")
    return sums.select(*by, "n", F.try_divide(F.col("__ab"), F.sqrt("__aa") * F.sqrt("__bb")).alias("spearman"))


def kendall(rows: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """by, n and tau-b of each group's pairs of finite numbers.

    Discordant pairs are counted without making pairs: values are ranked, and for every bit of the
    score's rank a running sum over rows with the same higher bits counts, in the order of the label,
    how many ones come before each zero. That is n log n rows, summed by range partitions.
    """
    cells = written(_finite_pairs(rows, by, label, score).withColumnRenamed("__c", "__n"), "cells")
    values = running_sum(cells.select(*by, "__y").distinct(), by, [F.col("__y")], F.lit(1), "__k")
    values = written(values, "ranks")
    tops = values.groupBy(*by).agg(F.max("__k").alias("__top"))
    dense = _on(cells.join(values, [*by, "__y"]), tops, by)
    width = F.length(F.conv(F.greatest("__top", F.lit(1)).cast("string"), 10, 2))
    bits = dense.withColumn("__bit", F.explode(F.sequence(F.lit(0), width - 1)))
    bits = bits.withColumns({"__high": F.expr("shiftright(__k, __bit + 1)"), "__one": F.expr("shiftright(__k, __bit) & 1")})
    # rows of equal labels are neither concordant nor discordant: only smaller labels count
    at = [*by, "__bit", "__high"]
    runs = bits.groupBy(*at, "__x").agg(F.sum(F.when(F.col("__one") == 1, F.col("__n")).otherwise(0)).alias("__ones"), F.sum(F.when(F.col("__one") == 0, F.col("__n")).otherwise(0)).alias("__zeros"))
    runs = running_sum(runs, at, [F.col("__x")], F.col("__ones"), "__before")
    worse = runs.groupBy(*by).agg(F.sum(F.col("__zeros") * F.col("__before")).alias("__worse"))
    half = lambda n: n * (n - 1) / 2

    def ties(*on: str) -> DataFrame:
        return cells.groupBy(*by, *on).agg(F.sum("__n").alias("__t")).groupBy(*by).agg(F.sum(half(F.col("__t"))).alias("__" + "".join(on).strip("_") + "_ties"))

    total = cells.groupBy(*by).agg(F.sum("__n").alias("n"))
    for p in (ties("__x"), ties("__y"), ties("__x", "__y"), worse):
        total = _on(total, p, by)
    total = total if by else total.where("n is not null")
    pairs = half(F.col("n"))
    better = pairs - F.col("__x_ties") - F.col("__y_ties") + F.col("__x__y_ties") - F.col("__worse")
    root = F.sqrt(pairs - F.col("__x_ties")) * F.sqrt(pairs - F.col("__y_ties"))
    return total.select(*by, "n", F.try_divide(better - F.col("__worse"), root).alias("kendall"))


def preference(rows: DataFrame, by: list[str], preferred: str, dispreferred: str, human_tie: str | None = None) -> DataFrame:
    """n, strict_accuracy, tie_aware_accuracy, tie_rate, mean_delta and median_delta of scored pairs.
    A win is a positive difference without a human tie; ties are human ones and equal scores."""
    ok = rows.where(finite(preferred) & finite(dispreferred))
    d = F.col(preferred).cast("double") - F.col(dispreferred).cast("double")
    tied = F.coalesce(F.col(human_tie), F.lit(False)) if human_tie else F.lit(False)
    ok = ok.select(*by, d.alias("__d"), tied.alias("__tied"))
    win = F.when((F.col("__d") > 0) & ~F.col("__tied"), 1.0).otherwise(0.0)
    tie = F.when(F.col("__tied") | (F.col("__d") == 0), 1.0).otherwise(0.0)
    means = ok.groupBy(*by).agg(F.count("*").alias("n"), F.avg(win).alias("strict_accuracy"), F.avg(win + 0.5 * tie).alias("tie_aware_accuracy"), F.avg(tie).alias("tie_rate"), F.avg("__d").alias("mean_delta"))
    return _on(means, quantiles(ok, by, "__d", {"median_delta": 0.5}), by)


def pairwise_accuracy(rows: DataFrame, by: list[str], chosen: str, rejected: str, tolerance: float = 1e-6) -> DataFrame:
    """n, accuracy (a tie within the tolerance counts half) and tie_rate."""
    d = F.col(chosen) - F.col(rejected)
    tie = F.abs(d) <= tolerance
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.when(tie, 0.5).when(d > 0, 1.0).otherwise(0.0)).alias("accuracy"), F.avg(F.when(tie, 1.0).otherwise(0.0)).alias("tie_rate"))


def regression(rows: DataFrame, by: list[str], target: str, prediction: str) -> DataFrame:
    """n, mae, rmse, pearson and spearman of pairs of finite numbers; correlations that aren't defined are 0."""
    ok = rows.where(finite(target) & finite(prediction)).select(*by, F.col(target).cast("double").alias("__t"), F.col(prediction).cast("double").alias("__p"))
    d = F.col("__t") - F.col("__p")
    sums = ok.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.coalesce(correlation("__t", "__p"), F.lit(0.0)).alias("pearson"))
    return _on(sums, spearman(ok, by, "__t", "__p").select(*by, F.coalesce("spearman", F.lit(0.0)).alias("spearman")), by)


def binary_accuracy(rows: DataFrame, by: list[str], label: str, logit: str) -> DataFrame:
    """n and accuracy of sigmoid(logit) >= 0.5."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.when((F.col(logit) >= 0) == (F.col(label) >= 0.5), 1.0).otherwise(0.0)).alias("accuracy"))


def macro_average(dimensions: DataFrame, metric: str, categories: str = "categories", family: str = "task_family") -> DataFrame:
    """Means of finite dimension metrics by family and by category, and the mean of the category means:
    level, name, value and n_dimensions (which counts undefined ones as well)."""
    m = finite_or_null(metric)
    by_family = dimensions.groupBy(F.col(family).alias("name")).agg(F.avg(m).alias("value"), F.count("*").alias("n_dimensions")).withColumn("level", F.lit("task"))
    each = dimensions.withColumn("name", F.explode(categories)).groupBy("name").agg(F.avg(m).alias("value"), F.count("*").alias("n_dimensions")).withColumn("level", F.lit("category"))
    overall = each.agg(F.avg("value").alias("value")).crossJoin(F.broadcast(dimensions.agg(F.count("*").alias("n_dimensions")))).withColumns({"level": F.lit("overall"), "name": F.lit("overall")})
    cols = ["level", "name", "value", "n_dimensions"]
    return by_family.select(cols).unionByName(each.select(cols)).unionByName(overall.select(cols)).withColumn("name", F.replace("name", F.lit(" "), F.lit("_")))


def draws_of_groups(sums: DataFrame, samples: int, seed: int) -> DataFrame:
    """__sample (from 1), __g and the number of times that a sample draws the group: draw d of sample s takes
    the group with the number h32(seed, s, d) mod groups. sums: a row for each group, numbered by __g."""
    groups = sums.count()
    draws = sums.sparkSession.range(samples * groups)
    at = (F.floor(F.col("id") / F.lit(max(groups, 1))) + 1).alias("__sample"), (F.col("id") % F.lit(max(groups, 1)) + 1).alias("__draw")
    draws = draws.select(*at).withColumn("__g", below(F.lit(max(groups, 1)), seed, F.col("__sample"), F.col("__draw")))
    return draws.groupBy("__sample", "__g").agg(F.count("*").alias("__times"))


def bootstrap(rows: DataFrame, group: str, value: str, samples: int = 1000, seed: int = 42) -> DataFrame:
    """Mean of value and its 95 % interval over `samples` resamplings of whole groups.

    Samples are made by a join of the draws, which are dealt over all tasks, with sums of groups, not row
    by row.
    """
    sums = rows.where(finite(value)).groupBy(group).agg(F.sum(value).alias("__s"), F.count("*").alias("__n"))
    sums = written(numbered(sums, F.col(group), name="__g"), "groups")
    means = draws_of_groups(sums, samples, seed).join(sums, "__g").groupBy("__sample").agg((F.sum(F.col("__s") * F.col("__times")) / F.sum(F.col("__n") * F.col("__times"))).alias("__mean"))
    limits = means.agg(F.percentile("__mean", F.lit(0.025)).alias("low"), F.percentile("__mean", F.lit(0.975)).alias("high"))
    return sums.agg((F.sum("__s") / F.sum("__n")).alias("mean")).crossJoin(limits)


def bootstrap_of(rows: DataFrame, group: str, columns: list[str], statistic: Callable[[DataFrame, list[str], str], DataFrame], name: str, samples: int = 1000, seed: int = 42) -> DataFrame:
    """As `bootstrap`, for any statistic of some columns: a function of rows, grouping columns and a column of weights that gives
    one row with the column `name` for each group of rows, such as `spearman`. Samples in which it isn't defined don't count.

    Returns one row: name, low and high. A group's equal rows are counted once for all samples; a sample takes these cells of the groups that
    it draws, with the number of draws as a factor of their weight, and copies no row.
    """
    weight = "__weight"
    cells = written(rows.where(F.col(group).isNotNull()).groupBy(group, *columns).agg(F.count("*").alias(weight)), "bootstrap-cells")
    groups = written(numbered(cells.select(group).distinct(), F.col(group), name="__g"), "groups")
    draws = draws_of_groups(groups, samples, seed).join(groups, "__g").select("__sample", group, "__times")
    each = cells.join(draws, group).withColumn(weight, F.col(weight) * F.col("__times"))
    each = statistic(each, ["__sample"], weight).where(finite(name))
    limits = each.agg(F.percentile(name, F.lit(0.025)).alias("low"), F.percentile(name, F.lit(0.975)).alias("high"))
    return statistic(cells, [], weight).select(name).crossJoin(limits)


def leaderboard(records: DataFrame, model: str, dataset: str, metrics: list[str], newest: str) -> DataFrame:
    """Models by mean rank over datasets: each model's newest record of a dataset, its mean metric, ranked
    within the dataset (1 the highest), then mean and worst rank. Ordered by them and by name. A newest record
    that lacks a metric is an error."""
    last = F.max(F.struct(newest, *metrics))
    rows = records.groupBy(model, dataset).agg(last.alias("r"))
    lacks = reduce(lambda a, b: a | b, [~finite(f"r.{m}") for m in metrics])
    mean = sum((F.col(f"r.{m}") for m in metrics[1:]), F.col(f"r.{metrics[0]}")) / len(metrics)
    mean = F.when(lacks, F.raise_error(F.concat(F.lit("a metric is missing: "), F.col(model).cast("string"), F.lit(" "), F.col(dataset).cast("string"))).cast("double")).otherwise(mean)
    rows = written(rows.select(model, dataset, mean.alias("__mean"), F.lit(1).alias("__c")), "records")
    ranked = rows.join(average_ranks(rows, [dataset], "__mean", "__c", "__rank", descending=True), [dataset, "__mean"])
    return ranked.groupBy(model).agg(F.avg("__rank").alias("mean_rank"), F.max("__rank").alias("worst_rank"), F.count("*").alias("n_datasets")).orderBy("mean_rank", "worst_rank", model)


def equal_count_bins(rows: DataFrame, order: list[Column], k: int, name: str = "bin") -> DataFrame:
    """rows with their bin: of n rows in the given (total) order, bin b has those from b * n / k to
    (b + 1) * n / k; k is at most n."""
    return parts(rows, order, F.expr(f"transform(filter(sequence(0, {k - 1}), b -> b > 0 and b < __n), b -> (b * __n) div least({k}, __n))"), name)


def binned_accuracy(pairs: DataFrame, chosen: str, rejected: str, chosen_score: str, rejected_score: str, id_col: str, k: int) -> DataFrame:
    """Accuracy by equal-count bins of the relative length difference of the two texts: bin, n, least,
    greatest and mean difference, accuracy."""
    rows = pairs.withColumn("__d", length_difference(chosen, rejected))
    rows = equal_count_bins(rows, [F.col("__d"), F.col(id_col)], k)
    right = F.when(F.col(chosen_score) > F.col(rejected_score), 1.0).otherwise(0.0)
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.min("__d").alias("least"), F.max("__d").alias("greatest"), F.avg("__d").alias("mean"), F.avg(right).alias("accuracy"))


def ranking_loss(pairs: DataFrame, by: list[str], better: str, worse: str, kind: str = "logistic", scale: float = 1.0, margin: float = 1.0, weight: str | None = None) -> DataFrame:
    """Mean loss of scored pairs: logistic log(1 + exp(-scale * difference)) or hinge; no pairs give no row."""
    d = (F.col(better) - F.col(worse)) * scale
    loss = F.greatest(F.lit(0.0), -d) + F.log1p(F.exp(-F.abs(d))) if kind == "logistic" else F.greatest(F.lit(0.0), margin - d)
    w = F.col(weight) if weight else F.lit(1.0)
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(loss * w) / F.sum(w)).alias("loss"))


def regression_loss(rows: DataFrame, by: list[str], target: str, prediction: str, kind: str = "huber", delta: float = 1.0) -> DataFrame:
    d = F.abs(F.col(target) - F.col(prediction))
    loss = {"mae": d, "mse": d * d, "huber": F.when(d <= delta, 0.5 * d * d).otherwise(delta * (d - 0.5 * delta))}[kind]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(loss).alias("loss"))


def early_stops(history: DataFrame, by: list[str], step: str, metric: str, patience: int, threshold: float = 0.0, least_examples: int = 0) -> DataFrame:
    """Of each run: best, best_step and stop_step (null if it isn't stopped). A finite metric over best +
    threshold is an improvement; `patience` finite checks in a row without one stop the run. Checks at a
    step below least_examples improve but don't count against the run.

    Runs are folded in blocks of CHECKS checks: a block's fold starts from the state that the block before
    leaves, so a run of any length passes through tasks of bounded size, at one round for each block of the
    longest run that isn't stopped by then. A block's checks lie in a folder of their own, so each is read once.
    """
    rows = history.where(finite(metric)).select(*by, F.col(step).alias("__s"), F.col(metric).cast("double").alias("__m"))
    rows = running_sum(rows, by, [F.col("__s"), F.col("__m")], F.lit(1), "__i").withColumn("__block", F.floor(F.col("__i") / CHECKS).cast("int"))
    rows = written(rows, "checks", ["__block"])
    last = rows.groupBy(*by).agg(F.max("__block").alias("__last"))
    blocks = (last.agg(F.max("__last").alias("b")).first()["b"] or 0) + 1
    kind = "struct<best:double,at:bigint,bad:int,stop:bigint>"
    zero = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("long").alias("at"), F.lit(0).alias("bad"), F.lit(None).cast("long").alias("stop"))

    def fold(acc: Column, x: Column) -> Column:
        up = acc["best"].isNull() | (x["__m"] > acc["best"] + threshold)
        bad = F.when(up, 0).when(x["__s"] < least_examples, acc["bad"]).otherwise(acc["bad"] + 1)
        new = F.struct(F.when(up, x["__m"]).otherwise(acc["best"]).alias("best"), F.when(up, x["__s"].cast("long")).otherwise(acc["at"]).alias("at"), bad.alias("bad"), F.when(bad >= patience, x["__s"].cast("long")).alias("stop"))
        return F.when(acc["stop"].isNotNull(), acc).otherwise(new).cast(kind)

    state = None
    for k in range(blocks):
        own = rows.where(F.col("__block") == k).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__i", "__s", "__m"))).alias("__seq"))
        if state is None:
            same = reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"l.{c}")) for c in by], F.lit(True))
            state = own.alias("s").join(last.alias("l"), same).select(*[F.col(f"s.{c}") for c in by], F.col("l.__last"), F.aggregate("__seq", zero.cast(kind), fold).alias("e"))
        else:
            # a block of many runs isn't for the driver to hand round
            new = state.join(own.hint("merge"), by, "left")
            state = new.select(*by, "__last", F.aggregate(F.coalesce("__seq", F.array().cast(own.schema["__seq"].dataType)), F.col("e"), fold).alias("e"))
        state = written(state, "stops")
        if state.where(F.col("e.stop").isNull() & (F.col("__last") > k)).isEmpty():
            break
    return state.select(*by, F.col("e.best").alias("best"), F.col("e.at").alias("best_step"), F.col("e.stop").alias("stop_step"))
