"""Trials of a search over settings: grids, schedules, objectives, comparison."""

from __future__ import annotations

import re
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.text import finite

#: Names of losses (fixed values).
PAIRWISE_LOSSES = {"logistic": "logistic", "pairwise_logistic": "logistic", "hinge": "hinge", "margin": "hinge", "weighted_logistic": "weighted_logistic", "logistic_weighted": "weighted_logistic", "weighted-logistic": "weighted_logistic"}
REGRESSION_LOSSES = {"huber": "huber", "smooth_l1": "huber", "smoothl1": "huber", "mse": "mse", "mae": "mae", "l1": "mae"}
#: Keys of an objective, in the order in which they are looked for (fixed values).
OBJECTIVES = ("hpo_dev_pairwise_accuracy", "hpo_dev_binary_accuracy", "hpo_dev_accuracy", "hpo_dev_pairwise_accuracy", "hpo_dev_spearman", "hpo_dev_acc", "hpo_dev_mean_pairwise_accuracy")
#: What a setting is where neither grid nor defaults give it, and by which setting a loss's trials are named (fixed values).
_SETTINGS = {"warmup_ratio": 0.03, "weight_decay": 0.01, "num_train_epochs": 1, "gradient_accumulation_steps": 1}
SETTINGS = {"pairwise": {**_SETTINGS, "epsilon": 0.2, "scale": 5.0}, "regression": _SETTINGS, "binary": _SETTINGS}
NAMED_BY = {"hinge": ("margin", "epsilon"), "huber": ("delta", "huber_delta"), "binary": (None, None), "mae": (None, None), "mse": (None, None)}
TRIAL_KEYS = ("trial_id", "trial_name", "loss", "learning_rate", "warmup_ratio", "weight_decay", "num_train_epochs", "per_device_train_batch_size", "gradient_accumulation_steps")


def loss_name(name: str | None, kind: str = "pairwise") -> str:
    """The one name of a loss; null is the kind's default."""
    table = {"pairwise": PAIRWISE_LOSSES, "regression": REGRESSION_LOSSES}[kind]
    key = next(iter(table)) if name is None else str(name).strip().lower()
    if key not in table:
        raise ValueError(f"unknown loss {name!r}; there are {sorted(table)}")
    return table[key]


def trial_grid(spark: SparkSession, payload: dict, kind: str = "pairwise") -> DataFrame:
    """The trials of {"defaults", "grid", "losses": {loss: axes of its own}} as a table: trial_id, trial_name, loss and a column for
    each setting, null where a loss has none.

    Axes are exploded one after another; a trial's number is its place in that mixed radix, from 1 on behind the losses
    before. Its name is number, loss, rate, the loss's own setting and batch size.
    """
    fixed = {**SETTINGS[kind], **payload.get("defaults", {})}
    tables, before = [], 0
    for loss, own in payload["losses"].items():
        axes = {**payload["grid"], **own}
        axes |= {k: [v] for k, v in fixed.items() if k not in axes}
        count = prod(map(len, axes.values()))
        table = spark.range(1).select(F.lit(loss).alias("loss"), F.lit(before + 1).alias("trial_id"))
        weight = count
        for axis, values in axes.items():
            weight //= len(values)
            shown = F.array(*[F.lit(f"{v:g}" if isinstance(v, int | float) else str(v)) for v in values])
            table = table.select("*", F.posexplode(F.array(*map(F.lit, values))).alias("__at", axis))
            table = table.withColumns({"trial_id": F.col("trial_id") + F.col("__at") * weight, f"__{axis}": F.get(shown, F.col("__at"))}).drop("__at")
        word, setting = NAMED_BY.get(REGRESSION_LOSSES.get(loss) or PAIRWISE_LOSSES.get(loss, loss), ("scale", "scale"))
        named = F.lit("") if word is None else F.concat(F.lit(word), F.col(f"__{setting}") if setting in axes else F.lit("1" if setting == "huber_delta" else "0"), F.lit("_"))
        says = F.format_string("%03d_%s_lr%s_%sbs%s", "trial_id", "loss", "__learning_rate", named, "__per_device_train_batch_size")
        tables.append(table.withColumn("trial_name", says).drop(*[f"__{x}" for x in axes]))
        before += count
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tables)


def trial_fault(trial: dict, kind: str = "pairwise") -> str | None:
    """What a trial lacks or has wrong, None if nothing."""
    need = (*TRIAL_KEYS, *(("epsilon", "scale") if kind == "pairwise" else ()))
    if lacking := sorted(k for k in need if k not in trial):
        return f"missing {lacking}"
    losses = {"binary": {"binary": "binary"}, "regression": REGRESSION_LOSSES}.get(kind, {**PAIRWISE_LOSSES, "margin_ranking": "hinge"})
    if trial["loss"] not in losses:
        return f"unknown loss {trial['loss']!r}"
    delta = trial.get("huber_delta", 1.0)
    return "huber_delta" if losses[trial["loss"]] == "huber" and not 0 < float(delta) < float("inf") else None


def grid_table(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """All combinations of some values, a column for each name: for grids that are joined with data."""
    frames = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in axes.items()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


def example_schedule(save: Column, evaluate: Column, batch: Column, accumulation: Column | None = None, devices: Column | None = None) -> Column:
    """Intervals in examples as a struct of whole steps: global_batch_size, eval_steps, save_steps, effective_eval_examples and
    effective_save_examples; null where neither interval is given. One interval alone, a number below 1, and saves that
    aren't a multiple of evaluations are errors. Steps are rounded, halves to even, and at least 1."""
    one = F.lit(1)
    size = batch * (one if accumulation is None else accumulation) * (one if devices is None else devices)
    parts = [x for x in (save, evaluate, batch, accumulation, devices) if x is not None]
    sound = reduce(lambda a, b: a & b, [x >= 1 for x in parts]) & (F.try_mod(save, evaluate) == 0)
    steps = F.greatest(one.cast("long"), F.bround(evaluate / size).cast("long"))
    saves = steps * F.floor(save / evaluate)
    found = F.struct(size.cast("long").alias("global_batch_size"), steps.alias("eval_steps"), saves.alias("save_steps"), (steps * size).alias("effective_eval_examples"), (saves * size).alias("effective_save_examples"))
    kind = "struct<global_batch_size:bigint,eval_steps:bigint,save_steps:bigint,effective_eval_examples:bigint,effective_save_examples:bigint>"
    fault = F.raise_error(F.lit("both intervals are positive, and saves a multiple of evaluations")).cast(kind)
    return F.when(save.isNull() & evaluate.isNull(), F.lit(None).cast(kind)).when(F.coalesce(sound, F.lit(False)), found.cast(kind)).otherwise(fault)


def objective(metrics: DataFrame, key: str | None = None, by: str = "trial") -> DataFrame:
    """by, key and value of each trial's objective, of metrics in long form (by, ordinal, key, value): the first
    finite one of the given key and OBJECTIVES; else the first finite hpo_dev_ metric in order of ordinal."""
    keys = [*([key] if key else []), *OBJECTIVES]
    first = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    place = F.when(first > 0, first).when(F.col("key").startswith("hpo_dev_"), F.lit(len(keys) + 1))
    ok = metrics.where(finite("value")).withColumn("__place", place).where("__place is not null")
    return ok.groupBy(by).agg(F.min(F.struct("__place", "ordinal", "key", "value")).alias("b")).select(by, "b.key", F.col("b.value").cast("double").alias("value"))


def compared(scores: DataFrame, trial: str, loss: str, columns: list[str]) -> DataFrame:
    """scores with mean_score, place (by mean score, the highest first, then name) and best_of_loss. Scores that
    aren't finite are an error. Trials are a small table."""
    from pyspark.sql import Window

    lacks = reduce(lambda a, b: a | b, [~finite(c) for c in columns])
    mean = sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns)
    mean = F.when(lacks, F.raise_error(F.concat(F.lit("scores aren't finite: "), F.col(trial).cast("string"))).cast("double")).otherwise(mean)
    order = [F.desc("mean_score"), F.col(trial)]
    out = scores.withColumn("mean_score", mean).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return out.withColumn("best_of_loss", F.row_number().over(Window.partitionBy(loss).orderBy(*order)) == 1)


def run_name_parts(name: Column | str) -> Column:
    """struct(model, language, kind, layers, dataset) of model_language_kind[_layers]; without a number at the end
    (one whose first character is a digit) layers is "5"."""
    c = F.col(name) if isinstance(name, str) else name
    parts = F.split(c, "_", 3)
    rest = F.coalesce(F.get(parts, F.lit(2)), F.lit(""))
    last = F.element_at(F.split(rest, "_"), -1)
    numbered = last.rlike(r"^\p{N}")
    head = F.when(F.contains(rest, F.lit("_")), F.substring(rest, F.lit(1), F.length(rest) - F.length(last) - 1)).otherwise(F.substring(rest, F.lit(1), F.length(rest) - 1))
    return F.struct(parts[0].alias("model"), F.get(parts, F.lit(1)).alias("language"), F.when(numbered, head).otherwise(rest).alias("kind"), F.when(numbered, last).otherwise("5").alias("layers"), rest.alias("dataset"))


def _file_numbers(paths: DataFrame, prefix: str, suffix: str, path: str) -> DataFrame:
    """Each row's path and the number in its file's name prefix<number>suffix, where it has one."""
    number = F.regexp_extract(F.element_at(F.split(path, "/"), -1), f"^{re.escape(prefix)}([0-9]+){re.escape(suffix)}$", 1).try_cast("long")
    return paths.select(F.col(path), number.alias("number")).where("number is not null")


def next_number(paths: DataFrame, prefix: str, suffix: str = "", path: str = "path") -> int:
    """The smallest number from the count of prefix<number>suffix on that none of the file names has. It is the count itself, or
    follows a number that is taken without its successor; only that least one reaches the driver."""
    taken = _file_numbers(paths, prefix, suffix, path).select("number").distinct()
    count = taken.count()
    late = taken.where(F.col("number") >= count)
    free = late.select((F.col("number") + 1).alias("number")).unionByName(taken.sparkSession.createDataFrame([(count,)], "number long"))
    return free.join(late, "number", "left_anti").agg(F.min("number")).first()[0]


def latest_number(paths: DataFrame, prefix: str, suffix: str = "", path: str = "path") -> DataFrame:
    """path and number of the file prefix<number>suffix with the highest number; no row if there is none."""
    rows = _file_numbers(paths, prefix, suffix, path)
    return rows.agg(F.max(F.struct("number", path)).alias("b")).where("b is not null").select(F.col(f"b.{path}").alias(path), F.col("b.number").alias("number"))


def checkpoint_order(name: Column | str) -> Column:
    """A key by which checkpoints stand in the order of their steps, "final" after all."""
    c = F.col(name) if isinstance(name, str) else name
    return F.struct((c == "final").alias("final"), F.coalesce(F.regexp_extract(c, r"([0-9]+)$", 1).try_cast("long"), F.lit(-1)).alias("step"), c.alias("name"))
