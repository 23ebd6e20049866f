"""Score tasks, scorers, retries and score tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.draws import order_key
from lamina.functions.ordering import numbered, running_sum, written
from lamina.functions.text import finite

#: A scorer gets a frame of tasks and returns one number for each row; it may raise.
Scorer = Callable[[pd.DataFrame], "pd.Series | list[float]"]


#: name -> a scorer.
SCORERS: dict[str, Scorer] = {}


def register_scorer(name: str, scorer: Scorer) -> None:
    """Adds a scorer; a name is taken once."""
    if name in SCORERS:
        raise ValueError(f"the scorer {name!r} is there already")
    SCORERS[name] = scorer


def scorer(name: str) -> Scorer:
    if name not in SCORERS:
        raise LookupError(f"no scorer {name!r}; there are {sorted(SCORERS)}")
    return SCORERS[name]


def attach(items: DataFrame, scores: DataFrame, methods: list[str]) -> DataFrame:
    """items with a column for each scoring method; items without a score keep null. Scores of other
    candidates don't matter."""
    wide = scores.where(F.col("scoring_method").isin(methods)).groupBy("candidate_id").pivot("scoring_method", methods).agg(F.max("score_value"))
    return items.join(wide, "candidate_id", "left")


def repeated_scores(scores: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates of items that several runs of one method score: candidate_id, scoring_method, n."""
    known = scores.join(items.select("candidate_id").distinct(), "candidate_id", "left_semi")
    return known.groupBy("candidate_id", "scoring_method").agg(F.count("*").alias("n")).where("n > 1")


def eligible_chains(items: DataFrame, methods: list[str], chain: list[str]) -> DataFrame:
    """Chains with at least one item that has all scores; their unscored items stay."""
    full = F.lit(True)
    for m in methods:
        full = full & F.col(m).isNotNull()
    return items.join(items.where(full).select(*chain).distinct(), chain, "left_semi")


def tasks(candidates: DataFrame, originals: DataFrame, policy: str = "original") -> DataFrame:
    """Each candidate with its reference text: its source's original, or its exact parent (the original
    where source_layer is 0). A candidate whose reference isn't there has a null reference_text."""
    if policy not in ("original", "parent"):
        raise ValueError(f"unknown reference policy {policy!r}")
    first = F.concat_ws("__", F.lit("original"), "dataset_name", F.concat(F.lit("base_"), F.col("base_text_id")))
    texts = originals.select(first.alias("reference_candidate_id"), F.col("text").alias("reference_text")).unionByName(candidates.select(F.col("candidate_id").alias("reference_candidate_id"), F.col("text").alias("reference_text")))
    reference = first if policy == "original" else F.when(F.col("source_layer") == 0, first).otherwise(F.col("parent_candidate_id"))
    return candidates.withColumn("reference_candidate_id", reference).join(texts, "reference_candidate_id", "left")


def scored(tasks: DataFrame, scorer: Scorer, id_col: str, batch: int = 256) -> DataFrame:
    """id_col, score_value, error_type and error_message of every task.

    A scorer gets `batch` rows at once. If it raises, the batch is halved until the bad rows stand
    alone, so each error is one row's and the others keep their scores. Scores that aren't finite are errors.
    """
    kind = tasks.schema[id_col].dataType.simpleString()

    def isolate(rows: pd.DataFrame) -> list[tuple]:
        try:
            values = [float(v) for v in scorer(rows)]
            if len(values) != len(rows):
                raise ValueError(f"{len(values)} scores for {len(rows)} rows")
        except Exception as e:
            if len(rows) == 1:
                return [(rows[id_col].iloc[0], None, type(e).__name__, str(e))]
            half = len(rows) // 2
            return isolate(rows.iloc[:half]) + isolate(rows.iloc[half:])
        fine = float("-inf"), float("inf")
        return [(i, v, None, None) if fine[0] < v < fine[1] else (i, None, "ValueError", "the score isn't finite") for i, v in zip(rows[id_col], values, strict=True)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [r for at in range(0, len(frame), batch) for r in isolate(frame.iloc[at : at + batch])]
            yield pd.DataFrame(out, columns=[id_col, "score_value", "error_type", "error_message"])

    return tasks.mapInPandas(run, f"`{id_col}` {kind}, score_value double, error_type string, error_message string")


def retried(tasks: DataFrame, scorer: Scorer, id_col: str, rounds: int = 100) -> DataFrame:
    """As `scored`, with failed tasks tried again until all have a score or the rounds are over. Each
    round is written, and only the pending tasks go into the next."""
    done = written(scored(tasks, scorer, id_col), "scores")
    for _ in range(rounds - 1):
        failed = done.where("error_type is not null")
        if failed.isEmpty():
            break
        again = scored(tasks.join(failed.select(id_col), id_col, "left_semi"), scorer, id_col)
        done = written(done.where("error_type is null").unionByName(again), "scores")
    return done


def distinct_scored(rows: DataFrame, key: list[str], scorer: Scorer) -> DataFrame:
    """rows with score_value: each distinct key is scored once and the score joined back. Null keys get null."""
    name = "__key"
    hashed = F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256)
    unique = rows.select(hashed.alias(name), *key).dropDuplicates([name])
    values = written(scored(unique, scorer, name).select(name, "score_value"), "distinct-scores")
    return rows.withColumn(name, hashed).join(values, name, "left").drop(name)


def pending(items: DataFrame, attempted: DataFrame, on: str) -> DataFrame:
    """Items that haven't been attempted."""
    return items.join(attempted.select(on).distinct(), on, "left_anti")


def retry_tasks(tasks: DataFrame, errors: DataFrame, on: str) -> DataFrame:
    """Tasks that have an error row."""
    return tasks.join(errors.select(on).distinct(), on, "left_semi")


def coverage_faults(tasks: DataFrame, done: DataFrame, errors: DataFrame, on: str) -> DataFrame:
    """Tasks that aren't in exactly one of done and errors, and rows there that are no task: on and fault."""
    seen = done.select(on, F.lit(1).alias("d"), F.lit(0).alias("e")).unionByName(errors.select(on, F.lit(0).alias("d"), F.lit(1).alias("e")))
    per = seen.groupBy(on).agg(F.sum("d").alias("d"), F.sum("e").alias("e"), F.lit(True).alias("seen"))
    both = tasks.select(on, F.lit(True).alias("task")).distinct().join(per, on, "full")
    fault = F.when(F.col("task").isNull(), "unknown").when(F.col("seen").isNull(), "missing").when(F.col("d") + F.col("e") != 1, "repeated")
    return both.withColumn("fault", fault).where("fault is not null").select(on, "fault")


def chunks(tasks: DataFrame, key: list[str], size: int, order: str) -> DataFrame:
    """Requests without repeats in chunks of `size`: logical_key (SHA-256 of the key columns), `order` and chunk."""
    logical = F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256)
    unique = tasks.groupBy(logical.alias("logical_key")).agg(F.min(order).alias(order))
    return numbered(unique, F.col(order), F.col("logical_key"), name="__i").withColumn("chunk", F.floor(F.col("__i") / size).cast("int")).drop("__i")


def sized_chunks(requests: DataFrame, order: str, body: str, most_rows: int, most_bytes: int) -> DataFrame:
    """requests with custom_id (`request-` and a number in the given order) and chunk: at most most_rows
    requests and most_bytes bytes of body in each. A request of more than half of that is an error."""
    size = F.octet_length(body)
    large = F.raise_error(F.concat(F.lit("a request is too large: "), F.col(order).cast("string"))).cast("int")
    rows = requests.withColumn("__bytes", F.when(size > most_bytes // 2, large).otherwise(size))
    rows = running_sum(rows, [], [F.col(order)], F.lit(1), "__i")
    rows = running_sum(rows, [], [F.col(order)], F.col("__bytes"), "__upto")
    # a block of most_rows is cut again where its bytes pass a multiple of half the limit
    block = F.floor(F.col("__i") / most_rows)
    begins = rows.groupBy(block.alias("__block")).agg(F.min("__upto").alias("__from"))
    part = F.floor((F.col("__upto") - F.col("__from")) / F.greatest(F.lit(most_bytes // 2), F.lit(1)))
    rows = rows.withColumn("__block", block).join(begins, "__block").withColumn("__part", part)
    parts = rows.select("__block", "__part").distinct()
    parts = running_sum(parts, [], [F.col("__block"), F.col("__part")], F.lit(1), "chunk")
    name = F.concat(F.lit("request-"), F.lpad(F.col("__i").cast("string"), 9, "0"))
    return rows.join(parts, ["__block", "__part"]).select(*requests.columns, name.alias("custom_id"), F.col("chunk").cast("int").alias("chunk"))


def collected(requests: DataFrame, answers: DataFrame, on: str) -> DataFrame:
    """Each request with its newest answer (attempt, value, error): a success is never replaced by an
    error; a request without an answer has the error MissingBatchResult."""
    good = F.col("error").isNull()
    last = F.max(F.struct(good.alias("good"), F.col("attempt"), F.col("value"), F.col("error")))
    best = answers.groupBy(on).agg(last.alias("b"))
    return requests.select(on).distinct().join(best, on, "left").select(on, F.col("b.value").alias("value"), F.when(F.col("b").isNull(), "MissingBatchResult").otherwise(F.col("b.error")).alias("error"))


def mean_of_samples(samples: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """Mean over n samples; null unless all n are there and finite."""
    ok = F.sum(F.when(finite(value), 1).otherwise(0))
    return samples.groupBy(*by).agg(ok.alias("n_valid"), F.when(ok == n, F.avg(F.when(finite(value), F.col(value)))).alias("mean"))


def latest(rows: DataFrame, by: list[str], newest: list[str]) -> DataFrame:
    """Each key's newest row. The maximum of a struct combines before the shuffle, so a hot key is no sort."""
    rest = [c for c in rows.columns if c not in by and c not in newest]
    top = rows.groupBy(*by).agg(F.max(F.struct(*newest, *rest)).alias("__top"))
    return top.select(*by, *[F.col(f"__top.{c}").alias(c) for c in [*newest, *rest]])


def select_originals(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n distinct ids drawn by hash, in order."""
    return df.select(id_col).distinct().orderBy(order_key(seed, F.col(id_col)), id_col).limit(n).orderBy(id_col)


def rekeyed(rows: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """rows with old ids in some columns replaced by new ones of mapping (old, new); null stays null, an id
    that isn't mapped is an error."""
    for c in columns:
        fault = F.raise_error(F.concat(F.lit(f"no new id for {c} "), F.col(c).cast("string"))).cast(mapping.schema["new"].dataType)
        new = F.when(F.col(c).isNotNull() & F.col(f"__{c}").isNull(), fault).otherwise(F.col(f"__{c}"))
        rows = rows.join(mapping.select(F.col("old").alias(c), F.col("new").alias(f"__{c}")), c, "left").withColumn(c, new).drop(f"__{c}")
    return rows


def unmapped(rows: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """Ids of some columns that mapping (old, new) lacks: column and id."""
    ids = reduce(DataFrame.unionByName, [rows.select(F.lit(c).alias("column"), F.col(c).alias("id")) for c in columns])
    return ids.where("id is not null").distinct().join(mapping.select(F.col("old").alias("id")), "id", "left_anti").select("column", "id")


def overlap(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Keys that both sides have; none is to be in a training and a test set."""
    return a.where(F.col(on).isNotNull()).select(on).distinct().join(b.select(on), on, "left_semi")


def two_tier(errors: DataFrame, documents: DataFrame, id_col: str, position: str) -> DataFrame:
    """Documents of error rows (custom_id): `doc-N` is the one at position N, anything else the one whose id it
    is; fault is "unknown" for none and "ambiguous" for an id that several documents have."""
    number = F.regexp_extract("custom_id", r"^doc-(\d+)$", 1).try_cast("long")
    at = documents.select(F.col(position).cast("long").alias("__at"), F.col(id_col).alias("__by_place"))
    ids = documents.groupBy(F.col(id_col).cast("string").alias("custom_id")).agg(F.count("*").alias("__n"), F.first(id_col).alias("__by_id"))
    out = errors.withColumn("__at", number).join(at, "__at", "left").join(ids, "custom_id", "left")
    found = F.coalesce("__by_place", F.when(F.col("__n") == 1, F.col("__by_id")))
    fault = F.when(found.isNotNull(), None).when(F.col("__n") > 1, "ambiguous").otherwise("unknown")
    return out.select(*errors.columns, found.alias("document"), fault.alias("fault"))


def score_faults(scores: DataFrame, items: DataFrame) -> DataFrame:
    """Score rows that can't be written, with their fault.

    scores: candidate_id, base_text_id, perturbation_method, perturbation_run_id, target_layer, source_layer,
    reference_candidate_id (may be null). items: candidate_id, base_text_id, method, run_id and label of all
    originals and candidates. Faults: unknown_candidate, provenance, unknown_reference, reference_provenance
    (of another source, or not of the score's source layer), repeated.
    """
    known = items.select(F.col("candidate_id"), F.col("base_text_id").alias("__base"), F.col("method").alias("__method"), F.col("run_id").alias("__run"), F.col("label").alias("__label"))
    other = items.select(F.col("candidate_id").alias("reference_candidate_id"), F.col("base_text_id").alias("__rbase"), F.col("label").alias("__rlabel"))
    times = scores.groupBy("candidate_id").agg(F.count("*").alias("__n"))
    rows = scores.join(known, "candidate_id", "left").join(other, "reference_candidate_id", "left").join(times, "candidate_id")
    same = (F.col("base_text_id") == F.col("__base")) & (F.col("perturbation_method") == F.col("__method")) & (F.col("perturbation_run_id") == F.col("__run")) & (F.col("target_layer") == F.col("__label"))
    fault = F.when(F.col("__base").isNull(), "unknown_candidate").when(~F.coalesce(same, F.lit(False)), "provenance")
    fault = fault.when(F.col("reference_candidate_id").isNotNull() & F.col("__rbase").isNull(), "unknown_reference")
    fault = fault.when(F.col("reference_candidate_id").isNotNull() & ~F.coalesce((F.col("__rbase") == F.col("__base")) & (F.col("__rlabel") == F.col("source_layer")), F.lit(False)), "reference_provenance")
    fault = fault.when(F.col("__n") > 1, "repeated")
    return rows.withColumn("fault", fault).where("fault is not null").select(*scores.columns, "fault")


def write_scores(scores: DataFrame, items: DataFrame, root: str, method: str, run: str, errors: DataFrame | None = None, metadata: dict | None = None) -> None:
    """A score run as JSON lines under root/method=.../run=..., errors and metadata beside it, after all rows
    have passed `score_faults`. Refuses a run that exists."""
    from lamina.operators.lineage import enforce
    from lamina.sources.jsonl import path_part, write_jsonl

    enforce(score_faults(scores, items), "scores are of known candidates, once each")
    at = f"{root}/scoring_method={path_part(method)}/scoring_run_id={path_part(run)}"
    write_jsonl(scores, f"{at}/scores")
    if errors is not None:
        write_jsonl(errors, f"{at}/errors")
    spark = scores.sparkSession
    spark.createDataFrame([(json.dumps(metadata or {}, sort_keys=True, allow_nan=False),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{at}/metadata")


def exported(items: DataFrame, splits: DataFrame, wanted: list[str], methods: list[str], mapping: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of the wanted splits and their scores under new ids (mapping of candidate ids: old, new).

    items: base_text_id, candidate_id, method, parent_candidate_id and others; splits: base_text_id, split. Every
    source is to have all methods (RuleBroken otherwise); an id without a new one is an error.
    """
    from lamina.operators.lineage import enforce

    rows = items.join(splits.where(F.col("split").isin(wanted)).select("base_text_id").distinct(), "base_text_id", "left_semi")
    have = rows.where(F.col("method").isin(methods)).groupBy("base_text_id").agg(F.countDistinct("method").alias("n"))
    lacking = rows.select("base_text_id").distinct().join(have, "base_text_id", "left").where(F.coalesce("n", F.lit(0)) < len(set(methods)))
    enforce(lacking, "every source has an output of each method")
    kept = scores.join(rows.select("candidate_id"), "candidate_id", "left_semi")
    refs = [c for c in ("candidate_id", "reference_candidate_id") if c in scores.columns]
    return rekeyed(rows, mapping, ["candidate_id", "parent_candidate_id"]), rekeyed(kept, mapping, refs)


def first_spec(records: DataFrame, specs: DataFrame, id_col: str) -> DataFrame:
    """Each record with the first spec (by ordinal) that fits: equal benchmark, and an aspect that is the
    spec's, before any colon, or begins with it and a space or bracket. Specs are a small table; records
    and specs meet by benchmark, not all with all."""
    base = F.trim(F.split_part("aspect", F.lit(":"), F.lit(1)))
    fits = (base == F.col("spec_aspect")) | base.startswith(F.concat("spec_aspect", F.lit(" "))) | base.startswith(F.concat("spec_aspect", F.lit("(")))
    named = specs.select(F.col("ordinal"), F.col("name").alias("spec"), F.col("benchmark"), F.col("aspect").alias("spec_aspect"))
    hits = records.join(F.broadcast(named), "benchmark").where(fits)
    return hits.withColumn("__k", F.row_number().over(Window.partitionBy(id_col).orderBy("ordinal"))).where("__k = 1").drop("__k", "ordinal", "spec_aspect")


#: Specs up to this number go to all tasks; more meet their records by a shuffle.
MOST_SPECS = 10_000


def matched_records(records: DataFrame, specs: DataFrame, line: str, scores: str, prefix: str = "line") -> DataFrame:
    """Records with the first spec (by ordinal) that fits: id (prefix and line number), spec, human_scores (the finite ones), human_score
    (their mean) and all columns of records.

    records: benchmark, aspect, task, original_data, the line number and an array of scores. specs: ordinal, name, benchmark, aspect, and
    task and original_data, which are to be equal where a spec has them. A record without a finite score has no spec, so it isn't
    there; nor is one that no spec fits. Null arrays have no scores; repeated lines are records of their own.
    """
    fine = F.filter(F.col(scores).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = records.withColumn("human_scores", fine).where(F.size("human_scores") > 0)
    base = F.trim(F.split_part("aspect", F.lit(":"), F.lit(1)))
    wanted = F.col("__aspect")
    fits = (base == wanted) | base.startswith(F.concat(wanted, F.lit(" "))) | base.startswith(F.concat(wanted, F.lit("(")))
    named = specs.select("benchmark", F.col("aspect").alias("__aspect"), *[F.col(c).alias(f"__{c}") for c in ("ordinal", "name", "task", "original_data")])
    same = [F.col(f"__{c}").isNull() | F.col(f"__{c}").eqNullSafe(F.col(c)) for c in ("task", "original_data")]
    if named.limit(MOST_SPECS + 1).count() <= MOST_SPECS:
        named = F.broadcast(named)
    hits = ok.withColumn("__row", F.monotonically_increasing_id())
    first = hits.join(named, "benchmark").where(fits & same[0] & same[1])
    k = F.row_number().over(Window.partitionBy("__row").orderBy("__ordinal"))  # as many rows as specs at most
    first = first.withColumn("__k", k).where("__k = 1")
    mean = F.aggregate("human_scores", F.lit(0.0), lambda a, x: a + x) / F.size("human_scores")
    return first.select(F.concat(F.lit(f"{prefix}:"), F.col(line).cast("string")).alias("id"), F.col("__name").alias("spec"), "human_scores", mean.alias("human_score"), *records.columns)
