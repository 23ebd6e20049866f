"""Token budgets and generation batches, pilot sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.draws import below
from lamina.functions.ordering import running_sum, written
from lamina.functions.text import token_count

#: Quantiles by which sources are dealt to buckets, and those of a report.
BUCKET_AT = (0.3, 0.6, 0.9, 1.0)
REPORT_AT = (0.1, 0.3, 0.5, 0.6, 0.9, 0.99, 1.0)


def order_statistics(rows: DataFrame, value: str, at: tuple[float, ...], times: Column | None = None) -> DataFrame:
    """quantile and value: of n values in order the one at round((n - 1) * quantile), halves to even; no mean of
    two. Distinct values are counted (a row `times` times) and summed by range partitions."""
    cells = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.sum(F.lit(1) if times is None else times).alias("__n"))
    cells = running_sum(cells, [], [F.col("__v")], F.col("__n"), "__before")
    total = cells.agg(F.sum("__n").alias("__total")).where("__total > 0")
    asked = rows.sparkSession.createDataFrame([(float(q),) for q in at], "quantile double").crossJoin(F.broadcast(total))
    asked = asked.withColumn("__place", F.bround((F.col("__total") - 1) * F.col("quantile")).cast("long"))
    hits = cells.join(F.broadcast(asked), (F.col("__place") >= F.col("__before")) & (F.col("__place") < F.col("__before") + F.col("__n")))
    return hits.select("quantile", F.col("__v").alias("value"))


def source_buckets(rows: DataFrame, tokens: str) -> list[int]:
    """Upper bounds of length buckets: some order statistics, rounded up to a multiple of 64 (64 at least), each once."""
    return sorted({max(64, -(-int(r["value"]) // 64) * 64) for r in order_statistics(rows, tokens, BUCKET_AT).collect()})  # four rows at most


def token_budgets(rows: DataFrame, tokens: str, prompt: str, buckets: list[int], ceiling: int = 32768, thinking: bool = True, thinking_cap: int = 0, extra: int = 32, overhead: int = 0, transition: int = 8, reserve: int = 256) -> DataFrame:
    """rows with source_bucket, thinking_tokens, answer_tokens, required_tokens, max_tokens and fits.

    A text gets the smallest bucket that holds it (its own size beyond all), room for as long a thought, and
    `extra` tokens more for the answer. Where that passes the ceiling the exact size takes the bucket's place
    before it counts as not fitting. An answer may grow by 15 %, or by `reserve` tokens.
    """
    size, p = F.col(tokens), F.col(prompt)
    bucket = F.coalesce(*[F.when(size <= b, F.lit(b)) for b in sorted(buckets)], size) if buckets else size
    thought = F.greatest(F.least(size, F.lit(thinking_cap)) if thinking_cap else size, F.lit(1)) if thinking else F.lit(0)
    need = lambda b: p + F.col("thinking_tokens") + b + extra + overhead + transition
    out = rows.withColumns({"source_bucket": bucket.cast("long"), "thinking_tokens": thought.cast("long")})
    out = out.withColumn("source_bucket", F.when(need(F.col("source_bucket")) > ceiling, size.cast("long")).otherwise(F.col("source_bucket")))
    out = out.withColumns({"answer_tokens": F.col("source_bucket") + extra, "required_tokens": need(F.col("source_bucket"))})
    elastic = F.greatest(F.lit(reserve), F.ceil(F.col("answer_tokens") * F.lit(0.15)))
    most = F.least(ceiling - p, F.col("thinking_tokens") + F.col("answer_tokens") + overhead + transition + elastic)
    return out.withColumns({"max_tokens": F.greatest(F.lit(0), most).cast("long"), "fits": F.col("required_tokens") <= ceiling})


def retry_tokens(attempts: Column, answer: Column) -> Column:
    """Tokens more that a text gets after failed attempts."""
    return attempts * F.greatest(F.lit(512), F.floor(answer / 2))


def budget_report(budgets: DataFrame, tokens: str, prompt: str) -> DataFrame:
    """What budgets add up to, in long form: metric, key and value. Metrics: input_count, over_context_count,
    reserved_rounding_tokens, bucket_counts (key: the bucket) and source_, prompt_ and required_token_quantiles. The numbers are
    counted once, by equal rows: texts aren't read again for each metric."""
    budgets = written(budgets.groupBy(tokens, prompt, "source_bucket", "required_tokens", "fits").agg(F.count("*").alias("__rows")), "budgets")
    n, none = F.col("__rows"), F.lit(0)
    sums = budgets.agg(F.coalesce(F.sum(n), none).alias("input_count"), F.coalesce(F.sum(F.when(~F.col("fits"), n)), none).alias("over_context_count"), F.coalesce(F.sum(n * (F.col("source_bucket") - F.col(tokens))), none).alias("reserved_rounding_tokens"))
    names = sums.columns
    out = sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.lit("").alias("key"), F.col(c).cast("double").alias("value")) for c in names])).alias("r")).select("r.*")
    buckets = budgets.groupBy("source_bucket").agg(F.sum(n).alias("n"))
    out = out.unionByName(buckets.select(F.lit("bucket_counts").alias("metric"), F.col("source_bucket").cast("string").alias("key"), F.col("n").cast("double").alias("value")))
    for metric, column in (("source_token_quantiles", tokens), ("prompt_token_quantiles", prompt), ("required_token_quantiles", "required_tokens")):
        q = order_statistics(budgets, column, REPORT_AT, n)
        out = out.unionByName(q.select(F.lit(metric).alias("metric"), F.col("quantile").cast("string").alias("key"), F.col("value").cast("double").alias("value")))
    return out


def generation_batches(budgets: DataFrame, size: int, order: list[str]) -> DataFrame:
    """budgets with batch: rows of one bucket (those that fit before those that don't, small buckets first) in a
    given order, `size` in each batch; batches are numbered from 0 over all buckets. budgets are written first, so what they
    were counted from is read once, not once more for the bounds of the order's ranges."""
    by = ["__unfit", "source_bucket"]
    rows = written(budgets.withColumn("__unfit", ~F.col("fits")), "budgets")
    rows = running_sum(rows, by, [F.col(c) for c in order], F.lit(1), "__i").withColumn("__own", F.floor(F.col("__i") / size))
    rows = written(rows, "batches")
    parts = running_sum(rows.select(*by, "__own").distinct(), [], [F.col(c) for c in (*by, "__own")], F.lit(1), "batch")
    return rows.join(parts, [*by, "__own"]).select(*budgets.columns, F.col("batch").cast("int").alias("batch"))


def batch_limits(batches: DataFrame, prompt: str, ceiling: int = 32768, extra: Column | None = None) -> DataFrame:
    """batch and context_limit: what the largest of its rows needs, rounded up to a multiple of 256, the ceiling
    at most; null where rows don't fit."""
    need = F.max(F.col(prompt) + F.col("max_tokens") + (extra if extra is not None else F.lit(0)))
    limit = F.least(F.lit(ceiling), F.ceil(need / 256) * 256).cast("long")
    return batches.groupBy("batch").agg(F.when(F.min("fits"), limit).alias("context_limit"))


def prompt_fits(prompt: Column, most: int, answer: int) -> Column:
    return prompt <= most - answer


def pilot_eligible(text: Column | str, coherence: bool = False, n_edits: int = 1) -> Column:
    """Whether a text can show an edit: 40 words and, for edits of coherence, 3 full stops; for several edits
    500 characters each and 2 full stops."""
    t = F.col(text) if isinstance(text, str) else text
    stops = F.regexp_count(t, F.lit(r"\."))
    if n_edits > 1:
        return (F.length(t) >= 500 * n_edits) & (stops >= 2)
    return (token_count(t) >= 40) & (stops >= 3) if coherence else token_count(t) >= 40


#: Where in the order of length the rows of a pilot set stand.
STRATA = {"short": 0.1, "medium": 0.5, "long": 0.95}


def stratified_picks(rows: DataFrame, id_col: str, length: Column, seed: int = 42, jitter: int = 64, strata: dict[str, float] = STRATA) -> DataFrame:
    """One row for each stratum: the one at floor((n - 1) * fraction), moved on by a draw below `jitter` (n at
    most), the last one at most, in the order of length and id. rows with stratum."""
    ordered = written(running_sum(rows.withColumn("__len", length), [], [F.col("__len"), F.col(id_col)], F.lit(1), "__i"), "by-length")
    n = ordered.agg(F.count("*").alias("__n"))
    asked = rows.sparkSession.createDataFrame([(k, float(f)) for k, f in strata.items()], "stratum string, __f double").crossJoin(F.broadcast(n))
    move = below(F.greatest(F.least(F.lit(jitter), F.col("__n")), F.lit(1)), seed, "pilot", F.col("stratum"))
    at = F.least(F.col("__n") - 1, F.floor((F.col("__n") - 1) * F.col("__f")) + move)
    return ordered.join(F.broadcast(asked.select("stratum", at.alias("__i"))), "__i").select(*rows.columns, "stratum")


def pilot_cases(rows: DataFrame, catalog: DataFrame, id_col: str, text_col: str, severities: tuple[str, ...], seed: int = 42) -> DataFrame:
    """Cases of a pilot: each edit of the catalog (edit_id, target_dimensions) at a short, a medium and a long
    text that can show it, in every severity. case_id, edit_id, stratum, severity and the text's id.

    Texts are ordered by length once for edits of coherence and once for the others; edits pick their own rows."""
    out = []
    for coherence in (False, True):
        edits = catalog.where(F.array_contains("target_dimensions", "Coherence") == coherence).select("edit_id")
        eligible = rows.where(pilot_eligible(text_col, coherence)).select(id_col, F.length(text_col).alias("__len"))
        ordered = written(running_sum(eligible, [], [F.col("__len"), F.col(id_col)], F.lit(1), "__i"), "by-length")
        strata = rows.sparkSession.createDataFrame([(k, float(f)) for k, f in STRATA.items()], "stratum string, __f double")
        asked = edits.crossJoin(F.broadcast(strata)).crossJoin(F.broadcast(ordered.agg(F.count("*").alias("__n")))).where("__n > 0")
        move = below(F.least(F.lit(64), F.col("__n")), seed, "pilot", F.col("edit_id"), F.col("stratum"))
        asked = asked.withColumn("__i", F.least(F.col("__n") - 1, F.floor((F.col("__n") - 1) * F.col("__f")) + move))
        out.append(ordered.join(F.broadcast(asked), "__i").select(id_col, "edit_id", "stratum"))
    cases = out[0].unionByName(out[1]).withColumn("severity", F.explode(F.array(*[F.lit(s) for s in severities])))
    cases = running_sum(cases, [], [F.col("edit_id"), F.col("stratum"), F.col("severity")], F.lit(1), "__k")
    return cases.select(F.concat(F.lit("pilot-"), F.lpad(F.col("__k").cast("string"), 4, "0")).alias("case_id"), "edit_id", "stratum", "severity", id_col)
