"""Resumable micro-batches: a journal of attempts, and its fold to the state that holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(items: DataFrame, settings: dict[str, str], id_col: str, text_col: str) -> str:
    """A hash of settings and of all (id, text) pairs, whatever their order: what a resumed run checks.
    Rows are hashed where they are, and the hashes added up."""
    row = F.conv(F.left(F.sha2(F.to_json(F.struct(F.col(id_col).cast("string"), F.col(text_col)), {"ignoreNullFields": "false"}), 256), F.lit(15)), 16, 10).cast("decimal(38,0)")
    r = items.select(row.alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("h")).select(F.sha2(F.concat_ws("|", F.lit(repr(sorted(settings.items()))), "n", "h"), 256)).first()
    return r[0]


JOURNAL = "batch int, n_rows long, fingerprint string"


class Changed(ValueError):
    """A run was resumed with other settings or inputs than it began with."""


def run_journaled(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], files_per_batch: int = 1, fingerprint: str = "") -> None:
    """Reads new files of `source` (parquet), works on each micro-batch and writes it as out/rows/batch=<id>,
    then its row of out/journal (batch, n_rows, fingerprint).

    A batch that is repeated after a failure overwrites its own folders, so each is there once. All that
    is there is worked off and the run ends; the next one takes only files that came since. It is refused
    where the journal has another fingerprint or lacks a batch. Empty batches have a journal row as well.
    """
    known = read_journal(spark, out)
    if known.where(F.col("fingerprint") != fingerprint).limit(1).count():
        raise Changed("the journal is of a run with other settings or inputs")
    if gaps := [r["batch"] for r in missing_batches(known, "batch").limit(5).collect()]:
        raise ValueError(f"the journal lacks batches {gaps}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def batch(df: DataFrame, n: int) -> None:
        path = f"{out}/rows/batch={n}"
        work(df).write.mode("overwrite").parquet(path)
        rows = df.sparkSession.read.parquet(path).agg(F.count("*").alias("n_rows"))
        rows.select("n_rows", F.lit(fingerprint).alias("fingerprint")).coalesce(1).write.mode("overwrite").parquet(f"{out}/journal/batch={n}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_journal(spark: SparkSession, out: str) -> DataFrame:
    """The journal's rows; none where nothing has run yet."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{out}/journal")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], JOURNAL)
    return spark.read.schema(JOURNAL).parquet(f"{out}/journal")


def run_summary(journal: DataFrame, attempts: DataFrame, items: DataFrame, id_col: str, ok: str) -> DataFrame:
    """One row: n_inputs, n_attempted, n_ready, n_failed, complete (all attempted), all_ready and n_batches.
    attempts: the folded state, with a boolean column `ok`."""
    state = items.select(id_col).distinct().join(attempts.select(id_col, F.col(ok).alias("__ok")), id_col, "left")
    counts = state.agg(F.count("*").alias("n_inputs"), F.count("__ok").alias("n_attempted"), F.count_if("__ok").alias("n_ready"), F.count_if(~F.col("__ok")).alias("n_failed"))
    counts = counts.withColumns({"complete": F.col("n_attempted") == F.col("n_inputs"), "all_ready": F.col("n_ready") == F.col("n_inputs")})
    return counts.crossJoin(F.broadcast(journal.agg(F.count("*").alias("n_batches"))))


def folded(attempts: DataFrame, by: list[str], order: list[str], ok: str) -> DataFrame:
    """Each item's state over its attempts: the newest success, else the newest failure, with n_attempts.
    A success is never undone by a later failure."""
    rest = [c for c in attempts.columns if c not in by and c not in order and c != ok]
    state = attempts.groupBy(*by).agg(F.max(F.struct(F.col(ok).alias(ok), *order, *rest)).alias("s"), F.count("*").alias("n_attempts"))
    return state.select(*by, *[F.col(f"s.{c}").alias(c) for c in [ok, *order, *rest]], "n_attempts")


def missing_batches(batches: DataFrame, number: str) -> DataFrame:
    """Numbers between 0 and the highest that no batch has."""
    top = batches.agg(F.max(number).alias("top")).where("top is not null")
    return top.select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias(number)).join(batches.select(number).distinct(), number, "left_anti")


def latest_stream(stream: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """A stream's newest row of each key, as an aggregation in complete or update mode."""
    return stream.groupBy(key).agg(F.max(F.struct(at, *columns)).alias("s")).select(key, *[F.col(f"s.{c}").alias(c) for c in (at, *columns)])


def windowed_counts(stream: DataFrame, at: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts by event-time windows; rows later than `late` behind the newest are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
