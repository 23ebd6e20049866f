"""Ordered runs that resume after their finished prefix.

Tasks stand in a total order and are cut into chunks of a fixed number of rows. A chunk's hash is over its rows in
order, so it changes with any row, any value and any place; the hashes of all chunks, folded level by level, are the table's
fingerprint. A run works off steps of chunks and journals each chunk's hash after its results are there. What a
later run finds is compared with the chunks of its own input: the longest run of equal chunks from the first on is the
prefix that is finished; anything else in the journal is a fault.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.ordering import numbered, written
from lamina.streaming.journal import Changed

#: Chunk hashes that one hash of the next level takes.
FOLD = 4096
JOURNAL = "chunk long, n long, hash string, n_failed long, step long"


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's values, each with its length, so that values don't run into each other; null has a mark."""
    value = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
    return F.sha2(F.concat(*map(value, columns)), 256)


def numbered_keys(tasks: DataFrame, order: list[str], columns: list[str], size: int) -> DataFrame:
    """The columns of order (which should be total), hash (of columns), number and chunk of every row. Values other than the order
    are hashed where they are, so only keys and hashes are moved."""
    keys = tasks.select(*order, row_hash(columns).alias("hash"))
    return numbered(keys, *[F.col(c) for c in order], F.col("hash"), name="number").withColumn("chunk", F.expr(f"number div {int(size)}"))


def chunk_hashes(keys: DataFrame) -> DataFrame:
    """chunk, n and hash (of the rows' hashes in order) of numbered keys. A chunk has `size` rows at most."""
    rows = F.array_sort(F.collect_list(F.struct("number", "hash")))
    return keys.groupBy("chunk").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(rows, lambda r: r["hash"]), ""), 256).alias("hash"))


def ordered_fingerprint(chunks: DataFrame) -> str:
    """One hash of a table in its order: chunk hashes, then runs of FOLD of these, level by level. A table without rows has the
    hash of nothing."""
    level = written(chunks.select(F.col("chunk").alias("number"), "hash"), "hashes")
    while (n := level.limit(2).count()) > 1:
        level = written(chunk_hashes(level.withColumn("chunk", F.expr(f"number div {FOLD}"))).select(F.col("chunk").alias("number"), "hash"), "hashes")
    return level.first()["hash"] if n else level.sparkSession.range(1).select(F.sha2(F.lit("").cast("binary"), 256)).first()[0]


def prefix_state(plan: DataFrame, journal: DataFrame) -> DataFrame:
    """chunk, hash and state of every chunk of the plan and of the journal (chunk, n, hash): done (it and all before it are finished
    and as they were), changed (other rows, or another order), repeated (journaled twice), beyond (no chunk of the
    input), unproved (finished, but not all before it), pending (not finished)."""
    found = journal.groupBy("chunk").agg(F.count("*").alias("__times"), F.max("n").alias("__n"), F.max("hash").alias("__hash"))
    both = plan.select("chunk", F.col("n"), "hash").join(found, "chunk", "full")
    state = F.when(F.col("hash").isNull(), "beyond").when(F.col("__hash").isNull(), "pending").when(F.col("__times") > 1, "repeated").when((F.col("hash") != F.col("__hash")) | (F.col("n") != F.col("__n")), "changed").otherwise("done")
    rows = both.select("chunk", F.coalesce("hash", "__hash").alias("hash"), state.alias("state"))
    broken = F.broadcast(rows.where("state != 'done'").agg(F.coalesce(F.min("chunk"), F.lit((1 << 63) - 1)).alias("__first")))
    late = (F.col("state") == "done") & (F.col("chunk") > F.col("__first"))
    return rows.crossJoin(broken).select("chunk", "hash", F.when(late, "unproved").otherwise(F.col("state")).alias("state"))


class Broken(ValueError):
    """What a run has left is no finished prefix of its input."""


def finished_prefix(plan: DataFrame, journal: DataFrame) -> int:
    """How many chunks are finished. Changed: the input isn't that of the journal. Broken: a gap, a chunk twice or results beyond the input."""
    counts = {r["state"]: (r["n"], r["first"]) for r in prefix_state(plan, journal).groupBy("state").agg(F.count("*").alias("n"), F.min("chunk").alias("first")).collect()}
    if "changed" in counts:
        raise Changed(f"chunk {counts['changed'][1]} of the input isn't what the run began with")
    for state, says in (("beyond", "the run is longer than its input: chunk"), ("repeated", "journaled twice: chunk"), ("unproved", "chunks before it aren't finished: chunk")):
        if state in counts:
            raise Broken(f"{says} {counts[state][1]}")
    return counts.get("done", (0, None))[0]


def rows_after(df: DataFrame, order: list[str], skip: int) -> DataFrame:
    """The rows behind the first `skip` of a total order. Broken where there are fewer."""
    keys = numbered(df.select(*order), *[F.col(c) for c in order], name="__number")
    if skip > (n := keys.count()):
        raise Broken(f"{skip} rows are to be skipped, and the input has {n}")
    return df.join(keys.where(F.col("__number") >= skip).select(*order), order, "left_semi")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_prefix_journal(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(JOURNAL).parquet(f"{out}/journal") if _exists(spark, f"{out}/journal") else spark.createDataFrame([], JOURNAL)


def run_prefix(tasks: DataFrame, order: list[str], columns: list[str], work: Callable[[DataFrame], DataFrame], out: str, failed: str, size: int = 1024, chunks_per_step: int = 64) -> dict[str, int]:
    """Works tasks off in steps of chunks: work(rows of a step) to out/rows/step=<k>, then the step's chunks to out/journal/step=<k>.
    The columns of order name a task (they come back in work's rows); `failed` is SQL over work's rows that says which failed.

    A run that stopped goes on behind its finished steps; one that stopped between rows and journal does that step
    anew over its own files. An input that isn't that of the journal is refused before anything is written
    (Changed, Broken). At the end the rows of all steps are counted against the input and out/published is
    made, once. Returns chunks, finished (before this run), rows and failed. The tasks of open steps are written
    once, by step, so a step reads its own rows alone.
    """
    spark = tasks.sparkSession
    keys = written(numbered_keys(tasks, order, columns, size), "task-keys")
    plan = written(chunk_hashes(keys), "task-chunks")
    finished, total = finished_prefix(plan, read_prefix_journal(spark, out)), plan.count()
    if finished % chunks_per_step and finished < total:
        raise Broken(f"{finished} chunks are finished, which is no whole number of steps of {chunks_per_step}")
    step = F.expr(f"chunk div {int(chunks_per_step)}")
    first, last = finished // chunks_per_step, -(-total // chunks_per_step)
    if finished < total:
        rest = keys.where(F.col("chunk") >= finished).select(*order, F.col("chunk").alias("__chunk"), step.alias("__step"))
        same = [tasks[c].eqNullSafe(rest[c]) for c in order]
        open_ = tasks.join(rest, same).select(*[tasks[c] for c in tasks.columns], "__chunk", "__step")
        folder = f"{out}/tasks-{first}"
        open_.repartition("__step", F.pmod(F.col("__chunk"), F.lit(16))).write.mode("overwrite").partitionBy("__step").parquet(folder)
        ready = spark.read.schema(open_.schema).parquet(folder)
        for k in range(first, last):
            rows = ready.where(F.col("__step") == k).drop("__step", "__chunk")
            path = f"{out}/rows/step={k}"
            work(rows).write.mode("overwrite").parquet(path)
            done = spark.read.parquet(path)
            own = keys.where(step == k).select(*order, "chunk")
            by_chunk = done.join(own, order).groupBy("chunk").agg(F.count("*").alias("__n"), F.count_if(F.expr(failed)).alias("n_failed"))
            log = plan.where(step == k).join(by_chunk, "chunk", "left").select("chunk", "n", "hash", F.coalesce("n_failed", F.lit(0)).alias("n_failed"), F.coalesce("__n", F.lit(0)).alias("__n"), F.lit(k).cast("long").alias("step"))
            log = written(log, "step-journal")
            if bad := log.where("n != __n").first():
                raise Broken(f"chunk {bad['chunk']} has {bad['n']} tasks and {bad['__n']} results")
            log.drop("__n").coalesce(1).write.mode("overwrite").parquet(f"{out}/journal/step={k}")
    sums = read_prefix_journal(spark, out).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("n_failed"), F.lit(0)).alias("failed")).first()
    publish_once(spark, f"{out}/published", ordered_fingerprint(plan))
    return {"chunks": total, "finished": finished, "rows": sums["rows"], "failed": sums["failed"]}


def publish_once(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a small file that only one writer can make; whether it was this one. Changed where it is there with another text."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    made = not fs.exists(p)
    if made:
        try:
            stream = fs.create(p, False)
        except Exception as e:
            if "already exists" not in str(e).lower():
                raise
            made = False
        else:
            stream.write(bytearray(text.encode()))
            stream.close()
    if not made and (was := spark.read.text(path, wholetext=True).first()[0].strip()) != text:
        raise Changed(f"{path} was made by another run: {was}")
    return made
