"""Layers generated as one resumable job.

A job's items are cut into files once; these are the queue that a stream works off in numbered batches. A batch's answers
are written first, then its candidates and failures, then its row of the journal: only the journal makes a batch count. A job
that stopped goes on with the batch it stopped in, and doesn't ask again for answers that are there. Failed items
can be queued again as another attempt. The folded state is published as a new snapshot of the layer, at
most one after each snapshot.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.generation import collected_batch, generated, source_items
from lamina.operators.lineage import duplicates, enforce
from lamina.sources.jsonl import Layers, path_part
from lamina.streaming.journal import Changed, fingerprint, folded, missing_batches
from lamina.streaming.prefix import publish_once

JOURNAL = "batch int, n_inputs long, n_ready long, n_failed long"
EXISTING = "parent_candidate_id string, candidate_index int"


def layer_items(layers: Layers, dataset: str, originals: DataFrame, source_layer: int = 0, source_method: str | None = None, source_run_id: str | None = None, splits: DataFrame | None = None, partitions: list[str] | None = None, order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """What a layer is made from: candidate_id, base_text_id, text and further columns of the originals (layer 0; base_text_id
    and text) or of a stored layer; of the given partitions of `splits` (base_text_id, split) only, and the first `limit`
    in `order`. A source without a split is an error where partitions are asked for."""
    if (source_layer == 0) != (source_method is None) or (source_layer == 0) != (source_run_id is None):
        raise ValueError("originals have no method and run, other layers have both")
    if source_layer == 0:
        ident = F.concat_ws("__", F.lit("original"), F.lit(dataset), F.col("base_text_id").cast("string"))
        rows = originals.withColumn("candidate_id", ident)
    else:
        rows = layers.get(source_method, source_run_id, source_layer).drop(*Layers.KEY, "snapshot")
    if partitions is not None:
        if splits is None or not partitions or not all(partitions):
            raise ValueError("partitions are names of splits that are given")
        own = splits.select(F.col("base_text_id").alias("__base"), F.col("split").alias("__split"))
        rows = rows.join(own, rows["base_text_id"] == own["__base"], "left")
        enforce(rows.where(F.coalesce("__split", F.lit("")) == "").select("base_text_id"), "sources have a split")
        rows = rows.where(F.col("__split").isin(partitions)).drop("__base", "__split")
    return rows if limit is None else source_items(rows, order or ["candidate_id"], limit)


class LayerJob:
    """The job of one layer, under jobs/ in the layers' folder.

    items: candidate_id (unique), base_text_id, text and whatever the method reads. `work` gives one result for each item
    (parent_candidate_id, base_text_id, text and what `collected_batch` knows); without it the registered method of that
    name works. It sees `attempt`, 0 at first, so that draws can differ. settings go into the fingerprint: a job whose
    items or settings aren't those that it began with is refused (Changed).
    """

    def __init__(self, layers: Layers, items: DataFrame, dataset: str, method: str, run_id: str, layer: int, work: Callable[[DataFrame], DataFrame] | None = None, settings: dict | None = None, rows_per_file: int = 4096, files_per_batch: int = 64, allow_unchanged: bool = False):
        self.layers, self.items, self.dataset, self.key = layers, items, dataset, (path_part(method), path_part(run_id), int(layer))
        self.spark, self.work, self.settings = layers.spark, work or (lambda rows: generated(rows, method)), settings or {}
        self.rows_per_file, self.files_per_batch, self.allow_unchanged = rows_per_file, files_per_batch, allow_unchanged
        self.root = f"{layers.root}/jobs/method={method}/run_id={run_id}/target_layer={layer}"

    # -- what is there --

    def _read(self, name: str, schema: str | None = None) -> DataFrame | None:
        path = f"{self.root}/{name}"
        if not self.layers._exists(path):
            return None
        return self.spark.read.schema(schema).parquet(path) if schema else self.spark.read.option("mergeSchema", "true").parquet(path)

    def journal(self) -> DataFrame:
        """The batches that count."""
        rows = self._read("journal", JOURNAL)
        return self.spark.createDataFrame([], JOURNAL) if rows is None else rows

    def _counted(self, name: str) -> DataFrame | None:
        rows = self._read(name)
        return None if rows is None else rows.join(F.broadcast(self.journal().select("batch")), "batch", "left_semi")  # a row for each batch

    def candidates(self) -> DataFrame | None:
        """Candidates of all batches that count, None before the first."""
        rows = self._counted("candidates")
        return None if rows is None else rows.drop("batch", "attempt")

    def state(self) -> DataFrame:
        """parent_candidate_id, ok, attempt, reason and n_attempts of every item that was tried; a success holds over any failure."""
        good, bad = self._counted("candidates"), self._counted("failures")
        if good is None or bad is None:
            return self.spark.createDataFrame([], "parent_candidate_id string, ok boolean, attempt int, reason string, n_attempts long")
        tries = good.select("parent_candidate_id", F.lit(True).alias("ok"), "attempt", F.lit(None).cast("string").alias("reason"))
        tries = tries.unionByName(bad.select("parent_candidate_id", F.lit(False).alias("ok"), "attempt", "reason"))
        return folded(tries, ["parent_candidate_id"], ["attempt"], "ok")

    def summary(self) -> dict:
        """Counts of the state: inputs, tried, ready, failed (by reason) and batches; complete: all were tried; all_ready: all succeeded."""
        counts = {(r["ok"], r["reason"]): r["n"] for r in self.state().groupBy("ok", "reason").agg(F.count("*").alias("n")).collect()}  # reasons are few
        n, ready, tried = self.items.count(), counts.get((True, None), 0), sum(counts.values())
        reasons = {reason: k for (ok, reason), k in sorted(counts.items(), key=str) if not ok}
        return {"input_count": n, "completed_input_count": tried, "output_count": ready, "unresolved_failure_count": tried - ready, "failure_counts": reasons, "generation_complete": tried == n, "all_outputs_ready": ready == n, "committed_batches": self.journal().count()}

    # -- work --

    def _begin(self) -> str:
        if self.items.limit(1).count() == 0:
            raise ValueError("the source layer is empty")
        enforce(duplicates(self.items, "candidate_id"), "items have ids of their own")
        says = {"dataset": self.dataset, "key": json.dumps(self.key), **{k: json.dumps(v, sort_keys=True) for k, v in self.settings.items()}}
        mark = fingerprint(self.items, says, "candidate_id", "text")
        publish_once(self.spark, f"{self.root}/fingerprint", mark)
        return mark

    def _rounds(self) -> list[int]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/queue")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        rounds = [int(x.removeprefix("attempt=")) for x in names if x.startswith("attempt=")]
        return sorted(r for r in rounds if self.layers._exists(f"{self.root}/queue/attempt={r}/_SUCCESS"))

    def _enqueue(self, rows: DataFrame, attempt: int) -> None:
        files = -(-rows.count() // self.rows_per_file)
        rows.repartition(max(1, files), "candidate_id").write.mode("overwrite").parquet(f"{self.root}/queue/attempt={attempt}")

    def _open(self) -> bool:
        """Whether the queue has rows that no counted batch has taken."""
        done = self.journal().agg(F.coalesce(F.sum("n_inputs"), F.lit(0)).alias("n")).first()["n"]
        return self.spark.read.parquet(*[f"{self.root}/queue/attempt={r}" for r in self._rounds()]).count() > done

    def _batch(self, rows: DataFrame, number: int) -> None:
        at = lambda name: f"{self.root}/{name}/batch={number}"
        spark, (method, run_id, layer) = rows.sparkSession, self.key
        if not self.layers._exists(f"{at('answers')}/_SUCCESS"):
            self.work(rows).write.mode("overwrite").parquet(at("answers"))
        mark = {"method": F.lit(method), "run_id": F.lit(run_id), "target_layer": F.lit(layer)}
        answers = spark.read.parquet(at("answers")).withColumns(mark)
        tries = rows.select(F.col("candidate_id").alias("parent_candidate_id"), "attempt")
        good, bad = collected_batch(rows, answers, spark.createDataFrame([], EXISTING), self.dataset, method, run_id, layer, self.allow_unchanged)
        for name, part in (("candidates", good.drop("method", "run_id", "target_layer", "attempt")), ("failures", bad)):
            part.join(tries, "parent_candidate_id").write.mode("overwrite").parquet(at(name))
        n = {name: spark.read.parquet(at(name)).count() for name in ("candidates", "failures")}
        log = spark.createDataFrame([(sum(n.values()), n["candidates"], n["failures"])], JOURNAL.split(", ", 1)[1])
        log.coalesce(1).write.mode("overwrite").parquet(at("journal"))

    def _drain(self) -> None:
        if gaps := [r["batch"] for r in missing_batches(self.journal(), "batch").limit(5).collect()]:
            raise Changed(f"the journal lacks batches {gaps}")
        schema = self.items.withColumn("attempt", F.lit(0)).schema
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files_per_batch).parquet(f"{self.root}/queue")
        run = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.root}/checkpoint")
        run.trigger(availableNow=True).start().awaitTermination()

    def run(self, retry_failed: bool = False) -> dict:
        """Works off what is open; with retry_failed, and nothing open from before, the failed items once more. Returns the summary."""
        self._begin()
        if not self._rounds():
            self._enqueue(self.items, 0)
        was_open = self._open()
        if was_open:
            self._drain()
        elif retry_failed:
            failed = self.state().where("not ok").select(F.col("parent_candidate_id").alias("candidate_id"))
            again = self.items.join(failed, "candidate_id", "left_semi")
            if again.limit(1).count():
                self._enqueue(again, self._rounds()[-1] + 1)
                self._drain()
        return self.summary()

    def publish(self, created_at_utc: str, source_layer: int = 0, source_method: str | None = None, source_run_id: str | None = None, config: dict | None = None) -> str:
        """The state as the layer's next snapshot, whose name is returned; the newest one where it holds this state already."""
        mark, found = self._begin(), self.summary()
        rows = self.candidates()
        if rows is None or not found["generation_complete"]:
            raise ValueError(f"{found['completed_input_count']} of {found['input_count']} items were tried")
        says = {**(config or {}), **found, "generation_fingerprint": mark}
        newest = self.layers.newest(*self.key)
        if newest is not None and json.loads(newest["config"]) == json.loads(json.dumps(says)):
            return newest["snapshot"]
        return self.layers.publish(rows, *self.key, created_at_utc, None if newest is None else newest["snapshot"], source_layer, source_method, source_run_id, says, found["input_count"])
