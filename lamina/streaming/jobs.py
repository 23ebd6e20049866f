"""External batch jobs as a state machine over the log of what happened to them.

A job is a chunk of requests that goes to a service at once. Its log has a row for each step (KINDS) and for each answer. Steps of
an attempt only go forward, the newest attempt's furthest step holds, and an answer that succeeded is never undone: so a state doesn't
depend on the order of the log's rows, and repeated or late ones change nothing. `job_states` folds a whole log, `JobStates`
keeps the same state along a stream and wakes up for jobs that are overdue.

phase: `prepared` (to be submitted; a refused attempt is over and the next has a higher number), `unconfirmed` (submission began and
nothing is known: not to be submitted again without a look at the service), `pending`, `overdue` (pending for longer than `due`),
`done` (ended, all requests succeeded), `retry` (ended, some didn't). Rows without a job or of another kind, and
answers without a request, are left out; an attempt of null is 0; without n_requests a job has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

LOG = "job string, at timestamp, attempt int, kind string, n_requests int, request string, value string, error string"
STATES = "job string, version int, attempt int, phase string, n_requests int, n_ready int, n_failed int"
#: Steps and how far they lead; the last four end an attempt (fixed values: a service's names).
KINDS = {"prepared": 0, "submitting": 1, "submitted": 2, "refused": 3, "completed": 4, "failed": 4, "expired": 4, "cancelled": 4}
ANSWER = "answer"
SUBMITTED = KINDS["submitted"]
ENDED = KINDS["completed"]
#: Requests that a job's own state holds.
OWN = 256
PHASES = {KINDS["prepared"]: "prepared", KINDS["submitting"]: "unconfirmed", SUBMITTED: "pending", KINDS["refused"]: "prepared"}


def _steps(log: DataFrame) -> DataFrame:
    """job, attempt, step, at_ms, n_requests, request and ok of the rows that count."""
    step = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in KINDS.items()])
    own = F.when(F.col("kind") == ANSWER, F.col("request"))
    rows = log.where(F.col("job").isNotNull() & (F.col("kind").isin(list(KINDS)) | own.isNotNull()))
    attempt = F.coalesce(F.col("attempt"), F.lit(0)).alias("attempt")
    return rows.select("job", "at", attempt, step.alias("step"), F.unix_millis("at").alias("at_ms"), F.coalesce("n_requests", F.lit(0)).alias("n_requests"), own.alias("request"), F.when(own.isNotNull(), F.col("error").isNull()).alias("ok"))


def _phase(step: Column, late: Column, ready: Column, requests: Column) -> Column:
    early = F.coalesce(*[F.when(step == n, F.lit(p)) for n, p in PHASES.items()])
    ended = F.when(ready >= requests, "done").otherwise("retry")
    return F.when(step.isNull(), "prepared").when(step == ENDED, ended).when(late, "overdue").otherwise(early)


def job_states(log: DataFrame, now: Column, due_ms: int) -> DataFrame:
    """The state of each job of a whole log as of `now` (a timestamp): job, attempt, phase, n_requests, n_ready and n_failed (requests
    whose answers are all errors). Answers are folded by request, then by job, each combined before its shuffle."""
    rows = _steps(log)
    each = rows.groupBy("job", "request").agg(F.max("ok").alias("ok"), F.max(F.when(F.col("step").isNotNull(), F.struct("attempt", "step", "at_ms"))).alias("top"), F.max("n_requests").alias("n_requests"))
    jobs = each.groupBy("job").agg(F.max("top").alias("top"), F.max("n_requests").alias("n_requests"), F.count_if("ok").cast("int").alias("n_ready"), F.count_if(~F.col("ok")).cast("int").alias("n_failed"))
    late = (F.col("top.step") == SUBMITTED) & (F.col("top.at_ms") + due_ms < F.unix_millis(now))
    phase = _phase(F.col("top.step"), F.coalesce(late, F.lit(False)), F.col("n_ready"), F.col("n_requests"))
    return jobs.select("job", F.coalesce("top.attempt", F.lit(0)).alias("attempt"), phase.alias("phase"), "n_requests", "n_ready", "n_failed")


def open_requests(requests: DataFrame, log: DataFrame, states: DataFrame) -> DataFrame:
    """Requests (job, request and whatever else) of jobs to be retried that have no answer without an error: what the next attempt sends."""
    good = log.where((F.col("kind") == ANSWER) & F.col("error").isNull()).select("job", "request").distinct()
    again = states.where(F.col("phase") == "retry").select("job")
    return requests.join(again, "job", "left_semi").join(good, ["job", "request"], "left_anti")


class JobStates(StatefulProcessor):
    """Keeps the state of each job: its furthest step, its counts, and for each request whether it has succeeded. One row for each
    change that shows, numbered by version; the highest version of a job holds. Each call to the store costs some 0.1 ms, so
    up to `own` requests stay in the job's own state, which is read and stored once a batch; those of larger jobs have entries of their own."""

    def __init__(self, due_ms: int, own: int = OWN):
        self.due_ms, self.own = due_ms, own

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "attempt int, step int, at_ms long, overdue boolean, n_requests int, n_ready int, n_failed int, version int, ready array<string>, failed array<string>")
        self.answers = handle.getMapState("answers", "request string", "ok boolean")

    def close(self) -> None:
        pass

    def _read(self) -> tuple[tuple, dict[str, bool]]:
        """A job's state, and the answers in it."""
        *state, ready, failed = self.job.get() or (-1, -1, 0, False, 0, 0, 0, 0, [], [])
        return tuple(state), dict.fromkeys(failed, False) | dict.fromkeys(ready, True)

    def _shown(self, state: tuple) -> tuple:
        attempt, step, _, overdue, n_requests, n_ready, n_failed, _ = state
        phase = ("done" if n_ready >= n_requests else "retry") if step == ENDED else "overdue" if overdue else PHASES.get(step, "prepared")
        return max(attempt, 0), phase, n_requests, n_ready, n_failed

    def _kept(self, key: tuple, old: tuple, new: tuple, own: dict[str, bool]) -> Iterator[pd.DataFrame]:
        """Stores a state; a row where what it shows is new."""
        fresh = old[-1] == 0 or self._shown(old) != self._shown(new)
        new = (*new[:-1], old[-1] + fresh)
        self.job.update((*new, [r for r, ok in own.items() if ok], [r for r, ok in own.items() if not ok]))
        if fresh:
            yield pd.DataFrame([(key[0], new[-1], *self._shown(new))], columns=[c.split()[0] for c in STATES.split(", ")])

    def _answered(self, answers: dict[str, bool], own: dict[str, bool], n_ready: int, n_failed: int) -> tuple[int, int]:
        """Stores answers that are news, in `own` as long as it has room for all; the counts with them."""
        apart = stored = n_ready + n_failed > len(own)
        if not apart and len(own.keys() | answers.keys()) > self.own:
            for request, ok in own.items():
                self.answers.updateValue((request,), (ok,))
            apart = True
        for request, ok in answers.items():
            before = own.get(request)
            if stored:
                before = (self.answers.getValue((request,)) or (None,))[0]
            if before or before is ok:
                continue
            if apart:
                self.answers.updateValue((request,), (ok,))
            else:
                own[request] = ok
            n_ready, n_failed = n_ready + ok, n_failed - (before is False) + (not ok)
        if apart:
            own.clear()
        return n_ready, n_failed

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old, own = self._read()
        top, n_requests, n_ready, n_failed = old[:3], old[4], old[5], old[6]
        for batch in rows:
            n_requests = max(n_requests, int(batch["n_requests"].max()))
            steps = zip(*(batch[c].tolist() for c in ("attempt", "step", "at_ms")), strict=True)
            top = max([top, *(tuple(map(int, x)) for x in steps if x[1] >= 0)])
            answers: dict[str, bool] = {}
            for request, ok in zip(batch["request"].tolist(), batch["ok"].tolist(), strict=True):
                if isinstance(request, str):
                    answers[request] = answers.get(request, False) or bool(ok)
            n_ready, n_failed = self._answered(answers, own, n_ready, n_failed)
        overdue = old[3] and top == old[:3]
        if top != old[:3]:
            if old[1] == SUBMITTED and not old[3]:
                self.handle.deleteTimer(old[2] + self.due_ms)
            if top[1] == SUBMITTED:
                self.handle.registerTimer(top[2] + self.due_ms)
        yield from self._kept(key, old, (*top, overdue, n_requests, n_ready, n_failed, 0), own)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old, own = self._read()
        if old[1] == SUBMITTED and expiredTimerInfo.getExpiryTimeInMs() == old[2] + self.due_ms:
            yield from self._kept(key, old, (*old[:3], True, *old[4:]), own)


#: The store that holds states of this kind.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def state_changes(log: DataFrame, due_ms: int, late: str = "0 seconds") -> DataFrame:
    """A log's changes of state (STATES), as a stream where the log is one. `at` is when the log took a row in, and the
    clock that makes jobs overdue; Spark drops rows further behind the newest than `late`. The session is to name STORE."""
    rows = _steps(log.withWatermark("at", late)).fillna(-1, ["step"])
    return rows.groupBy("job").transformWithStateInPandas(JobStates(due_ms), STATES, "Update", "EventTime")


def run_jobs(log: DataFrame, out: str, checkpoint: str, due_ms: int, late: str = "0 seconds") -> None:
    """Works off a streamed log: changes go to out/batch=<id>; a batch that is repeated after a failure overwrites its own."""
    spark = log.sparkSession
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        run = state_changes(log, due_ms, late).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        run.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE[0], before)


def current_states(changes: DataFrame) -> DataFrame:
    """Each job's newest state among changes."""
    top = changes.groupBy("job").agg(F.max(F.struct("version", "attempt", "phase", "n_requests", "n_ready", "n_failed")).alias("s"))
    return top.select("job", *[F.col(f"s.{c}").alias(c) for c in ("attempt", "phase", "n_requests", "n_ready", "n_failed")])
