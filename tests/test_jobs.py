"""The state machine of batch jobs: a streamed log ends where its fold does."""

import datetime as dt
import random
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from lamina.streaming import jobs

START = dt.datetime(2024, 1, 1)
HOUR = 3_600_000


def row(job, hours, attempt, kind, n=None, request=None, value=None, error=None):
    return (job, START + dt.timedelta(hours=hours), attempt, kind, n, request, value, error)


def states(df):
    return {r["job"]: tuple(r)[1:] for r in df.select("job", "attempt", "phase", "n_requests", "n_ready", "n_failed").collect()}


def test_stream_ends_at_the_fold(spark, tmp_path):
    rng = random.Random(5)
    steps = list(jobs.KINDS)
    log = [row("done", 0, 0, "submitted", 2), row("done", 1, 0, jobs.ANSWER, None, "a", "1"), row("done", 2, 0, "completed"), row("done", 3, 0, jobs.ANSWER, None, "b", None, "bad"), row("done", 4, 1, jobs.ANSWER, None, "b", "2"), row("done", 5, 0, jobs.ANSWER, None, "b", None, "late")]
    log += [row("lost", 0, 0, "submitting", 1), row("slow", 0, 0, "submitted", 1), row("slow", 30, 0, "submitted", 1), row("again", 0, 0, "submitted", 1), row("again", 9, 1, "submitted", 1), row("again", 10, 1, "failed")]
    log += [row("new", 39, None, "submitted", 1), row("odd", 0, 0, "unknown", 1), row(None, 0, 0, "submitted", 1), row("only", 1, 0, jobs.ANSWER, None, "q", "x"), row("none", 1, 0, jobs.ANSWER, None, None, "x"), row("empty", 2, 0, "completed", 0), row("full", 0, 0, "submitted", 1), row("full", 1, 0, "refused")]
    for _ in range(600):
        job, kind = f"j{rng.randrange(25)}", rng.choice([*steps[:4], steps[4 + rng.randrange(4)], *[jobs.ANSWER] * 8])
        log.append(row(job, rng.randrange(40), rng.choice([0, 0, 1, 2]), kind, rng.choice([None, 6]), f"r{rng.randrange(6)}", "v", rng.choice([None, "e", "e", "e"])))
    log.sort(key=lambda r: r[1])
    log = [x for r in log for x in [r] * rng.choice([1, 1, 2])]  # rows come again
    log.append(row("end", 60, 0, "prepared", 1))
    parts = [log[: len(log) // 3], log[len(log) // 3 : len(log) // 2], log[len(log) // 2 :]]
    source, out, checkpoint = (str(tmp_path / x) for x in ("log", "out", "checkpoint"))
    before = spark.conf.get(jobs.STORE[0])
    versions = []
    for part in parts:  # each run goes on from the checkpoint of the one before
        spark.createDataFrame(part, jobs.LOG).coalesce(1).write.mode("append").parquet(source)
        jobs.run_jobs(spark.readStream.schema(jobs.LOG).parquet(source), out, checkpoint, 24 * HOUR, "1 hour")
        versions.append(spark.read.parquet(out).count())
    assert spark.conf.get(jobs.STORE[0]) == before and versions[0] < versions[1] < versions[2]
    changes = spark.read.parquet(out)
    whole = spark.createDataFrame(log, jobs.LOG)
    want = states(jobs.job_states(whole, F.lit(str(START + dt.timedelta(hours=59))).cast("timestamp"), 24 * HOUR))
    assert states(jobs.current_states(changes)) == want
    assert want["done"] == (0, "done", 2, 2, 0) and want["lost"][1] == "unconfirmed" and want["slow"][1] == "overdue" and want["again"] == (1, "retry", 1, 0, 0)
    assert want["new"] == (0, "pending", 1, 0, 0) and want["only"] == (0, "prepared", 0, 1, 0) and want["empty"][1] == "done" and want["full"][1] == "prepared"
    assert not {"odd", None, "none"} & set(want) and {v[1] for v in want.values()} == {"done", "unconfirmed", "overdue", "retry", "pending", "prepared"}
    # versions of a job have no gap, and none shows what the one before does
    per = changes.groupBy("job").agg(F.count("*").alias("n"), F.max("version").alias("top"), F.countDistinct("version").alias("d")).collect()
    assert all(r["n"] == r["top"] == r["d"] for r in per)
    requests = spark.createDataFrame([("again", "q"), ("done", "b"), ("slow", "z")], "job string, request string")
    assert [tuple(r) for r in jobs.open_requests(requests, whole, jobs.job_states(whole, F.current_timestamp(), HOUR)).collect()] == [("again", "q")]


def test_empty_log(spark):
    assert jobs.job_states(spark.createDataFrame([], jobs.LOG), F.current_timestamp(), HOUR).count() == 0


COLUMNS = ["job", "attempt", "step", "at_ms", "n_requests", "request", "ok"]


class Store:
    """What a stateful processor sees of Spark's store, for one job; counts the calls."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, set()

    def getValueState(self, name, schema):
        return SimpleNamespace(get=self._called(lambda: self.value), exists=self._called(lambda: self.value is not None), update=self._called(lambda new: setattr(self, "value", new)))

    def getMapState(self, name, key, value):
        return SimpleNamespace(getValue=self._called(self.map.get), containsKey=self._called(lambda k: k in self.map), updateValue=self._called(lambda k, v: self.map.update({k: v})))

    def registerTimer(self, at):
        self._called(self.timers.add)(at)

    def deleteTimer(self, at):
        self._called(self.timers.discard)(at)

    def _called(self, f):
        def run(*args):
            self.calls += 1
            return f(*args)

        return run


def test_answers_need_few_calls_to_the_store():
    store, states = Store(), jobs.JobStates(HOUR)
    states.init(store)
    for ok in (False, True):
        rows = pd.DataFrame([("j", 0, -1, 0, 200, f"r{k}", ok) for k in range(200)], columns=COLUMNS)
        out = list(states.handleInputRows(("j",), iter([rows]), None))
        assert [tuple(df.iloc[0])[4:] for df in out] == [(200, 200 * ok, 200 * (not ok))]
    assert store.calls < 10


def test_any_room_for_answers_gives_the_same_states():
    """Jobs that outgrow their own state, in many small batches of one frame or several, with answers that come again or turn good."""
    rng = random.Random(8)
    batches = [[(f"r{rng.randrange(40)}", rng.random() < 0.3) for _ in range(1 + rng.randrange(8))] for _ in range(60)]
    seen = {}
    for own, frame in ((256, 10), (256, 2), (7, 10), (7, 3), (0, 1), (0, 4)):
        store, states = Store(), jobs.JobStates(HOUR, own)
        states.init(store)
        best, got = {}, []
        for batch in batches:
            rows = [("j", 0, -1, 0, 40, r, ok) for r, ok in batch] + [("j", 0, 2, 5, 40, None, None), ("j", 0, -1, None, 40, "r0", False)]
            frames = [pd.DataFrame(rows[k : k + frame], columns=COLUMNS) for k in range(0, len(rows), frame)]
            got += [tuple(df.iloc[0]) for df in states.handleInputRows(("j",), iter(frames), None)]
            for r, ok in [*batch, ("r0", False)]:
                best[r] = best.get(r, False) or ok
            assert store.value[5:7] == (sum(best.values()), len(best) - sum(best.values()))
        assert bool(store.map) == (own < 40) and len(store.timers) == 1
        seen[own, frame] = got
    assert len({str(x) for x in seen.values()}) == 1
