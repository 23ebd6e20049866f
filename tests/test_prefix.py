"""Runs that resume after their finished prefix."""

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamina.operators.scoring import scored
from lamina.streaming import prefix
from lamina.streaming.journal import Changed


def tasks(spark, n=100, change=None, move=None):
    rows = [(i, f"text {i}" if i != change else None, i if i != move else n + i) for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string, at long")


def plan_of(df, size=7):
    return prefix.chunk_hashes(prefix.numbered_keys(df, ["at", "id"], ["id", "text"], size))


def test_chunk_hashes_follow_order_and_values(spark):
    base = {r["chunk"]: (r["n"], r["hash"]) for r in plan_of(tasks(spark)).collect()}
    field = lambda v: "-" if v is None else f"{len(str(v))}:{v}"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [sha(field(i) + field(f"text {i}")) for i in range(100)]
    assert base == {k: (len(want[7 * k : 7 * k + 7]), sha("".join(want[7 * k : 7 * k + 7]))) for k in range(15)}
    again = {r["chunk"]: (r["n"], r["hash"]) for r in plan_of(tasks(spark).repartition(5).orderBy(F.desc("id"))).collect()}
    assert again == base  # how rows lie doesn't matter
    changed = {r["chunk"]: (r["n"], r["hash"]) for r in plan_of(tasks(spark, change=30)).collect()}
    assert [k for k in base if base[k] != changed[k]] == [4]
    moved = {r["chunk"]: (r["n"], r["hash"]) for r in plan_of(tasks(spark, move=30)).collect()}
    assert all(base[k] == moved[k] for k in range(4)) and all(base[k] != moved[k] for k in range(4, 15))
    prints = [prefix.ordered_fingerprint(plan_of(tasks(spark, **k))) for k in ({}, {"change": 30}, {"move": 30}, {"n": 0})]
    assert len(set(prints)) == 4 and prints[0] == prefix.ordered_fingerprint(plan_of(tasks(spark)))


def test_fingerprint_folds_levels(spark, monkeypatch):
    monkeypatch.setattr(prefix, "FOLD", 3)
    assert len({prefix.ordered_fingerprint(plan_of(tasks(spark, change=c), 2)) for c in (None, 0, 50, 99)}) == 4


def test_states_and_refusals(spark):
    plan = plan_of(tasks(spark)).persist()
    journal = lambda keep: plan.where(keep).select("chunk", "n", "hash")
    assert prefix.finished_prefix(plan, journal("chunk < 5")) == 5
    assert prefix.finished_prefix(plan, journal("false")) == 0 and prefix.finished_prefix(plan, journal("true")) == 15
    states = {r["chunk"]: r["state"] for r in prefix.prefix_state(plan, journal("chunk in (0, 1, 3)")).collect()}
    assert [states[k] for k in range(5)] == ["done", "done", "pending", "unproved", "pending"]
    with pytest.raises(prefix.Broken, match="aren't finished: chunk 3"):
        prefix.finished_prefix(plan, journal("chunk in (0, 1, 3)"))
    with pytest.raises(prefix.Broken, match="twice: chunk 1"):
        prefix.finished_prefix(plan, journal("chunk < 3").unionByName(journal("chunk = 1")))
    shorter = plan_of(tasks(spark, 70))
    with pytest.raises(prefix.Broken, match="longer than its input: chunk 10"):
        prefix.finished_prefix(shorter, journal("chunk < 12"))
    for other in ({"change": 8}, {"move": 8}):
        with pytest.raises(Changed, match="chunk 1"):
            prefix.finished_prefix(plan_of(tasks(spark, **other)), journal("chunk < 3"))
    assert prefix.finished_prefix(plan_of(tasks(spark, change=50)), journal("chunk < 3")) == 3  # behind the prefix


def test_run_goes_on_behind_what_is_finished(spark, tmp_path):
    out, seen = str(tmp_path / "run"), []

    def scorer(rows: pd.DataFrame) -> list[float]:
        if (rows["id"] % 10 == 3).any():
            raise RuntimeError("no score")
        return [float(i) for i in rows["id"]]

    def work(stop=None):
        def run(rows):
            ids = sorted(r["id"] for r in rows.select("id").collect())
            if stop is not None and stop in ids:
                raise KeyboardInterrupt
            seen.extend(ids)
            return scored(rows, scorer, "id")

        return run

    args = dict(order=["id"], columns=["id", "text"], out=out, failed="error_type is not null", size=10, chunks_per_step=2)
    with pytest.raises(KeyboardInterrupt):
        prefix.run_prefix(tasks(spark, 95), work=work(stop=45), **args)
    assert seen == list(range(40)) and not (tmp_path / "run" / "published").exists()
    # killed behind the rows of a step, before its journal
    (step,) = (tmp_path / "run" / "journal").glob("step=1")
    step.rename(tmp_path / "lost")
    with pytest.raises(Changed):
        prefix.run_prefix(tasks(spark, 95, change=5), work=work(), **args)
    with pytest.raises(prefix.Broken):
        prefix.run_prefix(tasks(spark, 10), work=work(), **args)
    seen.clear()
    assert prefix.run_prefix(tasks(spark, 95), work=work(), **args) == {"chunks": 10, "finished": 2, "rows": 95, "failed": 10}
    assert seen == list(range(20, 95))
    rows = spark.read.parquet(f"{out}/rows").collect()
    assert sorted(r["id"] for r in rows) == list(range(95)) and {r["id"] for r in rows if r["error_type"]} == set(range(3, 95, 10))
    seen.clear()
    assert prefix.run_prefix(tasks(spark, 95), work=work(), **args)["finished"] == 10 and not seen  # nothing is left to do
    with pytest.raises(Changed):  # more tasks behind a published run
        prefix.publish_once(spark, f"{out}/published", "another")


def test_lost_results_are_no_finished_step(spark, tmp_path):
    with pytest.raises(prefix.Broken, match="10 tasks and 9 results"):
        prefix.run_prefix(tasks(spark, 20), ["id"], ["id", "text"], lambda rows: rows.where("id != 4"), str(tmp_path / "o"), "false", 10, 1)


def test_rows_after(spark):
    df = tasks(spark, 9)
    assert sorted(r["id"] for r in prefix.rows_after(df, ["id"], 4).collect()) == [4, 5, 6, 7, 8]
    assert prefix.rows_after(df, ["id"], 9).count() == 0
    with pytest.raises(prefix.Broken, match="10 rows are to be skipped, and the input has 9"):
        prefix.rows_after(df, ["id"], 10)
