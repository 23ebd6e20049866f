"""Layers generated as resumable jobs, and their publication."""

import pytest
from pyspark.sql import functions as F

from lamina.sources.jsonl import Conflict, Layers
from lamina.streaming.journal import Changed
from lamina.streaming.layers import LayerJob, layer_items


def originals(spark, n=40):
    return spark.createDataFrame([(f"s{i}", f"text number {i}") for i in range(n)], "base_text_id string, text string")


def job(spark, root, seen=None, stop=None, n=40, **more):
    """A job in batches of one file of about ten items; items whose number ends in 3 succeed at their second attempt alone."""
    layers = Layers(spark, str(root))

    def work(rows):
        ids = sorted(r["base_text_id"] for r in rows.select("base_text_id").collect())
        if stop is not None and len(seen) >= stop:
            raise RuntimeError("the generator is gone")
        seen.append(ids)
        why = F.when(F.col("base_text_id").endswith("3") & (F.col("attempt") == 0), "no_answer")
        return rows.select(F.col("candidate_id").alias("parent_candidate_id"), "base_text_id", F.upper("text").alias("text"), why.alias("generation_failure"))

    return LayerJob(layers, layer_items(layers, "d", originals(spark, n)), "d", "upper", "r", 1, work, rows_per_file=10, files_per_batch=1, **more)


def test_job_killed_between_batches_goes_on(spark, tmp_path):
    seen = []
    with pytest.raises(Exception, match="the generator is gone"):
        job(spark, tmp_path, seen, stop=2).run()
    tried = sum(map(len, seen))
    half = job(spark, tmp_path, seen)
    assert len(seen) == 2 and half.journal().count() == 2 and half.summary()["completed_input_count"] == tried
    with pytest.raises(ValueError, match="of 40 items were tried"):
        half.publish("2024-01-01")
    found = half.run()
    assert sorted(x for ids in seen for x in ids) == sorted(f"s{i}" for i in range(40))  # each asked once
    assert found == {"input_count": 40, "completed_input_count": 40, "output_count": 36, "unresolved_failure_count": 4, "failure_counts": {"no_answer": 4}, "generation_complete": True, "all_outputs_ready": False, "committed_batches": found["committed_batches"]}
    assert job(spark, tmp_path, seen).run() == found  # nothing is left to do
    again = job(spark, tmp_path, seen).run(retry_failed=True)
    assert again["all_outputs_ready"] and again["output_count"] == 40 and sorted(seen[-1]) == ["s13", "s23", "s3", "s33"]
    state = {r["parent_candidate_id"]: (r["ok"], r["attempt"], r["n_attempts"]) for r in half.state().collect()}
    assert state["original__d__s3"] == (True, 1, 2) and state["original__d__s4"] == (True, 0, 1)


def test_job_killed_behind_its_answers_asks_no_more(spark, tmp_path, monkeypatch):
    from lamina.streaming import layers as module

    seen, real = [], module.collected_batch
    monkeypatch.setattr(module, "collected_batch", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(Exception, match="killed"):
        job(spark, tmp_path, seen).run()
    monkeypatch.setattr(module, "collected_batch", real)
    (first,) = seen
    assert job(spark, tmp_path, seen).summary()["completed_input_count"] == 0
    assert job(spark, tmp_path, seen).run()["completed_input_count"] == 40
    assert not set(first) & {x for ids in seen[1:] for x in ids}


def test_other_items_or_settings_are_refused(spark, tmp_path):
    job(spark, tmp_path, []).run()
    with pytest.raises(Changed):
        job(spark, tmp_path, [], n=39).run()
    with pytest.raises(Changed):
        job(spark, tmp_path, [], settings={"temperature": 0.5}).run()
    with pytest.raises(ValueError, match="empty"):
        job(spark, tmp_path / "other", [], n=0).run()
    twice = LayerJob(Layers(spark, str(tmp_path / "twice")), originals(spark, 3).withColumn("candidate_id", F.lit("x")), "d", "upper", "r", 1)
    with pytest.raises(Exception, match="items have ids of their own"):
        twice.run()


def test_publication_and_concurrent_writers(spark, tmp_path, monkeypatch):
    layers, a = Layers(spark, str(tmp_path)), job(spark, tmp_path, [])
    a.run()
    first = a.publish("2024-01-01")
    assert layers.newest("upper", "r", 1)["snapshot"] == first and layers.get("upper", "r", 1).count() == 36
    assert a.publish("2024-01-02") == first  # the state is published already
    a.run(retry_failed=True)
    with pytest.raises(ValueError, match="is of 2024-01-01"):
        a.publish("2023-01-01")
    # a writer dies behind the data, before its claim: the layer stays, and the next one publishes
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr("lamina.sources.jsonl.publish_once", lambda *_: (_ for _ in ()).throw(RuntimeError()))
        a.publish("2024-01-02")
    assert layers.get("upper", "r", 1).count() == 36
    # one dies behind its claim: the next reader of the newest snapshot enters it
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(Layers, "_enter", lambda *_: (_ for _ in ()).throw(RuntimeError()))
        a.publish("2024-01-03")
    assert layers.get("upper", "r", 1).count() == 36
    second = a.publish("2024-01-04")
    assert layers.newest("upper", "r", 1)["snapshot"] == second != first and layers.get("upper", "r", 1).count() == 40
    # a writer that has seen the first snapshot alone is too late
    rows = layers.get("upper", "r", 1)
    with pytest.raises(Conflict, match="not " + first):
        layers.publish(rows, "upper", "r", 1, "2024-01-05", first)
    # another one claims between this one's look and its own claim
    real = Layers._stored

    def stored(self, *args):
        if self is not other:
            return real(self, *args)
        layers.publish(rows, "upper", "r", 1, "2024-01-05", second)
        return real(self, *args)

    other = Layers(spark, str(tmp_path))
    monkeypatch.setattr(Layers, "_stored", stored)
    with pytest.raises(Conflict, match="made by another run"):
        other.publish(rows, "upper", "r", 1, "2024-01-06", second)
    assert layers.newest("upper", "r", 1)["created_at_utc"] == "2024-01-05"


def test_items_of_layers_and_splits(spark, tmp_path):
    layers, texts = Layers(spark, str(tmp_path)), originals(spark, 6)
    splits = spark.createDataFrame([(f"s{i}", "train" if i % 2 else "test") for i in range(6)], "base_text_id string, split string")
    ids = lambda rows: sorted(r["base_text_id"] for r in rows.collect())
    assert ids(layer_items(layers, "d", texts, splits=splits, partitions=["train"])) == ["s1", "s3", "s5"]
    assert ids(layer_items(layers, "d", texts, limit=2)) == ["s0", "s1"]
    with pytest.raises(Exception, match="sources have a split"):
        layer_items(layers, "d", texts, splits=splits.where("base_text_id != 's2'"), partitions=["train"])
    with pytest.raises(ValueError):
        layer_items(layers, "d", texts, partitions=["train"])
    with pytest.raises(ValueError):
        layer_items(layers, "d", texts, 1)
    job(spark, tmp_path, seen := [], n=6).run()
    b = job(spark, tmp_path, seen, n=6)
    b.run(retry_failed=True)
    b.publish("2024-01-01")
    rows = layer_items(layers, "d", texts, 1, "upper", "r", splits, ["test"])
    assert ids(rows) == ["s0", "s2", "s4"] and rows.first()["text"].startswith("TEXT")
