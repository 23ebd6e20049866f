import json

import pytest
from pyspark.sql import functions as F

from lamina.functions import edits, text
from lamina.functions.ordering import numbered
from lamina.operators import composing, lineage, metrics, scoring, splitting
from lamina.sources import benchmarks, jsonl
from lamina.streaming import journal

WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def run(spark, values, f, kind="string"):
    return [r["y"] for r in column(spark, values, kind).select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_white_space_is_that_of_python(spark):
    values = [f"a{c}b{c}" for c in WHITE] + ["", " ", "😀  é\t", "​x"]
    assert run(spark, values, text.normalized) == [" ".join(v.split()) for v in values]
    assert run(spark, values, text.token_count) == [len(v.split()) for v in values]
    assert run(spark, [None, *values], text.cleaned) == ["", *[v.strip() for v in values]]


def test_judge_scores(spark):
    cases = {'{"score": 4}': 4, '```json\n{"score": "2"}\n```': 2, "<think>score: 1</think>\nScore: 3.5": 3.5, 'x {"score": 9} y': 5, '{"why": "he said "no"", "score": 2}': 2, "none": None, None: None, '{"why": 1}': None, '{"score": "NaN"}': None, "score=-3": 1}
    assert run(spark, list(cases), text.judge_score) == list(cases.values())
    assert run(spark, ["[RESULT] 3", "Rating: 4.", "<think>Rating: 1</think>", "Rating: 9", None, "Rating : 4", "RESULT: 4", "[ result ]:2", "results 3"], text.rating) == [3, 4, None, None, None, 4, 4, 2, None]
    assert run(spark, ["Yes", "no.", "so\nYES!", "<think>No</think> it is yes or no", "", None, "maybe"], text.yes_no) == ["Yes", "No", "Yes", "No", "INVALID", "INVALID", "INVALID"]


def test_assessments(spark):
    cases = {None: "missing", "{": "malformed", '{"decision": "PASS", "passes": "true"}': "malformed", '{"decision": "PASS", "passes": false}': "inconsistent", '{"decision": "PASS", "passes": true}': "passed", '{"decision": "FAIL", "passes": false}': "failed"}
    assert run(spark, list(cases), text.assessment) == list(cases.values())


def test_small_text_functions(spark):
    assert run(spark, ["Hello, World!", "--", "x" * 60], text.slug) == ["Hello-World", "value", "x" * 40]
    assert run(spark, ["abcdef", "ab"], lambda c: text.shortened(c, 3, "~")) == ["abc~", "ab"]
    assert run(spark, ["abcdef"], lambda c: text.shortened(c, 3)) == ["abc\n\n[TRUNCATED]"]
    assert run(spark, ["English", "de-AT", "xx", None], text.language_code) == ["eng", "deu", None, None]
    assert run(spark, [".", "b", "", None], lambda c: text.joined(F.lit("a "), c)) == ["a.", "a b", "a", "a"]
    assert run(spark, ["1.5", " 2 ", "inf", "x", None], text.number) == [1.5, 2.0, None, None, None]


@pytest.mark.parametrize("edit", edits.EDITS)
def test_edits_change_or_are_null(spark, edit):
    values = ["", "one", "alpha beta gamma delta epsilon zeta eta theta", "a a a a", None]
    rows = edits.edited(column(spark, values), edit, 7, F.col("i"), text_col="x").orderBy("i").collect()
    for r in rows:
        assert r["edited"] is None or r["edited"] != " ".join((r["x"] or "").split())
    words = rows[2]["edited"].split()
    if edit in ("shuffle", "swap"):
        assert sorted(words) == sorted(values[2].split())
    assert rows[0]["edited"] is None and rows[4]["edited"] is None


def test_edit_counts_keep_to_limits(spark):
    rows = spark.range(500).select(edits.edit_count(F.lit(5), F.col("id")).alias("n")).groupBy("n").count().collect()
    assert {r["n"] for r in rows} <= {1, 2, 3, 4, 5} and max(rows, key=lambda r: r["count"])["n"] == 3


def test_row_numbers(spark):
    rows = numbered(spark.range(1000).repartition(7), F.col("id").desc(), name="k").collect()
    assert {r["id"]: r["k"] for r in rows} == {i: 999 - i for i in range(1000)}


def test_lineage(spark):
    rows = [("a", None, "1"), ("b", "a", "1"), ("c", "b", "2"), ("d", "x", "1"), ("e", "f", "1"), ("f", "e", "1")]
    df = spark.createDataFrame(rows, "candidate_id string, parent_candidate_id string, base_text_id string")
    assert [r["candidate_id"] for r in lineage.orphans(df).collect()] == ["d"]
    assert [r["candidate_id"] for r in lineage.foreign_parents(df).collect()] == ["c"]
    assert sorted((r["id"], r["root"], r["depth"]) for r in lineage.depths(df).collect()) == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2)]
    with pytest.raises(lineage.RuleBroken):
        lineage.enforce(lineage.orphans(df), "parents are there")
    lineage.enforce(df.limit(0), "nothing")


def test_depths_of_long_chains_and_cycles(spark):
    rows = [(f"a{i}", f"a{i - 1}" if i else None) for i in range(700)] + [(f"x{i}", f"x{(i + 1) % 3}") for i in range(3)] + [("y", "x0"), ("z", "z"), ("o", "gone")]
    rows += [("r", None), ("r", None), ("s", "r"), ("t", "s")]  # a repeated root: two paths to each row below
    df = spark.createDataFrame(rows, "candidate_id string, parent_candidate_id string")
    out = sorted((r["id"], r["root"], r["depth"]) for r in lineage.depths(df).collect())
    assert out == sorted([(f"a{i}", "a0", i) for i in range(700)] + [("r", "r", 0), ("s", "r", 1), ("t", "r", 2)] * 2)
    assert lineage.depths(df.where("parent_candidate_id is not null")).collect() == [] == lineage.depths(df.limit(0)).collect()


def test_quotas():
    assert splitting.equal_leftover_quotas({"train": 100, "dev": 10, "test": 10}, 3) == {"train": 1, "dev": 1, "test": 1}
    counts = {"train": 50, "dev": 20, "test": 20}
    for total in range(3, 91):
        out = {n: 1 for n in counts}
        for _ in range(total - 3):
            most = max(("train", "dev", "test"), key=lambda n: counts[n] - out[n])
            out[most] += 1
        assert splitting.equal_leftover_quotas(counts, total) == out
    assert splitting.rounded_sizes(57, 10, 10, 10) == {"train": 30, "dev": 10, "test": 10}
    with pytest.raises(ValueError):
        splitting.rounded_sizes(9, 5, 5, 5)


def test_stratified_sizes_and_shares(spark):
    df = spark.range(400).withColumn("s", F.col("id") % 4)
    out = splitting.stratified_split(df, "id", F.col("s"), {"train": 200, "dev": 40, "test": 40}).groupBy("s", "split").count().collect()
    for r in out:
        assert abs(r["count"] - {"train": 50, "dev": 10, "test": 10, "excluded": 30}[r["split"]]) <= 3


def test_cross_source_pairs_respect_reuse(spark):
    rows = [("d", str(i % 30), f"c{i}", "t", i % 3, "m", None) for i in range(300)]
    items = spark.createDataFrame(rows, "dataset_name string, base_text_id string, candidate_id string, text string, label int, method string, parent_candidate_id string")
    pairs = composing.cross_source_pairs(items, reuse=1).collect()
    used = [r[c] for r in pairs for c in ("left_candidate_id", "right_candidate_id")]
    assert len(pairs) > 50 and len(used) == len(set(used))
    assert all(r["left_base"] != r["right_base"] and r["left_label"] != r["right_label"] for r in pairs)


@pytest.mark.parametrize("reuse", [1, 3])
@pytest.mark.parametrize("few", [0, 256])
def test_cross_source_pairs_leave_none_that_fit(spark, monkeypatch, reuse, few):
    monkeypatch.setattr(composing, "FEW", few)
    rows = [("d", str(i % 30), f"c{i}", "t", i % 3, "m", None) for i in range(300)]
    # a source and a label that most items have, and a pair of which only few items fit each other
    rows += [("hot", "0", f"h{i}", "t", 0, "m", None) for i in range(400)] + [("hot", "0", f"s{i}", "t", 1 + i, "m", None) for i in range(9)] + [("hot", f"b{i}", f"l{i}", "t", 0, "m", None) for i in range(7)]
    rows += [("one", "x", f"o{i}", "t", i, "m", None) for i in range(300)] + [("d", None, "n0", "t", 1, "m", None), ("d", "1", "n1", "t", None, "m", None)]
    items = spark.createDataFrame(rows + rows[:5], "dataset_name string, base_text_id string, candidate_id string, text string, label int, method string, parent_candidate_id string")
    pairs = composing.cross_source_pairs(items, reuse=reuse).collect()
    by_id = {r[2]: r for r in rows}
    fit = lambda a, b: a[0] == b[0] and None not in (a[1], b[1], a[4], b[4]) and a[1] != b[1] and a[4] != b[4]
    made = {frozenset((r["left_candidate_id"], r["right_candidate_id"])) for r in pairs}
    uses = {i: sum(i in p for p in made) for i in by_id}
    assert len(made) == len(pairs) and max(uses.values()) <= reuse and all(fit(*(by_id[i] for i in p)) for p in made)
    left = [r for r in by_id.values() if uses[r[2]] < reuse]
    assert not [(a, b) for a in left for b in left if fit(a, b) and frozenset((a[2], b[2])) not in made]


def test_failures_stand_alone_and_are_retried(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.col("id") * 2.0)

    def picky(rows):
        if (rows["id"] % 10 == 3).any():
            raise RuntimeError("bad row")
        return rows["x"]

    out = scoring.scored(df, picky, "id").collect()
    assert {r["id"] for r in out if r["error_type"]} == set(range(3, 100, 10))
    assert all(r["score_value"] == 2 * r["id"] for r in out if not r["error_type"])
    flag = tmp_path / "second"

    def later(rows):
        if (rows["id"] == 5).any() and not flag.exists():
            if len(rows) == 1:
                flag.touch()
            raise RuntimeError("not yet")
        return rows["x"]

    assert scoring.retried(df, later, "id", 3).where("error_type is not null").count() == 0


def test_collected_answers(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    got = spark.createDataFrame([("a", 1, 5.0, None), ("a", 2, None, "late"), ("b", 1, None, "x"), ("z", 1, 1.0, None)], "k string, attempt int, value double, error string")
    assert sorted((r["k"], r["value"], r["error"]) for r in scoring.collected(asked, got, "k").collect()) == [("a", 5.0, None), ("b", None, "x"), ("c", None, "MissingBatchResult")]


def test_kendall_of_known_values(spark):
    rows = [("g", x, y) for x, y in [(1.0, 1.0), (2.0, 3.0), (2.0, 2.0), (4.0, 5.0), (5.0, 4.0), (5.0, 4.0), (None, 1.0)]] + [("flat", 1.0, 1.0), ("flat", 1.0, 2.0)]
    got = {r["g"]: r["kendall"] for r in metrics.kendall(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    pairs = [(a, b) for i, a in enumerate(rows[:6]) for b in rows[:i]]
    sign = lambda v: (v > 0) - (v < 0)
    c = sum(sign(a[1] - b[1]) * sign(a[2] - b[2]) for a, b in pairs)
    nx, ny = (sum(a[k] != b[k] for a, b in pairs) for k in (1, 2))
    assert got["g"] == pytest.approx(c / (nx * ny) ** 0.5) and got["flat"] is None


def test_early_stops(spark):
    rows = [(1, s, m) for s, m in enumerate([0.1, 0.3, float("nan"), 0.2, 0.25, 0.9])]
    (r,) = metrics.early_stops(spark.createDataFrame(rows, "run int, step int, m double"), ["run"], "step", "m", 2).collect()
    assert (r["best"], r["best_step"], r["stop_step"]) == (0.3, 1, 4)


def test_originals_from_lines(spark, tmp_path):
    rows = ['{"custom_id": 7, "text": "a", "x": [1]}', '{"head_id": "h", "custom_id": "h", "text": "b"}', '{"custom_id": true, "text": "c"}', "", "{", '{"custom_id": 1, "head_id": 2, "text": "d"}', '{"custom_id": 3, "text": ""}']
    (tmp_path / "o.jsonl").write_text("\n".join(rows))
    lines = jsonl.read_lines(spark, str(tmp_path / "o.jsonl"))
    assert jsonl.malformed(lines).count() == 1
    got = sorted((r["base_text_id"] or "", r["fault"] or "") for r in jsonl.originals(lines, "d").collect())
    assert got == sorted([("7", ""), ("h", ""), ("", "no_id"), ("", "malformed"), ("1", "ids_differ"), ("3", "no_text")])
    numbered_lines = jsonl.read_numbered_lines(spark, str(tmp_path / "o.jsonl")).collect()
    assert [r["value"] for r in sorted(numbered_lines, key=lambda r: r["line"])] == rows


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None), (2, "b", 1.5)], "b int, a string, c double")
    jsonl.write_jsonl(df, str(tmp_path / "out"))
    rows = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(rows, key=lambda r: r["b"]) == [{"a": "é", "b": 1, "c": None}, {"a": "b", "b": 2, "c": 1.5}]
    with pytest.raises(Exception, match="exists"):
        jsonl.write_jsonl(df, str(tmp_path / "out"))


def test_layers(spark, tmp_path):
    layers = jsonl.Layers(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "candidate_id string, text string")
    layers.write(rows, "m", "r", 1, "2026-01-01T00:00:00Z")
    layers.write(rows.limit(1), "m", "r", 1, "2026-01-02T00:00:00Z")
    layers.write(rows, "m", "r", 2, "2026-01-01T00:00:00Z", source_layer=1, source_method="m", source_run_id="r")
    assert layers.read(layers=[1]).count() == 1 and layers.read().count() == 3
    assert layers.count_faults().count() == 0
    with pytest.raises(lineage.RuleBroken):
        layers.write(rows.union(rows), "m", "other", 1, "2026-01-01T00:00:00Z")
    with pytest.raises(LookupError):
        layers.read(methods=["none"])
    with pytest.raises(ValueError):
        layers.write(rows, "../x", "r", 1, "")


def test_conllu(spark, tmp_path):
    (tmp_path / "x.conllu").write_text("# newdoc id = news-1\n# meta::title = T\n# text = T\n1\tT\n\n# text = Second one.\n# newdoc id = web-2\n# meta::genre = blog\n# text = Alone\n")
    lines = jsonl.read_numbered_lines(spark, str(tmp_path / "x.conllu"))
    got = {r["doc_id"]: (r["genre"], r["title"], r["text"], r["n_sentences"]) for r in benchmarks.conllu_documents(lines, "drop").collect()}
    assert got == {"news-1": ("news", "T", "Second one.", 1), "web-2": ("blog", None, "Alone", 1)}


def test_benchmark_records(spark):
    lists = spark.createDataFrame([("s", ["a", "b"], [1.0, 2.0])], "id string, texts array<string>, fluency array<double>")
    assert benchmarks.zipped_lists(lists, "id", "texts", {"f": "fluency"}, "B", "b").count() == 2
    bad = spark.createDataFrame([("s", ["a", "b"], [1.0])], "id string, texts array<string>, fluency array<double>")
    with pytest.raises(Exception, match="isn't as long"):
        benchmarks.zipped_lists(bad, "id", "texts", {"f": "fluency"}, "B", "b").collect()
    fixes = spark.createDataFrame([("1", "He go.", ["He goes.", "He go.", "", None])], "id string, s string, c array<string>")
    assert [r["preferred_text"] for r in benchmarks.corrections(fixes, "id", "s", "c").collect()] == ["He goes."]
    picks = spark.createDataFrame([("1", "x", "y", "A is better"), ("2", "x", "y", "b wins"), ("3", "x", "y", "Equally good")], "id string, a string, b string, choice string")
    got = {r["source_id"]: (r["preferred_text"], r["tie"]) for r in benchmarks.choices(picks, "id", "a", "b", "choice").collect()}
    assert got == {"1": ("x", False), "2": ("y", False), "3": ("x", True)}


def test_journal(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(5).repartition(3).write.parquet(source)
    work = lambda df: df.where("id != 6").withColumn("twice", F.col("id") * 2)
    journal.run_journaled(spark, source, "id long", out, state, work, fingerprint="a")
    spark.range(5, 8).repartition(3).write.mode("append").parquet(source)
    journal.run_journaled(spark, source, "id long", out, state, work, fingerprint="a")
    rows, log = spark.read.parquet(f"{out}/rows"), journal.read_journal(spark, out)
    assert sorted(r["twice"] for r in rows.collect()) == [0, 2, 4, 6, 8, 10, 14]
    # a batch without rows (id 6 alone) has a row of the journal, so it is no gap
    assert journal.missing_batches(log, "batch").count() == 0 and log.agg(F.sum("n_rows")).first()[0] == 7
    assert [r["batch"] for r in journal.missing_batches(log.where("batch != 1"), "batch").collect()] == [1]
    with pytest.raises(journal.Changed):
        journal.run_journaled(spark, source, "id long", out, state, work, fingerprint="b")
    done = spark.createDataFrame([(0, True), (1, False)], "id long, ok boolean")
    (s,) = journal.run_summary(log, done, spark.range(3), "id", "ok").collect()
    assert (s["n_inputs"], s["n_attempted"], s["n_ready"], s["n_failed"], s["complete"], s["n_batches"]) == (3, 2, 1, 1, False, log.count())
    df = spark.createDataFrame([("a", "x"), ("b", None)], "id string, text string")
    assert journal.fingerprint(df, {"k": "1"}, "id", "text") == journal.fingerprint(df.orderBy(F.desc("id")), {"k": "1"}, "id", "text") != journal.fingerprint(df, {"k": "2"}, "id", "text")
