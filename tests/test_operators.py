"""Builds, generation, budgets, suites, trials and answers, against brute force or known results."""

import itertools
import json
import random
from collections import Counter
from math import erf, factorial, sqrt

import pytest
from pyspark.sql import functions as F

from lamina.functions import answers, draws, edits, prompts
from lamina.functions.ordering import numbered, quantiles, running_sum
from lamina.operators import budgets, building, composing, generation, importing, lineage, metrics, scoring, splitting, suites, trials
from lamina.sources import benchmarks, jsonl

ITEM = "dataset_name string, base_text_id string, candidate_id string, text string, label int, method string, run_id string, parent_candidate_id string"


def chains(spark, n=30):
    rows = []
    for i in range(n):
        rows.append(("d", str(i), f"{i}-0", f"text {i}", 0, "original", "original", None))
        rows += [("d", str(i), f"{i}-{k}", f"text {i} {k}", k, f"m{k % 2}", "r", f"{i}-{k - 1}") for k in range(1, 4)]
    return spark.createDataFrame(rows, ITEM)


def splits_of(spark, n=30):
    return spark.createDataFrame([(str(i), ("train", "dev", "test")[min(i % 6, 2) if i % 6 < 3 else 0]) for i in range(n)], "base_text_id string, split string")


# --- ordering --------------------------------------------------------------------------------------


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_running_sums_and_quantiles(spark, by):
    r = random.Random(len(by))
    rows = [(r.choice([None, 0, 0, 0, 1, 2]), r.choice("xy"), i, r.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, h string, i long, v int").repartition(7)
    got = {x["i"]: x["before"] for x in running_sum(df, by, [F.col("i")], F.col("v")).collect()}
    at = {"g": 0, "h": 1}
    seen = Counter()
    for row in sorted(rows, key=lambda x: x[2]):
        key = tuple(row[at[c]] for c in by)
        assert got[row[2]] == seen[key]
        seen[key] += row[3]
    cut = {tuple(x[c] for c in by): (x["a"], x["b"]) for x in quantiles(df.where("g is not null"), by, "v", {"a": 0.5, "b": 0.1}).collect()}
    groups = {}
    for row in rows:
        if row[0] is not None:
            groups.setdefault(tuple(row[at[c]] for c in by), []).append(row[3])
    for key, values in groups.items():
        values.sort()
        for got_, q in zip(cut[key], (0.5, 0.1), strict=True):
            x = (len(values) - 1) * q
            lo, hi = values[int(x)], values[min(int(x) + 1, len(values) - 1)]
            assert abs(got_ - (lo + (hi - lo) * (x - int(x)))) < 1e-9
    assert numbered(df.limit(0), F.col("i")).collect() == []


def test_statistics_of_all_rows_and_of_none(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (float("nan"), 1.0), (2.0, None)], "t double, p double")
    (r,) = metrics.regression(rows, [], "t", "p").collect()
    assert (r["n"], round(r["mae"], 9)) == (3, round(4 / 3, 9)) and abs(r["spearman"] - 0.5) < 1e-12
    assert metrics.spearman(rows.limit(0), [], "t", "p").collect() == [] == metrics.kendall(rows.limit(0), [], "t", "p").collect()
    constant = rows.withColumn("p", F.lit(1.0))
    assert metrics.spearman(constant, [], "t", "p").first()["spearman"] is None and metrics.regression(constant, [], "t", "p").first()["spearman"] == 0


def test_early_stops_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(metrics, "CHECKS", 3)
    r = random.Random(3)
    rows = [(k, i, r.random()) for k in range(6) for i in range(k * 4)]
    got = {x["run"]: (x["best"], x["best_step"], x["stop_step"]) for x in metrics.early_stops(spark.createDataFrame(rows, "run int, step int, m double"), ["run"], "step", "m", 3, 0.01, 2).collect()}
    for k in range(1, 6):
        best, at, bad, stop = None, None, 0, None
        for _, i, m in [x for x in rows if x[0] == k]:
            if best is None or m > best + 0.01:
                best, at, bad = m, i, 0
            elif i >= 2:
                bad += 1
            if bad >= 3:
                stop = i
                break
        assert got[k] == (best, at, stop)


# --- builds ----------------------------------------------------------------------------------------


def test_training_sets(spark, tmp_path):
    rows, of = chains(spark), splits_of(spark)
    whole = building.training_set(rows, of)
    assert whole.count() == 30 and all(len(x["texts"]) == 4 for x in whole.collect())
    pairs = building.training_set(rows, of, pair_policy="parent_child", form="grouped").collect()
    assert len(pairs) == 90 and {len(x["labels"]) for x in pairs} == {2} and len({x["id"] for x in pairs}) == 90
    assert "d:0__parent_child_0" in {x["id"] for x in pairs}
    cross = building.training_set(rows, of, pair_policy="cross_source_unmatched", form="pairwise", reuse=1)
    split_of = {x["base_text_id"]: x["split"] for x in of.collect()}
    for x in cross.collect():
        assert {split_of[s] for s in x["source_original_ids"]} == {x["split"]} and x["chosen_layer"] < x["rejected_layer"] and x["pair_id"].startswith("unmatched__")
    small = building.training_set(rows, of, form="binary", downsample=30)
    assert small.count() == 30 and {x["split"] for x in small.collect()} == {"train", "dev", "test"}
    path = str(tmp_path / "set")
    building.write_training_set(whole, path, {"seed": 42})
    assert building.read_training_set(spark, path).count() == 30
    assert json.loads(spark.read.text(f"{path}/metadata").first()[0])["num_examples"]["train"] == whole.where("split = 'train'").count()
    with pytest.raises(Exception, match="exists"):
        building.write_training_set(whole, path)
    building.write_training_set(whole.where("split = 'train'"), path, overwrite=True)
    with pytest.raises(building.BuildError, match="lacks"):
        building.read_training_set(spark, path)


def test_training_sets_refuse(spark):
    rows, of = chains(spark), splits_of(spark)
    score = rows.where("label = 1").select("candidate_id", F.lit("s").alias("scoring_method"), F.lit(1.0).alias("score_value"))
    assert building.training_set(rows, of, score, ["s"], form="regression").count() == 30
    for kwargs in ({"form": "binary", "pair_policy": "original_only"}, {"form": "regression"}, {"scores": score, "score_names": ["other"]}, {"assignments": of.withColumn("split", F.lit("train"))}):
        with pytest.raises(building.BuildError):
            building.training_set(**{"items": rows, "assignments": of, **kwargs})
    for kwargs in ({"items": rows.where("label != 1")}, {"assignments": of.union(of)}, {"assignments": of.union(spark.createDataFrame([("zz", "dev")], of.schema))}, {"scores": score.union(score)}, {"items": rows.union(rows.where("candidate_id = '0-0'").withColumn("candidate_id", F.lit("again"))), "form": "binary"}):
        with pytest.raises(lineage.RuleBroken):
            building.training_set(**{"items": rows, "assignments": of, **kwargs})
    with pytest.raises(ValueError):
        building.training_set(rows, of, composition="none")
    with pytest.raises(Exception, match="no split for source"):
        building.in_splits(rows, of.where("base_text_id != '3'"), ["dev"], "error").collect()


def test_assignments_and_scores_in_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"base_text_id": "1", "split": "dev"}\n')
    assert building.read_assignments(spark, str(tmp_path / "a.jsonl"), chains(spark)).collect() == [("1", "dev")]
    (tmp_path / "b.jsonl").write_text('{"base_text_id": "1", "split": "dev"}\n{"base_text_id": "1", "split": "dev"}\n')
    with pytest.raises(lineage.RuleBroken):
        building.read_assignments(spark, str(tmp_path / "b.jsonl"), chains(spark))
    rows = chains(spark)
    scores = rows.where("label = 2").select("candidate_id", "base_text_id", F.col("method").alias("perturbation_method"), F.col("run_id").alias("perturbation_run_id"), F.col("label").alias("target_layer"), F.lit(1).alias("source_layer"), F.col("parent_candidate_id").alias("reference_candidate_id"), F.lit("m").alias("scoring_method"), F.lit("r").alias("scoring_run_id"), F.lit(0.5).alias("score_value"))
    root = str(tmp_path / "scores")
    scoring.write_scores(scores, rows, root, "m", "r", metadata={"k": 1})
    assert jsonl.read_scores(spark, root).count() == 30 == jsonl.read_scores(spark, root, ["m"], ["r"]).count()
    with pytest.raises(lineage.RuleBroken):
        scoring.write_scores(scores.withColumn("source_layer", F.lit(0)), rows, root, "m", "other")
    scoring.write_scores(scores, rows, root, "wrong", "r")
    with pytest.raises(lineage.RuleBroken, match="folder"):
        jsonl.read_scores(spark, root)
    with pytest.raises(ValueError):
        scoring.write_scores(scores, rows, root, "../x", "r")


def test_export_and_request_chunks(spark):
    rows, of = chains(spark), splits_of(spark)
    mapping = rows.select(F.col("candidate_id").alias("old"), F.concat(F.lit("n"), "candidate_id").alias("new"))
    kept, _ = scoring.exported(rows, of, ["dev"], ["m0", "m1"], mapping, rows.select("candidate_id"))
    assert kept.where("parent_candidate_id like 'n%'").count() == 15
    with pytest.raises(lineage.RuleBroken):
        scoring.exported(rows.where("candidate_id != '1-2'"), of, ["dev"], ["m0", "m1"], mapping, rows.select("candidate_id"))
    with pytest.raises(Exception, match="no new id"):
        scoring.rekeyed(rows, mapping.where("old != '1-1'"), ["candidate_id"]).collect()
    r = random.Random(4)
    sizes = [r.randrange(1, 50) for _ in range(200)]
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "k long, body string")
    got = sorted(scoring.sized_chunks(df, "k", "body", 20, 100).collect(), key=lambda x: x["k"])
    chunks = {}
    for x in got:
        chunks.setdefault(x["chunk"], []).append(x["k"])
    assert sorted(chunks) == list(range(len(chunks))) and all(len(c) <= 20 and sum(sizes[k] for k in c) <= 100 for c in chunks.values())
    assert [k for c in sorted(chunks) for k in chunks[c]] == list(range(200)) and got[7]["custom_id"] == "request-000000007"
    with pytest.raises(Exception, match="too large"):
        scoring.sized_chunks(df, "k", "body", 20, 60).collect()


# --- generation ------------------------------------------------------------------------------------


def test_assignment_plans_are_balanced(spark):
    docs = spark.createDataFrame([(str(i), "x" * r) for i, r in enumerate(random.Random(1).choices(range(3000), k=301))], "base_text_id string, text string")
    catalog = spark.createDataFrame([(f"e{i}", [f"d{i % 4}"]) for i in range(9)], "edit_id string, target_dimensions array<string>")
    plan = generation.assignment_plan(docs, catalog)
    rows = plan.collect()
    for method in generation.PLANNED:
        own = [x for x in rows if x["method"] == method]
        assert len(own) == 301 and all(len(set(x["edits"])) == x["edit_count"] for x in own)
        for counts in (Counter(e for x in own for e in x["edits"]), Counter(x["severity"] for x in own)):
            assert max(counts.values()) - min(counts.values()) <= 1
    assert {x["edit_count"] for x in rows if x["method"] == "llm_single"} == {1} and max(x["edit_count"] for x in rows) > 1
    assert generation.plan_faults(plan, catalog).count() == 0
    asked = generation.planned_requests(docs, plan, catalog, "llm_sampled").collect()
    edits_of = {(x["base_text_id"]): x["edits"] for x in rows if x["method"] == "llm_sampled"}
    assert all([e["edit_id"] for e in x["edits"]] == edits_of[x["base_text_id"]] for x in asked)
    with pytest.raises(Exception, match="no plan"):
        generation.planned_requests(docs, plan.where("base_text_id != '5'"), catalog, "llm_sampled").collect()
    with pytest.raises(Exception, match="unknown edit"):
        generation.planned_requests(docs, plan, catalog.where("edit_id != 'e1'"), "llm_sampled").collect()
    with pytest.raises(ValueError):
        generation.assignment_plan(docs, catalog.limit(0))
    with pytest.raises(lineage.RuleBroken):
        generation.assignment_plan(docs.union(docs), catalog)


def test_catalogs(spark, tmp_path):
    entry = {"edit_id": "a", "target_dimensions": ["d"], "edit_type": "t", "example_edited": "x", "example_source": "y"}
    lines = [json.dumps(entry), "", "{no", json.dumps({**entry, "edit_id": "b", "edit_type": " "}), json.dumps({**entry, "edit_id": "c"}), json.dumps({**entry, "edit_id": "c", "target_dimensions": []})]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    rows = sorted(generation.read_catalog(spark, str(tmp_path / "c.jsonl")).collect(), key=lambda x: x["ordinal"])
    assert [(x["edit_id"], x["fault"]) for x in rows] == [("a", None), (None, "malformed"), ("b", "missing"), ("c", "repeated"), ("c", "missing")] and rows[0]["example_clean"] == "y"


def test_edit_chains(spark):
    values = ["one two three four five six seven eight nine ten " * 3, "a", "", None, "same same"]
    df = spark.createDataFrame(list(enumerate(values)), "k long, text string")
    rows = {x["k"]: x for x in generation.edited_chains(df, F.lit(3), F.col("k")).collect()}
    assert len(rows[0]["applied"]) == 3 == len(rows[0]["audit"]) and rows[0]["reason"] is None and rows[0]["edited"] != values[0]
    assert all(a["tried"][-1] == a["applied"] for a in rows[0]["audit"])
    assert rows[2]["reason"] == rows[3]["reason"] == "no_change" and rows[2]["edited"] is None and sorted(rows[2]["audit"][0]["tried"]) == sorted(edits.EDITS)
    items = spark.createDataFrame([(str(k), str(k), v or "") for k, v in enumerate(values)], "candidate_id string, base_text_id string, text string")
    assert generation.generated(items, "trad_single").count() == 5
    with pytest.raises(LookupError):
        generation.generated(items, "none")
    with pytest.raises(ValueError):
        generation.method("trad_single")(lambda x: x)


def test_batches_of_results(spark):
    inputs = spark.createDataFrame([("p", "1", "a b"), ("q", "2", "c")], "candidate_id string, base_text_id string, text string")
    schema = "parent_candidate_id string, base_text_id string, method string, run_id string, target_layer int, text string"
    results = spark.createDataFrame([("p", "1", "m", "r", 1, "new"), ("q", "2", "m", "r", 1, " c ")], schema)
    old = spark.createDataFrame([("p", 4)], "parent_candidate_id string, candidate_index int")
    good, bad = generation.collected_batch(inputs, results, old, "d", "m", "r", 1)
    (c,) = good.collect()
    assert c["candidate_index"] == 5 and c["candidate_id"].startswith("candidate__d__m__r__base_1__layer_1__candidate_000005__")
    assert bad.collect() == [("q", "unchanged_output")]
    for wrong in (results.limit(1), results.withColumn("run_id", F.lit("other")), results.withColumn("base_text_id", F.lit("9"))):
        with pytest.raises(lineage.RuleBroken):
            generation.collected_batch(inputs, wrong, old, "d", "m", "r", 1)


def test_chances_of_edit_counts(spark):
    for most in range(1, 6):
        chances = edits.count_chances(most)
        assert abs(sum(chances) - 1) < 1e-12 and chances == pytest.approx(chances[::-1])
    phi = lambda x: (1 + erf(x / sqrt(2))) / 2
    # of two, one if the normal draw (mean 1.5, deviation 1/6) is below 1.5; of three the middle one between 1.5 and 2.5
    assert edits.count_chances(2)[0] == pytest.approx(0.5)
    assert edits.count_chances(3)[1] == pytest.approx((phi(1.5) - phi(-1.5)) / (phi(3) - phi(-3)))
    rows = spark.range(20000).select(edits.edit_count(F.lit(5), F.col("id")).alias("n")).groupBy("n").count().collect()
    for x in rows:
        assert abs(x["count"] / 20000 - edits.count_chances(5)[x["n"] - 1]) < 0.02


def test_words_and_focus(spark):
    t = "Don't stop, éáb 12 x’y 'end'"
    (r,) = spark.createDataFrame([(t,)], "t string").select(edits.word_spans("t").alias("s")).collect()
    assert [(t[x["start"] : x["end"]]) for x in r["s"]] == [x["word"] for x in r["s"]] == ["Don't", "stop", "éáb", "x’y", "end"]
    pick = lambda a, b, radius: [x["word"] for x in spark.createDataFrame([(t,)], "t string").select(edits.word_spans("t").alias("s")).select(edits.focused(F.col("s"), F.lit(a).cast("int"), F.lit(b).cast("int"), radius).alias("f")).first()["f"]]
    assert pick(6, 8, 0) == ["stop"] and pick(6, 8, 1) == ["Don't", "stop", "éáb"] and len(pick(None, None, 0)) == 5
    assert pick(17, 18, 0) == ["éáb"] or pick(17, 18, 0) == ["x’y"]
    case = lambda w, m: spark.range(1).select(edits.case_like(F.lit(w), F.lit(m))).first()[0]
    assert [case("word", m) for m in ("ABC", "Abc", "abc", "A")] == ["WORD", "Word", "word", "Word"]


def test_rules_and_spans(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, "x")], "k long, text string")
    every = generation.rule_outputs(df, ["swap", "deletion", "typo"], "all", F.col("k")).collect()
    assert {x["rule"] for x in every if x["k"] == 1} == {"swap", "deletion"} and [(x["rule"], x["reason"]) for x in every if x["k"] == 2] == [(None, "no_verified_edit")]
    first = generation.rule_outputs(df, ["typo", "swap", "deletion"], "first_success", F.col("k")).where("k = 1").collect()
    assert [x["rule"] for x in first] == ["swap"] and generation.rule_outputs(df, ["swap", "deletion"], "random_success", F.col("k")).count() == 2
    with pytest.raises(ValueError):
        generation.rule_outputs(df, ["none"], "all")
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(w).alias("word")) for a, b, w in ((4, 5, "long"), (0, 1, ""), (2, 3, "X"))])
    assert df.where("k = 1").select(edits.replaced(F.col("text"), spans)).first()[0] == " X long d e f g h"
    packed = jsonl.with_metadata(df.withColumn("n", F.col("k") * 2), ["text"])
    assert sorted(tuple(x) for x in jsonl.without_metadata(packed, "k long, n long").collect()) == [("a b c d e f g h", 1, 2), ("x", 2, 4)]
    with pytest.raises(LookupError):
        scoring.scorer("none")


def test_other_hashes(spark, tmp_path):
    import hashlib

    assert spark.range(1).select(draws.blake2b(F.lit("é"), 10)).first()[0] == hashlib.blake2b("é".encode(), digest_size=10).hexdigest()
    (tmp_path / "f").write_bytes(b"abc")
    assert jsonl.file_digests(spark, str(tmp_path / "f")).first()["sha256"] == hashlib.sha256(b"abc").hexdigest()


# --- answers and prompts ---------------------------------------------------------------------------


def test_completions(spark):
    asked = []

    def f(raw, content, finish, thinking):
        asked.append((raw, content, finish, thinking))
        return len(asked) - 1

    fenced = "```json\nx```"
    rows = [
        (f(None, None, "stop", False), "", "empty_output"), (f("  ", None, "stop", False), "", "empty_output"), (f("<think>a</think> b", None, "stop", False), "b", None), (f("a</think>b", None, "stop", True), "b", None),
        (f("no thought", None, "stop", True), "", "reasoning_only"), (f("<think>open", None, "stop", False), "", "reasoning_only"), (f("raw", "final", "stop", True), "final", None), (f('{"text": "x", "app', None, "length", False), "x", None),
        (f('{"text": "x', None, "length", False), "", "unparseable_output"), (f("[1]", None, "abort", False), "", "engine_abort"), (f('{"text": 3}', None, "stop", False), "", "unparseable_output"), (f("plain", None, "length", False), "", "truncated_output"),
        (f(fenced, None, "stop", False), "x", None), (f('{"a": "</think>", "text": "a\\n\\"b\\u00e9"} x', None, "stop", False), 'a\n"bé', None), (f('{"text": null}', None, "stop", False), "", "unparseable_output"), (f('{"text": " "}', None, None, False), " ", "empty_output"),
        (f("{}", None, "stop", False), "", "unparseable_output"), (f("plain", None, None, False), "plain", None), (f("\u2003é\u2003", None, "stop", False), "é", None),
    ]
    more = [f('{"text": "x", "applied_edits": {"a": 1}} more', None, "length", False), *[f(f'{{"text": "x", "applied_edits": {v}}}', None, "stop", False) for v in ('{"a": -1}', '{"a": true}', '{"a": 1.5}', '{"a": "1"}', "[1]", "null", "{}")]]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "i int, raw string, content string, finish string, thinking boolean")
    run = lambda t: df.where(F.col("thinking") == t).select("i", answers.completion(F.col("raw"), F.col("content"), F.col("finish"), t).alias("c")).collect()
    got = {r["i"]: r["c"] for r in run(True) + run(False)}
    for i, text, reason in rows:
        assert (got[i]["text"], got[i]["reason"]) == (text, reason), asked[i]
    assert tuple(got[more[0]]) == ("x", None, {"a": 1}, True, True)
    assert [(got[i]["edits"], got[i]["edits_reported"]) for i in more[1:]] == [(None, False)] * 6 + [({}, True)]


def test_repairs(spark):
    both = ("p", "t", None)
    cases = [(x, both) for x in ('{"prompt_sentence": "p", "text": "t"}', '<think>{}</think>```json\n{"prompt_sentence": " p ", "text": "t"}\n```', 'a {"prompt_sentence": "p", "text": "t"} b', '{"prompt_sentence": "p", "text": "t"', '{"prompt_sentence": "p" "text": "t"}', '{"text": "t", "prompt_sentence": "p",}')]
    cases += [('{"prompt_sentence": "a\\n"b"", "text": "t\\u00e9"}', ('a\n"b"', "té", None)), ('{"prompt_sentence": "a \\d "q" \n z", "text": "t"}', ('a \\d "q" \n z', "t", None)), ('{"prompt_sentence": "p", "text": "cut of', ("p", "cut of", None))]
    cases += [(x, (None, None, why)) for x, why in (("x", "no_object"), ('{"text": "t"}', "missing_field"), ('{"prompt_sentence": "", "text": "t"}', "empty_field"), ('{"prompt_sentence": 1, "text": "t"}', "not_a_string"), ('{"prompt_sentence": null, "text": "t"}', "not_a_string"), ("[1]", "no_object"), (None, "no_object"), ("", "no_object"), ("} {", "missing_field"))]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string")
    got = {r["i"]: tuple(r["r"]) for r in df.select("i", answers.repaired_object(F.col("x")).alias("r")).collect()}
    for i, (x, want) in enumerate(cases):
        assert got[i] == want, x


def test_prompts_are_checked():
    good = {"schema_version": 1, "id": "p", "version": "1", "required_variables": ["a"], "messages": [{"role": "user", "content": "{a}"}]}
    assert prompts.read_prompt(json.dumps(good)).variables == ("a",)
    for change in ({"schema_version": 2}, {"id": " "}, {"required_variables": ["a", "b"]}, {"required_variables": ["a", "a"]}, {"messages": []}, {"messages": [{"role": "me", "content": "{a}"}]}, {"messages": [{"role": "user", "content": "{a.b}"}]}, {"messages": [{"role": "user", "content": "{a:3}"}]}, {"messages": [{"role": "user", "content": "{a"}]}, {"extra": 1}):
        with pytest.raises(prompts.PromptError):
            prompts.read_prompt(json.dumps({**good, **change}))
    with pytest.raises(prompts.PromptError, match="twice"):
        prompts.read_prompt('{"id": "a", "id": "b"}')
    with pytest.raises(prompts.PromptError):
        prompts.read_prompt(json.dumps(good)).rendered({"b": "b"})
    with pytest.raises(prompts.PromptError):
        prompts.load_prompt(None, "root", "../x")
    assert prompts.rubric_text([("a", "b"), ("c", "d")]) == "1. a: b\n2. c: d"


# --- statistics ------------------------------------------------------------------------------------


def test_probabilities_of_correlations(spark):
    # Student's t by its density
    def tail(t, k, steps=200000, top=400.0):
        from math import exp, lgamma, pi

        c = exp(lgamma((k + 1) / 2) - lgamma(k / 2)) / sqrt(k * pi)
        h = (top - t) / steps
        f = lambda x: c * (1 + x * x / k) ** (-(k + 1) / 2)
        return 2 * h * (f(t) / 2 + f(top) / 2 + sum(f(t + h * i) for i in range(1, steps)))

    for r, n in ((0.3, 12), (0.9, 7), (-0.5, 30)):
        t = abs(r) * sqrt((n - 2) / (1 - r * r))
        assert abs(suites.t_probability(r, n) - tail(t, n - 2)) < 1e-5
    assert suites.t_probability(1.0, 5) == 0 and suites.t_probability(0.5, 2) is None
    # Kendall's by all permutations
    for n in (3, 5, 6):
        taus = []
        for p in itertools.permutations(range(n)):
            taus.append(sum(1 if p[i] < p[j] else -1 for i in range(n) for j in range(i + 1, n)) / (n * (n - 1) / 2))
        for tau in set(taus):
            want = sum(abs(x) >= abs(tau) - 1e-12 for x in taus) / len(taus)
            assert abs(suites.kendall_probability(tau, n, [], []) - want) < 1e-12
    for n, few in ((34, 0), (34, 1), (34, 2)):  # one discordant pair: closed form against all inversions
        tau, ways = 1 - 2 * few / (n * (n - 1) / 2), [1, n - 1, (n - 2) * (n + 1) // 2]
        want = 2 * sum(ways[: few + 1]) / factorial(n)
        got = suites.kendall_probability(tau, n, [], [])
        assert got == pytest.approx(want, rel=1e-9) if few < 2 else 0 < got < 1e-10
    assert suites.kendall_probability(1.0, 10**6, [], []) == 0 and suites.kendall_probability(-1.0, 10**6, [], []) == 0
    r = random.Random(8)
    rows = [("a", float(i), float(r.randrange(5))) for i in range(60)] + [("b", float(i), float(i * i % 23)) for i in range(12)]
    got = {x["g"]: x for x in suites.correlations(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    for g in "ab":
        own = [(x, y) for k, x, y in rows if k == g]
        ties = [c for c in Counter(y for _, y in own).values() if c > 1]
        assert got[g]["kendall_p"] == pytest.approx(suites.kendall_probability(got[g]["kendall"], len(own), [], ties), abs=1e-12)
        assert 0 <= got[g]["spearman_p"] <= 1


def test_budgets(spark):
    df = spark.createDataFrame([(i, i) for i in range(1, 101)], "k long, n long")
    assert budgets.source_buckets(df, "n") == [64, 128]
    got = {x["quantile"]: x["value"] for x in budgets.order_statistics(df, "n", (0.1, 0.5, 1.0)).collect()}
    assert got == {q: sorted(range(1, 101))[round(99 * q)] for q in (0.1, 0.5, 1.0)}
    big = budgets.token_budgets(spark.createDataFrame([(5000, 100), (10, 100)], "n long, p long"), "n", "p", [64, 8192], ceiling=12000).orderBy("n").collect()
    assert [x["fits"] for x in big] == [True, True] and big[1]["source_bucket"] == 5000  # 8192 doesn't fit, the exact size does
    batches = budgets.generation_batches(budgets.token_budgets(df.withColumn("p", F.col("n")), "n", "p", [64, 128]), 30, ["k"])
    sizes = Counter(x["batch"] for x in batches.collect())
    assert sizes == {0: 30, 1: 30, 2: 4, 3: 30, 4: 6}
    limits = {x["batch"]: x["context_limit"] for x in budgets.batch_limits(batches, "p").collect()}
    assert all(v % 256 == 0 for v in limits.values()) and limits[0] <= limits[4]
    docs = spark.createDataFrame([(i, "word. " * (30 + i)) for i in range(100)], "k long, t string")
    catalog = spark.createDataFrame([("a", ["Coherence"]), ("b", ["Fluency"])], "edit_id string, target_dimensions array<string>")
    cases = budgets.pilot_cases(docs, catalog, "k", "t", ("weak", "strong")).collect()
    assert len(cases) == 12 and len({x["case_id"] for x in cases}) == 12 and min(x["k"] for x in cases) >= 10


def test_trials(spark):
    payload = {"grid": {"learning_rate": [1e-5, 2e-5], "per_device_train_batch_size": [8]}, "losses": {"hinge": {"epsilon": [0.1, 0.2]}, "logistic": {"scale": [5.0]}}}
    rows = [r.asDict() for r in trials.trial_grid(spark, payload).orderBy("trial_id").collect()]
    grid = [{k: v for k, v in r.items() if v is not None} for r in rows]
    assert [(r["learning_rate"], r["epsilon"], r["scale"]) for r in rows] == [(1e-5, 0.1, 5.0), (1e-5, 0.2, 5.0), (2e-5, 0.1, 5.0), (2e-5, 0.2, 5.0), (1e-5, 0.2, 5.0), (2e-5, 0.2, 5.0)]
    assert [r["trial_id"] for r in rows] == [1, 2, 3, 4, 5, 6]
    (huber, mae) = trials.trial_grid(spark, {"grid": {"learning_rate": [1e-5], "per_device_train_batch_size": [8]}, "losses": {"huber": {}, "mae": {}}}, "regression").orderBy("trial_id").collect()
    assert huber["trial_name"] == "001_huber_lr1e-05_delta1_bs8" and mae["trial_name"] == "002_mae_lr1e-05_bs8"
    assert len(grid) == 6 and grid[0]["trial_name"] == "001_hinge_lr1e-05_margin0.1_bs8" and grid[-1]["trial_name"] == "006_logistic_lr2e-05_scale5_bs8"
    assert all(trials.trial_fault(t) is None for t in grid) and "missing" in trials.trial_fault({"trial_id": 1})
    assert trials.trial_fault({**grid[0], "loss": "huber", "huber_delta": 0}, "regression") == "huber_delta" and "unknown" in trials.trial_fault({**grid[0], "loss": "x"})
    assert trials.loss_name(" Margin ") == "hinge" and trials.loss_name(None, "regression") == "huber"
    with pytest.raises(ValueError):
        trials.loss_name("x")
    steps = lambda *x: spark.range(1).select(trials.example_schedule(*[F.lit(v).cast("long") for v in x]).alias("s")).first()["s"]
    assert steps(2000, 500, 32, 1, 4).asDict() == {"global_batch_size": 128, "eval_steps": 4, "save_steps": 16, "effective_eval_examples": 512, "effective_save_examples": 2048}
    assert steps(None, None, 1) is None and steps(80, 80, 32)["eval_steps"] == 2 and steps(4, 4, 32)["save_steps"] == 1  # 2.5 and 0.125
    for bad in ((100, None, 1), (100, 30, 1), (0, 0, 1), (None, 3, 1)):
        with pytest.raises(Exception, match="both intervals"):
            steps(*bad)
    paths = spark.createDataFrame([(f"x/m_{i}.jsonl",) for i in (0, 2, 10)] + [("x/other_5.jsonl",)], "path string")
    dense = spark.createDataFrame([(f"m_{i}",) for i in (1, 2, 4, 5, 6)], "path string")  # five names, 5 and 6 are taken
    assert trials.next_number(dense, "m_") == 7 and trials.next_number(dense.where("path = ''"), "m_") == 0
    assert trials.next_number(paths, "m_", ".jsonl") == 3 and trials.latest_number(paths, "m_", ".jsonl").first()["number"] == 10
    names = spark.createDataFrame([("final",), ("checkpoint-20",), ("checkpoint-3",)], "n string")
    assert [x["n"] for x in names.orderBy(trials.checkpoint_order("n")).collect()] == ["checkpoint-3", "checkpoint-20", "final"]


# --- sources ---------------------------------------------------------------------------------------


def test_json_sources(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"Text": " a ", "StoryID": "s", "HolisticData": {"consensus_score": 3}, "IncrementalData": {}}, {"Text": "", "HolisticData": {"consensus_score": 1}}]))
    (tmp_path / "dict.json").write_text(json.dumps({"x": {"Text": "b", "HolisticData": {"consensus_score": 2}, "IncrementalData": {"consensus_score": 4.5}}}))
    parts = {"whole": "HolisticData", "steps": "IncrementalData"}
    read = lambda name: benchmarks.consensus(jsonl.entries(jsonl.read_json(spark, str(tmp_path / name))), "C", "C", parts)
    got = sorted((x["id"], x["text"], x["human_score"]) for x in benchmarks.standalone(read("list.json"), None, read("dict.json")).collect())
    assert got == [("C:0:steps", "b", 4.5), ("C:0:whole", "b", 2.0), ("C:s:whole", "a", 3.0)]
    (tmp_path / "bad.json").write_text("3")
    with pytest.raises(Exception, match="neither"):
        jsonl.entries(jsonl.read_json(spark, str(tmp_path / "bad.json"))).collect()
    (tmp_path / "fed.json").write_text(json.dumps([{"response": "System: hi", "annotations": {"Fluent": [1, 0, "x"], "Overall": [2, 4]}}, {"context": "c", "annotations": {"Overall": [1]}}]))
    rows = {x["kind"]: x for x in benchmarks.dialogues(jsonl.entries(jsonl.read_json(spark, str(tmp_path / "fed.json")))).collect()}
    assert (rows["turn"]["text"], rows["turn"]["fluent"], rows["turn"]["overall"]) == (" hi", 0.5, 3.0) and rows["dialogue"]["overall"] == 1.0
    (tmp_path / "gen.json").write_text(json.dumps({"0": {"gen": {"a": {"text": "t", "score": [1, 2]}, "b": {"text": "u", "score": [4]}}}}))
    assert sorted((x["system"], x["score"]) for x in benchmarks.nested_ratings(jsonl.entries(jsonl.read_json(spark, str(tmp_path / "gen.json")))).collect()) == [("a", 1.5), ("b", 4.0)]
    (tmp_path / "usr.json").write_text(json.dumps([{"responses": [{"response": "a\nb", "Natural": [1, 2]}]}]))
    assert benchmarks.rated_responses(jsonl.entries(jsonl.read_json(spark, str(tmp_path / "usr.json"))), "Natural").first()["text"] == "ab"


def test_lines_are_numbered_by_blocks(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        for name in "ab":
            (tmp_path / name).write_text("\n".join(f"{name}{i}" for i in range(200)) + "\n")
        rows = jsonl.read_numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 400 and all(x["value"][1:] == str(x["line"] - 1) and x["file"].endswith(x["value"][0]) for x in rows)


def test_conllu_titles(spark):
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(["# text = lost", "# newdoc id = web-1", "# text = Head", "# text = Body", "x"])], "file string, line long, value string")
    (d,) = benchmarks.conllu_documents(lines, "first").collect()
    assert (d["doc_id"], d["title"], d["text"], d["n_sentences"]) == ("web-1", "Head", "Head Body", 2)
    with pytest.raises(ValueError):
        benchmarks.conllu_documents(lines, "x")


def test_imports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", '{"decision": "PASS", "passes": true}', 7), (2, "b", None, 8)], "id long, text string, answer string, line long")
    (x,) = importing.imported(rows, "d", "id", "text", "answer", "line").collect()
    assert x["filter_provenance"]["line"] == 7 and x["base_text_id"] == "1"
    with pytest.raises(lineage.RuleBroken):
        importing.imported(rows.union(rows), "d", "id", "text", "answer", "line")
    with pytest.raises(ValueError):
        importing.imported(rows.where("id = 2"), "d", "id", "text", "answer", "line")
    with pytest.raises(Exception, match="no label"):
        importing.labelled_audit(spark.createDataFrame([("a", "Maybe")], "s string, t string"), "s", "t").collect()
    assert importing.destination_faults([str(tmp_path), str(tmp_path / "new")], spark) == [str(tmp_path)]
    path = str(tmp_path / "o.jsonl")
    jsonl.write_originals(spark.createDataFrame([("d", "1", "t")], "dataset_name string, base_text_id string, text string").withColumn("custom_id", F.col("base_text_id")), path)
    assert jsonl.read_originals(spark, path, "d").count() == 1
    with pytest.raises(lineage.RuleBroken):
        jsonl.write_originals(spark.createDataFrame([("d", "1", "t")] * 2, "dataset_name string, base_text_id string, text string"), path + "2")
    with pytest.raises(Exception, match="finite"):
        jsonl.write_jsonl(spark.createDataFrame([(float("nan"),)], "x double"), path + "3")
    nested = spark.createDataFrame([((float("inf"), [1.0, float("nan")]),)], "s struct<a:double,b:array<double>>")
    assert jsonl.finite_only(nested).first()["s"].asDict() == {"a": None, "b": [1.0, None]}


def test_min_max_and_regression_refuse(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "b")], "x double, y string")
    with pytest.raises(Exception, match="constant"):
        composing.min_max(df, "x", F.lit(True)).collect()
    with pytest.raises(TypeError):
        composing.regression_rows(df, "y")
    with pytest.raises(LookupError):
        splitting.named_rows(df, "y", ["a", "z"])


def test_early_stops_end_when_all_have_stopped(spark, monkeypatch):
    monkeypatch.setattr(metrics, "CHECKS", 4)
    names, write = [], metrics.written
    monkeypatch.setattr(metrics, "written", lambda df, name, *more: (names.append(name), write(df, name, *more))[1])
    rows = [(k, i, 1.0 if i == k else 0.0) for k in range(2) for i in range(40)]
    got = sorted(map(tuple, metrics.early_stops(spark.createDataFrame(rows, "run int, step int, m double"), ["run"], "step", "m", 5).collect()))
    assert got == [(0, 1.0, 0, 5), (1, 1.0, 1, 6)] and names.count("stops") == 2


def test_only_parents_with_several_results_are_ordered(spark, monkeypatch):
    """Texts that order results are sampled to the driver, so parents with one result stay out of it."""
    seen, add = [], generation.running_sum
    monkeypatch.setattr(generation, "running_sum", lambda df, *more: (seen.append(df.count()), add(df, *more))[1])
    rows = [("a", "x"), ("b", "z"), ("b", "y"), ("c", "w"), (None, "v"), (None, "u"), (None, "t")]
    old = spark.createDataFrame([("a", 4), ("b", 0), ("b", 2)], "parent_candidate_id string, candidate_index int")
    got = generation.candidate_numbers(spark.createDataFrame(rows, "parent_candidate_id string, text string"), old, ["text"])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("a", "x", 5), ("b", "y", 3), ("b", "z", 4), ("c", "w", 0), (None, "t", 0), (None, "u", 1), (None, "v", 2)]))
    assert seen == [5]
