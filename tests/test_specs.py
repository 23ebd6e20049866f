"""The first spec that fits a record."""

from lamina.operators import scoring

SPECS = [(1, "any", "b", "fluency", None, None), (0, "news", "b", "fluency", "sum", "news"), (2, "other", "b", "coherence", None, None)]
RECORD = "line long, benchmark string, aspect string, task string, original_data string, s array<double>, human_scores string, name string"


def match(spark, rows):
    specs = spark.createDataFrame(SPECS, "ordinal int, name string, benchmark string, aspect string, task string, original_data string")
    records = spark.createDataFrame([(*r, "own") for r in rows], RECORD.replace("human_scores string, ", ""))
    return sorted((r["id"], r["spec"], r["human_scores"], r["human_score"]) for r in scoring.matched_records(records, specs, "line", "s").collect())


def test_first_spec_with_a_finite_score(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, "b", "fluency", "sum", "news", [1.0, 2.0]),  # the first by ordinal
        (2, "b", "fluency (all): how well", "sum", "web", [nan, 3.0, None, inf]),  # task alone isn't enough
        (3, "b", "fluency", "sum", "news", [nan, None, -inf]),  # no finite score
        (4, "b", "fluency", None, None, []),
        (5, "b", "fluencyx", None, None, [1.0]),  # another aspect
        (6, "c", "fluency", None, None, [1.0]),  # another benchmark
        (7, "b", " coherence : x", None, "news", [0.0]),
        (8, "b", "fluency", "sum", "news", None),
        (7, "b", "coherence", None, "news", [5.0]),  # a repeated line
        (9, None, None, None, None, [1.0]),
    ]
    assert match(spark, rows) == [("line:1", "news", [1.0, 2.0], 1.5), ("line:2", "any", [3.0], 3.0), ("line:7", "other", [0.0], 0.0), ("line:7", "other", [5.0], 5.0)]
    assert match(spark, []) == []
