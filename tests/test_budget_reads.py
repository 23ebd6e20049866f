"""Budgets are counted once, whatever is made of them."""

from pyspark.sql import functions as F

from lamina.operators import budgets


def counted(spark, rows):
    """Budgets of some rows and an accumulator of how often a row's tokens were counted."""
    times = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def tokens(n):
        times.add(1)
        return n

    df = spark.range(rows).select("id", F.col("id").cast("int").alias("p"), tokens("id").alias("n"))
    return budgets.token_budgets(df, "n", "p", [8, 64], ceiling=120, thinking=False), times


def test_report_counts_each_row_once(spark):
    df, times = counted(spark, 70)
    got = {(r["metric"], r["key"]): r["value"] for r in budgets.budget_report(df, "n", "p").collect()}
    assert times.value == 70
    rows = budgets.token_budgets(spark.range(70).select(F.col("id").alias("n"), F.col("id").cast("int").alias("p")), "n", "p", [8, 64], ceiling=120, thinking=False).collect()
    assert got["input_count", ""] == 70 and got["over_context_count", ""] == sum(not r["fits"] for r in rows) > 0
    assert got["reserved_rounding_tokens", ""] == sum(r["source_bucket"] - r["n"] for r in rows)
    need = sorted(r["required_tokens"] for r in rows)
    assert all(got["required_token_quantiles", str(q)] == need[round(69 * q)] for q in budgets.REPORT_AT)
    assert {(r["metric"], r["value"]) for r in budgets.budget_report(df.limit(0), "n", "p").collect()} == {(m, 0.0) for m in ("input_count", "over_context_count", "reserved_rounding_tokens")}


def test_batches_count_each_row_once(spark):
    df, times = counted(spark, 70)
    assert budgets.generation_batches(df, 16, ["id"]).count() == 70
    assert times.value == 70
