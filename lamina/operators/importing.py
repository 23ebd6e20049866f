"""The funnel from filter answers to originals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.ordering import quantiles, written
from lamina.functions.text import assessment, cleaned
from lamina.operators.lineage import duplicates, enforce

STATUSES = ("passed", "failed", "missing", "malformed", "inconsistent")


def assessed(rows: DataFrame, answer: str) -> DataFrame:
    """rows with status: what the filter's answer says."""
    return rows.withColumn("status", assessment(answer))


def imported(rows: DataFrame, dataset: str, id_col: str, text_col: str, answer: str, line: str) -> DataFrame:
    """As `originals`, with filter_provenance (the line and the answer); refused unless ids are distinct and a row
    has passed."""
    good = assessed(rows, answer).where("status = 'passed'").where(cleaned(text_col) != "")
    out = good.select(F.lit(dataset).alias("dataset_name"), F.col(id_col).cast("string").alias("base_text_id"), F.col(text_col).alias("text"), F.struct(F.col(line).alias("line"), F.col(answer).alias("assessment")).alias("filter_provenance"))
    out = written(out, "imported")
    enforce(duplicates(out, "base_text_id"), "passed rows have ids of their own")
    if out.isEmpty():
        raise ValueError("no row has passed")
    return out


def destination_faults(paths: list[str], spark: SparkSession) -> list[str]:
    """Those of the paths that exist: what an import must not replace."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = lambda p: (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)
    return [p for p in paths if there(p)]


def originals(rows: DataFrame, dataset: str, id_col: str, text_col: str, answer: str) -> DataFrame:
    """Passed rows with a text as originals: dataset_name, base_text_id, text and filter_answer."""
    good = assessed(rows, answer).where("status = 'passed'").where(cleaned(text_col) != "")
    return good.select(F.lit(dataset).alias("dataset_name"), F.col(id_col).cast("string").alias("base_text_id"), F.col(text_col).alias("text"), F.col(answer).alias("filter_answer"))


def funnel(rows: DataFrame, answer: str, by: list[str] | None = None) -> DataFrame:
    """Rows of each status, those that none has with 0: by, status and n."""
    by = by or []
    counts = assessed(rows, answer).groupBy(*by).agg(*[F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s) for s in STATUSES])
    return counts.unpivot(by, list(STATUSES), "status", "n").withColumn("n", F.coalesce("n", F.lit(0)))


def distribution(rows: DataFrame, by: list[str], features: dict[str, str]) -> DataFrame:
    """Counts of each value of some columns (arrays count by element): by, feature, value and n."""
    kinds = dict(rows.dtypes)
    each = []
    for name, column in features.items():
        value = F.explode(column) if kinds[column].startswith("array") else F.col(column)
        each.append(rows.select(*by, F.lit(name).alias("feature"), value.cast("string").alias("value")).where("value is not null"))
    return reduce(DataFrame.unionByName, each).groupBy(*by, "feature", "value").agg(F.count("*").alias("n"))


def length_report(rows: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """n, mean, p10 and p90 (linear) of lengths in code points."""
    sized = rows.select(*by, F.length(text_col).alias("__n"))
    means = sized.groupBy(*by).agg(F.count("*").alias("n"), F.avg("__n").alias("mean_chars"))
    cuts = quantiles(sized, by, "__n", {"p10": 0.1, "p90": 0.9})
    return means.join(cuts, by) if by else means.crossJoin(F.broadcast(cuts))


def labelled_audit(rows: DataFrame, src: str, tgt: str) -> DataFrame:
    """One row: n_rows, n_yes, n_no, n_sources, n_examples, n_conflicting (sources with both labels), mean
    longest length and rows_hash (a sum of the rows' hashes, whatever their order). Sources are counted through
    groups of their own, not as distinct sets in one task. A label that is neither Yes nor No is an error."""
    rows = rows.withColumn(tgt, F.when(F.col(tgt).isin("Yes", "No"), F.col(tgt)).otherwise(F.raise_error(F.concat(F.lit("no label: "), F.coalesce(F.col(tgt), F.lit("null"))))))
    pairs = rows.groupBy(src, tgt).agg(F.count("*").alias("n"))
    own = F.conv(F.left(F.sha2(F.concat_ws("\x1f", src, tgt), 256), F.lit(12)), 16, 10).cast("decimal(38,0)")
    pairs = pairs.withColumn("h", own * F.col("n"))
    sources = pairs.groupBy(src).agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.sum(F.when(F.col(tgt) == "Yes", F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col(tgt) == "No", F.col("n")).otherwise(0)).alias("no"), F.sum("h").alias("h"))
    chars = F.length(src)
    return sources.agg(F.sum("n").alias("n_rows"), F.sum("yes").alias("n_yes"), F.sum("no").alias("n_no"), F.count("*").alias("n_sources"), F.sum("labels").alias("n_examples"), F.sum(F.when(F.col("labels") > 1, 1).otherwise(0)).alias("n_conflicting"), (F.sum(chars * F.col("n")) / F.sum("n")).alias("mean_chars"), F.max(chars).alias("max_chars"), F.sum("h").cast("string").alias("rows_hash"))
