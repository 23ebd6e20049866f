"""Row numbers over a whole table without one task that sees all rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on one machine, where the
    session names none (tests), it is a new temporary folder, set for the session."""
    import tempfile

    sc = spark.sparkContext
    if path := sc.getConf().get("spark.checkpoint.dir"):
        return path
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is to name a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="lamina-")
    sc.setCheckpointDir(path)
    return path


#: Rows that a Python step over whole texts gets at once.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Cuts the session's Arrow batches to BATCH_ROWS rows; smaller settings stay."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def written(df: DataFrame, name: str, folders: list[str] | None = None) -> DataFrame:
    """df written once to the shared folder and read back; rows with equal values of `folders` in one folder, so that a filter on
    them reads nothing else."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    if not folders:
        out.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    out.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def running_sum(df: DataFrame, by: list[str], order: list[Column], value: Column, name: str = "before") -> DataFrame:
    """df with the sum of value over the rows of the same group that come before, in an order that should be
    total within it; 0 for the first.

    Rows are range-partitioned by group and order and written. Each partition sums on its own; where a group
    goes on from the partitions before, their sums are added: a table of one row for each partition at most.
    So neither a large group nor the whole table is one task's.
    """
    part, item = f"__part_{uuid.uuid4().hex[:8]}", f"__item_{uuid.uuid4().hex[:8]}"
    groups = [F.col(f"`{c}`") for c in by]
    rows = df.withColumn(item, value).repartitionByRange(*groups, *order).withColumn(part, F.spark_partition_id())
    rows = written(rows, "ordered")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, part).agg(F.sum(item).alias(f"{item}_s"))
    sums = sums.withColumn(f"{item}_b", F.sum(f"{item}_s").over(upto(Window.partitionBy(*by, F.lit(0)).orderBy(part)))).where(F.col(f"{item}_b").isNotNull()).drop(f"{item}_s")
    own = rows.withColumn(f"{item}_o", F.coalesce(F.sum(item).over(upto(Window.partitionBy(part, *by).orderBy(*order))), F.lit(0)))
    keys = [F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*by, part]]
    total = F.col(f"o.{item}_o") + F.coalesce(F.col(f"s.{item}_b"), F.lit(0))
    joined = own.alias("o").join(F.broadcast(sums.alias("s")), reduce(lambda a, b: a & b, keys), "left")
    return joined.select(*[F.col(f"o.`{c}`") for c in df.columns], total.alias(name))


def numbered(df: DataFrame, *order: Column, name: str = "row_number") -> DataFrame:
    """df with a 0-based row number in a global order, which should be total."""
    return running_sum(df, [], list(order), F.lit(1), name)


def parts(df: DataFrame, order: list[Column], starts: Column, name: str = "part") -> DataFrame:
    """df with the number of the part that a row is in (from 0), with the rows in an ascending order that should be total: a part begins
    at each of `starts`, an array of places (from 0) made of the number of rows `__n`; equal starts are empty parts.

    The order's columns alone are written and numbered. Rows find their part by comparing theirs with those at which
    parts begin, a list as long as `starts`: the rest of df is neither shuffled nor written. Rows that are equal in the order
    are in the same part, the one of their last.
    """
    names = [f"__k{i}" for i in range(len(order))]
    keys = numbered(df.select(*[c.alias(n) for c, n in zip(order, names, strict=True)]), *[F.col(n) for n in names], name="__i")
    at = keys.agg(F.count("*").alias("__n")).select(F.explode(starts.cast("array<bigint>")).alias("__i"))
    cuts = keys.join(F.broadcast(at), "__i").agg(F.collect_list(F.struct(*names)).alias("__cuts"))
    key = F.struct(*[c.alias(n) for c, n in zip(order, names, strict=True)])
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, F.size(F.filter("__cuts", lambda c: c <= key))).select(*[f"`{c}`" for c in df.columns], name)


def quantiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """by and a column for each of at: the quantile of value (numbers, nulls left out) between the two
    nearest ranks. Distinct values are counted and the counts summed in order, so no task holds a group."""
    cells = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__x")).agg(F.count("*").alias("__n"))
    cells = running_sum(cells, by, [F.col("__x")], F.col("__n"), "__before")
    place = lambda q: (F.col("__total") - 1) * F.lit(float(q))
    holds = lambda k: (F.col("__before") <= k) & (k < F.col("__before") + F.col("__n"))
    totals = cells.groupBy(*by).agg(F.sum("__n").alias("__total"))
    if by:
        cells = cells.join(totals, by)
    else:
        cells = cells.crossJoin(F.broadcast(totals))
    picks = []
    for name, q in at.items():
        picks += [F.max(F.when(holds(F.floor(place(q))), F.col("__x"))).alias(f"{name}__l"), F.max(F.when(holds(F.ceil(place(q))), F.col("__x"))).alias(f"{name}__h")]
    out = cells.groupBy(*by).agg(F.max("__total").alias("__total"), *picks)
    share = lambda q: place(q) - F.floor(place(q))
    return out.select(*by, *[(F.col(f"{n}__l") + (F.col(f"{n}__h") - F.col(f"{n}__l")) * share(q)).alias(n) for n, q in at.items()])
