"""Words and their places over several slices of a batch, against a scan of each text."""

import regex
from pyspark.sql import functions as F

from lamina.functions import edits
from lamina.functions.ordering import BATCH_ROWS


def test_word_spans_in_slices_of_small_batches(spark):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = [None if i % 7 == 0 else "" if i % 7 == 1 else f"é𝔄 don’t {'ab ' * (i % 11)}x{i}y" for i in range(3 * edits.SPANS_ROWS + 5)]
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1).select("k", edits.word_spans("t").alias("s")).orderBy(F.col("k")).collect()
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = [None if t is None else [(m.start(), m.end(), m[0]) for m in regex.finditer(edits.WORD, t)] for t in texts]
    assert [None if r["s"] is None else [tuple(x) for x in r["s"]] for r in rows] == want
