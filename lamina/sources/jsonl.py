"""JSON lines, canonical records and the layered catalog."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StructType

from lamina.functions.ordering import numbered, running_sum, written
from lamina.functions.text import finite
from lamina.operators.lineage import duplicates, enforce
from lamina.streaming.journal import Changed
from lamina.streaming.prefix import publish_once

ORIGINAL_KEYS = ("custom_id", "head_id")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines: file, value (the text) and record (the parsed object, null where malformed)."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    return rows.withColumn("record", F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed))


def malformed(lines: DataFrame) -> DataFrame:
    """Lines that are no JSON object."""
    return lines.where("record is null").select("file", "value")


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their numbers (from 1) as the files have them: file, line, value. Files are read
    in blocks; within a block lines have rising ids, and blocks stand in the order of their places, so a
    large file is read and numbered by many tasks."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), "value", F.monotonically_increasing_id().alias("__id")]
    rows = written(spark.read.text(path).select(*at), "lines")
    return running_sum(rows, ["file"], [F.col("__block"), F.col("__id")], F.lit(1), "__k").select("file", (F.col("__k") + 1).alias("line"), "value")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Whole files of JSON: file and record (null where malformed). A file is one value, so it fits in a task."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.select("file", F.try_parse_json("value").alias("record"))


def entries(files: DataFrame) -> DataFrame:
    """The elements of JSON files that hold a list, or the values of those that hold an object: file, at (from 0)
    and entry. Anything else is an error."""
    record = F.col("record")
    kind = F.schema_of_variant(record)
    ok = F.coalesce(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit(False))
    checked = F.when(ok, record).otherwise(F.raise_error(F.concat(F.lit("neither a list nor an object: "), F.col("file"))))
    return files.select("file", checked.alias("v")).lateralJoin(files.sparkSession.tvf.variant_explode(F.col("v").outer())).select("file", F.col("pos").alias("at"), F.col("value").alias("entry"))


def path_part(name: str) -> str:
    """A name that may be a folder's; separators and dots alone are refused."""
    if not name or any(c in name for c in "/\\=") or name in (".", ".."):
        raise ValueError(f"no name for a folder: {name!r}")
    return name


def read_originals(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """The originals of a JSON lines file, after all its rows are sound, their ids distinct, and there is one."""
    rows = written(originals(read_lines(spark, path), dataset), "originals")
    enforce(rows.where("fault is not null").select("base_text_id", "fault"), "originals are sound")
    enforce(duplicates(rows, "base_text_id"), "originals have ids of their own")
    if rows.isEmpty():
        raise ValueError("there are no originals")
    return rows.drop("fault")


def write_originals(rows: DataFrame, path: str) -> None:
    """Originals (dataset_name, base_text_id, text) as JSON lines: of one dataset, with ids of their own and texts."""
    enforce(duplicates(rows, "base_text_id"), "originals have ids of their own")
    enforce(rows.where("coalesce(base_text_id, '') = '' or coalesce(text, '') = ''").select("base_text_id"), "originals have ids and texts")
    if rows.select("dataset_name").distinct().limit(2).count() != 1:
        raise ValueError("originals are of one dataset")
    write_jsonl(rows, path)


def read_scores(spark: SparkSession, root: str, methods: list[str] | None = None, runs: list[str] | None = None) -> DataFrame:
    """Score rows below root/scoring_method=.../scoring_run_id=.../scores, errors left out. Only the folders asked
    for are read. Rows are to be sound, to name the method and run of their folder, and to score a candidate
    once in a run."""
    part = lambda wanted: "*" if wanted is None else "{" + ",".join(map(path_part, wanted)) + "}"
    lines = read_lines(spark, f"{root}/scoring_method={part(methods)}/scoring_run_id={part(runs)}/scores")
    of = lambda key: F.url_decode(F.regexp_extract("file", f"/{key}=([^/]+)/", 1))
    rows = scores(lines.withColumns({"__m": of("scoring_method"), "__r": of("scoring_run_id")}), ["__m", "__r"])
    rows = written(rows, "scores")
    enforce(rows.where("fault is not null"), "scores are sound")
    enforce(rows.where("scoring_method != __m or scoring_run_id != __r"), "scores are of their folder's method and run")
    enforce(duplicates(rows, "candidate_id", "scoring_method", "scoring_run_id"), "a run scores a candidate once")
    return rows.drop("fault", "__m", "__r")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes and sha256 of whole files (of a size that fits a task)."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def identifier(record, key: str):
    """A string or whole-number value as a string; null for anything else (true is no number)."""
    value = F.try_variant_get(record, f"$.{key}", "variant")
    kind = F.schema_of_variant(value)
    return F.when(kind.isin("STRING", "BIGINT", "INT", "SMALLINT", "TINYINT", "LONG"), F.try_variant_get(record, f"$.{key}", "string"))


def originals(lines: DataFrame, dataset: str) -> DataFrame:
    """dataset_name, base_text_id, text, metadata (the whole record as JSON) and fault (null if none).
    The id is custom_id, else head_id; both together must agree."""
    a, b = (identifier(F.col("record"), k) for k in ORIGINAL_KEYS)
    text = F.try_variant_get("record", "$.text", "string")
    fault = F.when(F.col("record").isNull(), "malformed").when(F.coalesce(a, b, F.lit("")) == "", "no_id").when(a != b, "ids_differ").when(F.coalesce(text, F.lit("")) == "", "no_text")
    return lines.select(F.lit(dataset).alias("dataset_name"), F.coalesce(a, b).alias("base_text_id"), text.alias("text"), F.to_json("record").alias("metadata"), fault.alias("fault"))


def scores(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """candidate_id, scoring_method, scoring_run_id, score_value and fault, and columns of lines to keep."""
    get = lambda k, t="string": F.try_variant_get("record", f"$.{k}", t)
    rows = lines.select(identifier(F.col("record"), "candidate_id").alias("candidate_id"), get("scoring_method").alias("scoring_method"), get("scoring_run_id").alias("scoring_run_id"), get("score_value", "double").alias("score_value"), "record", *(keep or []))
    fault = F.when(F.col("record").isNull(), "malformed").when(F.col("candidate_id").isNull() | F.col("scoring_method").isNull() | F.col("scoring_run_id").isNull(), "incomplete").when(~finite("score_value"), "not_finite")
    return rows.withColumn("fault", fault).drop("record")


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys, each row's nulls kept. Refuses a path that exists, and numbers that JSON
    doesn't have."""
    for c, t in df.dtypes:
        if t in ("double", "float"):
            df = df.withColumn(c, F.when(F.col(c).isNull() | finite(c), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} isn't finite")).cast(t)))
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def with_metadata(df: DataFrame, known: list[str]) -> DataFrame:
    """The known columns, and all others as JSON in one column `metadata`."""
    rest = [c for c in df.columns if c not in known]
    return df.select(*known, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("metadata") if rest else F.lit("{}").alias("metadata"))


def without_metadata(df: DataFrame, schema: str) -> DataFrame:
    """The inverse of `with_metadata`, for other columns of the given schema."""
    return df.withColumn("__m", F.from_json("metadata", schema)).select(*[c for c in df.columns if c != "metadata"], "__m.*")


def finite_only(df: DataFrame) -> DataFrame:
    """df with null for NaN and infinite numbers, in structs and arrays as well."""

    def clean(x: Column, kind: DataType) -> Column:
        if isinstance(kind, DoubleType | FloatType):
            return F.when(finite(x), x)
        if isinstance(kind, ArrayType):
            return F.transform(x, lambda e: clean(e, kind.elementType))
        if isinstance(kind, StructType):
            return F.when(x.isNotNull(), F.struct(*[clean(x[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return x

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def append_results(df: DataFrame, path: str) -> None:
    """Result rows as JSON lines, added to those that are there, without NaN and infinite numbers."""
    finite_only(df).select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def write_table(df: DataFrame, path: str, order: list[str]) -> None:
    """A small result as one CSV file with a header, rows in a given order."""
    df.orderBy(*order).coalesce(1).write.mode("errorifexists").csv(path, header=True)


class Conflict(ValueError):
    """Another writer was first."""


class Layers:
    """Layers of candidates under one folder: method, run_id and target_layer are partitions of immutable
    snapshots, and a small catalog says which snapshot holds. A layer is seen only after its catalog row
    is written, so a job that dies leaves no half layer. One driver writes at a time."""

    KEY = ("method", "run_id", "target_layer")
    SCHEMA = "method string, run_id string, target_layer int, snapshot string, source_layer int, source_method string, source_run_id string, config string, input_count long, output_count long, created_at_utc string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def catalog(self, methods: list[str] | None = None, runs: list[str] | None = None, layers: list[int] | None = None) -> DataFrame:
        """The newest row of each layer, filtered; None takes all."""
        path = f"{self.root}/catalog"
        rows = self.spark.read.schema(self.SCHEMA).json(path) if self._exists(path) else self.spark.createDataFrame([], self.SCHEMA)
        rest = [c for c in rows.columns if c not in self.KEY]
        rows = rows.groupBy(*self.KEY).agg(F.max(F.struct("created_at_utc", *[c for c in rest if c != "created_at_utc"])).alias("x")).select(*self.KEY, *[F.col(f"x.{c}").alias(c) for c in rest])
        for column, wanted in zip(self.KEY, (methods, runs, layers), strict=True):
            if wanted is not None:
                rows = rows.where(F.col(column).isin(wanted))
        return rows

    def get(self, method: str, run_id: str, layer: int) -> DataFrame:
        """The rows of one layer; LookupError if there is none."""
        return self.read([method], [run_id], [layer])

    def _stored(self, rows: DataFrame, method: str, run_id: str, layer: int, source_layer: int, source_method: str | None) -> tuple[str, int]:
        """Rows as an immutable snapshot that no catalog row names yet: its name and number of rows."""
        for part in (method, run_id):
            path_part(part)
        for column, own in (("perturbation_method", method), ("run_id", run_id), ("target_layer", layer)):
            if column in rows.columns:
                enforce(rows.where(~F.col(column).eqNullSafe(F.lit(own))).select("candidate_id", column), "candidates are of their layer")
        if (source_layer == 0) != (source_method is None) or layer <= source_layer:
            raise ValueError("the source doesn't fit the layer")
        snapshot = uuid.uuid4().hex
        path = f"{self.root}/layers/method={method}/run_id={run_id}/target_layer={layer}/snapshot={snapshot}"
        rows.drop(*self.KEY).write.parquet(path)
        back = self.spark.read.parquet(path)
        enforce(duplicates(back, "candidate_id"), "candidate ids are unique in a layer")
        return snapshot, back.count()

    def _enter(self, entry: tuple) -> None:
        self.spark.createDataFrame([entry], self.SCHEMA).coalesce(1).write.mode("append").json(f"{self.root}/catalog")

    def write(self, rows: DataFrame, method: str, run_id: str, layer: int, created_at_utc: str, source_layer: int = 0, source_method: str | None = None, source_run_id: str | None = None, config: dict | None = None, input_count: int | None = None) -> None:
        """A new snapshot of a layer; the former one stays on disk."""
        snapshot, n = self._stored(rows, method, run_id, layer, source_layer, source_method)
        self._enter((method, run_id, layer, snapshot, source_layer, source_method, source_run_id, json.dumps(config or {}, sort_keys=True), input_count, n, created_at_utc))

    def newest(self, method: str, run_id: str, layer: int) -> dict | None:
        """A layer's newest catalog row. A snapshot that was claimed by a publisher who died before its catalog row is entered first."""
        while True:
            row = self.catalog([method], [run_id], [layer]).first()
            row = None if row is None else {c: row[c] for c in self.columns()}
            claim = self._claim(method, run_id, layer, None if row is None else row["snapshot"])
            if not self._exists(claim):
                return row
            text = (self.spark.read.text(claim, wholetext=True).first() or [""])[0].strip()
            if not text:
                raise Conflict(f"{claim} is being made, or its maker died; remove it if none runs")
            self._enter(tuple(json.loads(text)))

    @classmethod
    def columns(cls) -> list[str]:
        return [c.split()[0] for c in cls.SCHEMA.split(", ")]

    def _claim(self, method: str, run_id: str, layer: int, after: str | None) -> str:
        return f"{self.root}/claims/method={method}/run_id={run_id}/target_layer={layer}/after-{after or 'nothing'}"

    def publish(self, rows: DataFrame, method: str, run_id: str, layer: int, created_at_utc: str, expected: str | None, source_layer: int = 0, source_method: str | None = None, source_run_id: str | None = None, config: dict | None = None, input_count: int | None = None) -> str:
        """A new snapshot in place of the newest one that the caller has seen (`expected`, None for no layer yet), and its name.

        Conflict where another snapshot is the newest by now, or another writer has claimed to follow it. The claim is a
        file that one writer can make; it holds the catalog row, so a writer who dies behind it has published.
        """
        now = self.newest(method, run_id, layer)
        if (None if now is None else now["snapshot"]) != expected:
            raise Conflict(f"the newest snapshot is {None if now is None else now['snapshot']}, not {expected}")
        if now is not None and now["created_at_utc"] >= created_at_utc:
            raise ValueError(f"the newest snapshot is of {now['created_at_utc']}")
        snapshot, n = self._stored(rows, method, run_id, layer, source_layer, source_method)
        entry = (method, run_id, layer, snapshot, source_layer, source_method, source_run_id, json.dumps(config or {}, sort_keys=True), input_count, n, created_at_utc)
        try:
            publish_once(self.spark, self._claim(method, run_id, layer, expected), json.dumps(entry))
        except Changed as e:
            raise Conflict(str(e)) from e
        self._enter(entry)
        return snapshot

    def read(self, methods: list[str] | None = None, runs: list[str] | None = None, layers: list[int] | None = None) -> DataFrame:
        """Rows of the layers that fit, with their partition columns; only their folders are read."""
        keys = [tuple(r) for r in self.catalog(methods, runs, layers).select(*self.KEY, "snapshot").collect()]  # a row for each layer
        for k, wanted in enumerate((methods, runs, layers)):
            if lacking := sorted(set(wanted or []) - {key[k] for key in keys}):
                raise LookupError(f"no layer with {self.KEY[k]} {lacking}")
        if not keys:
            raise LookupError("no such layer")
        paths = [f"{self.root}/layers/method={m}/run_id={r}/target_layer={n}/snapshot={s}" for m, r, n, s in keys]
        return self.spark.read.option("basePath", f"{self.root}/layers").option("mergeSchema", "true").parquet(*paths)

    def count_faults(self) -> DataFrame:
        """Layers whose rows aren't as many as the catalog says."""
        counts = self.read().groupBy(*self.KEY).agg(F.count("*").alias("n"))
        return self.catalog().join(counts, list(self.KEY), "left").where("coalesce(n, 0) != output_count")


def with_line_numbers(lines: DataFrame, *order) -> DataFrame:
    """lines with a 1-based number in the given order, for sources that have no numbers of their own."""
    return numbered(lines, *order, name="line").withColumn("line", F.col("line") + 1)
