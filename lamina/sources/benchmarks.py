"""Human-rated benchmarks as one kind of record: id, source_id, text, human_scores, human_score, benchmark, aspect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.ordering import running_sum, written
from lamina.functions.text import cleaned, finite, joined, number


def finite_scores(scores: Column | str) -> Column:
    """The finite numbers of an array."""
    return F.filter(scores, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def mean_score(scores: Column | str) -> Column:
    ok = finite_scores(scores)
    return F.when(F.size(ok) > 0, F.aggregate(ok, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(ok))


def records(rows: DataFrame, benchmark: str, prefix: str) -> DataFrame:
    """Canonical records of rows with key, source_id, text, human_scores and aspect; blank texts and rows
    without a finite score are left out."""
    rows = rows.where(cleaned("text") != "").withColumn("human_scores", finite_scores("human_scores")).where(F.size("human_scores") > 0)
    return rows.select(F.concat(F.lit(f"{prefix}:"), "key").alias("id"), "source_id", cleaned("text").alias("text"), "human_scores", mean_score("human_scores").alias("human_score"), F.lit(benchmark).alias("benchmark"), "aspect")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, line breaks inside quotes and doubled quotes."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def melted(rows: DataFrame, id_col: str, text_col: str, labels: list[str], benchmark: str, prefix: str) -> DataFrame:
    """One record for each row and label column that holds a finite number."""
    long = rows.select(id_col, text_col, *[F.col(c).cast("string").alias(c) for c in labels]).unpivot([id_col, text_col], labels, "aspect", "value")
    score = number("value")
    rows = long.where(finite(score)).select(F.concat_ws(":", id_col, "aspect").alias("key"), F.col(id_col).cast("string").alias("source_id"), F.col(text_col).alias("text"), F.array(score).alias("human_scores"), "aspect")
    return records(rows, benchmark, prefix)


def wide_essays(rows: DataFrame, id_col: str, texts: dict[str, dict[str, str]], benchmark: str, prefix: str) -> DataFrame:
    """Several text columns, each with its own score columns {aspect: column}: a record for each pair."""
    each = [F.struct(F.lit(t).alias("system"), F.col(t).alias("text"), F.lit(aspect).alias("aspect"), F.col(c).cast("string").alias("value")) for t, scores in texts.items() for aspect, c in scores.items()]
    long = rows.select(F.col(id_col).cast("string").alias("source_id"), F.inline(F.array(*each)))
    score = number("value")
    long = long.where(finite(score)).select(F.concat_ws(":", "source_id", "system", "aspect").alias("key"), "source_id", "text", F.array(score).alias("human_scores"), "aspect")
    return records(long, benchmark, prefix)


def zipped_lists(rows: DataFrame, id_col: str, texts: str, labels: dict[str, str], benchmark: str, prefix: str) -> DataFrame:
    """A list of texts with lists of scores of the same length; other lengths raise an error."""
    for c in labels.values():
        rows = rows.withColumn(c, F.when(F.size(c) == F.size(texts), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"{c} isn't as long as {texts}: "), F.col(id_col).cast("string")))))
    flat = rows.select(F.col(id_col).cast("string").alias("source_id"), F.posexplode(F.arrays_zip(texts, *labels.values())).alias("at", "x"))
    each = [F.struct(F.lit(a).alias("aspect"), F.col(f"x.{c}").cast("double").alias("value")) for a, c in labels.items()]
    flat = flat.select("source_id", "at", F.col(f"x.{texts}").alias("text"), F.inline(F.array(*each)))
    rows = flat.select(F.concat_ws(":", "source_id", "at", "aspect").alias("key"), "source_id", "text", F.array("value").alias("human_scores"), "aspect")
    return records(rows, benchmark, prefix)


def annotated(rows: DataFrame, id_col: str, text_col: str, scores: str, aspect: str, benchmark: str, prefix: str) -> DataFrame:
    """Texts with an array of annotators' scores."""
    rows = rows.select(F.col(id_col).cast("string").alias("key"), F.col(id_col).cast("string").alias("source_id"), F.col(text_col).alias("text"), F.col(scores).cast("array<double>").alias("human_scores"), F.lit(aspect).alias("aspect"))
    return records(rows, benchmark, prefix)


def corrections(rows: DataFrame, id_col: str, sentence: str, corrected: str) -> DataFrame:
    """Sentences with corrections as preferences: source_id, preferred_text, dispreferred_text. Empty and
    unchanged corrections are left out."""
    rows = rows.select(F.col(id_col).cast("string").alias("source_id"), cleaned(sentence).alias("dispreferred_text"), F.explode(corrected).alias("c"))
    rows = rows.withColumn("preferred_text", cleaned("c")).where("preferred_text != '' and dispreferred_text != '' and preferred_text != dispreferred_text")
    return rows.select("source_id", "preferred_text", "dispreferred_text")


def stories(rows: DataFrame, id_col: str, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """A context with a right and a wrong ending as preferences."""
    out = rows.select(F.col(id_col).cast("string").alias("source_id"), joined(prompt, chosen).alias("preferred_text"), joined(prompt, rejected).alias("dispreferred_text"))
    return out.where("preferred_text != '' and dispreferred_text != ''")


def choices(rows: DataFrame, id_col: str, a: str, b: str, choice: str) -> DataFrame:
    """Two answers and which is better ("a ...", "b ...", "equally ..."; anything else raises an error)."""
    c = F.lower(cleaned(choice))
    side = F.when(c.startswith("a "), "a").when(c.startswith("b "), "b").when(c.startswith("equally"), "tie").otherwise(F.raise_error(F.concat(F.lit("no choice: "), c)))
    out = rows.withColumn("__side", side)
    first = F.col("__side") != "b"
    return out.select(F.col(id_col).cast("string").alias("source_id"), F.when(first, F.col(a)).otherwise(F.col(b)).alias("preferred_text"), F.when(first, F.col(b)).otherwise(F.col(a)).alias("dispreferred_text"), (F.col("__side") == "tie").alias("tie"))


def grouped_rows(rows: DataFrame, line: str, size: int, texts: list[str], scores: list[str]) -> DataFrame:
    """Each `size` lines in a row are one item: the first one's texts, the scores' means. line is from 0."""
    g = F.floor(F.col(line) / size)
    return rows.groupBy(g.alias("item")).agg(*[F.min_by(t, line).alias(t) for t in texts], *[F.avg(s).alias(s) for s in scores])


def run_groups(rows: DataFrame, line: str, key: str, by: list[str] | None = None) -> DataFrame:
    """rows with run: lines in a row that have the same key share a number (from 1 within by). A line meets the one
    before it by its number, and runs are counted by range partitions, so `by` may be of any size."""
    by = by or []
    at = written(running_sum(rows, by, [F.col(line)], F.lit(1), "__k"), "lines")
    before = at.select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], (F.col("__k") + 1).alias("__k1"), F.col(key).alias("__was"), F.lit(True).alias("__has"))
    same = [F.col(c).eqNullSafe(F.col(f"__b{i}")) for i, c in enumerate(by)]
    on = reduce(lambda a, b: a & b, same, F.col("__k") == F.col("__k1"))
    new = F.when(F.col("__has") & F.col(key).eqNullSafe(F.col("__was")), 0).otherwise(1)
    flagged = at.join(before, on, "left").select(*at.columns, new.alias("__new"))
    out = running_sum(flagged, by, [F.col("__k")], F.col("__new"), "__runs")
    return out.select(*rows.columns, (F.col("__runs") + F.col("__new")).alias("run"))


def conllu_documents(lines: DataFrame, title: str = "meta") -> DataFrame:
    """Documents of CoNLL-U lines (file, line, value): file, doc_id, genre, title, text (sentences with a
    space between) and n_sentences, in each file's order.

    Each line belongs to the last "# newdoc id" before it in its file. title: "meta" takes the title from its
    comment; "drop" as well, and a first sentence equal to it goes; "first" takes the first sentence as the title.
    """
    if title not in ("meta", "drop", "first"):
        raise ValueError("title is to be meta, drop or first")
    tag = lambda name: F.when(F.col("value").startswith(f"# {name} = "), F.substring(F.col("value"), F.lit(len(name) + 6), F.length("value")))
    rows = lines.where(F.col("value").startswith("#")).select("file", "line", tag("newdoc id").alias("newdoc"), tag("meta::genre").alias("genre"), tag("meta::title").alias("title"), tag("text").alias("sentence"))
    begins = F.when(F.col("newdoc").isNotNull(), 1).otherwise(0)
    rows = running_sum(rows, ["file"], [F.col("line")], begins, "__n").withColumn("__n", F.col("__n") + begins).where("__n > 0")
    found = F.array_sort(F.collect_list(F.when(F.col("sentence").isNotNull(), F.struct("line", "sentence"))))
    docs = rows.groupBy("file", "__n").agg(F.max("newdoc").alias("doc_id"), F.max("genre").alias("genre"), F.max("title").alias("title"), F.transform(found, lambda x: x["sentence"]).alias("s"))
    first = F.get("s", F.lit(0))
    if title == "drop":
        docs = docs.withColumn("s", F.when(first == F.col("title"), F.slice("s", F.lit(2), F.size("s"))).otherwise(F.col("s")))
    elif title == "first":
        docs = docs.withColumn("title", first)
    return docs.select("file", "doc_id", F.coalesce("genre", F.split_part("doc_id", F.lit("-"), F.lit(1))).alias("genre"), "title", F.array_join("s", " ").alias("text"), F.size("s").alias("n_sentences"))


def consensus(entries_: DataFrame, benchmark: str, prefix: str, parts: dict[str, str]) -> DataFrame:
    """Records of entries (file, at, entry) with Text, StoryID (their place if there is none) and a consensus_score
    below each of some keys (aspect: key); blank texts and scores that are no number are left out."""
    get = lambda path, kind="string": F.try_variant_get("entry", path, kind)
    each = [F.struct(F.lit(aspect).alias("aspect"), get(f"$.{key}.consensus_score", "double").alias("value")) for aspect, key in parts.items()]
    rows = entries_.select(F.coalesce(get("$.StoryID"), F.col("at").cast("string")).alias("source_id"), get("$.Text").alias("text"), F.inline(F.array(*each)))
    rows = rows.where(finite("value"))
    return records(rows.select(F.concat_ws(":", "source_id", "aspect").alias("key"), "source_id", "text", F.array("value").alias("human_scores"), "aspect"), benchmark, prefix)


def standalone(*sources: DataFrame | None) -> DataFrame:
    """All records of the sources that are there, in one table."""
    some = [s for s in sources if s is not None]
    if not some:
        raise ValueError("no source is given")
    return reduce(DataFrame.unionByName, some)


#: Columns that a catalog of benchmarks has (fixed values).
METADATA = ("benchmark", "aspect", "aspect_number", "raw_volume", "retained_volume")


def metadata_faults(rows: DataFrame, columns: tuple[str, ...] = METADATA) -> DataFrame:
    """Rows of a catalog of benchmarks (all texts) that break a rule, with fault: empty, not_a_number, aspects (the
    number of names between commas differs from aspect_number) or volume (more retained than there are)."""
    if lacking := set(columns) - set(rows.columns):
        raise ValueError(f"the catalog lacks columns: {sorted(lacking)}")
    empty = reduce(lambda a, b: a | b, [F.coalesce(cleaned(c), F.lit("")) == "" for c in columns])
    whole = lambda c: F.trim(c).try_cast("long")
    names = F.size(F.filter(F.split("aspect", ","), lambda x: F.trim(x) != ""))
    fault = F.when(empty, "empty").when(whole("aspect_number").isNull() | whole("raw_volume").isNull() | whole("retained_volume").isNull(), "not_a_number")
    fault = fault.when(whole("aspect_number") != names, "aspects").when(whole("retained_volume") > whole("raw_volume"), "volume")
    return rows.withColumn("fault", fault).where("fault is not null")


def pairs_of_columns(rows: DataFrame, id_col: str, preferred: str, dispreferred: str) -> DataFrame:
    """Preferences from two text columns; pairs with a blank side are left out."""
    out = rows.select(F.col(id_col).cast("string").alias("source_id"), cleaned(preferred).alias("preferred_text"), cleaned(dispreferred).alias("dispreferred_text"))
    return out.where("preferred_text != '' and dispreferred_text != ''")


def rated_references(naturalness: DataFrame, quality: DataFrame, line: str, references: dict[str, tuple[str, str]], size: int = 3) -> DataFrame:
    """Each `size` lines in a row rate the same references: item, reference, text (the first line's), naturalness
    and quality (means). references: text column -> its columns in the two tables."""
    out = []
    for text, (natural, good) in references.items():
        a = grouped_rows(naturalness, line, size, [text], [natural]).select("item", F.col(text).alias("text"), F.col(natural).alias("naturalness"))
        b = grouped_rows(quality, line, size, [], [good]).select("item", F.col(good).alias("quality"))
        out.append(a.join(b, "item").select("item", F.lit(text).alias("reference"), "text", "naturalness", "quality"))
    return reduce(DataFrame.unionByName, out)


def dialogues(entries_: DataFrame) -> DataFrame:
    """Rated turns and dialogues: kind (turn where there is a response, else dialogue), text (the response without its
    first seven characters, the speaker; or the context), fluent (of turns) and overall: means of whole-number ratings."""
    get = lambda path, kind="string": F.try_variant_get("entry", path, kind)

    def mean(name: str) -> Column:
        values = F.filter(get(f"$.annotations.{name}", "array<variant>"), lambda v: F.schema_of_variant(v).isin("BIGINT", "INT", "SMALLINT", "TINYINT", "LONG"))
        numbers = F.transform(values, lambda v: F.try_variant_get(v, "$", "double"))
        return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers))

    turn = F.coalesce(get("$.response"), F.lit("")) != ""
    text = F.when(turn, F.substring(get("$.response"), F.lit(8), F.length(get("$.response")))).otherwise(get("$.context"))
    return entries_.select(F.when(turn, "turn").otherwise("dialogue").alias("kind"), text.alias("text"), F.when(turn, mean("Fluent")).alias("fluent"), mean("Overall").alias("overall"))


def consecutive_means(rows: DataFrame, line: str, key: str, text: str, scores: list[str]) -> DataFrame:
    """Lines in a row with the same key are one item: key, the last one's text and the scores' means, in order of run."""
    runs = run_groups(rows, line, key)
    return runs.groupBy("run", key).agg(F.max_by(text, line).alias(text), *[F.avg(F.col(s).cast("double")).alias(s) for s in scores])


def line_lookup(rows: DataFrame, lines: DataFrame, file_col: str, number_col: str) -> DataFrame:
    """rows with text: line number_col (from 1) of the file that file_col names. A number that the file doesn't have
    is an error; rows whose file isn't there are left out. lines: file, line, value."""
    have = rows.join(lines.select(F.col("file").alias(file_col)).distinct(), file_col, "left_semi")
    found = have.join(lines.select(F.col("file").alias(file_col), F.col("line").cast("long").alias(number_col), "value"), [file_col, number_col], "left")
    lack = F.raise_error(F.concat(F.lit("no such line: "), F.col(file_col), F.lit(" "), F.col(number_col).cast("string")))
    return found.select(*rows.columns, F.when(F.col("value").isNull(), lack).otherwise(F.col("value")).alias("text"))


def nested_ratings(entries_: DataFrame) -> DataFrame:
    """Generated texts with ratings: entries {"gen": {system: {"text", "score": [...]}}} as at, system, text and mean
    score."""
    spark = entries_.sparkSession
    gen = entries_.select("at", F.try_variant_get("entry", "$.gen", "variant").alias("g"))
    each = gen.lateralJoin(spark.tvf.variant_explode(F.col("g").outer())).select("at", F.col("key").alias("system"), "value")
    return each.select("at", "system", F.try_variant_get("value", "$.text", "string").alias("text"), mean_score(F.try_variant_get("value", "$.score", "array<double>")).alias("score"))


def rated_responses(entries_: DataFrame, dimension: str) -> DataFrame:
    """Responses of dialogues, without line breaks, with the mean of a dimension's ratings: at, place, text, score."""
    spark = entries_.sparkSession
    all_ = entries_.select("at", F.try_variant_get("entry", "$.responses", "variant").alias("r"))
    each = all_.lateralJoin(spark.tvf.variant_explode(F.col("r").outer())).select("at", F.col("pos").alias("place"), "value")
    text = F.replace(F.try_variant_get("value", "$.response", "string"), F.lit("\n"), F.lit(""))
    return each.select("at", "place", text.alias("text"), mean_score(F.try_variant_get("value", f"$.{dimension}", "array<double>")).alias("score"))


def negated(rows: DataFrame, score: str) -> DataFrame:
    """rows whose error score becomes one of which more is better."""
    return rows.withColumn(score, -F.col(score))


def score_matrix(rows: DataFrame, system: str, segment: str, score: str, systems: list[str]) -> DataFrame:
    """Segments by systems: one column for each system, null where it has no score."""
    return rows.groupBy(segment).pivot(system, systems).agg(F.avg(score))
