"""Generation of candidates: catalogs and plans of edits, chains of edits, and what comes back from a generator."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import edits as damage
from lamina.functions.draws import order_key
from lamina.functions.ordering import parts, running_sum, written
from lamina.functions.text import normalized, tokens
from lamina.operators.lineage import enforce

SEVERITIES = ("weak", "medium", "strong")
PLANNED = ("llm_single", "llm_sampled")
CATALOG_KEYS = ("edit_id", "target_dimensions", "edit_type", "example_edited", "example_clean")
PLAN_KEYS = ("base_text_id", "method", "edit_count", "edits", "severity", "target_dimensions")


# --- catalogs and plans ----------------------------------------------------------------------------


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog of edits from JSON lines, in the order of the file: ordinal (from 0), the CATALOG_KEYS and
    fault: malformed, missing (a key lacks or is blank) or repeated, null if none. The example of the source
    text may be called example_source. `enforce` the rows with a fault to refuse the file."""
    from lamina.sources.jsonl import read_numbered_lines

    lines = read_numbered_lines(spark, path).where(F.trim("value") != "")
    record = F.try_parse_json("value")
    get = lambda k: F.try_variant_get("r", f"$.{k}", "string")
    rows = lines.withColumn("r", F.when(F.schema_of_variant(record).startswith("OBJECT"), record))
    dimensions = F.try_variant_get("r", "$.target_dimensions", "array<string>")
    rows = rows.select("line", F.col("r").isNull().alias("__bad"), get("edit_id").alias("edit_id"), dimensions.alias("target_dimensions"), get("edit_type").alias("edit_type"), get("example_edited").alias("example_edited"), F.coalesce(get("example_source"), get("example_clean")).alias("example_clean"))
    lacks = reduce(lambda a, b: a | b, [F.coalesce(F.trim(c), F.lit("")) == "" for c in CATALOG_KEYS if c != "target_dimensions"]) | F.coalesce(F.size("target_dimensions") < 1, F.lit(True)) | F.coalesce(F.exists("target_dimensions", lambda d: F.trim(d) == ""), F.lit(False))
    rows = rows.withColumn("__n", F.count("*").over(Window.partitionBy("edit_id")))  # a catalog is a small table
    fault = F.when(F.col("__bad"), "malformed").when(lacks, "missing").when(F.col("__n") > 1, "repeated")
    return rows.withColumn("fault", fault).withColumn("ordinal", F.row_number().over(Window.orderBy("line")) - 1).select("ordinal", *CATALOG_KEYS, "fault")


def _cycles(at: Column, n: int, values: list[str], *key) -> Column:
    """The value at a place of a deck: one cycle of all values after another, each in a new hash order."""
    cycle = F.floor(at / n)
    order = F.array_sort(F.array(*[F.struct(order_key(*key, cycle.cast("string"), v).alias("k"), F.lit(v).alias("v")) for v in values]))
    return F.element_at(order, (F.pmod(at, F.lit(n)) + 1).cast("int"))["v"]


def assignment_plan(originals: DataFrame, catalog: DataFrame, seed: int = 42, methods: tuple[str, ...] = PLANNED) -> DataFrame:
    """Which edits, in which severity, a generator is asked for, for each source and method.

    originals: base_text_id and text; catalog: edit_id and target_dimensions. llm_single gets one edit, other
    methods 1 to `edit_budget` of the text, each number equally likely. Sources stand in a hash order; each
    takes the next edits of a circle of all, so no source has an edit twice and the edits' numbers differ by one
    at most; severities come in cycles of all. Returns base_text_id, method, edit_count, edits, severity and
    target_dimensions (of the edits in their order, each once). Repeated ids and an empty catalog are errors.
    """
    enforce(originals.groupBy("base_text_id").agg(F.count("*").alias("n")).where("n > 1 or base_text_id is null"), "sources have ids of their own")
    circle = F.array_sort(F.collect_list(F.struct(order_key(seed, "operations", F.col("edit_id")).alias("k"), "edit_id", "target_dimensions")))
    circle = written(catalog.agg(F.transform(circle, lambda x: F.struct(x["edit_id"].alias("edit_id"), x["target_dimensions"].alias("target_dimensions"))).alias("__circle")), "circle")
    if not circle.select(F.size("__circle")).first()[0]:
        raise ValueError("the catalog has no edits")
    each = []
    for method in methods:
        n = F.lit(1) if method == "llm_single" else F.least(damage.drawn_edit_count("text", seed, method, F.col("base_text_id")), F.size("__circle"))
        rows = originals.select("base_text_id", "text").crossJoin(F.broadcast(circle)).select("base_text_id", n.cast("int").alias("edit_count"), order_key(seed, method, "source-order", F.col("base_text_id")).alias("__draw"))
        rows = running_sum(rows, [], [F.col("__draw"), F.col("base_text_id")], F.col("edit_count"), "__from")
        rows = running_sum(rows, [], [F.col("__draw"), F.col("base_text_id")], F.lit(1), "__at")
        each.append(rows.withColumns({"method": F.lit(method), "severity": _cycles(F.col("__at"), len(SEVERITIES), list(SEVERITIES), seed, method, "severity")}))
    rows = reduce(DataFrame.unionByName, each).crossJoin(F.broadcast(circle))
    place = lambda i: F.pmod(F.col("__from") + i, F.size("__circle")) + 1
    picked = F.transform(F.sequence(F.lit(0), F.col("edit_count") - 1), lambda i: F.element_at("__circle", place(i).cast("int")))
    rows = rows.withColumn("__edits", picked)
    return rows.select("base_text_id", "method", "edit_count", F.col("__edits.edit_id").alias("edits"), "severity", F.array_distinct(F.flatten("__edits.target_dimensions")).alias("target_dimensions"))


def plan_faults(plan: DataFrame, catalog: DataFrame, methods: tuple[str, ...] = PLANNED) -> DataFrame:
    """Rows of a plan that can't be used: base_text_id, method and fault (no_id, method, edit_count, repeated_edit,
    severity, repeated, unknown_edit, dimensions)."""
    if lacking := set(PLAN_KEYS) ^ set(plan.columns):
        raise ValueError(f"a plan has the columns {PLAN_KEYS}; these differ: {sorted(lacking)}")
    times = plan.groupBy("base_text_id", "method").agg(F.count("*").alias("__n"))
    known = planned_edits(plan, catalog).groupBy("base_text_id", "method").agg(F.max(F.col("target_dimensions").isNull()).alias("__unknown"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "target_dimensions"))), lambda x: F.coalesce(x["target_dimensions"], F.array().cast("array<string>"))))).alias("__dims"))
    rows = plan.join(times, ["base_text_id", "method"], "left").join(known, ["base_text_id", "method"], "left")
    fault = F.when(F.coalesce("base_text_id", F.lit("")) == "", "no_id").when(~F.coalesce(F.col("method").isin(*methods), F.lit(False)), "method")
    fault = fault.when(F.coalesce((F.col("edit_count") < 1) | (F.col("edit_count") != F.size("edits")) | (F.col("method") == "llm_single") & (F.col("edit_count") != 1), F.lit(True)), "edit_count").when(F.size(F.array_distinct("edits")) != F.size("edits"), "repeated_edit")
    fault = fault.when(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), "severity").when(F.col("__n") > 1, "repeated").when(F.col("__unknown"), "unknown_edit").when(F.col("__dims") != F.col("target_dimensions"), "dimensions")
    return rows.select("base_text_id", "method", fault.alias("fault")).where("fault is not null")


def planned_edits(plan: DataFrame, catalog: DataFrame) -> DataFrame:
    """A plan's edits, one row each: base_text_id, method, place (from 0, in the plan's order) and the catalog's
    columns, null for an edit that it lacks. The catalog is a small table."""
    rows = plan.select("base_text_id", "method", F.posexplode("edits").alias("place", "edit_id"))
    return rows.join(F.broadcast(catalog.drop("fault", "ordinal")), "edit_id", "left")


def planned_requests(items: DataFrame, plan: DataFrame, catalog: DataFrame, method: str) -> DataFrame:
    """items with edits (an array of the catalog's entries in the plan's order) and severity. An item without a
    plan of the method, or with an edit that the catalog lacks, is an error."""
    own = plan.where(F.col("method") == method)
    entry = [c for c in catalog.columns if c not in ("fault", "ordinal")]
    packed = planned_edits(own, catalog.withColumn("__known", F.lit(True))).groupBy("base_text_id").agg(F.array_sort(F.collect_list(F.struct("place", *entry))).alias("__e"), F.count_if(F.col("__known").isNull()).alias("__unknown"))
    rows = items.join(own.select("base_text_id", "severity"), "base_text_id", "left").join(packed, "base_text_id", "left")
    fault = lambda why: F.raise_error(F.concat(F.lit(why), F.col("base_text_id").cast("string"))).cast("string")
    severity = F.when(F.col("severity").isNull(), fault("no plan for source ")).when(F.col("__unknown") > 0, fault("an unknown edit in the plan of source ")).otherwise(F.col("severity"))
    return rows.select(*items.columns, F.transform("__e", lambda x: F.struct(*[x[c].alias(c) for c in entry])).alias("edits"), severity.alias("severity"))


# --- chains of edits -------------------------------------------------------------------------------


def edited_chains(rows: DataFrame, count: Column, *key, text_col: str = "text", edits: tuple[str, ...] = tuple(damage.EDITS)) -> DataFrame:
    """rows with `count` edits after one another: edited (null unless all could be done), applied (the edits'
    names), audit (an array of place, tried and applied: what was tried at each place, in order) and reason
    ("no_change" where no edit could be done any more, else null).

    Each place draws its edit from all of them, and on failure from those left, so a place fails only if every
    edit does. All edits of a place are tried at once, in the order of their draws; each place is written.
    """
    keep = rows.columns
    out = rows.withColumns({"__now": F.coalesce(text_col, F.lit("")), "__count": count, "applied": F.array().cast("array<string>"), "audit": F.array().cast("array<struct<place:int,tried:array<string>,applied:string>>"), "__on": F.lit(True)})
    most = out.agg(F.max("__count").alias("m")).first()["m"] or 0
    for place in range(int(most)):
        step = out.withColumn("__words", tokens("__now"))
        for name in edits:
            step = damage.edited(step, name, "chain", place, *key, name=f"__{name}", words="__words")
        tries = F.array_sort(F.array(*[F.struct(order_key("operation", place, *key, name).alias("draw"), F.lit(name).alias("name"), F.col(f"__{name}").alias("text")) for name in edits]))
        step = step.withColumn("__tries", tries).drop(*[f"__{name}" for name in edits])
        step = step.withColumn("__first", F.array_position(F.transform("__tries", lambda t: t["text"].isNotNull()), True).cast("int"))
        due = F.col("__on") & (F.col("__count") > place)
        done = due & (F.col("__first") > 0)
        hit = F.when(F.col("__first") > 0, F.try_element_at("__tries", F.col("__first")))
        tried = F.transform(F.when(F.col("__first") > 0, F.slice("__tries", F.lit(1), F.col("__first"))).otherwise(F.col("__tries")), lambda t: t["name"])
        entry = F.struct(F.lit(place).alias("place"), tried.alias("tried"), hit["name"].alias("applied"))
        step = step.select(*keep, F.when(done, hit["text"]).otherwise(F.col("__now")).alias("__now"), "__count", F.when(done, F.array_append("applied", hit["name"])).otherwise(F.col("applied")).alias("applied"), F.when(due, F.array_append("audit", entry)).otherwise(F.col("audit")).alias("audit"), F.when(due, done).otherwise(F.col("__on")).alias("__on"))
        out = written(step, "edited")
    changed = F.col("__on") & (F.size("applied") > 0)
    return out.select(*keep, F.when(changed, F.col("__now")).alias("edited"), "applied", "audit", F.when(~F.col("__on"), "no_change").alias("reason"))


def rule_outputs(rows: DataFrame, rules: list[str], mode: str, *key, text_col: str = "text") -> DataFrame:
    """rows with rule, output and reason, one for each rule that changes the text (mode "all"), for the first of the
    given rules that does ("first_success") or for one drawn from those that do ("random_success"). A row that no
    rule changes stays once, without a rule and with the reason "no_verified_edit". The modes that take one pick it
    within the row, so nothing is shuffled."""
    if mode not in ("all", "first_success", "random_success"):
        raise ValueError(f"unknown mode {mode!r}")
    if unknown := [r for r in rules if r not in damage.EDITS]:
        raise ValueError(f"unknown rules {unknown}")
    out = rows.withColumn("__words", tokens(text_col))
    for name in rules:
        out = damage.edited(out, name, "rule", *key, name=f"__{name}", words="__words")
    draw = lambda i, name: F.lit(f"{i:06d}") if mode != "random_success" else order_key("rule-choice", *key, name)
    tries = F.array(*[F.struct(draw(i, name).alias("draw"), F.lit(name).alias("rule"), F.col(f"__{name}").alias("output")) for i, name in enumerate(rules)])
    hits = F.array_sort(F.filter(tries, lambda t: t["output"].isNotNull()))
    out = out.withColumn("__hits", hits if mode == "all" else F.slice(hits, F.lit(1), F.lit(1)))
    each = out.select(*rows.columns, F.explode_outer("__hits").alias("__h"))
    return each.select(*rows.columns, F.col("__h.rule").alias("rule"), F.col("__h.output").alias("output"), F.when(F.col("__h").isNull(), "no_verified_edit").alias("reason"))


# --- results ---------------------------------------------------------------------------------------


def failure(text: Column, source: Column, *, generation_failure: Column | None = None, over_length: Column | None = None, skipped: Column | None = None, by_model: Column | None = None, most_chars: Column | None = None, allow_unchanged: bool = False) -> Column:
    """Why an output can't become a candidate, null if it can; of several reasons the first: the generator's own,
    over_length, the method's reason to skip, empty_output, unchanged_output (but for white space), and, where no
    model made it, max_output_chars_exceeded."""
    none = F.lit(None).cast("string")
    out = F.when(F.coalesce(none if generation_failure is None else generation_failure, F.lit("")) != "", generation_failure if generation_failure is not None else none)
    if over_length is not None:
        out = out.when(over_length, "over_length")
    if skipped is not None:
        out = out.when(skipped.isNotNull(), skipped)
    out = out.when(F.coalesce(normalized(text), F.lit("")) == "", "empty_output")
    if not allow_unchanged:
        out = out.when(normalized(text) == normalized(source), "unchanged_output")
    if most_chars is not None:
        out = out.when(~F.coalesce(by_model if by_model is not None else F.lit(False), F.lit(False)) & (F.length(text) > most_chars), "max_output_chars_exceeded")
    return out


def batch_faults(inputs: DataFrame, results: DataFrame, id_col: str = "candidate_id", parent_col: str = "parent_candidate_id") -> DataFrame:
    """Ids whose numbers of inputs and results differ: id, n_inputs and n_results."""
    a, b = inputs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n_inputs")), results.groupBy(F.col(parent_col).alias("id")).agg(F.count("*").alias("n_results"))
    both = a.join(b, "id", "full").select("id", F.coalesce("n_inputs", F.lit(0)).alias("n_inputs"), F.coalesce("n_results", F.lit(0)).alias("n_results"))
    return both.where("n_inputs != n_results")


def candidate_numbers(results: DataFrame, existing: DataFrame, order: list[str], parent_col: str = "parent_candidate_id") -> DataFrame:
    """results with candidate_index: within a parent on from the highest that existing (parent_col,
    candidate_index) has, in the given order. Large parents are numbered by range partitions. Parents with one result
    need no order: the bounds of ranges are drawn from samples on the driver, and what orders may be whole texts."""
    last = existing.groupBy(parent_col).agg(F.max("candidate_index").alias("__last"))
    several = results.groupBy(F.col(parent_col).alias("__several")).agg(F.count("*").alias("__n")).where("__n > 1")
    same = F.col(parent_col).eqNullSafe(F.col("__several"))
    one = results.join(several, same, "left_anti").withColumn("__k", F.lit(0).cast("long"))
    many = running_sum(results.join(several, same, "left_semi"), [parent_col], [F.col(c) for c in order], F.lit(1), "__k")
    rows = one.unionByName(many).join(last, parent_col, "left")
    return rows.select(*results.columns, (F.coalesce(F.col("__last") + 1, F.lit(0)) + F.col("__k")).cast("int").alias("candidate_index"))


def candidate_id(dataset: Column, method: Column, run: Column, base: Column, layer: Column, parent: Column, index: Column) -> Column:
    """A readable id that is unique by a hash of all parts."""
    from lamina.functions.text import slug

    parts = F.to_json(F.struct(base.cast("string").alias("base_text_id"), index.alias("candidate_index"), dataset.alias("dataset_name"), parent.alias("parent_candidate_id"), method.alias("perturbation_method"), run.alias("run_id"), layer.alias("target_layer")))
    return F.concat_ws("__", F.lit("candidate"), slug(dataset), slug(method), slug(run), F.concat(F.lit("base_"), slug(base.cast("string"))), F.concat(F.lit("layer_"), layer.cast("string")), F.concat(F.lit("candidate_"), F.lpad(index.cast("string"), 6, "0")), F.left(F.sha2(parts, 256), F.lit(20)))


def collected_batch(inputs: DataFrame, results: DataFrame, existing: DataFrame, dataset: str, method: str, run: str, layer: int, allow_unchanged: bool = False) -> tuple[DataFrame, DataFrame]:
    """Candidates and failures of a batch, one result for each input.

    inputs: candidate_id, base_text_id, text. results: parent_candidate_id, base_text_id, method, run_id, target_layer, text,
    and where there are any generation_failure, over_length, skip_reason, by_model and max_output_chars. existing:
    parent_candidate_id and candidate_index of candidates from before. Refuses a batch whose ids don't match or
    whose results are of another method, run, layer or source.
    """
    enforce(batch_faults(inputs, results), "a batch has one result for each input")
    base = inputs.select(F.col("candidate_id").alias("parent_candidate_id"), F.col("text").alias("__source"), F.col("base_text_id").alias("__base"))
    rows = results.join(base, "parent_candidate_id")
    same = (F.col("method") == method) & (F.col("run_id") == run) & (F.col("target_layer") == layer) & (F.col("base_text_id") == F.col("__base"))
    enforce(rows.where(~F.coalesce(same, F.lit(False))).select("parent_candidate_id"), "results are of the method, run, layer and source asked for")
    col = lambda c: F.col(c) if c in results.columns else None
    why = failure(F.col("text"), F.col("__source"), generation_failure=col("generation_failure"), over_length=col("over_length"), skipped=col("skip_reason"), by_model=col("by_model"), most_chars=col("max_output_chars"), allow_unchanged=allow_unchanged)
    rows = written(rows.withColumn("reason", why), "batch")
    good = candidate_numbers(rows.where("reason is null").drop("__source", "__base", "reason"), existing, ["text"])
    ident = candidate_id(F.lit(dataset), F.col("method"), F.col("run_id"), F.col("base_text_id"), F.col("target_layer"), F.col("parent_candidate_id"), F.col("candidate_index"))
    return good.withColumn("candidate_id", ident), rows.where("reason is not null").select("parent_candidate_id", "reason")


def failure_counts(failures: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, reason and n."""
    return failures.groupBy(*(by or []), "reason").agg(F.count("*").alias("n"))


# --- methods ---------------------------------------------------------------------------------------

#: name -> a function of items (candidate_id, base_text_id, text, ...) that gives parent_candidate_id, text and more, one row each.
METHODS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def method(name: str) -> Callable:
    """Registers a method; a name is taken once."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        if name in METHODS:
            raise ValueError(f"the method {name!r} is there already")
        METHODS[name] = f
        return f

    return add


def generated(items: DataFrame, name: str) -> DataFrame:
    """The results of a registered method, written; refused unless there is one for each item."""
    if name not in METHODS:
        raise LookupError(f"no method {name!r}; there are {sorted(METHODS)}")
    out = written(METHODS[name](items), "generated")
    enforce(batch_faults(items, out), "a method gives one result for each item")
    return out


def _traditional(items: DataFrame, count: Column) -> DataFrame:
    rows = edited_chains(items.select("candidate_id", "base_text_id", "text"), count, F.col("candidate_id"))
    return rows.select(F.col("candidate_id").alias("parent_candidate_id"), "base_text_id", F.col("edited").alias("text"), F.col("applied").alias("perturbation_edits"), F.size("applied").alias("edit_count"), "audit", F.col("reason").alias("skip_reason"))


@method("trad_single")
def trad_single(items: DataFrame) -> DataFrame:
    """One edit of each text."""
    return _traditional(items, F.lit(1))


@method("trad_sampled")
def trad_sampled(items: DataFrame) -> DataFrame:
    """As many edits as the length-scaled law draws."""
    from lamina.functions.text import edit_budget

    return _traditional(items, damage.edit_count(edit_budget("text"), "trad_sampled", F.col("candidate_id")))


def source_items(items: DataFrame, order: list[str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """The rows from `offset` on, `limit` of them, in a given total order (rows that are equal in it go or stay together)."""
    if offset < 0 or limit is not None and limit < 0:
        raise ValueError("offset and limit are 0 or more")
    starts = F.array(*[F.lit(at).cast("long") for at in ([offset] if limit is None else [offset, offset + limit])])
    return parts(items, [F.col(c) for c in order], starts, "__part").where("__part = 1").drop("__part")
