"""Queries of training set builds, generation and budgets, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import answers, draws, edits, prompts, text
from lamina.operators import budgets, building, composing, generation, importing, scoring, splitting
from lamina.plans.queries import _CUTS, _ITEMS, _WS, _h, _norm, _t, items, query

# --- builds ----------------------------------------------------------------------------------------

_SPLIT = _h("'42'", "'split'", "base_text_id")
#: Assignments of the conversations, eight tenths to train.
_ASSIGNED = f"""assigned AS (SELECT base_text_id, CASE WHEN h < 8 THEN 'train' WHEN h < 9 THEN 'dev' ELSE 'test' END AS split FROM (SELECT base_text_id, {_SPLIT} % 10 AS h FROM (SELECT DISTINCT base_text_id FROM items)))"""


def assigned(rows):
    of = rows.select("base_text_id").distinct()
    return splitting.hash_split(of, "base_text_id", {"train": 8, "dev": 1, "test": 1})


def item_scores(rows):
    """A score of every item whose source's number isn't a multiple of 3."""
    return rows.where("cast(base_text_id as long) % 3 != 0").select("candidate_id", F.lit("length").alias("scoring_method"), F.length("text").cast("double").alias("score_value"))


@query(f"""WITH {_ITEMS}, {_ASSIGNED} SELECT split, 'chat:' || base_text_id AS id, string_agg(candidate_id, ',' ORDER BY md5('42:chat:' || base_text_id || ':' || candidate_id), candidate_id) AS candidates, CAST(count(*) AS INTEGER) AS n
FROM items JOIN assigned USING (base_text_id) GROUP BY split, base_text_id""")
def dataset_build_grouped(spark, sf):
    rows = items(spark, sf)
    out = building.training_set(rows, assigned(rows))
    return out.select("split", "id", F.array_join("candidate_ids", ",").alias("candidates"), F.size("labels").alias("n"))


@query(f"""WITH {_ITEMS}, {_ASSIGNED} SELECT split, 'chat:' || a.base_text_id || '__original_only_' || (row_number() OVER (PARTITION BY a.base_text_id ORDER BY b.label, b.method, b.candidate_id) - 1) AS pair_id,
a.candidate_id AS chosen_id, b.candidate_id AS rejected_id, CAST(b.label - a.label AS DOUBLE) AS weight FROM items a JOIN items b ON a.base_text_id = b.base_text_id AND a.method = 'original' AND b.method <> 'original' JOIN assigned s ON s.base_text_id = a.base_text_id""")
def dataset_build_pairwise(spark, sf):
    rows = items(spark, sf)
    return building.training_set(rows, assigned(rows), pair_policy="original_only", form="pairwise").select("split", "pair_id", "chosen_id", "rejected_id", "weight")


@query(f"""WITH {_ITEMS}, {_ASSIGNED}, k AS (SELECT *, row_number() OVER (PARTITION BY base_text_id, method ORDER BY md5('42:chat:' || base_text_id || ':' || candidate_id), candidate_id) AS k FROM items WHERE method <> 'original')
SELECT split, candidate_id, CASE WHEN method = 'original' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, label AS layer FROM (SELECT base_text_id, candidate_id, method, label FROM items WHERE method = 'original' UNION ALL SELECT base_text_id, candidate_id, method, label FROM k WHERE k <= 1) JOIN assigned USING (base_text_id)""")
def dataset_build_binary(spark, sf):
    rows = items(spark, sf)
    return building.training_set(rows, assigned(rows), composition="fixed_per_source", form="binary").select("split", "candidate_id", "label", "layer")


@query(f"WITH {_ITEMS}, {_ASSIGNED} SELECT split, candidate_id, CAST(length(text) AS DOUBLE) AS label, label AS layer FROM items JOIN assigned USING (base_text_id) WHERE CAST(base_text_id AS BIGINT) % 3 <> 0")
def dataset_build_regression(spark, sf):
    rows = items(spark, sf)
    return building.training_set(rows, assigned(rows), item_scores(rows), ["length"], form="regression").select("split", "candidate_id", "label", "layer")


@query(f"""WITH {_ITEMS} SELECT 'chat:' || a.base_text_id || '__all_unequal_layers_' || (row_number() OVER (PARTITION BY a.base_text_id ORDER BY a.label, a.method, a.candidate_id, b.label, b.method, b.candidate_id) - 1) AS pair_id, a.candidate_id AS l, b.candidate_id AS r
FROM items a JOIN items b ON a.base_text_id = b.base_text_id AND a.label < b.label""")
def pair_policy_ids(spark, sf):
    return building.policy_pairs(items(spark, sf), "all_unequal_layers").select("pair_id", F.col("left_candidate_id").alias("l"), F.col("right_candidate_id").alias("r"))


@query(f"""WITH {_ITEMS}, a AS (SELECT DISTINCT base_text_id, CASE WHEN CAST(base_text_id AS BIGINT) % 5 = 0 THEN 'extra' ELSE 'train' END AS split FROM items UNION ALL SELECT DISTINCT base_text_id, 'dev' FROM items WHERE CAST(base_text_id AS BIGINT) % 7 = 0 UNION ALL SELECT 'doc-' || doc_id, 'test' FROM documents),
g AS (SELECT base_text_id, count(*) AS n, min(split) AS split FROM a GROUP BY 1) SELECT base_text_id, CASE WHEN n > 1 THEN 'repeated' WHEN base_text_id LIKE 'doc-%' THEN 'unknown' ELSE 'unsupported' END AS fault FROM g WHERE n > 1 OR base_text_id LIKE 'doc-%' OR split = 'extra'""")
def split_unknown_ids(spark, sf):
    rows = items(spark, sf).select("base_text_id").distinct()
    number = F.col("base_text_id").cast("long")
    own = rows.select("base_text_id", F.when(number % 5 == 0, "extra").otherwise("train").alias("split"))
    again = rows.where(number % 7 == 0).withColumn("split", F.lit("dev"))
    other = _t(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("base_text_id"), F.lit("test").alias("split"))
    return building.split_faults(own.unionByName(again).unionByName(other), rows)


@query(f"WITH {_ITEMS} SELECT candidate_id FROM items WHERE {_SPLIT} % 10 >= 8 AND CAST(base_text_id AS BIGINT) % 4 <> 0")
def source_partition_filter(spark, sf):
    rows = items(spark, sf)
    return building.in_splits(rows, assigned(rows).where("cast(base_text_id as long) % 4 != 0"), ["dev", "test"]).select("candidate_id")


@query("SELECT 'lang' AS column, v AS value FROM (SELECT unnest(['xx', 'zz']) AS v) UNION ALL SELECT 'source', 'none'")
def unknown_requested_values(spark, sf):
    d = _t(spark, sf, "documents")
    known = d.agg(F.min("lang")).first()[0]
    return building.unknown_values(d, {"lang": [known, "xx", "zz"], "source": ["none"], "doc_id": None})


@query(f"""WITH {_ITEMS}, s AS (SELECT CASE WHEN label = 3 THEN 'no-' ELSE '' END || candidate_id AS candidate_id, CASE WHEN label = 2 THEN 'x' ELSE base_text_id END AS base_text_id, label, CASE WHEN label = 1 AND CAST(base_text_id AS BIGINT) % 2 = 0 THEN 'gone' WHEN label = 1 THEN parent_candidate_id WHEN label = 4 THEN candidate_id END AS ref FROM items)
SELECT candidate_id, CASE WHEN label = 3 THEN 'unknown_candidate' WHEN label = 2 THEN 'provenance' WHEN label = 1 THEN 'unknown_reference' ELSE 'reference_provenance' END AS fault FROM s WHERE label IN (2, 3) OR ref = 'gone' OR label = 4""")
def score_write_faults(spark, sf):
    rows = items(spark, sf)
    label, number = F.col("label"), F.col("base_text_id").cast("long")
    ref = F.when((label == 1) & (number % 2 == 0), "gone").when(label == 1, F.col("parent_candidate_id")).when(label == 4, F.col("candidate_id"))
    s = rows.select(F.when(label == 3, F.concat(F.lit("no-"), "candidate_id")).otherwise(F.col("candidate_id")).alias("candidate_id"), F.when(label == 2, "x").otherwise(F.col("base_text_id")).alias("base_text_id"), F.col("method").alias("perturbation_method"), F.col("run_id").alias("perturbation_run_id"), label.alias("target_layer"), (label - 1).alias("source_layer"), ref.alias("reference_candidate_id"))
    return scoring.score_faults(s, rows).select("candidate_id", "fault")


@query(f"""WITH {_ITEMS}, s AS (SELECT *, CASE WHEN label = 2 THEN NULL WHEN label = 3 THEN CAST('nan' AS DOUBLE) ELSE length(text) END AS score FROM items) SELECT base_text_id, CAST(count(*) FILTER (label <> 0 AND score IS NOT NULL AND isfinite(score)) AS BIGINT) AS accepted,
CAST(count(*) FILTER (label = 2) AS BIGINT) AS skipped_missing, CAST(count(*) FILTER (label = 3) AS BIGINT) AS skipped_invalid, CAST(count(*) FILTER (label = 0) AS BIGINT) AS excluded_layer_zero FROM s GROUP BY 1""")
def score_split_statistics(spark, sf):
    score = F.when(F.col("label") == 3, F.lit("nan").cast("double")).when(F.col("label") != 2, F.length("text").cast("double"))
    return building.score_statistics(items(spark, sf).withColumn("score", score), "score", ["base_text_id"], exclude_layer_zero=True)


@query(f"""WITH {_ITEMS}, {_ASSIGNED}, k AS (SELECT i.*, s.split FROM items i JOIN assigned s USING (base_text_id)) SELECT 'new-' || candidate_id AS candidate_id, 'new-' || parent_candidate_id AS parent_candidate_id, CAST(length(text) AS DOUBLE) AS score_value FROM k WHERE split <> 'train'""")
def export_final_dataset(spark, sf):
    rows = items(spark, sf)
    mapping = rows.select(F.col("candidate_id").alias("old"), F.concat(F.lit("new-"), "candidate_id").alias("new"))
    scores = rows.select("candidate_id", F.length("text").cast("double").alias("score_value"))
    kept, scored = scoring.exported(rows, assigned(rows), ["dev", "test"], ["original"], mapping, scores)
    return kept.select("candidate_id", "parent_candidate_id").join(scored, "candidate_id")


@query("WITH m AS (SELECT doc_id AS old FROM documents WHERE doc_id % 4 <> 0) SELECT c AS \"column\", id FROM (SELECT DISTINCT 'doc_id' AS c, doc_id AS id FROM labels UNION SELECT DISTINCT 'other', doc_id + 1 FROM labels) ANTI JOIN m ON id = m.old")
def unmapped_ids(spark, sf):
    mapping = _t(spark, sf, "documents").where("doc_id % 4 != 0").select(F.col("doc_id").alias("old"), (-F.col("doc_id")).alias("new"))
    return scoring.unmapped(_t(spark, sf, "labels").select("doc_id", (F.col("doc_id") + 1).alias("other")), mapping, ["doc_id", "other"])


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'view'")
def id_overlap(spark, sf):
    e = _t(spark, sf, "events")
    return scoring.overlap(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "user_id")


@query("""WITH d AS (SELECT doc_id, 'd' || (CASE WHEN doc_id % 9 = 0 THEN -1 ELSE doc_id END) AS id FROM documents), e AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'doc-' || doc_id WHEN 1 THEN 'd' || doc_id ELSE 'd-1' END AS custom_id FROM documents UNION ALL SELECT -1, 'nothing'),
n AS (SELECT id, count(*) AS n, min(doc_id) AS doc_id FROM d GROUP BY id) SELECT e.custom_id, e.doc_id AS error_id, CASE WHEN e.custom_id LIKE 'doc-%' THEN (SELECT id FROM d WHERE d.doc_id = e.doc_id) WHEN n.n = 1 THEN n.id END AS document, CASE WHEN e.custom_id LIKE 'doc-%' OR n.n = 1 THEN NULL WHEN n.n > 1 THEN 'ambiguous' ELSE 'unknown' END AS fault
FROM e LEFT JOIN n ON n.id = e.custom_id""")
def regeneration_errors(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), F.when(F.col("doc_id") % 9 == 0, -1).otherwise(F.col("doc_id")).cast("string")).alias("id"))
    kind = F.col("doc_id") % 3
    name = F.when(kind == 0, F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).when(kind == 1, F.concat(F.lit("d"), F.col("doc_id").cast("string"))).otherwise("d-1")
    errors = d.select(F.col("doc_id").alias("error_id"), name.alias("custom_id")).unionByName(spark.createDataFrame([(-1, "nothing")], "error_id long, custom_id string"))
    return scoring.two_tier(errors, d, "id", "doc_id")


# --- exclusions and splits -------------------------------------------------------------------------

_OUT = f"""d AS (SELECT doc_id, {_norm("coalesce(text, '')")} AS own FROM documents), o AS (SELECT doc_id, 'a' AS m, CASE WHEN doc_id % 7 = 0 THEN text ELSE text || ' x' END AS t FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT doc_id, 'b', CASE WHEN doc_id % 5 = 0 THEN '  ' || text ELSE 'y' END FROM documents),
j AS (SELECT d.doc_id, own, count(DISTINCT m) AS n, list_sort(coalesce(list(m) FILTER ({_norm('t')} = own), [])) AS same FROM d LEFT JOIN o USING (doc_id) GROUP BY d.doc_id, own),
r AS (SELECT *, CASE WHEN n < 2 THEN 'missing_workflow' WHEN len(same) > 0 THEN 'identical_after_normalization' END AS reason FROM j),
x AS (SELECT doc_id, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY own, reason IS NULL ORDER BY CAST(doc_id AS VARCHAR)) > 1 THEN 'duplicate_original' END) AS reason, CASE WHEN n = 2 THEN same ELSE [] END AS same FROM r)"""


def _outputs(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "text")
    a = d.where("doc_id % 11 != 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" x"))))
    b = d.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("  "), "text")).otherwise("y"))
    return d, {"a": a, "b": b}


@query(f"WITH {_OUT} SELECT doc_id, reason, array_to_string(same, ',') AS same FROM x")
def workflow_exclusions(spark, sf):
    d, outputs = _outputs(spark, sf)
    return splitting.exclusions(d, outputs, "doc_id").select("doc_id", "reason", F.array_join("same", ",").alias("same"))


@query(f"""WITH {_OUT}, u AS (SELECT count(*) FILTER (reason IS NULL) AS u FROM x) SELECT metric, CAST(n AS BIGINT) AS n FROM (SELECT 'original_sources' AS metric, count(*) AS n FROM x UNION ALL SELECT k, count(*) FILTER (reason = k) FROM x, (SELECT unnest(['missing_workflow', 'identical_after_normalization', 'duplicate_original']) AS k) GROUP BY k
UNION ALL SELECT 'usable_before_rounding', u FROM u UNION ALL SELECT 'retained_sources', u // 20 * 20 FROM u UNION ALL SELECT 'excluded_by_rounding', u % 20 FROM u UNION ALL SELECT 'identical_by_method:' || m, count(*) FROM (SELECT unnest(same) AS m FROM x) GROUP BY m)""")
def exclusion_funnel(spark, sf):
    d, outputs = _outputs(spark, sf)
    return splitting.exclusion_funnel(splitting.exclusions(d, outputs, "doc_id"), 20)


@query(f"""WITH {_OUT}, s AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM x WHERE reason IS NULL)), f AS (SELECT doc_id, 'lang:' || lang AS feature FROM s UNION ALL SELECT doc_id, 'source:' || source FROM s), t AS (SELECT feature, count(*) AS total FROM f GROUP BY feature),
a AS (SELECT doc_id, round(sum(1.0::DOUBLE / total), 12) AS rarity, arg_min(feature, (total, feature)) AS least FROM f JOIN t USING (feature) GROUP BY doc_id), b AS (SELECT *, row_number() OVER (ORDER BY -rarity, least, md5('42:stratum:' || doc_id), doc_id) - 1 AS i FROM a),
c AS (SELECT *, row_number() OVER (ORDER BY (CAST(i AS DOUBLE) * 0.6180339887498949) - floor(CAST(i AS DOUBLE) * 0.6180339887498949), i) - 1 AS k, (SELECT count(*) FROM a) // 10 * 10 AS n FROM b) SELECT doc_id, CASE WHEN k < n - 20 THEN 'train' WHEN k < n - 10 THEN 'dev' WHEN k < n THEN 'test' ELSE 'excluded' END AS split FROM c""")
def workflow_split(spark, sf):
    d, outputs = _outputs(spark, sf)
    full = _t(spark, sf, "documents")
    kinds = F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"))
    features = full.select("doc_id", F.explode(kinds).alias("feature"), F.lit(1).alias("n"))
    return splitting.workflow_split(d, outputs, features, F.lit(1.0), 10, 10, 10, on="doc_id")


@query("SELECT 'a' AS method, doc_id, CASE WHEN doc_id < 0 THEN 'unknown' ELSE 'repeated' END AS fault FROM (SELECT doc_id FROM documents WHERE doc_id % 13 = 0 UNION ALL SELECT -1)")
def workflow_faults(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id")
    a = d.unionByName(d.where("doc_id % 13 = 0")).unionByName(spark.createDataFrame([(-1,)], "doc_id long"))
    return splitting.workflow_faults({"a": a, "b": d}, d, "doc_id")


@query("SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY lang")
def ordered_distinct(spark, sf):
    return splitting.ordered_distinct(_t(spark, sf, "documents"), "lang", "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (1, 5, 7)")
def named_documents(spark, sf):
    return splitting.named_rows(_t(spark, sf, "documents"), "doc_id", [1, 5, 7, 5]).select("doc_id", "lang")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) WHERE i >= 100 AND i < 350")
def source_items_window(spark, sf):
    return generation.source_items(_t(spark, sf, "events"), ["ts", "event_id"], limit=250, offset=100).select("event_id")


# --- generation ------------------------------------------------------------------------------------

_RESULT = f"""r AS (SELECT doc_id, text AS source, CASE doc_id % 8 WHEN 0 THEN '  ' WHEN 1 THEN '  ' || text WHEN 2 THEN text || ' more' ELSE 'new ' || doc_id END AS out, doc_id % 8 AS k FROM documents),
f AS (SELECT doc_id, CASE WHEN k = 3 THEN 'reasoning_only' WHEN k = 4 THEN 'over_length' WHEN k = 5 THEN 'no_change' WHEN trim(out) = '' THEN 'empty_output' WHEN {_norm('out')} = {_norm('source')} THEN 'unchanged_output' WHEN k <> 6 AND length(out) > 1000 THEN 'max_output_chars_exceeded' END AS reason FROM r)"""


def _failures(spark, sf):
    k = F.col("doc_id") % 8
    rows = _t(spark, sf, "documents").select("doc_id", "text", F.when(k == 0, "  ").when(k == 1, F.concat(F.lit("  "), "text")).when(k == 2, F.concat("text", F.lit(" more"))).otherwise(F.concat(F.lit("new "), F.col("doc_id").cast("string"))).alias("out"))
    why = generation.failure(F.col("out"), F.col("text"), generation_failure=F.when(k == 3, "reasoning_only"), over_length=k == 4, skipped=F.when(k == 5, "no_change"), by_model=k == 6, most_chars=F.lit(1000))
    return rows.select("doc_id", why.alias("reason"))


@query(f"WITH {_RESULT} SELECT doc_id, reason FROM f")
def failure_class(spark, sf):
    return _failures(spark, sf)


@query(f"WITH {_RESULT} SELECT reason, count(*) AS n FROM f WHERE reason IS NOT NULL GROUP BY reason")
def failure_counts(spark, sf):
    return generation.failure_counts(_failures(spark, sf).where("reason is not null"))


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 + CASE WHEN user_id % 3 = 0 THEN user_id % 5 + 1 ELSE 0 END AS INTEGER) AS candidate_index FROM events")
def candidate_numbers(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").alias("parent_candidate_id"), "event_id")
    old = e.select("parent_candidate_id").distinct().where("parent_candidate_id % 3 = 0").withColumn("candidate_index", (F.col("parent_candidate_id") % 5).cast("int"))
    return generation.candidate_numbers(e, old, ["event_id"]).select("event_id", "candidate_index")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS n_inputs, CASE WHEN doc_id % 6 = 0 THEN 2 ELSE 1 END AS n_results FROM (SELECT doc_id FROM documents WHERE doc_id % 6 = 0 UNION ALL SELECT -1)")
def batch_faults(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("candidate_id"))
    results = d.unionByName(d.where("candidate_id % 6 = 0")).unionByName(spark.createDataFrame([(-1,)], "candidate_id long")).withColumnRenamed("candidate_id", "parent_candidate_id")
    return generation.batch_faults(d, results).select("id", F.col("n_inputs").cast("int").alias("n_inputs"), F.col("n_results").cast("int").alias("n_results"))


def _catalog(spark):
    return spark.createDataFrame([(f"e{i}", [f"dim{i % 3}", f"dim{i % 2 + 2}"]) for i in range(11)], "edit_id string, target_dimensions array<string>")


_CATALOG = "c AS (SELECT 'e' || i AS edit_id, ['dim' || (i % 3), 'dim' || (i % 2 + 2)] AS dims FROM range(11) t(i))"
_SEVERITY = "list_transform(list_sort(list_transform(['weak', 'medium', 'strong'], lambda v: {'k': md5('42:' || method || ':severity:' || (place // 3) || ':' || v), 'v': v})), lambda x: x.v)[place % 3 + 1]"


@query(f"""WITH {_CATALOG}, o AS (SELECT *, row_number() OVER (ORDER BY md5('42:operations:' || edit_id)) - 1 AS p FROM c), m AS (SELECT unnest(['llm_single', 'llm_sampled']) AS method),
d AS (SELECT CAST(doc_id AS VARCHAR) AS id, method, CASE method WHEN 'llm_single' THEN 1 ELSE 1 + CAST(('0x' || substr(md5('edit-count:42:llm_sampled:' || doc_id), 1, 8)) AS BIGINT) % CAST(least(5, greatest(1, length(text) // 500)) AS BIGINT) END AS n FROM documents, m),
k AS (SELECT *, row_number() OVER w - 1 AS place, coalesce(sum(n) OVER (PARTITION BY method ORDER BY md5('42:' || method || ':source-order:' || id), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM d WINDOW w AS (PARTITION BY method ORDER BY md5('42:' || method || ':source-order:' || id), id)),
e AS (SELECT id, method, i, edit_id FROM (SELECT id, method, b, unnest(range(n)) AS i FROM k) x JOIN o ON o.p = (b + i) % 11) SELECT k.id AS base_text_id, k.method, CAST(n AS INTEGER) AS edit_count, (SELECT string_agg(edit_id, ',' ORDER BY i) FROM e WHERE e.id = k.id AND e.method = k.method) AS edits, {_SEVERITY} AS severity FROM k""")
def assignment_plan(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("base_text_id"), "text")
    return generation.assignment_plan(d, _catalog(spark)).select("base_text_id", "method", "edit_count", F.array_join("edits", ",").alias("edits"), "severity")


def _plan(spark, sf):
    k = F.col("doc_id")
    e = F.array(F.concat(F.lit("e"), (k % 13).cast("string")), F.concat(F.lit("e"), ((k + 1) % 7).cast("string")))
    return _t(spark, sf, "documents").select(k.cast("string").alias("base_text_id"), F.when(k % 10 == 0, "other").otherwise("llm_sampled").alias("method"), F.when(k % 9 == 0, 3).otherwise(2).alias("edit_count"), e.alias("edits"), F.when(k % 8 == 0, "mild").otherwise("weak").alias("severity"), F.array(F.lit("dim0")).alias("target_dimensions"))


@query(f"""WITH {_CATALOG}, p AS (SELECT doc_id, unnest([0, 1]) AS place, unnest(['e' || (doc_id % 13), 'e' || ((doc_id + 1) % 7)]) AS edit_id FROM documents) SELECT CAST(doc_id AS VARCHAR) AS base_text_id, CAST(place AS INTEGER) AS place, edit_id, array_to_string(dims, ',') AS dims FROM p LEFT JOIN c USING (edit_id)""")
def planned_edits(spark, sf):
    return generation.planned_edits(_plan(spark, sf), _catalog(spark)).select("base_text_id", "place", "edit_id", F.when(F.col("target_dimensions").isNotNull(), F.array_join("target_dimensions", ",")).alias("dims"))


@query("""SELECT CAST(k AS VARCHAR) AS base_text_id, CASE WHEN k % 10 = 0 THEN 'other' ELSE 'llm_sampled' END AS method, CASE WHEN k % 10 = 0 THEN 'method' WHEN k % 9 = 0 THEN 'edit_count' WHEN k % 13 = (k + 1) % 7 THEN 'repeated_edit' WHEN k % 8 = 0 THEN 'severity' WHEN k % 13 > 10 THEN 'unknown_edit' ELSE 'dimensions' END AS fault FROM (SELECT doc_id AS k FROM documents)""")
def plan_faults(spark, sf):
    return generation.plan_faults(_plan(spark, sf), _catalog(spark))


_TOK = f"SELECT doc_id, list_filter(string_split_regex(text, '{_WS}'), lambda x: x <> '') AS w FROM documents"
_SPAN = lambda key, of: "CASE " + " ".join(f"WHEN {_h(key, *of)} % 1000000 < {c} THEN {i}" for i, c in enumerate(_CUTS)) + f" ELSE {len(_CUTS)} END"
_KEY = ["'chain'", "'0'", "doc_id"]


@query(f"""WITH d AS ({_TOK}), n AS (SELECT *, len(w) AS n FROM d), s AS (SELECT *, least(n, greatest(1, {_SPAN("'deletion-length'", _KEY)})) AS k, least(n, greatest(1, {_SPAN("'repetition-length'", _KEY)})) AS rk, {_h("'swap'", *_KEY)} % greatest(n - 1, 1) AS sa FROM n),
t AS (SELECT *, {_h("'deletion-start'", *_KEY)} % greatest(n - k + 1, 1) AS a, {_h("'repetition-source'", *_KEY)} % greatest(n - rk + 1, 1) AS rb, {_h("'repetition-start'", *_KEY)} % greatest(n, 1) AS ra FROM s),
c AS (SELECT doc_id, array_to_string(w, ' ') AS was, CASE WHEN n > k AND n > 1 THEN array_to_string(list_concat(w[1:a], w[a + k + 1:]), ' ') END AS deletion, CASE WHEN n > 0 THEN array_to_string(list_concat(list_concat(w[1:ra], w[rb + 1:rb + rk]), w[ra + 1:]), ' ') END AS repetition,
CASE WHEN n > 1 THEN array_to_string(list_concat(list_concat(w[1:sa], [w[sa + 2], w[sa + 1]]), w[sa + 3:]), ' ') END AS swap FROM t),
l AS (SELECT doc_id, name, out, md5('operation:0:' || doc_id || ':' || name) AS draw FROM (SELECT doc_id, was, unnest(['deletion', 'repetition', 'swap']) AS name, unnest([deletion, repetition, swap]) AS out FROM c) WHERE out <> was)
SELECT d.doc_id, arg_min(out, draw) AS edited, arg_min(name, draw) AS applied, CASE WHEN count(out) = 0 THEN 'no_change' END AS reason FROM d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id""")
def edit_chain_single(spark, sf):
    out = generation.edited_chains(_t(spark, sf, "documents").select("doc_id", "text"), F.lit(1), F.col("doc_id"), edits=("deletion", "repetition", "swap"))
    return out.select("doc_id", "edited", F.try_element_at("applied", F.lit(1)).alias("applied"), "reason")


def _cumulative(most: int) -> str:
    upto, out = 0.0, []
    for k, c in enumerate(edits.count_chances(most)[:-1], 1):
        upto += c
        out.append(f"WHEN u < {upto!r} THEN {k}")
    return "CASE " + " ".join(out) + f" ELSE {most} END" if out else "1"


@query("WITH d AS (SELECT doc_id, least(5, greatest(1, length(text) // 500)) AS m, (" + _h("'edits'", "doc_id") + " + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM documents) SELECT doc_id, CASE m " + " ".join(f"WHEN {m} THEN {_cumulative(m)}" for m in range(1, 6)) + " END AS edits FROM d")
def sampled_edit_counts(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", edits.edit_count(text.edit_budget("text"), F.col("doc_id")).alias("edits"))


@query("SELECT doc_id, CAST(1 + " + _h("'edit-count'", "'7'", "doc_id") + " % CAST(least(5, greatest(1, length(text) // 500)) AS BIGINT) AS INTEGER) AS edits FROM documents")
def uniform_edit_counts(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", edits.drawn_edit_count("text", 7, F.col("doc_id")).alias("edits"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\p{L}(?:[\\p{L}\\p{M}]|[''’]\\p{L})*') AS w FROM documents) SELECT doc_id, CAST(len(w) AS INTEGER) AS n, w[1] AS first, w[len(w)] AS last FROM w""")
def word_spans(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", edits.word_spans("text").alias("s"))
    return d.select("doc_id", F.size("s").alias("n"), F.try_element_at("s", F.lit(1))["word"].alias("first"), F.try_element_at("s", F.lit(-1))["word"].alias("last"))


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(text, '\\p{L}(?:[\\p{L}\\p{M}]|[''’]\\p{L})*') AS w, text FROM documents) SELECT doc_id, CASE WHEN len(w) > 0 THEN CASE WHEN starts_with(text, w[1]) THEN '[' || w[1] || ']' || substring(text, length(w[1]) + 1) END END AS text FROM d""")
def first_words_replaced(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "text", edits.word_spans("text").alias("s")).withColumn("f", F.try_element_at("s", F.lit(1)))
    new = edits.replaced(F.col("text"), F.array(F.struct(F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.concat(F.lit("["), "f.word", F.lit("]")).alias("word"))))
    return d.select("doc_id", F.when((F.size("s") > 0) & (F.col("f.start") == 0), new).alias("text"))


@query(f"""WITH d AS ({_TOK}), n AS (SELECT *, len(w) AS n FROM d), s AS (SELECT *, least(n, greatest(1, {_SPAN("'deletion-length'", ["'rule'", "doc_id"])})) AS k, {_h("'swap'", "'rule'", "doc_id")} % greatest(n - 1, 1) AS sa FROM n), t AS (SELECT *, {_h("'deletion-start'", "'rule'", "doc_id")} % greatest(n - k + 1, 1) AS a FROM s),
c AS (SELECT doc_id, array_to_string(w, ' ') AS was, CASE WHEN n > k AND n > 1 THEN array_to_string(list_concat(w[1:a], w[a + k + 1:]), ' ') END AS deletion, CASE WHEN n > 1 THEN array_to_string(list_concat(list_concat(w[1:sa], [w[sa + 2], w[sa + 1]]), w[sa + 3:]), ' ') END AS swap FROM t),
l AS (SELECT doc_id, rule, out FROM (SELECT doc_id, was, unnest(['swap', 'deletion']) AS rule, unnest([swap, deletion]) AS out FROM c) WHERE out <> was) SELECT d.doc_id, rule, out AS output, CASE WHEN rule IS NULL THEN 'no_verified_edit' END AS reason FROM d LEFT JOIN l USING (doc_id)""")
def rule_outputs(spark, sf):
    return generation.rule_outputs(_t(spark, sf, "documents").select("doc_id", "text"), ["swap", "deletion"], "all", F.col("doc_id")).select("doc_id", "rule", "output", "reason")


@query(f"WITH {_ITEMS} SELECT candidate_id, row_number() OVER (PARTITION BY base_text_id ORDER BY CASE WHEN method = 'original' THEN 0 ELSE 1 END, label, method, candidate_id) AS place FROM items")
def composed_order(spark, sf):
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(*composing.CHAIN).orderBy(*composing.composed_order()))
    return items(spark, sf).select("candidate_id", at.cast("long").alias("place"))


# --- answers and prompts ---------------------------------------------------------------------------

_EDGE = rf"^{_WS}|{_WS}$"


@query(f"""WITH c AS (SELECT conv_id, turn, conv_id % 6 AS kind, coalesce(text, '') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN kind IN (0, 2) THEN t WHEN kind IN (1, 5) THEN regexp_replace('A: ' || t, '{_EDGE}', '', 'g') ELSE '' END AS text,
  CASE WHEN kind = 3 THEN 'unparseable_output' WHEN kind = 4 THEN CASE WHEN turn % 2 = 0 THEN 'reasoning_only' ELSE 'truncated_output' END WHEN kind IN (0, 2) AND regexp_replace(t, '{_EDGE}', '', 'g') = '' THEN 'empty_output' END AS reason, kind = 0 AS reported,
  CASE WHEN kind = 0 THEN turn END AS edits, kind = 2 AS cut FROM c""")
def completion_parse(spark, sf):
    """Turns as answers: an object with counts and more behind it, after a thought, cut after its text, cut in its text, a thought alone or
    a cut answer, fenced."""
    c = _t(spark, sf, "conversations").withColumn("t", F.coalesce("text", F.lit(""))).withColumn("kind", F.col("conv_id") % 6)
    kind, json_, says = F.col("kind"), F.to_json(F.struct(F.col("t").alias("text"))), F.concat(F.lit("A: "), F.col("t"))
    raw = F.when(kind == 0, F.concat(F.to_json(F.struct(F.col("t").alias("text"), F.create_map(F.lit("e"), "turn").alias("applied_edits"))), F.lit(" tail"))).when(kind == 1, F.concat(F.lit("<think>no</think> "), says))
    raw = raw.when(kind == 2, F.concat(F.expr("left(to_json(struct(t as text)), length(to_json(struct(t as text))) - 1)"), F.lit(', "app'))).when(kind == 3, F.concat(F.lit('{"text": "'), F.regexp_replace("t", r'["\\]', "")))
    raw = raw.when(kind == 4, F.concat(F.when(F.col("turn") % 2 == 0, "<think>").otherwise("so "), F.col("t"))).otherwise(F.concat(F.lit("```json\n"), says, F.lit("\n```")))
    finish = F.when((kind == 2) | (kind == 4) & (F.col("turn") % 2 == 1), "length").otherwise("stop")
    found = c.withColumn("c", answers.completion(raw, F.lit(None).cast("string"), finish))
    return found.select("conv_id", "turn", "c.text", "c.reason", F.col("c.edits_reported").alias("reported"), F.col("c.edits")["e"].alias("edits"), "c.cut")


@query(f"""WITH c AS (SELECT conv_id, turn, conv_id % 6 AS kind, 'T: ' || coalesce(text, '') AS t FROM conversations), w AS (SELECT *, regexp_replace(t, '[\"\\\\{{}}[:cntrl:]]', '', 'g') AS w FROM c)
SELECT conv_id, turn, CASE kind WHEN 0 THEN regexp_replace(t, '{_EDGE}', '', 'g') WHEN 1 THEN 'p' WHEN 2 THEN 'p' WHEN 3 THEN regexp_replace('He said "no", ' || w, '{_EDGE}', '', 'g') END AS prompt_sentence,
  CASE WHEN kind IN (0, 1, 2, 3) THEN regexp_replace(CASE WHEN kind = 0 THEN t ELSE w END, '{_EDGE}', '', 'g') END AS text, CASE kind WHEN 4 THEN 'missing_field' WHEN 5 THEN 'not_a_string' END AS reason FROM w""")
def json_repair(spark, sf):
    """Turns as objects: whole, among other words, without its last brace, with bare quotes, without a field, with a number."""
    c = _t(spark, sf, "conversations").withColumn("t", F.concat(F.lit("T: "), F.coalesce("text", F.lit(""))))
    c = c.withColumn("w", F.regexp_replace("t", r'["\\{}\x00-\x1f\x7f]', "")).withColumn("kind", F.col("conv_id") % 6)
    kind, made = F.col("kind"), F.to_json(F.struct(F.lit("p").alias("prompt_sentence"), F.col("w").alias("text")))
    raw = F.when(kind == 0, F.to_json(F.struct(F.col("t").alias("prompt_sentence"), F.col("t").alias("text")))).when(kind == 1, F.concat(F.lit("So: "), made, F.lit(" end"))).when(kind == 2, F.rtrim(made, F.lit("}")))
    raw = raw.when(kind == 3, F.concat(F.lit('{"prompt_sentence": "He said "no", '), F.col("w"), F.lit('", "text": "'), F.col("w"), F.lit('" }'))).when(kind == 4, F.to_json(F.struct(F.col("w").alias("text"))))
    raw = raw.otherwise(F.to_json(F.struct(F.col("conv_id").alias("prompt_sentence"), F.col("w").alias("text"))))
    return c.withColumn("r", answers.repaired_object(raw)).select("conv_id", "turn", "r.*")


_ENVELOPE = """CASE turn WHEN 0 THEN '{"text": "a", "key": "k"}' WHEN 1 THEN '{"custom_id": "k", "candidates": [{"content": {"parts": [{"text": "b"}, {"x": 1}, {"text": "c"}]}}, {"content": {"parts": [{"text": "d"}]}}]}' WHEN 2 THEN '{"metadata": {"key": "k"}, "output": [{"content": [{"type": "no", "text": "x"}, {"type": "output_text", "text": "e"}]}]}' WHEN 3 THEN '{"request": {"key": "k"}, "message": "f"}' WHEN 4 THEN '{"message": 4}' ELSE 'broken' END"""


@query("SELECT conv_id, turn, CASE turn WHEN 0 THEN 'a' WHEN 1 THEN 'bcd' WHEN 2 THEN 'e' WHEN 3 THEN 'f' END AS text, CASE WHEN turn < 4 THEN 'k' END AS key FROM conversations")
def response_texts(spark, sf):
    c = _t(spark, sf, "conversations").withColumn("r", F.expr(_ENVELOPE))
    return c.select("conv_id", "turn", answers.response_text("r").alias("text"), answers.response_key("r").alias("key"))


@query("SELECT conv_id, turn, CASE turn WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 5 WHEN 3 THEN 2 END AS rating FROM conversations")
def rating_parse(spark, sf):
    raw = F.expr("CASE turn WHEN 0 THEN 'good [RESULT] 3' WHEN 1 THEN '<think>Rating: 1</think>Rating : 4.' WHEN 2 THEN 'RESULT:5' WHEN 3 THEN 'so [ result ] : 2' WHEN 4 THEN 'Rating: 9' ELSE 'RESULTS 3' END")
    return _t(spark, sf, "conversations").select("conv_id", "turn", text.rating(raw).alias("rating"))


@query("SELECT doc_id, CASE WHEN lang = 'en' AND source = 'src1' THEN 'mapped' WHEN source IN ('src1', 'src2') THEN source ELSE 'general' END AS rubric FROM documents")
def rubric_choice(spark, sf):
    d = _t(spark, sf, "documents").withColumns({"task": F.concat(F.lit(" "), F.upper("lang")), "aspect": F.upper("source")})
    rule = prompts.rubrics(d, "task", "aspect", {("en", "src1"): "mapped", ("en", "src2"): "not there"}, ["mapped", "src1", "src2"], "general")
    return d.select("doc_id", rule.alias("rubric"))


@query("SELECT item_id, 'You {judge}.' AS first, 'Text ' || item_id || ': ' || coalesce(text, '') || '!' AS second FROM benchmark")
def prompt_rendering(spark, sf):
    spec = prompts.read_prompt('{"schema_version": 1, "id": "p", "version": "1", "required_variables": ["n", "t"], "messages": [{"role": "system", "content": "You {{judge}}."}, {"role": "user", "content": "Text {n}: {t}!"}]}')
    m = _t(spark, sf, "benchmark").select("item_id", spec.rendered({"n": "item_id", "t": "text"}).alias("m"))
    return m.select("item_id", F.col("m")[0]["content"].alias("first"), F.col("m")[1]["content"].alias("second"))


@query("SELECT lang AS task, source AS aspect, CASE WHEN source = 'src1' THEN 'new' ELSE 'old' END AS prompt FROM (SELECT DISTINCT lang, source FROM documents) UNION ALL SELECT 'other', 'x', 'new'")
def prompt_overrides(spark, sf):
    table = _t(spark, sf, "documents").select(F.col("lang").alias("task"), F.col("source").alias("aspect"), F.lit("old").alias("prompt")).distinct()
    new = table.where("aspect = 'src1'").withColumn("prompt", F.lit("new")).unionByName(spark.createDataFrame([("other", "x", "new")], "task string, aspect string, prompt string"))
    return prompts.with_overrides(table, new, ["task", "aspect"], "prompt")


@query("SELECT conv_id, turn, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS cleaned, CASE WHEN turn % 2 = 0 THEN 'Well, ' || trim(text) ELSE trim(text) || '.' END AS joined FROM conversations WHERE trim(coalesce(text, '')) <> ''")
def joined_texts(spark, sf):
    c = _t(spark, sf, "conversations").where(text.cleaned("text") != "")
    return c.select("conv_id", "turn", text.cleaned("text").alias("cleaned"), F.when(F.col("turn") % 2 == 0, text.joined(F.lit(" Well, "), "text")).otherwise(text.joined("text", F.lit(". "))).alias("joined"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' WHEN 'da' THEN 'dan' WHEN 'fi' THEN 'fin' WHEN 'sv' THEN 'swe' END AS code, source AS genre FROM documents")
def languages_and_genres(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.language_code(F.concat(F.lit(" "), F.upper("lang"), F.lit("-XX"))).alias("code"), text.genre(F.concat("source", F.lit("-12-3"))).alias("genre"))


@query("""WITH a AS (SELECT user_id, event_id AS attempt, CASE WHEN event_type = 'view' THEN 'failed' END AS error, value FROM events), b AS (SELECT user_id, arg_max(value, (error IS NULL, attempt)) AS value, arg_max(coalesce(error, ''), (error IS NULL, attempt)) AS error FROM a GROUP BY user_id), r AS (SELECT DISTINCT user_id FROM events UNION SELECT -1)
SELECT r.user_id, b.value, CASE WHEN b.user_id IS NULL THEN 'MissingBatchResult' ELSE nullif(b.error, '') END AS error FROM r LEFT JOIN b USING (user_id)""")
def collected_answers(spark, sf):
    e = _t(spark, sf, "events")
    a = e.select("user_id", F.col("event_id").alias("attempt"), "value", F.when(F.col("event_type") == "view", "failed").alias("error"))
    return scoring.collected(e.select("user_id").unionByName(spark.createDataFrame([(-1,)], "user_id long")), a, "user_id")


@query("SELECT source, lang, count(*) AS n FROM (SELECT source, lang FROM documents WHERE doc_id % 3 <> 0 EXCEPT ALL SELECT source, lang FROM documents WHERE doc_id % 2 = 0) GROUP BY 1, 2")
def row_differences(spark, sf):
    from lamina.operators.lineage import same_rows

    d = _t(spark, sf, "documents").select("doc_id", "source", "lang")
    out = same_rows(d.where("doc_id % 3 != 0").drop("doc_id"), d.where("doc_id % 2 = 0").drop("doc_id"))
    return out.where("side = 'left'").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 40")
def selected_originals(spark, sf):
    return scoring.select_originals(_t(spark, sf, "documents"), "doc_id", 40)


# --- budgets ---------------------------------------------------------------------------------------

_SIZED = f"d AS (SELECT doc_id, len(list_filter(string_split_regex(text, '{_WS}'), lambda x: x <> '')) AS n FROM documents)"


def _sized(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.token_count("text").cast("long").alias("tokens")).withColumn("prompt", F.col("tokens") + 100)


@query(f"WITH {_SIZED}, o AS (SELECT list_sort(list(n)) AS v, count(*) AS c FROM d), q AS (SELECT unnest([0.3, 0.6, 0.9, 1.0]) AS q) SELECT DISTINCT CAST(greatest(64, CAST(ceil(v[CAST(round_even((c - 1) * CAST(q AS DOUBLE), 0) AS BIGINT) + 1] / 64) * 64 AS BIGINT)) AS BIGINT) AS bucket FROM o, q")
def source_buckets(spark, sf):
    return spark.createDataFrame([(b,) for b in budgets.source_buckets(_sized(spark, sf), "tokens")], "bucket long")


_BUDGET = f"""{_SIZED}, b AS (SELECT *, n + 100 AS p, CASE WHEN n <= 128 THEN 128 WHEN n <= 512 THEN 512 ELSE n END AS b0, greatest(n, 1) AS th FROM d), c AS (SELECT *, CASE WHEN p + th + b0 + 40 > 4000 THEN n ELSE b0 END AS bucket FROM b),
g AS (SELECT doc_id, n, p, bucket, th, bucket + 32 AS answer, p + th + bucket + 40 AS need FROM c), t AS (SELECT *, need <= 4000 AS fits, greatest(0, least(4000 - p, th + answer + 8 + greatest(256, CAST(ceil(answer * 0.15::DOUBLE) AS BIGINT)))) AS most FROM g)"""


def _budgets(spark, sf):
    return budgets.token_budgets(_sized(spark, sf), "tokens", "prompt", [128, 512], ceiling=4000)


@query(f"WITH {_BUDGET} SELECT doc_id, CAST(bucket AS BIGINT) AS source_bucket, CAST(need AS BIGINT) AS required_tokens, CAST(most AS BIGINT) AS max_tokens, fits FROM t")
def token_budgets(spark, sf):
    return _budgets(spark, sf).select("doc_id", "source_bucket", F.col("required_tokens").cast("long").alias("required_tokens"), "max_tokens", "fits")


_PICK = lambda c: f"(SELECT list_sort(list({c})) FROM t)[CAST(round_even(((SELECT count(*) FROM t) - 1) * CAST(q AS DOUBLE), 0) AS BIGINT) + 1]"


@query(f"""WITH {_BUDGET}, q AS (SELECT unnest([0.1, 0.3, 0.5, 0.6, 0.9, 0.99, 1.0]) AS q) SELECT 'input_count' AS metric, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM t UNION ALL SELECT 'over_context_count', '', CAST(count(*) FILTER (NOT fits) AS DOUBLE) FROM t UNION ALL SELECT 'reserved_rounding_tokens', '', CAST(sum(bucket - n) AS DOUBLE) FROM t
UNION ALL SELECT 'bucket_counts', CAST(bucket AS VARCHAR), CAST(count(*) AS DOUBLE) FROM t GROUP BY bucket UNION ALL SELECT 'source_token_quantiles', CAST(CAST(q AS DOUBLE) AS VARCHAR), CAST({_PICK('n')} AS DOUBLE) FROM q UNION ALL SELECT 'prompt_token_quantiles', CAST(CAST(q AS DOUBLE) AS VARCHAR), CAST({_PICK('p')} AS DOUBLE) FROM q UNION ALL SELECT 'required_token_quantiles', CAST(CAST(q AS DOUBLE) AS VARCHAR), CAST({_PICK('need')} AS DOUBLE) FROM q""")
def budget_report(spark, sf):
    return budgets.budget_report(_budgets(spark, sf), "tokens", "prompt")


@query(f"""WITH {_BUDGET}, i AS (SELECT *, (row_number() OVER (PARTITION BY fits, bucket ORDER BY doc_id) - 1) // 16 AS own FROM t) SELECT doc_id, CAST(dense_rank() OVER (ORDER BY NOT fits, bucket, own) - 1 AS INTEGER) AS batch FROM i""")
def generation_batches(spark, sf):
    return budgets.generation_batches(_budgets(spark, sf), 16, ["doc_id"]).select("doc_id", "batch")


@query(f"WITH d AS (SELECT doc_id, text, len(list_filter(string_split_regex(text, '{_WS}'), lambda x: x <> '')) AS n, length(text) - length(replace(text, '.', '')) AS stops FROM documents) SELECT doc_id, n >= 40 AS single, n >= 40 AND stops >= 3 AS coherence, length(text) >= 1000 AND stops >= 2 AS two FROM d")
def pilot_eligibility(spark, sf):
    p = budgets.pilot_eligible
    return _t(spark, sf, "documents").select("doc_id", p("text").alias("single"), p("text", True).alias("coherence"), p("text", n_edits=2).alias("two"))


@query(f"""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), s AS (SELECT unnest(['short', 'medium', 'long']) AS stratum, unnest([0.1, 0.5, 0.95]) AS f),
a AS (SELECT stratum, least(n - 1, CAST(floor((n - 1) * CAST(f AS DOUBLE)) AS BIGINT) + {_h("'42'", "'pilot'", "stratum")} % least(64, n)) AS i FROM s, (SELECT count(*) AS n FROM documents)) SELECT doc_id, stratum FROM o JOIN a USING (i)""")
def stratified_picks(spark, sf):
    return budgets.stratified_picks(_t(spark, sf, "documents"), "doc_id", F.col("n_chars")).select("doc_id", "stratum")


@query("SELECT doc_id, n_chars AS error, -n_chars::DOUBLE AS up, CASE WHEN n_chars > 0 THEN round(-ln(n_chars), 9) END AS perplexity FROM documents")
def score_directions(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("error"), text.higher_is_better("n_chars", "error").alias("up"), F.round(text.higher_is_better("n_chars", "perplexity"), 9).alias("perplexity"))


@query("SELECT event_id, round(1 / (1 + exp(50 - value)), 9) AS p FROM events")
def yes_probabilities(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.round(text.yes_probability("value", F.lit(50.0)), 9).alias("p"))


@query("WITH b AS (SELECT user_id % 40 AS batch FROM events WHERE user_id % 40 NOT IN (3, 17)), m AS (SELECT max(batch) AS m FROM b) SELECT g AS batch FROM (SELECT unnest(range(0, (SELECT m + 1 FROM m))) AS g) ANTI JOIN b ON g = b.batch")
def journal_gaps(spark, sf):
    from lamina.streaming.journal import missing_batches

    b = _t(spark, sf, "events").select((F.col("user_id") % 40).alias("batch")).where("batch not in (3, 17)")
    return missing_batches(b, "batch")


@query("SELECT (SELECT count(*) FROM documents) AS n_inputs, count(*) AS n_attempted, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS n_ready, CAST(count(*) FILTER (quality = 0) AS BIGINT) AS n_failed, count(*) = (SELECT count(*) FROM documents) AS complete, count(*) FILTER (quality = 1) = (SELECT count(*) FROM documents) AS all_ready, (SELECT count(*) FROM benchmark) AS n_batches FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def generation_summary(spark, sf):
    from lamina.streaming.journal import run_summary

    done = _t(spark, sf, "labels").where("quality is not null").select("doc_id", (F.col("quality") == 1).alias("ok"))
    return run_summary(_t(spark, sf, "benchmark"), done, _t(spark, sf, "documents"), "doc_id", "ok")
