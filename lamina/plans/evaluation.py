"""Queries of suites, trials, statistics and benchmark sources, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import composing, metrics, suites, trials
from lamina.plans.queries import _ITEMS, _h, _t, items, query
from lamina.sources import benchmarks


def _labelled(spark, sf):
    return _t(spark, sf, "documents").join(_t(spark, sf, "labels").where("quality is not null"), "doc_id")


def _length_scorer(rows):
    return rows["text"].str.len().astype(float)


# --- suites ----------------------------------------------------------------------------------------

_RHO = "round(CASE WHEN stddev_pop(a) * stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END, 9)"


@query(f"""WITH d AS (SELECT doc_id, lang, quality AS x, length(text) AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2 AS a, rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2 AS b FROM d),
p AS (SELECT a.lang, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM d a JOIN d b ON a.lang = b.lang AND a.doc_id < b.doc_id), k AS (SELECT lang, sum(sx * sy) AS c, sum(abs(sx)) AS nx, sum(abs(sy)) AS ny FROM p GROUP BY lang)
SELECT lang, count(*) AS n, {_RHO} AS spearman, any_value(round(CASE WHEN nx * ny > 0 THEN c / (sqrt(nx) * sqrt(ny)) END, 9)) AS kendall FROM r JOIN k USING (lang) GROUP BY lang""")
def suite_correlations(spark, sf):
    d = _labelled(spark, sf).select("lang", "text", F.col("quality").cast("double").alias("human_score"))
    out = suites.scored_suite(d, _length_scorer, ["lang"])
    # p-values have no SQL; tests hold them against sums over all permutations
    return out.select("lang", "n", F.round("spearman", 9).alias("spearman"), F.round("kendall", 9).alias("kendall"))


@query(f"""WITH {_ITEMS}, p AS (SELECT b.method, length(trim(a.text)) - length(trim(b.text)) AS d, b.label % 2 = 0 AS tie FROM items a JOIN items b ON a.base_text_id = b.base_text_id AND a.method = 'original' AND b.method <> 'original' WHERE trim(a.text) <> '' AND trim(b.text) <> '')
SELECT method, count(*) AS n, round(avg(CASE WHEN d > 0 AND NOT tie THEN 1.0 ELSE 0.0 END), 9) AS strict_accuracy, round(avg(CASE WHEN tie OR d = 0 THEN 1.0 ELSE 0.0 END), 9) AS tie_rate, round(median(d), 9) AS median_delta FROM p GROUP BY method""")
def suite_preferences(spark, sf):
    p = composing.original_pairs(items(spark, sf)).select(F.col("right_method").alias("method"), F.col("left_text").alias("preferred_text"), F.col("right_text").alias("dispreferred_text"), (F.col("right_label") % 2 == 0).alias("tie"))
    out = suites.preference_suite(p, _length_scorer, ["method"], "tie")
    return out.select("method", "n", *[F.round(c, 9).alias(c) for c in ("strict_accuracy", "tie_rate", "median_delta")])


_RECORDS = "r AS (SELECT lang AS spec, source AS benchmark, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS task, CASE WHEN doc_id % 3 = 0 THEN ['fluency', 'clarity'] ELSE ['fluency'] END AS cats FROM documents)"


@query(f"WITH {_RECORDS} SELECT 'spec' AS kind, name, count(spec) AS n FROM (SELECT DISTINCT spec AS name FROM r UNION SELECT 'nothing') LEFT JOIN r ON spec = name GROUP BY name UNION ALL SELECT 'benchmark', benchmark, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'task', task, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'category', c, count(*) FROM (SELECT unnest(cats) AS c FROM r) GROUP BY 2")
def suite_audit(spark, sf):
    k = F.col("doc_id")
    r = _t(spark, sf, "documents").select(F.col("lang").alias("spec"), F.col("source").alias("benchmark"), F.when(k % 2 == 0, "even").otherwise("odd").alias("task_family"), F.when(k % 3 == 0, F.array(F.lit("fluency"), F.lit("clarity"))).otherwise(F.array(F.lit("fluency"))).alias("fluency_categories"))
    specs = r.select(F.col("spec").alias("name")).distinct().unionByName(spark.createDataFrame([("nothing",)], "name string"))
    return suites.suite_audit(r, specs)


@query("""WITH a AS (SELECT user_id AS id FROM events WHERE event_type = 'view'), b AS (SELECT user_id AS id FROM events WHERE event_type = 'purchase') SELECT * FROM (SELECT 'overlap' AS fault, 'both' AS side, count(*) AS n FROM (SELECT id FROM a INTERSECT SELECT id FROM b)
UNION ALL SELECT 'repeated', 'train', count(*) FROM (SELECT id FROM a GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'repeated', 'test', count(*) FROM (SELECT id FROM b GROUP BY id HAVING count(*) > 1)) WHERE n > 0""")
def split_audit(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").alias("id"), "event_type")
    return suites.split_audit(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "id")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) WHERE k <= 20")
def capped_dimensions(spark, sf):
    return suites.capped(_t(spark, sf, "events"), ["event_type"], "event_id", 20).select("event_type", "event_id")


@query("WITH m AS (SELECT lang, count(*) AS n, CAST(sum(n_chars) FILTER (doc_id < 0) AS DOUBLE) AS nothing, CAST(max(n_chars) AS DOUBLE) AS longest FROM documents GROUP BY lang) SELECT lang, 'm_n' AS key, CAST(n AS DOUBLE) AS value FROM m UNION ALL SELECT lang, 'm_longest', longest FROM m")
def metrics_long_form(spark, sf):
    m = _t(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.when(F.col("doc_id") < 0, F.col("n_chars"))).alias("nothing"), F.max("n_chars").alias("longest"))
    return suites.long_form(m, ["lang"], "m_")


@query("SELECT source AS name FROM (SELECT DISTINCT source FROM documents) WHERE source NOT IN ('src1')")
def included_specs(spark, sf):
    specs = _t(spark, sf, "documents").select(F.col("source").alias("name")).distinct().withColumn("notes", F.when(F.col("name") == "src1", "under review").otherwise(" "))
    return suites.included_specs(specs).select("name")


_SEGMENTS = "s AS (SELECT event_type AS system, user_id AS item, avg(value) AS m, avg(CASE WHEN event_id % 4 <> 0 THEN round(value / 25) END) AS h FROM events GROUP BY 1, 2)"


def _segments(spark, sf):
    return _t(spark, sf, "events").groupBy(F.col("event_type").alias("system"), F.col("user_id").alias("item")).agg(F.avg("value").alias("m"), F.avg(F.when(F.col("event_id") % 4 != 0, F.round(F.col("value") / 25))).alias("h"))


@query(f"""WITH {_SEGMENTS}, y AS (SELECT system, avg(m) AS m, avg(h) AS h FROM s GROUP BY system), p AS (SELECT avg(CASE WHEN sign(a.m - b.m) = sign(a.h - b.h) THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n_pairs FROM y a JOIN y b ON a.system < b.system)
SELECT round(covar_pop(m, h) / (stddev_pop(m) * stddev_pop(h)), 9) AS pearson, any_value(n_pairs) AS n_pairs, round(any_value(accuracy), 9) AS accuracy FROM y, p""")
def system_agreement(spark, sf):
    out = suites.system_agreement(_segments(spark, sf), "system", "m", "h")
    return out.select(F.round("pearson", 9).alias("pearson"), "n_pairs", F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH {_SEGMENTS} SELECT count(*) AS n, round(covar_pop(m, h) / (stddev_pop(m) * stddev_pop(h)), 9) AS pearson FROM s WHERE h IS NOT NULL")
def segment_pearson(spark, sf):
    return suites.segment_pearson(_segments(spark, sf), "m", "h").select("n", F.round("pearson", 9).alias("pearson"))


@query(f"""WITH {_SEGMENTS}, r AS (SELECT system, item, round(m) AS m, h FROM s WHERE h IS NOT NULL), p AS (SELECT abs(a.m - b.m) AS d, sign(a.m - b.m) = sign(a.h - b.h) AS same, a.h = b.h AS tie FROM r a JOIN r b ON a.item = b.item AND a.system < b.system), e AS (SELECT DISTINCT d AS eps FROM p UNION SELECT 0.0),
a AS (SELECT eps, (SELECT avg(CASE WHEN CASE WHEN d <= eps THEN tie ELSE same END THEN 1.0 ELSE 0.0 END) FROM p) AS acc FROM e) SELECT round(arg_min(eps, (-round(acc, 12), eps)), 9) AS epsilon, round(max(acc), 9) AS accuracy, (SELECT count(*) FROM p) AS n_pairs FROM a""")
def tie_calibrated_accuracy(spark, sf):
    out = suites.tie_calibrated(_segments(spark, sf).withColumn("m", F.round("m")), "item", "system", "m", "h")
    return out.select(F.round("epsilon", 9).alias("epsilon"), F.round("accuracy", 9).alias("accuracy"), "n_pairs")


@query(f"""WITH {_ITEMS}, p AS (SELECT length(a.text) AS x, length(b.text) AS y FROM items a JOIN items b ON a.base_text_id = b.base_text_id AND a.label < b.label) SELECT CASE WHEN x < y THEN 'shorter' WHEN x > y THEN 'longer' ELSE 'equal' END AS direction, count(*) AS n, round(avg(CASE WHEN x % 10 = y % 10 THEN 0.5 WHEN x % 10 > y % 10 THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM p GROUP BY 1""")
def directed_accuracy(spark, sf):
    p = composing.unequal_pairs(items(spark, sf)).withColumns({"a": F.length("left_text") % 10, "b": F.length("right_text") % 10})
    return suites.directed_accuracy(p, [], "a", "b", "left_text", "right_text").select("direction", "n", F.round("accuracy", 9).alias("accuracy"))


@query("SELECT user_id % 7 AS run, event_id AS step, row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id) AS number, value FROM events")
def accuracy_history(spark, sf):
    return suites.history(_t(spark, sf, "events").select((F.col("user_id") % 7).alias("run"), F.col("event_id").alias("step"), "value"), "run", "step", ["value"])


@query(f"""WITH d AS (SELECT source, quality AS x, n_chars AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), g AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS g FROM (SELECT DISTINCT source FROM d)), k AS (SELECT count(*) AS groups FROM g),
z AS (SELECT s.i AS sample, j.j AS draw FROM (SELECT unnest(range(1, 11)) AS i) s, (SELECT unnest(range(1, (SELECT groups FROM k) + 1)) AS j) j), w AS (SELECT sample, x, y FROM z JOIN g ON g.g = {_h("'42'", 'sample', 'draw')} % (SELECT groups FROM k) JOIN d USING (source)),
r AS (SELECT sample, rank() OVER (PARTITION BY sample ORDER BY x) + (count(*) OVER (PARTITION BY sample, x) - 1) / 2 AS a, rank() OVER (PARTITION BY sample ORDER BY y) + (count(*) OVER (PARTITION BY sample, y) - 1) / 2 AS b FROM w), m AS (SELECT covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) AS m FROM r GROUP BY sample),
o AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS b FROM d) SELECT (SELECT round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) FROM o) AS spearman, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def bootstrap_spearman(spark, sf):
    out = metrics.bootstrap_of(_labelled(spark, sf), "source", ["quality", "n_chars"], lambda rows, by, weight: metrics.spearman(rows, by, "quality", "n_chars", weight), "spearman", 10)
    return out.select(*[F.round(c, 6).alias(c) for c in ("spearman", "low", "high")])


# --- trials ----------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT user_id AS trial, event_id AS ordinal, CASE event_type WHEN 'view' THEN 'hpo_dev_total_pairs' WHEN 'purchase' THEN 'hpo_dev_spearman' WHEN 'click' THEN 'hpo_dev_accuracy' ELSE 'other' END AS key, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events),
p AS (SELECT *, CASE key WHEN 'hpo_dev_accuracy' THEN 1 WHEN 'hpo_dev_spearman' THEN 2 WHEN 'hpo_dev_total_pairs' THEN 3 END AS place FROM m WHERE value IS NOT NULL) SELECT trial, arg_min(key, (place, ordinal)) AS key, arg_min(value, (place, ordinal)) AS value FROM p WHERE place IS NOT NULL GROUP BY trial""")
def objective_selection(spark, sf):
    e = _t(spark, sf, "events")
    key = F.when(F.col("event_type") == "view", "hpo_dev_total_pairs").when(F.col("event_type") == "purchase", "hpo_dev_spearman").when(F.col("event_type") == "click", "hpo_dev_accuracy").otherwise("other")
    return trials.objective(e.select(F.col("user_id").alias("trial"), F.col("event_id").alias("ordinal"), key.alias("key"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value")))


@query("""WITH s AS (SELECT source AS trial, lang AS loss, avg(n_chars) AS a, max(n_chars) AS b FROM documents GROUP BY 1, 2), m AS (SELECT trial || '-' || loss AS trial, loss, (a + b) / 2 AS mean FROM s) SELECT trial, loss, round(mean, 6) AS mean_score, CAST(row_number() OVER (ORDER BY mean DESC, trial) AS INTEGER) AS place, row_number() OVER (PARTITION BY loss ORDER BY mean DESC, trial) = 1 AS best_of_loss FROM m""")
def trial_comparison(spark, sf):
    s = _t(spark, sf, "documents").groupBy("source", "lang").agg(F.avg("n_chars").alias("a"), F.max("n_chars").cast("double").alias("b"))
    s = s.select(F.concat_ws("-", "source", "lang").alias("trial"), F.col("lang").alias("loss"), "a", "b")
    return trials.compared(s, "trial", "loss", ["a", "b"]).select("trial", "loss", F.round("mean_score", 6).alias("mean_score"), "place", "best_of_loss")


@query("SELECT doc_id, 'm' || doc_id AS model, lang AS language, CASE WHEN doc_id % 2 = 0 THEN 'mixed_x' ELSE 'trad' END AS kind, CASE WHEN doc_id % 2 = 0 THEN '3' ELSE '5' END AS layers FROM documents")
def run_names(spark, sf):
    name = F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit("_"), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, "_mixed_x_3").otherwise("_trad"))
    p = trials.run_name_parts(name)
    return _t(spark, sf, "documents").select("doc_id", p["model"].alias("model"), p["language"].alias("language"), p["kind"].alias("kind"), p["layers"].alias("layers"))


@query("""WITH l AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS place, count(*) AS n, max(n_chars) AS m FROM documents WHERE lang IS NOT NULL GROUP BY lang),
g AS (SELECT lang, row_number() OVER (ORDER BY place, r, b, k) AS trial_id, [1e-5, 2e-5][r] AS learning_rate, [8, 16][b] AS batch, [n / 8.0, m / 4.0][k] AS scale FROM l, range(1, 3) x(r), range(1, 3) y(b), range(1, 3) z(k))
SELECT CAST(trial_id AS INTEGER) AS trial_id, lang AS loss, CAST(learning_rate AS DOUBLE) AS learning_rate, batch, CAST(scale AS DOUBLE) AS scale,
  printf('%03d_%s_lr', trial_id, lang) || format('{:g}', CAST(learning_rate AS DOUBLE)) || '_scale' || format('{:g}', CAST(scale AS DOUBLE)) || '_bs' || batch AS trial_name FROM g""")
def trial_grid_table(spark, sf):
    """A grid whose losses are the languages, and whose scales come from their numbers and lengths of documents."""
    per = _t(spark, sf, "documents").where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("m"))
    losses = {r["lang"]: {"scale": [r["n"] / 8, r["m"] / 4]} for r in per.orderBy("lang").collect()}  # a few languages
    grid = trials.trial_grid(spark, {"grid": {"learning_rate": [1e-5, 2e-5], "per_device_train_batch_size": [8, 16]}, "losses": losses})
    return grid.select("trial_id", "loss", "learning_rate", F.col("per_device_train_batch_size").alias("batch"), "scale", "trial_name")


@query("""WITH d AS (SELECT doc_id, 100 + n_chars % 900 AS evaluate, (100 + n_chars % 900) * (1 + doc_id % 4) AS save, CAST(8 * (1 + doc_id % 7) AS BIGINT) AS size FROM documents WHERE n_chars IS NOT NULL),
s AS (SELECT *, greatest(1, CAST(round_even(evaluate / CAST(size AS DOUBLE), 0) AS BIGINT)) AS steps FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS global_batch_size, CAST(steps AS BIGINT) AS eval_steps, CAST(steps * (save // evaluate) AS BIGINT) AS save_steps, CAST(steps * size AS BIGINT) AS effective_eval_examples, CAST(steps * (save // evaluate) * size AS BIGINT) AS effective_save_examples FROM s""")
def schedule_steps(spark, sf):
    docs = _t(spark, sf, "documents").where("n_chars is not null")
    evaluate = 100 + F.col("n_chars") % 900
    made = trials.example_schedule(evaluate * (1 + F.col("doc_id") % 4), evaluate, 1 + F.col("doc_id") % 7, F.lit(2), F.lit(4))
    return docs.select("doc_id", made.alias("s")).select("doc_id", "s.*")


@query("SELECT max(doc_id) AS number, 'out/m_' || max(doc_id) || '.jsonl' AS path FROM documents WHERE doc_id % 10 <> 9")
def latest_run_file(spark, sf):
    paths = _t(spark, sf, "documents").select(F.concat(F.lit("out/m_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 10 == 9, ".txt").otherwise(".jsonl")).alias("path"))
    return trials.latest_number(paths, "m_", ".jsonl")


# --- sources ---------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT *, CASE WHEN lag(source) OVER (ORDER BY doc_id) IS NOT DISTINCT FROM source THEN 0 ELSE 1 END AS new FROM documents), g AS (SELECT *, sum(new) OVER (ORDER BY doc_id) AS run FROM r) SELECT run, source, arg_max(doc_id, doc_id) AS doc_id, round(avg(n_chars), 6) AS n_chars FROM g GROUP BY run, source""")
def consecutive_means(spark, sf):
    d = _t(spark, sf, "documents").withColumn("text_id", F.col("doc_id"))
    return benchmarks.consecutive_means(d, "doc_id", "source", "text_id", ["n_chars"]).select("run", "source", F.col("text_id").alias("doc_id"), F.round("n_chars", 6).alias("n_chars"))


@query("SELECT a.item, 'ref1' AS reference, a.lang AS text, round(a.n, 6) AS naturalness, round(b.n, 6) AS quality FROM (SELECT doc_id // 3 AS item, arg_min(lang, doc_id) AS lang, avg(n_chars) AS n FROM documents GROUP BY 1) a JOIN (SELECT doc_id // 3 AS item, avg(n_chars % 7) AS n FROM documents GROUP BY 1) b USING (item)")
def rated_references(spark, sf):
    d = _t(spark, sf, "documents")
    out = benchmarks.rated_references(d.select("doc_id", F.col("lang").alias("ref1"), F.col("n_chars").alias("n")), d.select("doc_id", (F.col("n_chars") % 7).alias("q")), "doc_id", {"ref1": ("n", "q")})
    return out.select("item", "reference", "text", F.round("naturalness", 6).alias("naturalness"), F.round("quality", 6).alias("quality"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'not_a_number' WHEN 2 THEN 'aspects' ELSE 'volume' END AS fault FROM documents WHERE doc_id % 5 < 4""")
def metadata_faults(spark, sf):
    k = F.col("doc_id") % 5
    rows = _t(spark, sf, "documents").select("doc_id", F.when(k == 0, " ").otherwise(F.col("source")).alias("benchmark"), F.lit("a, b,").alias("aspect"), F.when(k == 1, "two").when(k == 2, "3").otherwise("2").alias("aspect_number"), F.lit("10").alias("raw_volume"), F.when(k == 3, "11").otherwise("10").alias("retained_volume"))
    return benchmarks.metadata_faults(rows).select("doc_id", "fault")


@query("SELECT CAST(conv_id AS VARCHAR) AS source_id, trim(max(text) FILTER (turn = 0)) AS preferred_text, trim(max(text) FILTER (turn = 1)) AS dispreferred_text FROM conversations WHERE turn < 2 GROUP BY conv_id HAVING trim(coalesce(max(text) FILTER (turn = 0), '')) <> '' AND trim(coalesce(max(text) FILTER (turn = 1), '')) <> ''")
def preference_pairs(spark, sf):
    c = _t(spark, sf, "conversations").where("turn < 2").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("b"))
    return benchmarks.pairs_of_columns(c, "conv_id", "a", "b")


@query("SELECT doc_id, l.text FROM (SELECT doc_id, 'f' || (doc_id % 3) AS f, doc_id % 20 + 1 AS line FROM documents WHERE doc_id % 3 < 2) d JOIN (SELECT 'f' || (doc_id // 20) AS f, doc_id % 20 + 1 AS line, lang || doc_id AS text FROM documents WHERE doc_id < 40) l USING (f, line)")
def line_lookup(spark, sf):
    d = _t(spark, sf, "documents")
    name = lambda x: F.concat(F.lit("f"), x.cast("string"))
    lines = d.where("doc_id < 40").select(name(F.expr("doc_id div 20")).alias("file"), (F.col("doc_id") % 20 + 1).alias("line"), F.concat("lang", F.col("doc_id").cast("string")).alias("value"))
    rows = d.select("doc_id", name(F.col("doc_id") % 3).alias("f"), (F.col("doc_id") % 20 + 1).alias("n"))
    return benchmarks.line_lookup(rows, lines, "f", "n").select("doc_id", "text")


@query("SELECT 's:' || conv_id || ':' || turn || ':' || a AS id, CAST(v AS DOUBLE) AS human_score FROM (SELECT conv_id, turn, text, 'length' AS a, length(text) AS v FROM conversations UNION ALL SELECT conv_id, turn, text, 'turn', turn FROM conversations) WHERE trim(coalesce(text, '')) <> ''")
def zipped_list_records(spark, sf):
    c = _t(spark, sf, "conversations").withColumn("t", F.coalesce("text", F.lit("")))
    packed = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "t"))).alias("p"))
    lists = packed.select("conv_id", F.transform("p", lambda x: x["t"]).alias("texts"), F.transform("p", lambda x: F.length(x["t"]).cast("double")).alias("length"), F.transform("p", lambda x: x["turn"].cast("double")).alias("turns"))
    return benchmarks.zipped_lists(lists, "conv_id", "texts", {"length": "length", "turn": "turns"}, "S", "s").select("id", "human_score")


@query("SELECT 'e:' || doc_id || ':' || s || ':' || a AS id, CAST(v AS DOUBLE) AS human_score FROM (SELECT doc_id, 'lang' AS s, lang AS t, 'long' AS a, n_chars AS v FROM documents UNION ALL SELECT doc_id, 'lang', lang, 'odd', doc_id % 2 FROM documents UNION ALL SELECT doc_id, 'source', source, 'long', n_chars FROM documents) WHERE trim(coalesce(t, '')) <> ''")
def wide_essay_records(spark, sf):
    d = _t(spark, sf, "documents").withColumn("odd", F.col("doc_id") % 2)
    return benchmarks.wide_essays(d, "doc_id", {"lang": {"long": "n_chars", "odd": "odd"}, "source": {"long": "n_chars"}}, "E", "e").select("id", "human_score")


@query("""WITH x AS (SELECT doc_id, lang AS s, unnest([source, lang, '', NULL]) AS c FROM documents) SELECT CAST(doc_id AS VARCHAR) AS source_id, trim(c) AS preferred_text, trim(s) AS dispreferred_text FROM x WHERE trim(coalesce(c, '')) <> '' AND trim(coalesce(s, '')) <> '' AND trim(c) <> trim(s)""")
def correction_preferences(spark, sf):
    d = _t(spark, sf, "documents").withColumn("fixes", F.array("source", "lang", F.lit(""), F.lit(None).cast("string")))
    return benchmarks.corrections(d, "doc_id", "lang", "fixes")


@query("SELECT CAST(doc_id AS VARCHAR) AS source_id, CASE doc_id % 3 WHEN 1 THEN source ELSE lang END AS preferred_text, CASE doc_id % 3 WHEN 1 THEN lang ELSE source END AS dispreferred_text, doc_id % 3 = 2 AS tie FROM documents")
def choice_preferences(spark, sf):
    pick = F.when(F.col("doc_id") % 3 == 0, "A is better").when(F.col("doc_id") % 3 == 1, " b wins").otherwise("Equally good")
    return benchmarks.choices(_t(spark, sf, "documents").withColumn("pick", pick), "doc_id", "lang", "source", "pick")


@query("SELECT CAST(doc_id AS VARCHAR) AS source_id, 'Once. ' || lang AS preferred_text, 'Once.!' AS dispreferred_text FROM documents WHERE trim(coalesce(lang, '')) <> ''")
def story_preferences(spark, sf):
    d = _t(spark, sf, "documents").where("trim(lang) != ''").withColumns({"c": F.lit("Once. "), "wrong": F.lit("!")})
    return benchmarks.stories(d, "doc_id", "c", "lang", "wrong")


@query("SELECT user_id AS segment, CAST(max(CASE WHEN event_type = 'view' THEN v END) AS DOUBLE) AS view, CAST(max(CASE WHEN event_type = 'click' THEN v END) AS DOUBLE) AS click FROM (SELECT user_id, event_type, round(-avg(value), 6) AS v FROM events GROUP BY 1, 2) GROUP BY user_id")
def score_matrix(spark, sf):
    e = benchmarks.negated(_t(spark, sf, "events"), "value")
    out = benchmarks.score_matrix(e, "event_type", "user_id", "value", ["view", "click"])
    return out.select(F.col("user_id").alias("segment"), F.round("view", 6).alias("view"), F.round("click", 6).alias("click"))


@query("SELECT DISTINCT lang AS name, 'better' AS value FROM documents WHERE lang IS NOT NULL")
def registered_scorers(spark, sf):
    from lamina.operators import scoring

    if "first-letter" not in scoring.SCORERS:
        scoring.register_scorer("first-letter", _length_scorer)
    d = _t(spark, sf, "documents").select(F.col("lang").alias("name"), F.col("lang").alias("text")).where("name is not null").distinct()
    out = scoring.distinct_scored(d, ["text"], scoring.scorer("first-letter"))
    return out.select("name", F.when(F.col("score_value") > 0, "better").alias("value"))
