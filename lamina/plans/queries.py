"""Queries over the shared tables, and the SQL that gives the same rows.

documents are originals, labels are scores, conversations are chains (turn 0 the original, each turn's
parent the turn before, roles as methods), events are a run log, benchmark a held-out set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import draws, edits, text
from lamina.operators import composing, importing, lineage, metrics, scoring, splitting
from lamina.sources import benchmarks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


def _h(*parts: str) -> str:
    return "CAST(('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 8)) AS BIGINT)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as chains of items."""
    c = _t(spark, sf, "conversations")
    ident = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    first = F.col("turn") == 0
    return c.select(
        F.lit("chat").alias("dataset_name"), F.col("conv_id").cast("string").alias("base_text_id"), ident(F.col("turn")).alias("candidate_id"), "text", F.col("turn").cast("int").alias("label"),
        F.when(first, "original").otherwise(F.col("role")).alias("method"), F.lit("run0").alias("run_id"), F.when(~first, ident(F.col("turn") - 1)).alias("parent_candidate_id"),
    )


_ITEMS = """items AS (SELECT 'chat' AS dataset_name, CAST(conv_id AS VARCHAR) AS base_text_id, conv_id || '-' || turn AS candidate_id, text, CAST(turn AS INTEGER) AS label,
  CASE WHEN turn = 0 THEN 'original' ELSE role END AS method, 'run0' AS run_id, CASE WHEN turn <> 0 THEN conv_id || '-' || (turn - 1) END AS parent_candidate_id FROM conversations)"""


# --- sources, identity and lineage -----------------------------------------------------------------


@query(f"SELECT CAST(doc_id AS VARCHAR) AS base_text_id, 'original__docs__base_' || doc_id AS candidate_id, {_norm('text')} AS text, CAST(len({_norm('text')}) AS INTEGER) AS n_chars FROM documents")
def originals_normalized(spark, sf):
    d = _t(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("base_text_id"), F.concat(F.lit("original__docs__base_"), F.col("doc_id").cast("string")).alias("candidate_id"), text.normalized("text").alias("text")).withColumn("n_chars", F.length("text"))


@query(f"WITH {_ITEMS} SELECT candidate_id, parent_candidate_id FROM items i WHERE label <> 2 AND parent_candidate_id IS NOT NULL AND parent_candidate_id NOT IN (SELECT candidate_id FROM items WHERE label <> 2)")
def lineage_orphans(spark, sf):
    return lineage.orphans(items(spark, sf).where("label != 2")).select("candidate_id", "parent_candidate_id")


@query(f"WITH RECURSIVE {_ITEMS}, r AS (SELECT candidate_id AS id, candidate_id AS root, 0 AS depth FROM items WHERE parent_candidate_id IS NULL UNION ALL SELECT i.candidate_id, r.root, r.depth + 1 FROM items i JOIN r ON i.parent_candidate_id = r.id) SELECT id, root, CAST(depth AS INTEGER) AS depth FROM r")
def lineage_depth(spark, sf):
    return lineage.depths(items(spark, sf))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return lineage.duplicates(_t(spark, sf, "events"), "user_id", "event_type")


@query(f"""WITH {_ITEMS}, c AS (SELECT candidate_id, CASE WHEN label % 5 = 4 THEN label ELSE label - 1 END AS source_layer, label AS target_layer, CASE WHEN label > 1 THEN method END AS source_method, CASE WHEN label = 3 THEN 'web' ELSE 'trad' END AS source, length(text) % 3 AS edits, label = 2 AS twice, text FROM items WHERE label > 0)
SELECT candidate_id, '[' || array_to_string(list_filter([CASE WHEN NOT (source_layer >= 0 AND target_layer > source_layer) THEN 'layer_order' END, CASE WHEN (source_layer = 0) <> (source_method IS NULL) THEN 'source_given' END, CASE WHEN source = 'web' THEN 'known_source' END, CASE WHEN edits <> 2 THEN 'edit_count' END, CASE WHEN twice THEN 'distinct_dimensions' END, CASE WHEN length(text) = 0 THEN 'text' END], lambda x: x IS NOT NULL), ', ') || ']' AS broken FROM c""")
def rule_violations(spark, sf):
    label = F.col("label")
    c = items(spark, sf).where("label > 0").select("candidate_id", F.when(label % 5 == 4, label).otherwise(label - 1).alias("source_layer"), label.alias("target_layer"), F.when(label > 1, F.col("method")).alias("source_method"), F.when(label == 3, "web").otherwise("trad").alias("perturbation_source"), (F.length("text") % 3).alias("edit_count"), F.array(F.lit("a"), F.lit("b")).alias("perturbation_edits"), F.when(label == 2, F.array(F.lit("x"), F.lit("x"))).otherwise(F.array(F.lit("x"))).alias("target_dimensions"), "text")
    out = lineage.coded(c, lineage.candidate_rules())
    return out.select("candidate_id", F.concat(F.lit("["), F.array_join("violations", ", "), F.lit("]")).alias("broken"))


@query("SELECT l.doc_id, 'left' AS side FROM (SELECT DISTINCT doc_id FROM documents) l ANTI JOIN labels USING (doc_id) UNION ALL SELECT l.doc_id, 'right' FROM (SELECT DISTINCT doc_id FROM labels) l ANTI JOIN documents USING (doc_id)")
def id_set_differences(spark, sf):
    return lineage.same_ids(_t(spark, sf, "documents"), _t(spark, sf, "labels"), "doc_id")


# --- selection, splits, features -------------------------------------------------------------------


@query(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY {_norm('text')} ORDER BY CAST(doc_id AS VARCHAR)) AS k FROM documents) WHERE k = 1")
def exact_dedup_keep_first(spark, sf):
    return splitting.keep_first(_t(spark, sf, "documents"), "doc_id").select("doc_id", "source")


@query(f"SELECT a.doc_id, b.doc_id AS base_doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id - a.doc_id % 10 WHERE {_norm('a.text')} = {_norm('b.text')}")
def noop_candidates(spark, sf):
    d = _t(spark, sf, "documents")
    cand = d.select("doc_id", (F.col("doc_id") - F.col("doc_id") % 10).alias("base_doc_id"), "text")
    return splitting.unchanged(cand, d.select(F.col("doc_id").alias("base_doc_id"), "text"), "base_doc_id").select("doc_id", "base_doc_id")


@query("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def complete_case(spark, sf):
    e = _t(spark, sf, "events")
    return splitting.complete_groups(e, "event_type", "user_id")


@query("SELECT doc_id, CAST(least(9, floor(i * 10 / n)) AS INTEGER) AS bucket FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)")
def length_buckets_10(spark, sf):
    return splitting.length_buckets(_t(spark, sf, "documents"), "doc_id", F.col("n_chars")).select("doc_id", "bucket")


@query("SELECT doc_id, CAST(floor((i * 7 - 1) / n) AS INTEGER) AS bin FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS i, count(*) OVER () AS n FROM documents)")
def quantile_bins_equal_count(spark, sf):
    return metrics.equal_count_bins(_t(spark, sf, "documents"), [F.col("n_chars"), F.col("doc_id")], 7).select("doc_id", "bin")


@query(f"WITH d AS (SELECT doc_id, {_h(chr(39) + '42' + chr(39), chr(39) + 'split' + chr(39), 'doc_id')} % 10 AS h FROM documents) SELECT doc_id, CASE WHEN h < 8 THEN 'train' WHEN h < 9 THEN 'dev' ELSE 'test' END AS split FROM d")
def split_assign_hash(spark, sf):
    return splitting.hash_split(_t(spark, sf, "documents"), "doc_id", {"train": 8, "dev": 1, "test": 1}).select("doc_id", "split")


@query("SELECT source, count(DISTINCT lang) AS n_splits FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def split_leakage(spark, sf):
    return lineage.leaks(_t(spark, sf, "documents"), ["source"], "lang")


@query("""WITH f AS (SELECT doc_id, 'lang:' || lang AS feature FROM documents UNION ALL SELECT doc_id, 'source:' || source FROM documents UNION ALL SELECT doc_id, 'size:' || CAST(least(n_chars // 1000, 9) AS BIGINT) FROM documents),
t AS (SELECT feature, count(*) AS total FROM f GROUP BY feature) SELECT doc_id, round(sum(CASE WHEN feature LIKE 'source:%' THEN 0.25 ELSE 1.0 END / total), 9) AS rarity FROM f JOIN t USING (feature) GROUP BY doc_id""")
def feature_rarity(spark, sf):
    d = _t(spark, sf, "documents")
    kinds = F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"), F.concat(F.lit("size:"), F.least(F.floor(F.col("n_chars") / 1000), F.lit(9)).cast("string")))
    rows = d.select("doc_id", F.explode(kinds).alias("feature"), F.lit(1).alias("n"))
    out = splitting.rarity(rows, "doc_id", F.when(F.col("feature").startswith("source:"), 0.25).otherwise(1.0))
    return out.withColumn("rarity", F.round("rarity", 9))


@query("""WITH a AS (SELECT doc_id, lang, md5('42:stratum:' || doc_id) AS draw FROM documents), b AS (SELECT *, row_number() OVER (ORDER BY lang, draw, doc_id) - 1 AS i FROM a),
c AS (SELECT *, row_number() OVER (ORDER BY (CAST(i AS DOUBLE) * 0.6180339887498949) - floor(CAST(i AS DOUBLE) * 0.6180339887498949), i) - 1 AS k FROM b)
SELECT doc_id, CASE WHEN k < 100 THEN 'train' WHEN k < 130 THEN 'dev' WHEN k < 160 THEN 'test' ELSE 'excluded' END AS split FROM c""")
def split_stratified(spark, sf):
    return splitting.stratified_split(_t(spark, sf, "documents"), "doc_id", F.col("lang"), {"train": 100, "dev": 30, "test": 30}).select("doc_id", "split")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:dev:' || doc_id), doc_id) - 1 < greatest(1, round_even(count(*) OVER () * 0.05, 0)) THEN 'dev' ELSE 'train' END AS split FROM documents")
def train_dev_split(spark, sf):
    return splitting.train_dev(_t(spark, sf, "documents"), "doc_id", 0.05).select("doc_id", "split")


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def seeded_subset(spark, sf):
    return splitting.hash_limit(_t(spark, sf, "documents"), "doc_id", 50).select("doc_id")


# --- import, audit, reports ------------------------------------------------------------------------

_ANSWER = """CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 11 = 1 THEN '{"decision": "PASS"' WHEN event_id % 11 = 2 THEN '{"decision": "PASS", "passes": "true"}' WHEN event_id % 11 = 3 THEN '{"decision": "PASS", "passes": false}'
 WHEN value >= 50 THEN '{"decision": "PASS", "passes": true}' ELSE '{"decision": "FAIL", "passes": false}' END"""


@query(f"""WITH a AS (SELECT event_type, event_id % 11 AS r, value, {_ANSWER} AS answer FROM events), s AS (SELECT event_type, CASE WHEN answer IS NULL THEN 'missing' WHEN r IN (1, 2) THEN 'malformed' WHEN r = 3 THEN 'inconsistent' WHEN value >= 50 THEN 'passed' ELSE 'failed' END AS status FROM a),
k AS (SELECT DISTINCT event_type, u.status FROM events, (SELECT unnest(['passed', 'failed', 'missing', 'malformed', 'inconsistent']) AS status) u)
SELECT k.event_type, k.status, count(s.status) AS n FROM k LEFT JOIN s ON s.event_type = k.event_type AND s.status = k.status GROUP BY ALL""")
def import_funnel_counts(spark, sf):
    return importing.funnel(_t(spark, sf, "events").withColumn("answer", F.expr(_ANSWER)), "answer", ["event_type"])


@query("""SELECT lang, 'source' AS feature, source AS value, count(*) AS n FROM documents GROUP BY lang, source UNION ALL SELECT lang, 'quality', CAST(quality AS VARCHAR), count(*) FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality""")
def workflow_distribution(spark, sf):
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left")
    return importing.distribution(d, ["lang"], {"source": "source", "quality": "quality"})


@query("SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean_chars, round(quantile_cont(length(text), 0.1), 6) AS p10, round(quantile_cont(length(text), 0.9), 6) AS p90 FROM documents GROUP BY lang")
def length_report(spark, sf):
    return importing.length_report(_t(spark, sf, "documents"), ["lang"]).withColumns({c: F.round(c, 6) for c in ("mean_chars", "p10", "p90")})


@query("""WITH r AS (SELECT text AS src, CASE WHEN turn % 2 = 0 THEN 'Yes' ELSE 'No' END AS tgt FROM conversations), s AS (SELECT src, count(*) AS n, count(DISTINCT tgt) AS k FROM r GROUP BY src)
SELECT (SELECT count(*) FROM r) AS n_rows, (SELECT count(*) FROM r WHERE tgt = 'Yes') AS n_yes, (SELECT count(*) FROM r WHERE tgt = 'No') AS n_no, count(*) AS n_sources, CAST(sum(k) AS BIGINT) AS n_examples, count(*) FILTER (k > 1) AS n_conflicting,
(SELECT round(avg(length(src)), 6) FROM r) AS mean_chars, CAST(max(length(src)) AS INTEGER) AS max_chars FROM s""")
def labelled_audit(spark, sf):
    c = _t(spark, sf, "conversations").select(F.col("text").alias("src"), F.when(F.col("turn") % 2 == 0, "Yes").otherwise("No").alias("tgt"))
    return importing.labelled_audit(c, "src", "tgt").withColumn("mean_chars", F.round("mean_chars", 6)).drop("rows_hash")


_JUDGED = """CASE turn WHEN 0 THEN '{"score": ' || (conv_id % 7) || '}' WHEN 1 THEN '```json' || chr(10) || '{"score": 3.5, "why": "x"}' || chr(10) || '```' WHEN 2 THEN '<think>score: 1</think> Score: 4' WHEN 3 THEN 'I say {"score": "2"} here' WHEN 4 THEN 'nothing' ELSE 'score = 9.25 of 10' END"""


@query("SELECT conv_id, turn, CAST(CASE turn WHEN 0 THEN least(5, greatest(1, conv_id % 7)) WHEN 1 THEN 3.5 WHEN 2 THEN 4 WHEN 3 THEN 2 WHEN 4 THEN NULL ELSE 5 END AS DOUBLE) AS score FROM conversations")
def judge_score_parse(spark, sf):
    return _t(spark, sf, "conversations").withColumn("raw", F.expr(_JUDGED.replace("||", "||"))).select("conv_id", "turn", text.judge_score("raw").alias("score"))


_ANSWERED = """CASE turn WHEN 0 THEN 'maybe yes' || chr(10) || 'No.' WHEN 1 THEN '<think>No</think>Yes' WHEN 2 THEN 'it is YES, I think' WHEN 3 THEN '' WHEN 4 THEN 'noyes' ELSE 'yes' || chr(10) || 'no or yes or NO' END"""


@query("SELECT conv_id, turn, CASE turn WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' WHEN 2 THEN 'Yes' WHEN 3 THEN 'INVALID' WHEN 4 THEN 'INVALID' ELSE 'No' END AS answer FROM conversations")
def yes_no_parse(spark, sf):
    return _t(spark, sf, "conversations").withColumn("raw", F.expr(_ANSWERED)).select("conv_id", "turn", text.yes_no("raw").alias("answer"))


@query("SELECT page_id, left(CASE WHEN s = '' THEN 'value' ELSE s END, 40) AS slug FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS s FROM pages)")
def url_slugs(spark, sf):
    return _t(spark, sf, "pages").select("page_id", text.slug("url").alias("slug"))


@query("SELECT doc_id, CAST(least(5, greatest(1, length(text) // 500)) AS INTEGER) AS edits, CAST(len(list_filter(string_split_regex(text, '" + _WS + "'), lambda x: x <> '')) AS INTEGER) AS n_tokens FROM documents")
def edit_budgets(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.edit_budget("text").alias("edits"), text.token_count("text").alias("n_tokens"))


# --- damaged texts ---------------------------------------------------------------------------------

_CUTS = edits._POISSON
_SPAN = lambda key: "CASE " + " ".join(f"WHEN {_h(key, 'doc_id')} % 1000000 < {c} THEN {i}" for i, c in enumerate(_CUTS)) + f" ELSE {len(_CUTS)} END"
_TOK = f"WITH d AS (SELECT doc_id, list_filter(string_split_regex(text, '{_WS}'), lambda x: x <> '') AS w FROM documents), n AS (SELECT *, len(w) AS n FROM d)"


@query(f"""{_TOK}, s AS (SELECT *, least(n, greatest(1, {_SPAN("'deletion-length'")})) AS k FROM n), t AS (SELECT *, {_h("'deletion-start'", 'doc_id')} % greatest(n - k + 1, 1) AS a FROM s)
SELECT doc_id, CASE WHEN n > k AND n > 1 THEN array_to_string(list_concat(w[1:a], w[a + k + 1:]), ' ') END AS text FROM t""")
def deletion_layer(spark, sf):
    return edits.edited(_t(spark, sf, "documents"), "deletion", F.col("doc_id")).select("doc_id", F.col("edited").alias("text"))


@query(f"""{_TOK}, s AS (SELECT *, least(n, greatest(1, {_SPAN("'repetition-length'")})) AS k FROM n), t AS (SELECT *, {_h("'repetition-source'", 'doc_id')} % greatest(n - k + 1, 1) AS b, {_h("'repetition-start'", 'doc_id')} % greatest(n, 1) AS a FROM s)
SELECT doc_id, CASE WHEN n > 0 THEN array_to_string(list_concat(list_concat(w[1:a], w[b + 1:b + k]), w[a + 1:]), ' ') END AS text FROM t""")
def repetition_layer(spark, sf):
    return edits.edited(_t(spark, sf, "documents"), "repetition", F.col("doc_id")).select("doc_id", F.col("edited").alias("text"))


@query(f"""{_TOK}, t AS (SELECT *, {_h("'swap'", 'doc_id')} % greatest(n - 1, 1) AS a FROM n), o AS (SELECT doc_id, array_to_string(w, ' ') AS was, CASE WHEN n > 1 THEN array_to_string(list_concat(list_concat(w[1:a], [w[a + 2], w[a + 1]]), w[a + 3:]), ' ') END AS text FROM t)
SELECT doc_id, CASE WHEN text <> was THEN text END AS text FROM o""")
def swap_layer(spark, sf):
    return edits.edited(_t(spark, sf, "documents"), "swap", F.col("doc_id")).select("doc_id", F.col("edited").alias("text"))


@query(f"""{_TOK}, s AS (SELECT *, least(n, greatest(2, {_SPAN("'shuffle-length'")})) AS k FROM n), t AS (SELECT *, {_h("'shuffle-start'", 'doc_id')} % greatest(n - k + 1, 1) AS a FROM s),
o AS (SELECT doc_id, n, array_to_string(w, ' ') AS was, array_to_string(list_concat(list_concat(w[1:a], list_transform(list_sort(list_transform(w[a + 1:a + k], lambda x, i: {{'k': md5('shuffle:' || (i - 1) || ':' || doc_id), 'w': x}})), lambda x: x.w)), w[a + k + 1:]), ' ') AS text FROM t)
SELECT doc_id, CASE WHEN n > 1 AND text <> was THEN text END AS text FROM o""")
def shuffle_layer(spark, sf):
    return edits.edited(_t(spark, sf, "documents"), "shuffle", F.col("doc_id")).select("doc_id", F.col("edited").alias("text"))


@query(f"""{_TOK}, l AS (SELECT *, list_filter(range(1, n + 1), lambda i: regexp_matches(w[i], '\\p{{L}}{{4}}')) AS l FROM n), p AS (SELECT *, l[{_h("'typo-word'", 'doc_id')} % greatest(len(l), 1) + 1] AS i FROM l), q AS (SELECT *, w[i] AS x, {_h("'typo-kind'", 'doc_id')} % 3 AS kind FROM p),
r AS (SELECT *, {_h("'typo-place'", 'doc_id')} % greatest(length(x) - 1, 1) + 1 AS a FROM q), c AS (SELECT *, CASE kind WHEN 0 THEN substring(x, 1, a - 1) || substring(x, a + 1) WHEN 1 THEN substring(x, 1, a) || substring(x, a, 1) || substring(x, a + 1) ELSE substring(x, 1, a - 1) || substring(x, a + 1, 1) || substring(x, a, 1) || substring(x, a + 2) END AS y FROM r)
SELECT doc_id, CASE WHEN len(l) > 0 AND x <> y THEN array_to_string(list_concat(list_concat(w[1:i - 1], [y]), w[i + 1:]), ' ') END AS text FROM c""")
def typo_layer(spark, sf):
    return edits.edited(_t(spark, sf, "documents"), "typo", F.col("doc_id")).select("doc_id", F.col("edited").alias("text"))


# --- chains and pairs ------------------------------------------------------------------------------


@query(f"""WITH {_ITEMS}, m AS (SELECT base_text_id, method, count(*) AS n FROM items WHERE method <> 'original' GROUP BY ALL), q AS (SELECT base_text_id, min(n) AS quota FROM m GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY base_text_id, method ORDER BY md5('42:chat:' || base_text_id || ':' || candidate_id), candidate_id) AS k FROM items WHERE method <> 'original')
SELECT candidate_id, method, label FROM items WHERE method = 'original' UNION ALL SELECT candidate_id, method, label FROM k JOIN q USING (base_text_id) WHERE k <= quota""")
def compose_balanced(spark, sf):
    return composing.compose(items(spark, sf), "balanced").select("candidate_id", "method", "label")


@query(f"""WITH {_ITEMS}, k AS (SELECT *, row_number() OVER (PARTITION BY base_text_id, method ORDER BY md5('42:chat:' || base_text_id || ':' || candidate_id), candidate_id) AS k FROM items WHERE method <> 'original')
SELECT candidate_id, method, label FROM items WHERE method = 'original' UNION ALL SELECT candidate_id, method, label FROM k WHERE k <= 1""")
def compose_fixed(spark, sf):
    return composing.compose(items(spark, sf), "fixed_per_source", per_source=1).select("candidate_id", "method", "label")


@query(f"""WITH {_ITEMS}, c AS (SELECT *, -ln(({_h("'42'", "'chat'", 'base_text_id', 'candidate_id')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / (CASE method WHEN 'user' THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END) AS clock FROM items WHERE method IN ('user', 'assistant')),
n AS (SELECT base_text_id, count(DISTINCT method) AS most FROM items WHERE method <> 'original' GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY base_text_id ORDER BY clock, candidate_id) AS k FROM c)
SELECT candidate_id, method, label FROM items WHERE method = 'original' UNION ALL SELECT candidate_id, method, label FROM k JOIN n USING (base_text_id) WHERE k <= most""")
def compose_weighted(spark, sf):
    return composing.compose(items(spark, sf), "weighted", {"user": 1.0, "assistant": 3.0}, 1).select("candidate_id", "method", "label")


@query(f"""WITH {_ITEMS}, m AS (SELECT DISTINCT base_text_id, method, -ln(({_h("'42'", "'chat'", 'base_text_id', 'method')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE) AS clock FROM items WHERE method <> 'original'),
o AS (SELECT base_text_id, arg_min(method, clock) AS method FROM m GROUP BY 1)
SELECT candidate_id, method, label FROM items WHERE method = 'original' UNION ALL SELECT candidate_id, i.method, label FROM items i JOIN o ON i.base_text_id = o.base_text_id AND i.method = o.method""")
def compose_exclusive(spark, sf):
    return composing.compose(items(spark, sf), "source_exclusive").select("candidate_id", "method", "label")


@query(f"WITH {_ITEMS} SELECT a.candidate_id AS left_candidate_id, b.candidate_id AS right_candidate_id FROM items a JOIN items b ON a.base_text_id = b.base_text_id AND b.parent_candidate_id = a.candidate_id")
def pairs_parent_child(spark, sf):
    return composing.parent_child_pairs(items(spark, sf)).select("left_candidate_id", "right_candidate_id")


_FLAT = """SELECT a.base_text_id || '__' || a.candidate_id || '__' || b.candidate_id AS pair_id, a.base_text_id AS source_id, a.dataset_name, a.candidate_id AS chosen_id, b.candidate_id AS rejected_id, a.text AS chosen_text, b.text AS rejected_text,
 a.label AS chosen_layer, b.label AS rejected_layer, CAST(b.label - a.label AS DOUBLE) AS weight FROM items a JOIN items b ON a.base_text_id = b.base_text_id"""


@query(f"WITH {_ITEMS} {_FLAT} AND a.method = 'original' AND b.method <> 'original'")
def pairs_original_only(spark, sf):
    return composing.pairwise_rows(composing.original_pairs(items(spark, sf)))


@query(f"WITH {_ITEMS} {_FLAT} AND a.label < b.label")
def pairs_all_unequal(spark, sf):
    return composing.pairwise_rows(composing.unequal_pairs(items(spark, sf)))


@query()
def pairs_cross_source(spark, sf):
    return composing.cross_source_pairs(items(spark, sf)).select("left_candidate_id", "right_candidate_id", "left_label", "right_label")


@query(f"WITH {_ITEMS} SELECT candidate_id, text, label AS layer, CASE WHEN method = 'original' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM items")
def flatten_binary(spark, sf):
    return composing.binary_rows(items(spark, sf)).select("candidate_id", "text", "layer", "label")


@query("SELECT doc_id, CAST(quality AS DOUBLE) AS label, 0 AS layer FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def flatten_regression(spark, sf):
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left").withColumn("label", F.lit(0))
    return composing.regression_rows(d, "quality").select("doc_id", "label", "layer")


@query(f"WITH d AS (SELECT doc_id, n_chars, {_h(chr(39) + '42' + chr(39), chr(39) + 'split' + chr(39), 'doc_id')} % 10 < 8 AS train FROM documents), l AS (SELECT min(n_chars) AS a, max(n_chars) AS b FROM d WHERE train) SELECT doc_id, round((n_chars - a) / (b - a), 9) AS scaled FROM d, l")
def minmax_train_scaled(spark, sf):
    d = splitting.hash_split(_t(spark, sf, "documents"), "doc_id", {"train": 8, "dev": 1, "test": 1})
    return composing.min_max(d, "n_chars", F.col("split") == "train").select("doc_id", F.round("scaled", 9).alias("scaled"))


@query(f"WITH {_ITEMS} SELECT base_text_id, string_agg(candidate_id, ',' ORDER BY label, method, run_id, candidate_id) AS candidates, CAST(count(*) AS INTEGER) AS n FROM items GROUP BY 1")
def grouped_chains(spark, sf):
    return composing.chain_arrays(items(spark, sf)).select("base_text_id", F.array_join("candidate_ids", ",").alias("candidates"), F.size("labels").alias("n"))


# --- scores ----------------------------------------------------------------------------------------


def _scores(spark, sf):
    s = _t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("candidate_id"), F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return s.unpivot("candidate_id", ["quality", "toxic"], "scoring_method", "score_value")


@query("SELECT CAST(d.doc_id AS VARCHAR) AS candidate_id, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def score_attach(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("candidate_id"))
    return scoring.attach(d, _scores(spark, sf), ["quality", "toxic"])


@query("SELECT CAST(doc_id AS VARCHAR) AS candidate_id, m AS scoring_method, CAST(2 AS BIGINT) AS n FROM labels, (SELECT unnest(['quality', 'toxic']) AS m)")
def score_dup_violation(spark, sf):
    s = _scores(spark, sf)
    return scoring.repeated_scores(s.unionByName(s), s.select("candidate_id"))


@query("SELECT DISTINCT d.source, d.doc_id FROM documents d WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def eligible_sources(spark, sf):
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels").where("toxic = 1"), "doc_id", "left")
    return scoring.eligible_chains(d, ["toxic"], ["source"]).select("source", "doc_id")


@query(f"""WITH {_ITEMS} SELECT i.candidate_id, CASE WHEN i.label = 1 THEN 'original__chat__base_' || i.base_text_id ELSE i.parent_candidate_id END AS reference_candidate_id, p.text AS reference_text
FROM items i JOIN items p ON p.candidate_id = i.parent_candidate_id WHERE i.label > 0""")
def score_tasks_parent(spark, sf):
    i = items(spark, sf)
    cand = i.where("label > 0").withColumn("source_layer", F.col("label") - 1)
    return scoring.tasks(cand, i.where("label = 0"), "parent").select("candidate_id", "reference_candidate_id", "reference_text")


def _length_scorer(rows):
    return rows["text"].str.len().astype(float)


@query("SELECT doc_id, CAST(length(text) AS DOUBLE) AS score_value FROM documents")
def score_dedupe_fanout(spark, sf):
    return scoring.distinct_scored(_t(spark, sf, "documents").select("doc_id", "text"), ["text"], _length_scorer).select("doc_id", "score_value")


def _picky_scorer(rows):
    if (rows["doc_id"] % 97 == 0).any():
        raise ValueError("no score for this row")
    return rows["n_chars"].astype(float)


@query("SELECT doc_id, CASE WHEN doc_id % 97 <> 0 THEN CAST(n_chars AS DOUBLE) END AS score_value, CASE WHEN doc_id % 97 = 0 THEN 'ValueError' END AS error_type, CASE WHEN doc_id % 97 = 0 THEN 'no score for this row' END AS error_message FROM documents")
def score_failure_isolation(spark, sf):
    return scoring.scored(_t(spark, sf, "documents").select("doc_id", "n_chars"), _picky_scorer, "doc_id")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def retry_pending(spark, sf):
    return scoring.pending(_t(spark, sf, "documents"), _t(spark, sf, "labels"), "doc_id").select("doc_id")


@query("SELECT d.doc_id, 'missing' AS fault FROM documents d ANTI JOIN labels l USING (doc_id) UNION ALL SELECT doc_id, 'repeated' FROM labels WHERE toxic = 1")
def coverage_faults(spark, sf):
    s = _t(spark, sf, "labels")
    return scoring.coverage_faults(_t(spark, sf, "documents"), s, s.where("toxic = 1"), "doc_id")


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 100 AS INTEGER) AS chunk FROM (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang)")
def chunked_requests(spark, sf):
    return scoring.chunks(_t(spark, sf, "documents"), ["text", "lang"], 100, "doc_id").select("doc_id", "chunk")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def latest_per_key(spark, sf):
    return scoring.latest(_t(spark, sf, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "ts")


@query(f"""WITH {_ITEMS} SELECT 'new-' || candidate_id AS candidate_id, 'new-' || parent_candidate_id AS parent_candidate_id FROM items""")
def export_rekey(spark, sf):
    i = items(spark, sf)
    mapping = i.select(F.col("candidate_id").alias("old"), F.concat(F.lit("new-"), "candidate_id").alias("new"))
    return scoring.rekeyed(i.select("candidate_id", "parent_candidate_id"), mapping, ["candidate_id", "parent_candidate_id"])


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type <> 'error' AND value > 20 AS ok, value FROM events) SELECT user_id, bool_or(ok) AS ok, arg_max(event_id, (ok, ts, event_id)) AS event_id, count(*) AS n_attempts FROM e GROUP BY user_id""")
def journal_fold(spark, sf):
    from lamina.streaming.journal import folded

    e = _t(spark, sf, "events").select("user_id", "ts", "event_id", ((F.col("event_type") != "error") & (F.col("value") > 20)).alias("ok"))
    return folded(e, ["user_id"], ["ts", "event_id"], "ok").select("user_id", "ok", "event_id", "n_attempts")


@query("""WITH s AS (SELECT * FROM (VALUES (0, 'secure', 'web', 'https://www'), (1, 'blog', 'web', 'https'), (2, 'plain', 'web', 'http')) t(ordinal, spec, benchmark, a)), p AS (SELECT page_id, split_part(url, '.', 1) AS aspect FROM pages),
h AS (SELECT page_id, spec, ordinal FROM p, s WHERE trim(split_part(aspect, ':', 1)) = a OR trim(split_part(aspect, ':', 1)) LIKE a || ' %' OR trim(split_part(aspect, ':', 1)) LIKE a || '(%')
SELECT page_id, arg_min(spec, ordinal) AS spec FROM h GROUP BY page_id""")
def spec_first_match(spark, sf):
    p = _t(spark, sf, "pages").select("page_id", F.lit("web").alias("benchmark"), F.split_part("url", F.lit("."), F.lit(1)).alias("aspect"))
    specs = spark.createDataFrame([(0, "secure", "web", "https://www"), (1, "blog", "web", "https"), (2, "plain", "web", "http")], "ordinal int, name string, benchmark string, aspect string")
    return scoring.first_spec(p, specs, "page_id").select("page_id", "spec")


# --- statistics ------------------------------------------------------------------------------------


def _labelled(spark, sf):
    return _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id")


@query("""WITH r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY quality) + (count(*) OVER (PARTITION BY lang, quality) - 1) / 2 AS a, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS b FROM documents JOIN labels USING (doc_id))
SELECT lang, count(*) AS n, round(CASE WHEN stddev_pop(a) * stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END, 9) AS spearman FROM r GROUP BY lang""")
def spearman_by_lang(spark, sf):
    return metrics.spearman(_labelled(spark, sf), ["lang"], "quality", "n_chars").withColumn("spearman", F.round("spearman", 9))


@query("""WITH d AS (SELECT doc_id, lang, quality AS x, n_chars AS y FROM documents JOIN labels USING (doc_id)), p AS (SELECT a.lang, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM d a JOIN d b ON a.lang = b.lang AND a.doc_id < b.doc_id),
s AS (SELECT lang, sum(sx * sy) AS c, sum(abs(sx)) AS nx, sum(abs(sy)) AS ny FROM p GROUP BY lang) SELECT lang, (SELECT count(*) FROM d WHERE d.lang = s.lang) AS n, round(CASE WHEN nx * ny > 0 THEN c / (sqrt(nx) * sqrt(ny)) END, 9) AS kendall FROM s""")
def kendall_by_lang(spark, sf):
    return metrics.kendall(_labelled(spark, sf), ["lang"], "quality", "n_chars").withColumn("kendall", F.round("kendall", 9))


@query(f"""WITH {_ITEMS}, p AS (SELECT a.base_text_id, length(a.text) - length(b.text) AS d, a.label % 2 = b.label % 2 AS tie FROM items a JOIN items b ON a.base_text_id = b.base_text_id AND a.method = 'original' AND b.method <> 'original')
SELECT count(*) AS n, round(avg(CASE WHEN d > 0 AND NOT tie THEN 1.0 ELSE 0.0 END), 9) AS strict_accuracy, round(avg(CASE WHEN d > 0 AND NOT tie THEN 1.0 ELSE 0.0 END + CASE WHEN tie OR d = 0 THEN 0.5 ELSE 0 END), 9) AS tie_aware_accuracy, round(avg(CASE WHEN tie OR d = 0 THEN 1.0 ELSE 0.0 END), 9) AS tie_rate, round(avg(d), 9) AS mean_delta, round(median(d), 9) AS median_delta FROM p""")
def preference_metrics(spark, sf):
    p = composing.original_pairs(items(spark, sf)).select(F.length("left_text").alias("a"), F.length("right_text").alias("b"), (F.col("left_label") % 2 == F.col("right_label") % 2).alias("tie"))
    out = metrics.preference(p, [], "a", "b", "tie")
    return out.select("n", *[F.round(c, 9).alias(c) for c in out.columns if c != "n"])


@query(f"""WITH {_ITEMS}, p AS (SELECT b.method, length(a.text) / 100.0::DOUBLE - length(b.text) / 100.0::DOUBLE AS d FROM items a JOIN items b ON a.base_text_id = b.base_text_id AND a.label < b.label)
SELECT method, count(*) AS n, round(avg(CASE WHEN abs(d) <= 1e-6 THEN 0.5::DOUBLE WHEN d > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy, round(avg(CASE WHEN abs(d) <= 1e-6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS tie_rate FROM p GROUP BY method""")
def pairwise_accuracy_tol(spark, sf):
    p = composing.unequal_pairs(items(spark, sf)).select(F.col("right_method").alias("method"), (F.length("left_text") / 100.0).alias("a"), (F.length("right_text") / 100.0).alias("b"))
    return metrics.pairwise_accuracy(p, ["method"], "a", "b").select("method", "n", F.round("accuracy", 9).alias("accuracy"), F.round("tie_rate", 9).alias("tie_rate"))


@query("""WITH d AS (SELECT lang, CAST(quality AS DOUBLE) AS t, n_chars / 10000.0::DOUBLE AS p FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY t) + (count(*) OVER (PARTITION BY lang, t) - 1) / 2 AS a, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2 AS b FROM d)
SELECT lang, count(*) AS n, round(avg(abs(t - p)), 9) AS mae, round(sqrt(avg((t - p) * (t - p))), 9) AS rmse, round(coalesce(CASE WHEN stddev_pop(t) * stddev_pop(p) > 0 THEN covar_pop(t, p) / (stddev_pop(t) * stddev_pop(p)) END, 0), 9) AS pearson, round(coalesce(CASE WHEN stddev_pop(a) * stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END, 0), 9) AS spearman FROM r GROUP BY lang""")
def regression_metrics(spark, sf):
    d = _labelled(spark, sf).select("lang", F.col("quality").cast("double").alias("t"), (F.col("n_chars") / 10000.0).alias("p"))
    out = metrics.regression(d, ["lang"], "t", "p")
    return out.select("lang", "n", *[F.round(c, 9).alias(c) for c in ("mae", "rmse", "pearson", "spearman")])


@query("SELECT lang, count(*) AS n, round(avg(CASE WHEN (n_chars >= 1000) = (quality >= 0.5) THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def binary_accuracy(spark, sf):
    return metrics.binary_accuracy(_labelled(spark, sf).withColumn("logit", F.col("n_chars") - 1000), ["lang"], "quality", "logit").withColumn("accuracy", F.round("accuracy", 9))


_DIMS = """d AS (SELECT lang || ' ' || source AS name, lang AS task_family, CASE WHEN source IN ('src1', 'src2') THEN ['fluency', 'clear text'] ELSE ['fluency'] END AS categories, CASE WHEN source = 'src3' THEN NULL ELSE avg(n_chars) END AS metric FROM documents GROUP BY lang, source)"""


@query(f"""WITH {_DIMS}, t AS (SELECT 'task' AS level, task_family AS name, avg(metric) AS value, count(*) AS n_dimensions FROM d GROUP BY 2), c AS (SELECT 'category' AS level, replace(name, ' ', '_') AS name, avg(metric) AS value, count(*) AS n_dimensions FROM (SELECT unnest(categories) AS name, metric FROM d) GROUP BY 2)
SELECT level, name, round(value, 6) AS value, n_dimensions FROM t UNION ALL SELECT level, name, round(value, 6), n_dimensions FROM c UNION ALL SELECT 'overall', 'overall', round(avg(value), 6), (SELECT count(*) FROM d) FROM c""")
def macro_aggregate(spark, sf):
    d = _t(spark, sf, "documents").groupBy("lang", "source").agg(F.avg("n_chars").alias("m"))
    cats = F.when(F.col("source").isin("src1", "src2"), F.array(F.lit("fluency"), F.lit("clear text"))).otherwise(F.array(F.lit("fluency")))
    d = d.select(F.col("lang").alias("task_family"), cats.alias("categories"), F.when(F.col("source") == "src3", F.lit("nan").cast("double")).otherwise(F.col("m")).alias("metric"))
    return metrics.macro_average(d, "metric").withColumn("value", F.round("value", 6))


@query("""WITH r AS (SELECT user_id % 20 AS model, event_type AS dataset, value, ts, row_number() OVER (PARTITION BY user_id % 20, event_type ORDER BY ts DESC, value DESC) AS k FROM events), m AS (SELECT model, dataset, value AS m FROM r WHERE k = 1),
a AS (SELECT model, dataset, rank() OVER (PARTITION BY dataset ORDER BY m DESC) + (count(*) OVER (PARTITION BY dataset, m) - 1) / 2 AS rank FROM m) SELECT model, round(avg(rank), 9) AS mean_rank, round(max(rank), 9) AS worst_rank, count(*) AS n_datasets FROM a GROUP BY model""")
def leaderboard_average_rank(spark, sf):
    e = _t(spark, sf, "events").select((F.col("user_id") % 20).alias("model"), F.col("event_type").alias("dataset"), "value", "ts")
    return metrics.leaderboard(e, "model", "dataset", ["value"], "ts").withColumns({c: F.round(c, 9) for c in ("mean_rank", "worst_rank")})


@query(f"""WITH g AS (SELECT source, sum(n_chars) AS s, count(*) AS n, row_number() OVER (ORDER BY source) - 1 AS g FROM documents GROUP BY source), k AS (SELECT count(*) AS groups FROM g),
x AS (SELECT s.i AS sample, d.j AS draw FROM (SELECT unnest(range(1, 201)) AS i) s, (SELECT unnest(range(1, (SELECT groups FROM k) + 1)) AS j) d), y AS (SELECT sample, {_h("'42'", 'sample', 'draw')} % (SELECT groups FROM k) AS g FROM x),
m AS (SELECT sample, sum(s) / sum(n) AS mean FROM y JOIN g USING (g) GROUP BY sample) SELECT (SELECT round(sum(s) / sum(n), 6) FROM g) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m""")
def bootstrap_ci(spark, sf):
    out = metrics.bootstrap(_t(spark, sf, "documents"), "source", "n_chars", 200)
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query(f"""WITH {_ITEMS}, p AS (SELECT a.candidate_id || b.candidate_id AS id, abs(length(a.text) - length(b.text)) / greatest(length(a.text), length(b.text), 1) AS d, length(a.text) > length(b.text) AS good FROM items a JOIN items b ON a.base_text_id = b.base_text_id AND a.method = 'original' AND b.method <> 'original'),
n AS (SELECT *, row_number() OVER (ORDER BY d, id) AS i, count(*) OVER () AS n FROM p) SELECT CAST(floor((i * 5 - 1) / n) AS INTEGER) AS bin, count(*) AS n, round(min(d), 9) AS least, round(max(d), 9) AS greatest, round(avg(d), 9) AS mean, round(avg(CASE WHEN good THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM n GROUP BY 1""")
def length_bin_accuracy(spark, sf):
    p = composing.original_pairs(items(spark, sf)).select(F.concat("left_candidate_id", "right_candidate_id").alias("id"), "left_text", "right_text", F.length("left_text").alias("a"), F.length("right_text").alias("b"))
    out = metrics.binned_accuracy(p, "left_text", "right_text", "a", "b", "id", 5)
    return out.select("bin", "n", *[F.round(c, 9).alias(c) for c in ("least", "greatest", "mean", "accuracy")])


@query("""WITH p AS (SELECT event_type, value - 50.0::DOUBLE AS d FROM events) SELECT event_type, count(*) AS n, round(avg(greatest(0, -d) + ln(1 + exp(-abs(d)))), 9) AS loss FROM p GROUP BY event_type""")
def ranking_losses(spark, sf):
    e = _t(spark, sf, "events").select("event_type", "value", F.lit(50.0).alias("other"))
    return metrics.ranking_loss(e, ["event_type"], "value", "other").withColumn("loss", F.round("loss", 9))


@query("SELECT event_type, count(*) AS n, round(avg(CASE WHEN abs(value - 50) <= 1 THEN 0.5 * (value - 50) * (value - 50) ELSE abs(value - 50) - 0.5 END), 9) AS loss FROM events GROUP BY event_type")
def regression_losses(spark, sf):
    e = _t(spark, sf, "events").select("event_type", "value", F.lit(50.0).alias("t"))
    return metrics.regression_loss(e, ["event_type"], "t", "value").withColumn("loss", F.round("loss", 9))


@query("""WITH RECURSIVE e AS (SELECT user_id % 50 AS run, event_id AS step, CAST(value AS DOUBLE) AS m, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS k FROM events WHERE isfinite(value)),
f AS (SELECT run, k, m AS best, step AS best_step, 0 AS bad, CAST(NULL AS BIGINT) AS stop FROM e WHERE k = 1 UNION ALL SELECT e.run, e.k, CASE WHEN e.m > f.best THEN e.m ELSE f.best END, CASE WHEN e.m > f.best THEN e.step ELSE f.best_step END, CASE WHEN e.m > f.best THEN 0 ELSE f.bad + 1 END, CASE WHEN e.m <= f.best AND f.bad + 1 >= 5 THEN e.step END
FROM f JOIN e ON e.run = f.run AND e.k = f.k + 1 WHERE f.stop IS NULL) SELECT run, arg_max(best, k) AS best, arg_max(best_step, k) AS best_step, max(stop) AS stop_step FROM f GROUP BY run""")
def early_stopping(spark, sf):
    e = _t(spark, sf, "events").select((F.col("user_id") % 50).alias("run"), F.col("event_id").alias("step"), "value")
    return metrics.early_stops(e, ["run"], "step", "value", 5)


# --- benchmark records -----------------------------------------------------------------------------


@query("SELECT 'doc:' || doc_id || ':' || a AS id, CAST(doc_id AS VARCHAR) AS source_id, a AS aspect, v AS human_score FROM (SELECT doc_id, 'quality' AS a, CAST(quality AS DOUBLE) AS v FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS DOUBLE) FROM labels) JOIN documents USING (doc_id) WHERE v IS NOT NULL AND trim(text) <> ''")
def unpivot_labels(spark, sf):
    return benchmarks.melted(_labelled(spark, sf), "doc_id", "text", ["quality", "toxic"], "docs", "doc").select("id", "source_id", "aspect", "human_score")


@query("SELECT conv_id, turn, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS new FROM conversations)")
def run_length_groups(spark, sf):
    return benchmarks.run_groups(_t(spark, sf, "conversations"), "turn", "role", ["conv_id"]).select("conv_id", "turn", "run")


@query("SELECT doc_id // 3 AS item, arg_min(source, doc_id) AS source, round(avg(n_chars), 6) AS n_chars FROM documents GROUP BY 1")
def rated_triples(spark, sf):
    return benchmarks.grouped_rows(_t(spark, sf, "documents"), "doc_id", 3, ["source"], ["n_chars"]).withColumn("n_chars", F.round("n_chars", 6))


@query("SELECT vec_id, CAST(n AS INTEGER) AS n_valid, round(m, 6) AS mean FROM (SELECT vec_id, len(list_filter(embedding, lambda x: isfinite(x))) AS n, list_avg(list_transform(list_filter(embedding, lambda x: isfinite(x)), lambda x: CAST(x AS DOUBLE))) AS m FROM embeddings)")
def mean_of_annotators(spark, sf):
    e = _t(spark, sf, "embeddings")
    return e.select("vec_id", F.size(benchmarks.finite_scores("embedding")).alias("n_valid"), F.round(benchmarks.mean_score("embedding"), 6).alias("mean"))


@query(f"""SELECT DISTINCT a.conv_id, b.conv_id AS other FROM conversations a JOIN conversations b ON {_norm('a.text')} = {_norm('b.text')} WHERE a.conv_id % 10 = 0 AND b.conv_id % 10 <> 0
UNION SELECT d.doc_id, -b.item_id FROM documents d JOIN benchmark b ON {_norm('d.text')} = {_norm('b.text')}""")
def benchmark_overlap(spark, sf):
    key = F.sha2(text.normalized("text"), 256).alias("k")
    c = _t(spark, sf, "conversations").select("conv_id", key)
    turns = c.where("conv_id % 10 = 0").join(c.where("conv_id % 10 != 0").select(F.col("conv_id").alias("other"), "k"), "k").select("conv_id", "other")
    d, b = _t(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), key), _t(spark, sf, "benchmark").select((-F.col("item_id")).alias("other"), key)
    return turns.unionByName(d.join(b, "k").select("conv_id", "other")).distinct()


@query("""SELECT user_id, CASE WHEN n = 3 THEN round(s / 3, 9) END AS mean, n AS n_valid FROM (SELECT user_id, count(*) AS n, sum(value) AS s FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 3 GROUP BY user_id)""")
def judge_sample_means(spark, sf):
    first = metrics.running_sum(_t(spark, sf, "events"), ["user_id"], [F.col("event_id")], F.lit(1), "k").where("k < 3")
    return scoring.mean_of_samples(first, ["user_id"], "value", 3).select("user_id", F.round("mean", 9).alias("mean"), "n_valid")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 25")
def first_n_per_dimension(spark, sf):
    w = Window.partitionBy("lang").orderBy("doc_id")
    return _t(spark, sf, "documents").withColumn("k", F.row_number().over(w)).where("k <= 25").select("lang", "doc_id")


@query(f"SELECT doc_id, {_h(chr(39) + '7' + chr(39), 'doc_id')} AS draw FROM documents")
def seeded_draws(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", draws.h32(7, F.col("doc_id")).alias("draw"))
