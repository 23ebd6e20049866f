"""Queries of resumed runs, balanced splits, edit spans and soft pairwise accuracy, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lamina.functions import diffs, edits, features, swaps
from lamina.functions.draws import h32
from lamina.functions.ordering import shared_dir, written
from lamina.operators import balancing, rules, scoring, suites
from lamina.plans.queries import _ITEMS, _WS, _h, _norm, _t, items, query
from lamina.sources.jsonl import Layers
from lamina.streaming import jobs, prefix
from lamina.streaming.layers import LayerJob, layer_items

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0} END"
_CHUNKS = f"SELECT number // 32 AS chunk, count(*) AS n, sha256(string_agg(h, '' ORDER BY number)) AS hash FROM (SELECT h, row_number() OVER (ORDER BY doc_id, h) - 1 AS number FROM (SELECT doc_id, sha256({_FIELD.format('doc_id')} || {_FIELD.format('text')}) AS h FROM {{0}})) GROUP BY 1"


@query(f"""WITH p AS ({_CHUNKS.format("documents")}), e AS (SELECT doc_id, CASE WHEN doc_id % 150 = 149 THEN upper(text) ELSE text END AS text FROM documents),
j AS (SELECT * FROM ({_CHUNKS.format("e")}) WHERE chunk <> 3 AND chunk * 4 < 3 * (SELECT count(*) FROM p)),
s AS (SELECT chunk, coalesce(p.hash, j.hash) AS hash, CASE WHEN p.hash IS NULL THEN 'beyond' WHEN j.hash IS NULL THEN 'pending' WHEN p.hash <> j.hash OR p.n <> j.n THEN 'changed' ELSE 'done' END AS state FROM p FULL JOIN j USING (chunk))
SELECT chunk, hash, CASE WHEN state = 'done' AND chunk > (SELECT min(chunk) FROM s WHERE state <> 'done') THEN 'unproved' ELSE state END AS state FROM s""")
def prefix_resume(spark, sf):
    """Chunks of the documents against the journal of an earlier run, whose texts differed here and there, that stopped before a
    quarter of them and lost a chunk."""
    docs = _t(spark, sf, "documents")
    plan = prefix.chunk_hashes(prefix.numbered_keys(docs, ["doc_id"], ["doc_id", "text"], 32))
    earlier = docs.withColumn("text", F.when(F.col("doc_id") % 150 == 149, F.upper("text")).otherwise(F.col("text")))
    total = F.broadcast(plan.agg(F.count("*").alias("total")))
    was = prefix.chunk_hashes(prefix.numbered_keys(earlier, ["doc_id"], ["doc_id", "text"], 32))
    journal = was.crossJoin(total).where("chunk != 3 and chunk * 4 < 3 * total").drop("total")
    return prefix.prefix_state(plan, journal)


_SIGNED = """s AS (SELECT event_type AS system, user_id % 50 AS item, avg(CAST(round(value * 100) AS BIGINT) % 1000) AS m, avg(CAST(event_id % 5 AS BIGINT)) AS h FROM events GROUP BY 1, 2),
g AS (SELECT system, item, CAST(round(m * 1000) AS BIGINT) AS m, CAST(round(h * 1000) AS BIGINT) AS h FROM s WHERE item IN (SELECT item FROM s GROUP BY item HAVING count(*) = (SELECT count(DISTINCT system) FROM s)))"""


@query(f"""WITH {_SIGNED}, b AS (SELECT item, k AS block, {_h("'42'", "'sign'", "item", "k")} AS bits FROM (SELECT DISTINCT item FROM g), range(32) t(k)),
d AS (SELECT system, block * 32 + k AS r, sum(CASE WHEN (bits >> k) & 1 = 1 THEN m ELSE -m END) AS m, sum(CASE WHEN (bits >> k) & 1 = 1 THEN h ELSE -h END) AS h FROM g JOIN b USING (item), range(32) t(k) GROUP BY 1, 2),
o AS (SELECT system, sum(m) AS m, sum(h) AS h FROM g GROUP BY system),
p AS (SELECT x.system AS a, y.system AS b, avg(CASE WHEN x.m - y.m >= u.m - v.m THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p, avg(CASE WHEN x.h - y.h >= u.h - v.h THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS q
  FROM d x JOIN d y ON x.r = y.r AND x.system < y.system JOIN o u ON u.system = x.system JOIN o v ON v.system = y.system GROUP BY 1, 2)
SELECT (SELECT count(*) FROM o) AS n_systems, (SELECT count(DISTINCT item) FROM g) AS n_items, count(*) AS n_pairs, round(avg(1 - abs(p - q)), 9) AS accuracy FROM p""")
def soft_pairwise_accuracy(spark, sf):
    """Event types as systems, groups of users as items; whole numbers, so that sums don't depend on their order."""
    per = _t(spark, sf, "events").groupBy(F.col("event_type").alias("system"), (F.col("user_id") % 50).alias("item")).agg(F.avg(F.round(F.col("value") * 100).cast("long") % 1000).alias("m"), F.avg(F.col("event_id") % 5).alias("h"))
    rows = per.select("system", "item", *[F.round(F.col(c) * 1000).cast("long").alias(c) for c in "mh"])
    out = suites.soft_pairwise_accuracy(rows, "item", "system", "m", "h")
    return out.select("n_systems", "n_items", "n_pairs", F.round("accuracy", 9).alias("accuracy"))


def _tokens(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '{_WS}'), lambda x: x <> '')"


@query(f"""WITH {_ITEMS}, t AS (SELECT c.candidate_id, {_tokens("o.text")} AS l, {_tokens("c.text")} AS r FROM items c JOIN items o ON o.base_text_id = c.base_text_id AND o.method = 'original' WHERE c.method <> 'original')
SELECT candidate_id, CAST(len(l) AS INTEGER) AS n_left, CAST(len(r) AS INTEGER) AS n_right, sha256(array_to_string(r, ' ')) AS rebuilt, true AS in_order, l = r AS same FROM t""")
def severity_diff(spark, sf):
    """Each candidate against its source's original: the candidate's tokens rebuilt from the spans."""
    from lamina.functions.text import normalized

    rows = items(spark, sf)
    words = lambda c: F.filter(F.split(normalized(F.coalesce(c, F.lit(""))), " "), lambda w: w != "")
    first = rows.where("method = 'original'").select("base_text_id", words(F.col("text")).alias("l"))
    both = rows.where("method != 'original'").join(first, "base_text_id").select("candidate_id", "l", words(F.col("text")).alias("r"))
    spans = diffs.with_edit_spans(both, "l", "r", ["candidate_id", "l", "r"])
    covered = F.aggregate("spans", F.lit(0), lambda n, s: F.when((n >= 0) & (s["left_from"] == n), s["left_to"]).otherwise(F.lit(-1)))
    back = F.array_join(diffs.rebuilt("l", "r", "spans"), " ")
    same = F.size("spans") == F.size(F.filter("spans", lambda s: s["tag"] == "equal"))
    return spans.select("candidate_id", F.size("l").alias("n_left"), F.size("r").alias("n_right"), F.sha2(back.cast("binary"), 256).alias("rebuilt"), (covered == F.size("l")).alias("in_order"), same.alias("same"))


@query("""WITH f AS (SELECT doc_id, unnest(['lang:' || lang, 'source:' || source, 'chars:' || length(text) // 2000]) AS feature FROM documents), c AS (SELECT count(*) AS n FROM documents),
z AS (SELECT n, unnest(['dev', 'test', 'train']) AS split, unnest([n // 10, n // 10, n - 2 * (n // 10)]) AS size FROM c)
SELECT feature, split, CAST(size AS BIGINT) AS size, count(*) AS total, round(count(*) * size / CAST(n AS DOUBLE), 6) AS target, true AS within FROM f, z WHERE feature IS NOT NULL GROUP BY feature, split, size, n""")
def split_balance(spark, sf):
    """A tenth of the documents each for dev and test, dealt by kind and then balanced until each split holds each feature to six
    sources, or a tenth of the target: of each feature and split the target, and whether it does."""
    docs = _t(spark, sf, "documents")
    n = docs.count()
    sizes = {"dev": n // 10, "test": n // 10, "train": n - 2 * (n // 10)}
    kinds = F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"), F.concat(F.lit("chars:"), F.floor(F.length("text") / 2000).cast("string")))
    features = docs.select("doc_id", F.explode(kinds).alias("feature"), F.lit(1).alias("n")).where("feature is not null")
    features = written(features, "features")
    within = F.abs(F.col("observed") - F.col("target")) <= F.greatest(F.lit(6.0), F.col("target") / 10)
    out = balancing.balanced_split(docs, features, F.lit(1.0), "doc_id", sizes, within=within)
    per = balancing.deviations(out, features, F.lit(1.0), "doc_id").join(F.broadcast(out.groupBy("split").agg(F.count("*").alias("size"))), "split")
    return per.select("feature", "split", "size", "total", F.round("target", 6).alias("target"), within.alias("within"))


_SPECS = [(0, "german", "en-de", "style", "de", None), (1, "french web", "en-de", "style", "fr", "web"), (2, "style", "en-de", "style", None, None), (3, "never", "en-de", "style", None, None), (4, "rest", "other", "length", None, None)]


@query(f"""WITH s AS (SELECT * FROM (VALUES {", ".join(str(x).replace("None", "NULL") for x in _SPECS)}) t(ordinal, name, benchmark, aspect, task, original_data)),
r AS (SELECT d.doc_id, CASE WHEN d.doc_id % 5 < 4 THEN 'en-de' ELSE 'other' END AS benchmark, CASE d.doc_id % 4 WHEN 0 THEN 'style: of words' WHEN 1 THEN 'style (all)' WHEN 2 THEN 'styles' ELSE 'length' END AS aspect,
  lang AS task, CASE WHEN n_chars % 2 = 0 THEN 'web' END AS original_data, list_filter([CASE WHEN n_chars % 7 = 0 THEN NULL ELSE CAST(quality AS DOUBLE) END, CASE WHEN n_chars % 3 = 0 THEN NULL ELSE CAST(toxic AS DOUBLE) END], lambda x: x IS NOT NULL) AS v FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s.ordinal) AS k FROM r JOIN s ON s.benchmark = r.benchmark AND (trim(split_part(r.aspect, ':', 1)) = s.aspect OR trim(split_part(r.aspect, ':', 1)) LIKE s.aspect || ' %' OR trim(split_part(r.aspect, ':', 1)) LIKE s.aspect || '(%')
  AND (s.task IS NULL OR s.task = r.task) AND (s.original_data IS NULL OR s.original_data = r.original_data) WHERE len(v) > 0)
SELECT 'doc:' || doc_id AS id, name AS spec, CAST(len(v) AS INTEGER) AS n, round(list_sum(v) / len(v), 9) AS human_score FROM h WHERE k = 1""")
def spec_records(spark, sf):
    """Labelled documents as records of a benchmark; scores that aren't there are null or no number."""
    rows = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id")
    aspect = F.element_at(F.array(*[F.lit(a) for a in ("style: of words", "style (all)", "styles", "length")]), (F.col("doc_id") % 4).cast("int") + 1)
    score = lambda c, k, none: F.when(F.col("n_chars") % k != 0, F.col(c).cast("double")).otherwise(F.lit(none))
    records = rows.select("doc_id", F.when(F.col("doc_id") % 5 < 4, "en-de").otherwise("other").alias("benchmark"), aspect.alias("aspect"), F.col("lang").alias("task"), F.when(F.col("n_chars") % 2 == 0, "web").alias("original_data"), F.array(score("quality", 7, float("nan")), score("toxic", 3, None)).alias("scores"))
    specs = spark.createDataFrame(_SPECS, "ordinal int, name string, benchmark string, aspect string, task string, original_data string")
    out = scoring.matched_records(records, specs, "doc_id", "scores", "doc")
    return out.select("id", "spec", F.size("human_scores").alias("n"), F.round("human_score", 9).alias("human_score"))


@query(f"""WITH d AS (SELECT doc_id, text, coalesce({_norm("text")}, '') = '' AS blank FROM documents),
a AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'no_answer' WHEN text IS NULL OR doc_id % 7 = 1 AND blank THEN 'empty_output' WHEN doc_id % 7 = 1 THEN 'unchanged_output' END AS r0 FROM d),
b AS (SELECT *, CASE WHEN r0 IS NULL THEN NULL WHEN doc_id % 3 <> 0 THEN 'no_answer' WHEN text IS NULL THEN 'empty_output' END AS r1, CAST(r0 IS NOT NULL AS INTEGER) AS attempt FROM a)
SELECT CAST(doc_id AS VARCHAR) AS base_text_id, r1 IS NULL AS ok, attempt, r1 AS reason, CAST(attempt + 1 AS BIGINT) AS n_attempts, CASE WHEN r1 IS NULL THEN sha256('draft ' || attempt || ': ' || text) END AS text_sha256 FROM b""")
def layer_job_state(spark, sf):
    """A layer of all documents as a job whose generator fails for some, with one more attempt of these: state, and published texts."""
    layers = Layers(spark, f"{shared_dir(spark)}/layers-{uuid.uuid4().hex}")
    originals = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("base_text_id"), "text")

    def work(rows):
        number, first = F.col("base_text_id").cast("long"), F.col("attempt") == 0
        says = F.concat(F.lit("draft "), F.col("attempt").cast("string"), F.lit(": "), F.col("text"))
        fails = F.when(F.when(first, number % 7 == 0).otherwise(number % 3 != 0), "no_answer")
        return rows.select(F.col("candidate_id").alias("parent_candidate_id"), "base_text_id", F.when(first & (number % 7 == 1), F.col("text")).otherwise(says).alias("text"), fails.alias("generation_failure"))

    job = LayerJob(layers, layer_items(layers, "docs", originals), "docs", "drafts", "run0", 1, work)
    job.run()
    job.run(retry_failed=True)
    job.publish("2024-01-01T00:00:00Z")
    texts = layers.get("drafts", "run0", 1).select("parent_candidate_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    base = F.substring_index("parent_candidate_id", "__", -1).alias("base_text_id")
    return job.state().join(texts, "parent_candidate_id", "left").select(base, "ok", "attempt", "reason", "n_attempts", "text_sha256")


_LETTERS = r"\p{L}[\p{L}\p{M}]*(?:['’]\p{L}[\p{L}\p{M}]*)*".replace("'", "''")


@query(f"""WITH b AS (SELECT item_id, coalesce(text, '') AS t, {_h("'swap'", "item_id")} AS draw FROM benchmark), w AS (SELECT item_id, draw, regexp_extract_all(t, '{_LETTERS}') AS w, string_split_regex(t, '{_LETTERS}') AS g FROM b),
x AS (SELECT item_id, w, g, unnest(range(len(w))) AS i FROM w), y AS (SELECT item_id, i, w[i + 1] AS word, contains(g[i + 1], ',') OR contains(g[i + 2], ',') AS listed FROM x),
p AS (SELECT a.item_id, a.i, b.i AS j, a.listed <> b.listed AS leaves, a.listed AND b.listed AS members, array_to_string(list_slice(g, a.i + 2, b.i + 1), ' ') AS gap FROM y a JOIN y b ON a.item_id = b.item_id AND a.i < b.i AND a.word <> b.word JOIN w ON w.item_id = a.item_id),
q AS (SELECT *, regexp_matches(gap, '[;:!?…()\\[\\]{{}}]') AS strong, contains(gap, ',') AS comma FROM p),
s AS (SELECT item_id, i, j, 20 * (j - i) + CASE WHEN leaves THEN 1000 ELSE 0 END + CASE WHEN strong THEN 250 WHEN comma THEN -100 ELSE 0 END + CASE WHEN j - i > 1 THEN 100 ELSE 0 END AS score FROM q WHERE NOT (members AND comma AND NOT strong)),
m AS (SELECT *, max(score) OVER (PARTITION BY item_id) AS top FROM s), n AS (SELECT item_id, i, j, score, count(*) OVER (PARTITION BY item_id) AS n_best, row_number() OVER (PARTITION BY item_id ORDER BY i, j) - 1 AS k FROM m WHERE score = top)
SELECT b.item_id, CAST(n.i AS INTEGER) AS first, CAST(n.j AS INTEGER) AS second, CAST(n.score AS INTEGER) AS score, CAST(coalesce(n.n_best, 0) AS INTEGER) AS n_best FROM b LEFT JOIN n ON n.item_id = b.item_id AND n.k = b.draw % n.n_best""")
def swap_by_structure(spark, sf):
    """The words of each benchmark text whose exchange changes its structure most, against all pairs of its words."""
    b = _t(spark, sf, "benchmark")
    made = b.select("item_id", swaps.structural_swap(F.coalesce("text", F.lit("")), h32("swap", F.col("item_id"))).alias("s"))
    return made.select("item_id", "s.first", "s.second", "s.score", "s.n_best")


def _without_zeros(text: str) -> str:
    if not any(c in "0123456789" for c in text):
        raise ValueError("no digits")
    return text.replace("0", "O")


_RULES = [rules.Rule("joined", lambda t: t.replace(" ", "")), rules.Rule("zeros", _without_zeros), rules.Rule("english", lambda t: t + " indeed", ("en",)), rules.Rule("cut", lambda t: t.split("e", 1)[1])]


@query(f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, t, 'joined' AS rule, NULL AS raised, replace(t, ' ', '') AS o FROM d UNION ALL SELECT doc_id, t, 'zeros', CASE WHEN NOT regexp_matches(t, '[0-9]') THEN 'ValueError' END, replace(t, '0', 'O') FROM d
  UNION ALL SELECT doc_id, t, 'english', NULL, t || ' indeed' FROM d WHERE lang = 'en' UNION ALL SELECT doc_id, t, 'cut', CASE WHEN NOT contains(t, 'e') THEN 'IndexError' END, substr(t, strpos(t, 'e') + 1) FROM d),
f AS (SELECT *, coalesce(raised, CASE WHEN {_norm("o")} = '' THEN 'empty_output' WHEN {_norm("o")} = {_norm("t")} THEN 'unchanged_output' END) AS fault FROM r)
SELECT doc_id, rule, fault, CASE WHEN fault IS NULL THEN sha256(o) END AS output_sha256 FROM f""")
def rule_outcomes(spark, sf):
    """Each document under four rules, two of which raise where they can't be used."""
    got = rules.rule_results(_t(spark, sf, "documents").select("doc_id", "lang", "text"), _RULES, F.col("text"), F.col("lang"))
    return got.select("doc_id", "rule", "fault", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"))


@query(f"""WITH d AS (SELECT item_id, {_tokens("text")} AS t FROM benchmark), w AS (SELECT item_id, list_transform(t, lambda x: list_transform(range(1, length_grapheme(x) + 1), lambda k: substring_grapheme(x, k, 1))) AS w, t FROM d),
n AS (SELECT *, list_transform(w, lambda x: len(list_filter(x, lambda c: regexp_matches(c, '^\\p{{L}}')))) AS n, list_filter(flatten(w), lambda c: regexp_matches(c, '^\\p{{L}}')) AS letters FROM w),
l AS (SELECT *, CASE WHEN len(n) = 0 THEN 1 WHEN list_max(n) >= 4 THEN 4 WHEN list_max(n) >= 2 THEN 2 ELSE 1 END AS least FROM n), o AS (SELECT *, list_filter(range(len(n)), lambda i: n[i + 1] >= least) AS own FROM l),
a AS (SELECT *, own[1 + {_h("'grapheme-word'", "item_id")} % greatest(len(own), 1)] AS spot, {_h("'grapheme-kind'", "item_id")} % 4 AS kind, letters[1 + {_h("'grapheme-letter'", "item_id")} % greatest(len(letters), 1)] AS fresh FROM o),
c AS (SELECT *, w[spot + 1] AS c, list_filter(range(len(w[spot + 1])), lambda i: regexp_matches(w[spot + 1][i + 1], '^\\p{{L}}')) AS p FROM a), k AS (SELECT *, CAST({_h("'grapheme-place'", "item_id")} % greatest(len(p), 1) AS INTEGER) AS k FROM c),
i AS (SELECT *, p[k + 1] AS i, coalesce(p[k + 2], p[greatest(k, 1)]) AS j FROM k),
m AS (SELECT *, array_to_string(list_transform(range(len(c)), lambda x: CASE WHEN x = i AND kind = 0 THEN '' WHEN x = i AND kind = 1 THEN c[x + 1] || c[x + 1] WHEN x = i AND kind = 2 THEN fresh || c[x + 1] WHEN x = i AND kind = 3 THEN c[j + 1] WHEN x = j AND kind = 3 THEN c[i + 1] ELSE c[x + 1] END), '') AS word FROM i),
e AS (SELECT item_id, array_to_string(t, ' ') AS old, array_to_string(list_filter(list_transform(range(len(t)), lambda x: CASE WHEN x = spot THEN word ELSE t[x + 1] END), lambda x: x <> ''), ' ') AS made FROM m)
SELECT item_id, CASE WHEN made <> old THEN made END AS edited FROM e""")
def grapheme_typos(spark, sf):
    """A typing error in each benchmark text."""
    return edits.grapheme_typo(_t(spark, sf, "benchmark").select("item_id", "text"), F.col("item_id")).select("item_id", "edited")


#: What a bundle of the query below is drawn from, tag by tag.
_FORMS = {"speech": ["V", "N", "v.ptcp", "V.PTCP.PRS", "AUX", "ADJ"], "mood": ["IND", "SBJV", None], "tense": ["PRS", "pst", None], "person": ["1", "2", "3", None], "number": ["sg", "PL", None], "gender": ["MASC", "FEM", None, None], "finite": ["FIN", "NFIN", None, None], "other": ["LGSPEC1", "ARGNO1S", None]}
_LISTS = {k: "[" + ", ".join(f"'{x}'" if x else "NULL" for x in v) + "]" for k, v in _FORMS.items()}


def _drawn(side: str) -> str:
    """A bundle in SQL: tags drawn from doc_id; `new` keeps two of three tags of `old`."""
    own = {k: f"""{_LISTS[k]}[1 + {_h(f"'{k}'", "'old'", "doc_id")} % {len(v)}]""" for k, v in _FORMS.items()}
    if side == "new":
        own = {k: f"""CASE WHEN {_h(f"'{k}'", "'keep'", "doc_id")} % 3 > 0 THEN {own[k]} ELSE {_LISTS[k]}[1 + {_h(f"'{k}'", "'new'", "doc_id")} % {len(v)}] END""" for k, v in _FORMS.items()}
    return f"concat_ws(';', {', '.join(own.values())})"


def _in(x: str, *dimensions: str) -> str:
    names = ", ".join(f"'{t}'" for d in dimensions for t in features.DIMENSIONS[d])
    return f"list_sort(list_filter({x}, lambda t: t IN ({names})))"


def _points(x: str, y: str) -> str:
    less = lambda p, q: f"len(list_filter({p}, lambda t: NOT list_contains({q}, t)))"
    return f"5 * len(list_intersect({x}, {y})) - 6 * {less(x, y)} - 2 * {less(y, x)}"


def _core(x: str) -> str:
    return f"""list_filter({x}, lambda t: NOT list_contains({_in(x, "tense", "mood")}, t))"""


def _is_finite(x: str) -> str:
    return f"""split_part({x}[1], '.', 1) IN ('V', 'AUX') AND len({_in(x, "nonfinite")}) = 0 AND NOT starts_with({x}[1], 'V.PTCP') AND len({_in(x, "finite", "person", "number", "tense", "mood")}) > 0"""


@query(f"""WITH s AS (SELECT doc_id, {_drawn("old")} AS a, {_drawn("new")} AS b FROM documents), t AS (SELECT doc_id, list_distinct(string_split(upper(a), ';')) AS xs, list_distinct(string_split(upper(b), ';')) AS ys, string_split(upper(a), ';') AS x, string_split(upper(b), ';') AS y FROM s)
SELECT doc_id, split_part(x[1], '.', 1) AS speech, {_is_finite("x")} AS finite, {_is_finite("y")} AS new_finite, {_in("x", "person")}[1] AS person,
CAST({_points("xs", "ys")} AS INTEGER) AS similarity, CAST({_points(_core("xs"), _core("ys"))} AS INTEGER) AS core_similarity,
{" AND ".join(f"(len({_in('x', d)}) = 0 OR {_in('x', d)} = {_in('y', d)})" for d in ("tense", "mood", "finite"))} AS same_marked, {" AND ".join(f"{_in('x', d)} = {_in('y', d)}" for d in features.AGREEMENT)} AS agrees FROM t""")
def feature_similarity(spark, sf):
    """Two bundles of tags drawn for each document, compared."""
    pick = lambda k, side: F.element_at(F.array(*[F.lit(x) for x in _FORMS[k]]), (1 + h32(k, side, F.col("doc_id")) % len(_FORMS[k])).cast("int"))
    new = lambda k: F.when(h32(k, "keep", F.col("doc_id")) % 3 > 0, pick(k, "old")).otherwise(pick(k, "new"))
    rows = _t(spark, sf, "documents").select("doc_id", F.concat_ws(";", *[pick(k, "old") for k in _FORMS]).alias("a"), F.concat_ws(";", *[new(k) for k in _FORMS]).alias("b"))
    rows = rows.select("doc_id", features.bundle(F.col("a")).alias("x"), features.bundle(F.col("b")).alias("y"))
    x, y = F.col("x"), F.col("y")
    return rows.select(
        "doc_id", features.part_of_speech(x).alias("speech"), features.finite_verb(x).alias("finite"), features.finite_verb(y).alias("new_finite"), features.marked(x, "person").alias("person"),
        features.similarity(x, y).alias("similarity"), features.similarity(x, y, "tense", "mood").alias("core_similarity"),
        features.same_marked(x, y, "tense", "mood", "finite").alias("same_marked"), (features.agreement(x) == features.agreement(y)).alias("agrees"),
    )


_STEPS = ["prepared", "submitting", "submitted", "submitted", "refused", "submitted", "completed", "expired"]
_DUE = 10 * 86_400_000
_LOG = f"""SELECT 'job-' || user_id AS job, ts AS seen, event_id % 5 AS attempt, CASE WHEN event_type = 'signup' THEN {_STEPS}[1 + (event_id // 5) % 8] ELSE 'answer' END AS kind,
  1 + user_id % 35 AS n, 'r' || event_id % 40 AS request, event_type <> 'error' AND value >= 60 AS ok FROM events"""
_RANK = "CASE kind WHEN 'prepared' THEN 0 WHEN 'submitting' THEN 1 WHEN 'submitted' THEN 2 WHEN 'refused' THEN 3 ELSE 4 END"


@query(f"""WITH l AS ({_LOG}), s AS (SELECT job, attempt, {_RANK} AS step, epoch_ms(seen) AS at_ms, row_number() OVER (PARTITION BY job ORDER BY attempt DESC, {_RANK} DESC, seen DESC) AS k FROM l WHERE kind <> 'answer'),
r AS (SELECT job, request, bool_or(ok) AS ok FROM l WHERE kind = 'answer' GROUP BY 1, 2), a AS (SELECT job, count_if(ok) AS n_ready, count_if(NOT ok) AS n_failed FROM r GROUP BY 1),
j AS (SELECT job, max(n) AS n FROM l GROUP BY 1)
SELECT job, CAST(coalesce(attempt, 0) AS INTEGER) AS attempt, CASE WHEN step IS NULL OR step IN (0, 3) THEN 'prepared' WHEN step = 1 THEN 'unconfirmed' WHEN step = 4 AND coalesce(n_ready, 0) >= n THEN 'done' WHEN step = 4 THEN 'retry'
  WHEN at_ms + {_DUE} < (SELECT max(epoch_ms(seen)) FROM l) THEN 'overdue' ELSE 'pending' END AS phase,
CAST(n AS INTEGER) AS n_requests, CAST(coalesce(n_ready, 0) AS INTEGER) AS n_ready, CAST(coalesce(n_failed, 0) AS INTEGER) AS n_failed FROM j LEFT JOIN a USING (job) LEFT JOIN (SELECT * FROM s WHERE k = 1) USING (job)""")
def batch_job_state(spark, sf):
    """Events as the log of jobs, one for each user, streamed through the state machine."""
    answer = F.col("event_type") != "signup"
    step = F.element_at(F.array(*[F.lit(x) for x in _STEPS]), (1 + F.floor(F.col("event_id") / 5) % 8).cast("int"))
    log = _t(spark, sf, "events").select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 5).cast("int").alias("attempt"), F.when(answer, jobs.ANSWER).otherwise(step).alias("kind"),
        (1 + F.col("user_id") % 35).cast("int").alias("n_requests"), F.concat(F.lit("r"), (F.col("event_id") % 40).cast("string")).alias("request"), F.col("value").cast("string").alias("value"),
        F.when((F.col("event_type") != "error") & (F.col("value") >= 60), None).otherwise(F.lit("no answer")).alias("error"),
    )
    root = f"{shared_dir(spark)}/jobs-{uuid.uuid4().hex}"
    log.write.parquet(f"{root}/log")
    jobs.run_jobs(spark.readStream.schema(jobs.LOG).parquet(f"{root}/log"), f"{root}/changes", f"{root}/checkpoint", _DUE)
    return jobs.current_states(spark.read.parquet(f"{root}/changes"))
