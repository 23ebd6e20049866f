"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import alignment, chat, decontaminate, languages, licenses, merkle, partenum, pieces, quality, search, substrings, suffixes, tokens
from lamina.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels").where(quality.training_part()))
    out = quality.score_quality(docs, model)
    return out.select("doc_id", (~quality.training_part()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "bad_lines")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.similar_documents(table(spark, sf_dir, "documents"), n=4, percent=85)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs, model = languages.trigram_model(table(spark, sf_dir, "documents"))
    return languages.identify_languages(table(spark, sf_dir, "pages"), langs, model)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"), length=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = search.whole_vectors(table(spark, sf_dir, "embeddings"))
    return search.top_k(vectors, vectors.where(F.col("id") % 50 == 0), k=5)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=5, threshold=0.8)


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    out = pieces.decode_pieces(pieces.encode_pieces(table(spark, sf_dir, "documents"), model), model)
    return out.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = chat.END.strip() + chat.START + "assistant ok"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.conversation_digests(chat.chat_examples(turns.unionByName(own)))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", upper, upper.lower()))
    out = merkle.proofs(merkle.document_manifest(table(spark, sf_dir, "documents"), tampered))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.align_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_ngram_join, op3_license_scan, op4_language_id, op5_substring_dedup, op6_token_counts, op7_exact_topk, op8_decontaminate, op9_piece_codec, op10_chat_format, op11_merkle_manifest, op12_token_alignment, op13_suffix_dedup)}

_VECTORS = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

_WORDS = "list_filter(string_split_regex({text}, '[ \\x09-\\x0D]+'), lambda x: x <> '')"

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0} END"
_CRC = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: list_reduce(range(8), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(a, b)), 4294967295), 4294967295)"""

ORACLE_SQL = {
    "op13_suffix_dedup": """WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT r, i, md5_number(substr(x, 2 * i + 1, 800)) AS t FROM (SELECT r, x, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
q AS (SELECT r, i FROM s SEMI JOIN (SELECT t FROM s GROUP BY t HAVING count(*) > 1) USING (t)),
z AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM q),
u AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM z),
v AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM u GROUP BY r, k),
w AS (SELECT r, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, count(*) AS n_spans, sum(b - a) AS n_removed FROM v GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(0, coalesce(n_spans, 0) + 1), lambda j: substr(x, 2 * coalesce(b[j], 0) + 1, 2 * (coalesce(a[j + 1], n) - coalesce(b[j], 0)))), ''))) AS kept_sha256
FROM d LEFT JOIN w USING (r)""",
    "op11_merkle_manifest": f"""WITH RECURSIVE e AS (SELECT *, {" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head,
  {_CRC} % 5 = 0 AS tampered, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents),
h AS (SELECT doc_id, source, sha256(head || {_FIELD.format("text")}) AS leaf, CASE WHEN tampered THEN sha256(head || {_FIELD.format("lowered")}) END AS changed FROM e),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM h),
own AS (SELECT s, 0 AS level, i, n AS size, leaf AS d FROM l UNION ALL
  SELECT s, any_value(level) + 1, i // 16, (any_value(size) + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM own WHERE size > 1 GROUP BY s, i // 16),
top AS (SELECT -1 AS s, 0 AS level, s AS i, count(*) OVER () AS size, d FROM own WHERE size = 1 UNION ALL
  SELECT s, any_value(level) + 1, i // 16, (any_value(size) + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM top WHERE size > 1 GROUP BY s, i // 16),
r AS (SELECT s, level, i // 16 AS run, list(d ORDER BY i) AS ds FROM (FROM own UNION ALL FROM top) WHERE size > 1 GROUP BY s, level, i // 16),
v AS (SELECT DISTINCT s, level FROM r),
w AS (SELECT l.s, l.i, v.s AS tree, level, l.i // CAST(16 ** level AS BIGINT) AS j FROM l JOIN v ON v.s = l.s UNION ALL
  SELECT l.s, l.i, -1, level, l.s // CAST(16 ** level AS BIGINT) FROM l JOIN v ON v.s = -1),
p AS (SELECT w.s, w.i, row_number() OVER (PARTITION BY w.s, w.i ORDER BY tree < 0, w.level) AS k, array_to_string(ds[1:j % 16], '') AS lefts, array_to_string(ds[j % 16 + 2:], '') AS rights
  FROM w JOIN r ON r.s = tree AND r.level = w.level AND run = j // 16),
f AS (SELECT s, i, 0 AS k, coalesce(changed, leaf) AS d FROM l UNION ALL SELECT f.s, f.i, p.k, sha256(lefts || d || rights) FROM f JOIN p ON p.s = f.s AND p.i = f.i AND p.k = f.k + 1),
g AS (SELECT s, i, arg_max(d, k) AS folded_root FROM f GROUP BY s, i),
q AS (SELECT s, i, sha256(string_agg(lefts || rights, '' ORDER BY k)) AS proof_sha256 FROM p GROUP BY s, i)
SELECT l.doc_id, leaf, o.d AS subroot, t.d AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = t.d AS verified
FROM l JOIN g USING (s, i) LEFT JOIN q USING (s, i) JOIN (SELECT s, d FROM own WHERE size = 1) o ON o.s = l.s CROSS JOIN (SELECT d FROM top WHERE size = 1) t""",
    "op2_ngram_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)""",
    "op5_substring_dedup": f"""WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS t FROM s),
m AS (SELECT t, min(doc_id) AS least FROM g GROUP BY t HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN m USING (t) WHERE doc_id > least),
a AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept FROM p ANTI JOIN r ON p.doc_id = r.doc_id AND p.i = r.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op8_decontaminate": f"""WITH b AS (SELECT DISTINCT item_id, {_WORDS.format(text="lower(coalesce(text, ''))")} AS w FROM benchmark),
d AS (SELECT doc_id, {_WORDS.format(text="lower(coalesce(text, ''))")} AS w FROM documents),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM bs JOIN ds USING (t) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item) - 1e-9""",
    "op7_exact_topk": _VECTORS
    + """, s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_chat_format": """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
f AS (SELECT *, 12 + 1 + 11 + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS chars,
  row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
}
