import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF)
        docs = spark.createDataFrame(rows.collect(), rows.schema)
        out.append(docs)
    return out


def _shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_stages(spark, stages):
    before = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for df in stages[:-1]:
        assert df.columns == before.columns
    good, single, cut, clean = ({r["doc_id"]: r["text"] for r in df.collect()} for df in stages[:-1])
    known = [labels[i] == (i in good) for i in labels]
    assert np.mean(known) > 0.9
    # of similar documents only the first is left, and nothing else went
    sets = {i: _shingles(t) for i, t in good.items() if _shingles(t)}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for i in sets:
        if i in single:
            assert not any(alike(i, j) for j in sets if j < i and j in single)
        else:
            assert any(alike(i, j) for j in sets if j != i)
    # passages of 50 words are in one document at most
    seen = {}
    for i, t in cut.items():
        w = t.split()
        for k in range(len(w) - 49):
            assert seen.setdefault(tuple(w[k : k + 50]), i) == i
    items = [_shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, t in cut.items():
        hit = any(s and len(s & _shingles(t)) >= 0.8 * len(s) for s in items)
        assert hit == (i not in clean)


def test_last_stage_encodes(spark, stages):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in stages[-2].collect()}
    rows = stages[-1].collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        assert np.frombuffer(r["ids_le"], "<u4").tolist() == sp.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)


def test_nulls_and_nothing(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None), (2, "", None, None, None), (None, "x", "en", "s", 1)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert {r["doc_id"] for r in docs.collect()} <= {1, 2}


def test_rows_that_share_an_id_keep_their_own_texts(spark):
    words = lambda k, n: " ".join(f"{k}w{i}" for i in range(n))
    passage = words("p", 60)
    rows = [(1, f"{words('a', 5)} {passage}", "en", "s", 1), *[(2, f"{passage} {words('b', 5)}", "fr", f"s{i}", 2) for i in range(4)]]
    rows += [(2, words("c", 80), "de", "own", 3), (2, passage, "en", "gone", 4), (2, None, None, None, None), (2, f"{words('d', 3)} {passage}", "en", "late", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    b = words("b", 5)
    want = [rows[0], *[(2, b, "fr", f"s{i}", len(b)) for i in range(4)], rows[5], rows[7], (2, words("d", 3) + " ", "en", "late", len(words("d", 3)) + 1)]
    assert sorted(map(str, map(tuple, corpus_pipeline.drop_repeats(spark, docs, SF).collect()))) == sorted(map(str, want))
