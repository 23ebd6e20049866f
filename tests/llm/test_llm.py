import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import chat, decontaminate, languages, licenses, partenum, pieces, quality, search, substrings, tokens
from lamina.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
CLASH = ", id long, h long, n long, node long, text2 string, salt int, score string, pos int, ids_le string, partition int"
SCHEMA = "doc_id long, text string" + CLASH
EMPTY = (None,) * 10


def docs_of(spark, texts):
    """Documents with null and clashing columns beside id and text."""
    rows = [(i, t, *EMPTY) if not isinstance(t, tuple) else (*t, *EMPTY) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def long_text(seed, n=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(n))


ODD = [None, "", " \n\t", "a", "A b", "é ﬁ 😀 \x00 <|endoftext|>", "word " * 30, long_text(1, 20000)]


# --- encoding and counting -------------------------------------------------------------------------


def test_pieces_are_the_librarys(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(3)
    parts = ["a", "e", "the", "ing", " ", "  ", "▁", "\n", "é", "中", "😀", "\x00", "<s>", "9", ".", "aaaa", "́"]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(300)] + ["a" * 5000, " " * 100]
    df = pieces.decode_pieces(pieces.encode_pieces(docs_of(spark, texts), PIECES), PIECES)
    rows = {r["doc_id"]: r for r in df.withColumn("ids", pieces.unpacked()).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(rows[i]["ids_le"], "<u4").tolist() == ids == rows[i]["ids"]
        assert rows[i]["decoded"] == sp.decode(ids) and rows[i]["n_tokens"] == len(ids)


def test_any_ids_decode_as_in_the_library():
    import sentencepiece

    sp, model, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.piece_model(PIECES), random.Random(4)
    for _ in range(3000):
        ids = [r.randrange(600) if r.random() < 0.8 else r.randrange(32000) for _ in range(r.randint(0, 12))]
        assert model.decode(np.array(ids, "<u4").tobytes()) == sp.decode(ids)
    with pytest.raises(ValueError):
        model.decode(np.array([32000], "<u4").tobytes())


@pytest.mark.parametrize("hot", [0, 20, 1 << 17])
def test_token_counts_are_the_librarys(spark, hot):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    texts = ODD + ["İ Σσ 'LL don't<|startoftext|>x", "½٣ 한글 \u0085 \x1c b"] + ["the the cat"] * 3
    rows = tokens.token_counts(docs_of(spark, texts), WORDS, hot=hot).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in rows}
    assert len(rows) == len(texts)
    for i, x in enumerate(texts):
        assert got[i] == (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids))
    twice = docs_of(spark, [(1, "a b"), (1, "a b"), (None, "c")])
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(twice, WORDS).collect()} == {1: 4, None: 1}


# --- near duplicates and repeats -------------------------------------------------------------------


def _shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def _components(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_similar_documents_against_all_pairs(spark, n, percent):
    r = random.Random(n)
    texts = list(ODD) + ["a b c", "A b C", "a b c d e f g h", "a b c d e f g h i"]
    for _ in range(12):
        base = [r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(30)) for _ in range(r.choice([7, 9, 30, 120]))]
        for _ in range(6):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 12))):
                w[r.randrange(len(w))] = "changed" + str(r.randrange(5))
            texts.append(" ".join(w[: len(w) - r.randrange(0, 3)]))
    got = {x["doc_id"]: x for x in partenum.similar_documents(docs_of(spark, texts), n, percent).collect()}
    sets = {i: _shingles(t, n) for i, t in enumerate(texts)}
    want = _components(sets, percent)
    assert {i: (g["n_shingles"], g["component_id"]) for i, g in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}


@pytest.mark.parametrize("percent", [60, 80, 85])
def test_similar_documents_of_common_signatures_against_all_pairs(spark, monkeypatch, percent):
    """Every signature that more than two open nodes share goes the way of the rarest elements."""
    monkeypatch.setattr(partenum, "MANY", 2)
    r = random.Random(percent)
    templates = [[f"t{k}w{i}" for i in range(m)] for k, m in ((0, 90), (1, 40))]
    texts = []
    for _ in range(70):
        base = r.choice(templates)
        own = [f"o{r.randrange(60)}" for _ in range(r.choice([1, 3, 6, 9, 14, 30]))]
        texts.append(" ".join(base[: len(base) - r.randrange(4)] + own))
    got = {x["doc_id"]: x["component_id"] for x in partenum.similar_documents(docs_of(spark, texts), 1, percent).collect()}
    assert got == _components({i: _shingles(t, 1) for i, t in enumerate(texts)}, percent)


def _hot_nodes(spark, sets, percent):
    """Nodes and sets as `rare_pairs` takes them."""
    packed = [np.array(sorted(s), np.uint64) for s in sets]
    names = [i.to_bytes(16, "big") for i in range(len(sets))]
    sketch = partenum.sketches(np.concatenate(packed), np.array([len(p) for p in packed])).tolist()
    nodes = spark.createDataFrame([(k, k, s) for k, s in zip(names, sketch, strict=True)], "node binary, label binary, sketch array<long>")
    return nodes, spark.createDataFrame([(k, p.tobytes()) for k, p in zip(names, packed, strict=True)], "node binary, set binary")


def test_rare_pairs_hold_all_similar_ones_and_few_of_a_template(spark):
    r = random.Random(9)
    word = lambda: r.randrange(1 << 62)
    template = [word() for _ in range(160)]
    sets = [{*template, *(word() for _ in range(40))} for _ in range(1000)]  # 0.67 alike
    planted = set()
    for k in range(0, 200, 4):
        near = set(sorted(sets[k])[: r.randrange(184, 200)]) | {word() for _ in range(r.randrange(4))}
        if 100 * len(near & sets[k]) >= 80 * len(near | sets[k]):
            planted.add((k, len(sets)))
        sets.append(near)
    pairs = {tuple(sorted(int.from_bytes(x, "big") for x in p)) for p in partenum.rare_pairs(*_hot_nodes(spark, sets, 80), 80).collect()}
    assert planted and planted <= pairs and len(pairs) < len(sets)


def test_similar_sets_share_a_signature():
    r = np.random.default_rng(5)
    for size in (6, 7, 10, 25, 60, 200, 900, 4000):
        for _ in range(25):
            base = np.unique(r.integers(0, 1 << 63, size).astype(np.uint64))
            most = int(len(base) * 15 / 115)  # what may go from one side alone
            gone = r.integers(0, most + 1)
            other = base[gone:]
            new = np.unique(r.integers(0, 1 << 63, max(0, (15 * len(base) - 100 * gone) // 85)).astype(np.uint64))
            other = np.unique(np.concatenate([other, new]))
            both = len(np.intersect1d(base, other))
            if 100 * both < 85 * (len(base) + len(other) - both):
                continue
            sig, owner = partenum.signatures(np.concatenate([base, other]), np.array([len(base), len(other)]), 85)
            assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())


@pytest.mark.parametrize("percent", range(50, 98, 3))
def test_empty_parts_lose_no_pair(percent):
    """The chance that a similar pair has only empty parts in common, where other cuts don't follow: of all ways to
    deal its differences over the partitions, those in which each partition has three or more or, with two at
    most, agrees in empty parts alone. It only falls with more partitions."""
    few = partenum.few_cuts(percent)
    low, _, cuts = partenum.bands(percent, 1 << 20)
    band = int(np.searchsorted(cuts, few, side="right"))
    n, k = int(cuts[band]), 3 * int(cuts[band]) - 1
    common = percent * low[band - 1] / 100  # the smaller set may be of the band below
    empty = (1 - 1 / (2 * n)) ** common
    ways = np.array([1 / np.prod(np.arange(1.0, j + 1)) for j in range(min(k, 150) + 1)])
    bad = ways * np.where(np.arange(len(ways)) <= 2, empty, 1)

    def dealt(one):
        """log of the coefficient of x^k in one^n."""
        log, p, out, scale = 0.0, one, np.ones(1), n
        plog = 0.0
        while scale:
            if scale & 1:
                out = np.convolve(out, p)[: k + 1]
                log += plog + np.log(out.max())
                out = out / out.max()
            p = np.convolve(p, p)[: k + 1]
            plog = 2 * plog + np.log(p.max())
            p, scale = p / p.max(), scale >> 1
        return log + np.log(out[k])

    assert dealt(bad) - dealt(ways) < np.log(1e-15)


@pytest.mark.parametrize("percent", [50, 60, 75, 79, 80, 85])
def test_similar_sets_of_any_sizes_share_a_signature(percent):
    r = np.random.default_rng(percent)
    for small in range(1, 90):
        for large in {100 * small // percent, max(small, 97 * small // percent)}:
            values = r.integers(0, 1 << 63, large, np.uint64)
            found, owner = partenum.signatures(np.concatenate([np.sort(values[:small]), np.sort(values)]), np.array([small, large]), percent)
            assert set(found[owner == 0]) & set(found[owner == 1]), (small, large)


def test_similar_documents_of_none_and_without_ids(spark):
    assert partenum.similar_documents(docs_of(spark, [(1, "x")]).limit(0)).collect() == []
    rows = partenum.similar_documents(docs_of(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in rows) == [(-1, -1), (3, 3), (3, 3)]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("length", [1, 3, 13, 50])
def test_repeats_against_all_windows(spark, length):
    r = random.Random(length)
    shared = [[r.choice("abcdef") * r.randint(1, 3) for _ in range(k)] for k in (12, 13, 14, 60, 80)]
    texts = list(ODD[:7])
    for _ in range(40):
        w = []
        for _ in range(r.randrange(1, 5)):
            w += r.choice(shared) if r.random() < 0.5 else [str(r.randrange(10**6)) for _ in range(r.randrange(1, 30))]
        texts.append("\n ".join(w))
    texts += texts[-3:]
    first, windows = {}, {}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        windows[i] = [tuple(w[k : k + length]) for k in range(len(w) - length + 1)]
        for x in windows[i]:
            first.setdefault(x, i)
    rows = {x["doc_id"]: x for x in substrings.remove_repeats(docs_of(spark, texts), length).collect()}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        gone = {k + j for k, x in enumerate(windows[i]) if first[x] < i for j in range(length)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        assert (rows[i]["n_words"], rows[i]["n_removed"], bytes(rows[i]["kept"])) == (len(w), len(gone), b" ".join(kept))
        assert bytes(rows[i]["cleaned"]).split() == kept
    assert substrings.remove_repeats(docs_of(spark, [(1, "x")]).limit(0), 13).collect() == []


def test_repeats_with_colliding_hashes(spark, monkeypatch):
    """With few bits in the first hash the second one tells sequences apart."""
    full = substrings.full_hashes
    monkeypatch.setattr(substrings, "full_hashes", lambda *a: (full(*a)[0] & np.uint64(7), full(*a)[1]))
    r = random.Random(2)
    shared = [[str(r.randrange(10**6)) for _ in range(20)] for _ in range(5)]
    texts = [" ".join(itertools.chain(*(r.choice(shared) if r.random() < 0.5 else [str(r.randrange(10**6)) for _ in range(9)] for _ in range(4)))) for _ in range(20)]
    first = {}
    for i, t in enumerate(texts):
        for k in range(len(t.split()) - 12):
            first.setdefault(tuple(t.split()[k : k + 13]), i)
    rows = {x["doc_id"]: x["n_removed"] for x in substrings.remove_repeats(docs_of(spark, texts), 13).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        assert rows[i] == len({k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)})


@pytest.mark.parametrize("period", substrings.COVERS)
def test_covers_hold_every_difference(period):
    cover = substrings.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


# --- decontamination -------------------------------------------------------------------------------


def test_contained_items_against_all_pairs(spark):
    r = random.Random(8)
    items = [" ".join(str(r.randrange(400)) for _ in range(k)) for k in (3, 5, 8, 15, 40, 90)] + [None, ""]
    texts = list(ODD[:7])
    for _ in range(60):
        w = (r.choice(items) or "x").split()
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = "other"
        texts.append(" ".join([str(r.randrange(400)) for _ in range(r.randrange(80))] + w + ["end."]).upper())
    texts.append(texts[-1])
    bench = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(items)], "item_id long, text string, size int, partition string")
    got = {(x["doc_id"], x["item_id"]): (x["n_shared"], x["n_item"]) for x in decontaminate.contained_items(docs_of(spark, texts), bench).collect()}
    sets = [{s for s in _shingles(t, 5) if len(s) == 5} for t in texts]
    known = [{s for s in _shingles(t, 5) if len(s) == 5} for t in items]
    want = {(d, i): (len(a & b), len(b)) for d, a in enumerate(sets) for i, b in enumerate(known) if b and len(a & b) >= 0.8 * len(b) - 1e-9}
    assert got == want and want
    assert decontaminate.contained_items(docs_of(spark, texts), bench.limit(0)).collect() == []


# --- quality ---------------------------------------------------------------------------------------


def test_marginals_against_all_labellings():
    r = np.random.default_rng(1)
    node, edge, counts = r.normal(size=9), r.normal(size=(2, 2)), np.array([4, 1, 3, 1])
    good, pair = quality.marginals(node, counts, edge)
    at = 0
    for n in counts:
        total, each, two = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(node[at + t] for t in range(n) if y[t]) + sum(edge[y[t - 1], y[t]] for t in range(1, n)))
            total += p
            each += p * np.array(y)
            for t in range(1, n):
                two[t, y[t - 1], y[t]] += p
        assert np.allclose(good[at : at + n], each / total) and np.allclose(pair[at : at + n], two / total)
        at += n


def test_quality_separates_and_scores_all(spark):
    r = random.Random(2)
    fine = lambda: "\n".join(" ".join(r.choice(["the", "cat", "sat", "on", "a", "mat"]) for _ in range(9)).capitalize() + "." for _ in range(r.randrange(1, 8)))
    junk = lambda: "\n".join(" ".join(r.choice(["BUY", "NOW", "$$$", "!!", "###"]) for _ in range(9)) for _ in range(r.randrange(1, 8)))
    texts = [fine() if i % 2 else junk() for i in range(120)]
    docs = docs_of(spark, texts + ODD)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, None), (None, 1), (999, 1)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    rows = {x["doc_id"]: x for x in quality.score_quality(docs, model).collect()}
    assert len(rows) == len(texts) + len(ODD) and all(0 <= x["score"] <= 1 for x in rows.values())
    assert all((rows[i]["score"] >= 0.5) == bool(i % 2) for i in range(60, 120))
    assert rows[120]["score"] == rows[121]["score"]  # null and empty
    n = quality.label_lines(docs, model).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {x["doc_id"]: x["n"] for x in n} == {i: x["n_lines"] for i, x in rows.items()}
    blank = quality.fit_quality(docs, labels.limit(0))
    assert {x["score"] for x in quality.score_quality(docs, blank).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), model).collect() == []


def test_labels_of_documents_give_mixed_lines():
    """Junk lines inside good documents, and good ones inside junk, are told apart though no line has a label."""
    r, texts, kinds = random.Random(6), [], []
    fine = lambda: " ".join(r.choice(["the", "cat", "sat", "on", "a", "mat"]) for _ in range(9)).capitalize() + "."
    junk = lambda: " ".join(r.choice(["BUY", "NOW", "$$$", "!!", "###"]) for _ in range(9))
    for i in range(200):
        own = [i % 2 == 1] * 10
        for _ in range(r.choice([0, 0, 1, 2])):
            own[r.randrange(10)] = i % 2 == 0
        texts.append("\n".join(fine() if good else junk() for good in own).encode())
        kinds += own
    own, lengths, counts = quality.line_features(texts)
    model = quality.fit(own, lengths, counts, np.arange(200.0) % 2)
    good = model.lines(own, counts)
    assert np.mean((good >= 0.5) == np.array(kinds)) > 0.97
    assert all((model.documents(good, lengths, counts) >= 0.5) == (np.arange(200) % 2 == 1))
    q, _ = quality.given_labels(np.zeros(30), np.array([10, 20]), np.zeros((2, 2)), np.ones(30), np.array([1.0, 0.0]))
    assert 0.8 <= q[:10].mean() < 0.82 and 0.18 < q[10:].mean() <= 0.2


# --- licences and languages ------------------------------------------------------------------------


def test_license_spans(spark):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "without any charge at all").replace("sublicense, ", "")
    texts = [None, "", "Licensed under CC BY-NC 4.0.", f"İ x\n{changed}\nend", "Released under the MIT License. Then: released under the  MIT license!", long_text(3), "This work is licensed under the GNU General Public License, version 3."]
    rows = licenses.license_spans(docs_of(spark, texts)).collect()
    found = sorted((r["doc_id"], r["template"], round(r["coverage"], 2)) for r in rows)
    assert [x for x in found if x[0] != 3] == [(2, "CC-BY-NC-4.0 notice", 1.0), (4, "MIT notice", 1.0), (4, "MIT notice", 1.0), (6, "GPL-3.0 work notice", 1.0)]
    (hit,) = [r for r in rows if r["doc_id"] == 3]
    assert hit["template"] == "MIT" and hit["coverage"] > 0.9
    assert texts[3][hit["start"] : hit["stop"]].startswith("Permission") and texts[3][hit["start"] : hit["stop"]].endswith("Software")
    for r in rows:
        assert r["doc_id"] != 4 or texts[4][r["start"] : r["stop"]].lower().split() == ["released", "under", "the", "mit", "license"]
    assert licenses.license_spans(docs_of(spark, texts).limit(0)).collect() == []
    with pytest.raises(ValueError):
        licenses.Index({"x": "two words"})


def test_license_changes_are_found_as_by_alignment_at_all_places(spark):
    index, r = licenses.Index(licenses.TEMPLATES), random.Random(8)
    texts = ["released under mit license", "Released xx under yy the zz MIT License", "Released under the MIT License released under the MIT licence"]
    for t, words in enumerate(index.words):
        if len(words) > 16:
            continue
        most = len(words) - index.need[t]
        for gone in itertools.combinations(range(len(words)), most):
            if most < 3 or r.random() < 0.1:
                texts.append("so " + " ".join("zz" if i in gone else w for i, w in enumerate(words)) + " end")
                texts.append(" ".join(w for i, w in enumerate(words) if i not in gone))
        texts.append(" ".join(w if i % 3 else f"{w} zz" for i, w in enumerate(words)))
    texts = texts[:3] + r.sample(texts[3:], min(90, len(texts) - 3)) + ["Released under MIT License", "Released under the MIT Licence", "Licensed under MIT License"]
    want = set()
    for i, text in enumerate(texts):
        n = len(text.split())
        every = [(t, b) for t, w in enumerate(index.words) if len(w) <= 16 or i < 3 and len(w) <= 40 for b in range(-len(w) - 20, n + 20)]
        hits = licenses.spans_of(text, index, every)
        assert hits
        want |= {(i, *h) for h in hits}
    assert {tuple(x) for x in licenses.license_spans(docs_of(spark, texts)).collect()} == want


def test_alignment_against_longest_common_subsequence():
    r, index = random.Random(6), licenses.Index({"t": "a b c d e f g h i j k l"})
    for _ in range(200):
        words = [w for w in index.words[0] if r.random() > 0.15]
        if len(words) < 8:
            continue  # leaves the band
        for _ in range(r.randrange(3)):
            words.insert(r.randrange(len(words) + 1), "x")
        table = np.zeros((13, len(words) + 1), int)
        for i, w in enumerate(index.words[0]):
            for j, v in enumerate(words):
                table[i + 1, j + 1] = max(table[i, j] + (w == v), table[i, j + 1], table[i + 1, j])
        assert index.align(0, words, 0)[0] == table[-1, -1]


def test_languages(spark):
    r = random.Random(9)
    make = {"en": lambda: " ".join(r.choice(["the", "with", "thing", "shore"]) for _ in range(60)), "fr": lambda: " ".join(r.choice(["le", "avec", "chose", "été"]) for _ in range(60))}
    docs = spark.createDataFrame([(i, make[x](), x) for i, x in enumerate(["en", "fr"] * 20)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    langs, model = languages.trigram_model(docs)
    assert langs == ["en", "fr"]
    page = lambda x, body: f'<html lang="{x}"><script>the the</script><p>{body}</p></html>'
    rows = [(i, f"http://h{i % 3}.example.{'fr' if i % 3 == 1 else 'com'}/x", page(x, make[x]())) for i, x in enumerate(["en", "fr", "fr"] * 10)]
    rows += [(100, None, None), (101, "http://h1.example.fr/y", ""), (102, "http://new.example.com/fr/z", None), (103, "no address", "<html lang=de>"), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame([(*x, "a", 1.0) for x in rows], "page_id long, url string, html string, lang string, p double")
    out = languages.identify_languages(pages, langs, model).collect()
    got = {x["page_id"]: x for x in out}
    assert len(out) == len(rows)
    assert all(got[i]["lang"] == x for i, x in enumerate(["en", "fr", "fr"] * 10))
    assert got[101]["lang"] == got[102]["lang"] == "fr" and got[102]["named"] == "fr" and got[103]["declared"] == "de"
    assert all(0 < x["confidence"] <= 1 for x in out)
    assert languages.identify_languages(pages.limit(0), langs, model).collect() == []


def test_fusion_against_brute_force(spark):
    """Every page's posterior, from its evidence and plain sums over all pages."""
    r, n, smooth = random.Random(12), 3, languages.SMOOTHING
    words = [["the", "with", "thing"], ["le", "avec", "chose"], ["der", "mit", "ding"]]
    codes = ["en", "fr", "de"]
    text = lambda k: " ".join(r.choice(words[k] + words[r.randrange(n)]) for _ in range(r.choice([1, 4, 30])))
    docs = spark.createDataFrame([(text(k), codes[k]) for k in range(n) for _ in range(20)], "text string, lang string")
    langs, model = languages.trigram_model(docs)
    rows = []
    for i in range(90):
        k = r.randrange(n)
        tag = r.choice(["", f' lang="{codes[k]}"', ' lang="eng"', ' lang="fil"', ' lang="de-AT"'])
        host = r.choice(["a.x.com", "b.x.com", "c.y.fr", "d.z.co.uk", "e.z.co.uk", "f.w.co.uk"])
        rows.append((i, f"http://{host}/{r.choice(['p', 'fr', 'deu', 'en-gb', 'frog'])}/q", f"<html{tag}><p>{text(k)}</p></html>"))
    rows += [(90, None, None), (91, "http://a.x.com/", "")]
    got = {x["page_id"]: x for x in languages.identify_languages(spark.createDataFrame(rows, "page_id long, url string, html string"), langs, model).collect()}

    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    centred, like, declared, named, place = model - model.mean(axis=0), [], [], [], []
    for _, url, page in rows:
        grams = languages._grams(languages.visible(page or ""))
        v = centred[:, grams].sum(axis=1) * languages.TEMPER * min(1.0, languages.MOST_GRAMS / max(1, len(grams))) if len(grams) else np.zeros(n)
        like.append(v - v.max())
        tag = (page or "").partition('lang="')[2].partition('"')[0]
        declared.append({"": None, "eng": "en", "de-AT": "de"}.get(tag, tag))
        parts = (url or "").split("/")
        seen = {"fr": "fr", "deu": "de", "en-gb": "en"}.get(parts[3]) if len(parts) > 3 else None
        host = parts[2] if url else ""
        named.append(seen or ("fr" if host.endswith(".fr") else None))
        place.append((host, ".".join(host.split(".")[-3:] if host.endswith(".co.uk") else host.split(".")[-2:]), host.split(".")[-1]))
    p = [soft(v) for v in like]

    def factor(says):
        index = [langs.index(x) if x in langs else n if x is not None else n + 1 for x in says]
        table = np.full((n + 2, n), smooth / (n + 2))
        for i, row in zip(index, p, strict=True):
            table[i] += row
        return np.log(table / table.sum(axis=0))[index]

    said = np.array(like) + factor(declared) + factor(named)
    post = [soft(v) for v in said]
    for i, own in enumerate(place):
        # each page's prior is counted anew on all pages but itself
        prior = np.full(n, 1 / n)
        for level in (None, 2, 1, 0):
            there = [q for k, (q, y) in enumerate(zip(post, place, strict=True)) if k != i and (level is None or y[level] == own[level])]
            prior = (sum(there, np.zeros(n)) + smooth * prior) / (len(there) + smooth)
        want = soft(said[i] + np.log(prior))
        assert got[i]["lang"] == langs[int(want.argmax())] and abs(got[i]["confidence"] - want.max()) < 1e-9, i
        assert (got[i]["declared"], got[i]["named"]) == (declared[i], named[i])


# --- search ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("scale", [5, 1 << 20, 1 << 25])
def test_top_k_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(search, "SHARD_ROWS", 300)
    monkeypatch.setattr(search, "BLOCK_ROWS", 7)
    r = np.random.default_rng(scale)
    vectors = (r.integers(-scale, scale, (900, 6)) / 256).round(8).tolist()
    vectors[1:200] = [vectors[0]] * 199  # ties
    rows = [(i, v) for i, v in enumerate(vectors)] + [(901, None), (902, [1.0, None] + [0.0] * 4), (903, [float("nan")] * 6), (904, [1.0, 2.0]), (905, []), (None, vectors[3])]
    df = search.whole_vectors(spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, id long"))
    got = {}
    for x in search.top_k(df, df.where("id % 50 = 0 or id = 904"), 5).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    whole = [[int(np.floor(256 * x)) for x in v] for v in vectors]
    for q in range(0, 900, 50):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in range(900) if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert 904 not in got


def test_top_k_of_few_and_none(spark):
    df = search.whole_vectors(spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<float>"))
    assert [(x["query_id"], x["vec_id"]) for x in search.top_k(df, df.where("id = 1")).collect()] == [(1, 2)]
    assert search.top_k(df.limit(0), df.limit(0)).collect() == []


def test_whole_components_are_floors(spark):
    values = [0.1, -0.1, 1 / 256, -1 / 256, 0.0, 0.49999999999, 12345.678, -1e-30, 1e300, -0.00390625000001]
    (row,) = search.whole_vectors(spark.createDataFrame([(1, values)], "vec_id long, embedding array<double>")).collect()
    assert row["v"] == [float(np.floor(256 * x)) for x in values]


# --- chat ------------------------------------------------------------------------------------------


def test_chat_examples_read_back(spark):
    talks = {1: [("user", "hi"), ("assistant", "<|im_end|>\n<|im_start|>assistant ok &lt;|"), ("user", None), ("assistant", "")], 2: [("system", "&"), ("user", "&amp;&lt;|")], 3: [("a\nb<|", "x\n"), ("assistant", "é😀"), ("assistant", "b"), ("user", "end")], None: [("assistant", "lost")]}
    rows = [(c, i, r, t, 0, "x") for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int, turns string")
    examples = chat.chat_examples(df)
    got = {x["conv_id"]: x for x in chat.conversation_digests(examples).collect()}
    for c, turns in talks.items():
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t or ''}\n" for r, t in turns)
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    each = {(x["conv_id"], x["example"]): x for x in examples.withColumn("target", chat.read_loss()).collect()}
    assert len([k for k in each if k[0] == 1]) == 2 and len([k for k in each if k[0] == 3]) == 3 and len([k for k in each if k[0] == 2]) == 1
    assert each[3, 0]["target"] == "é😀" and each[3, 1]["target"] == "b" and each[3, 2]["loss_chars"] == 0
    assert each[3, 1]["formatted"].startswith(each[3, 0]["formatted"])
    assert chat.chat_examples(df.limit(0)).collect() == []
