"""Token alignment, Merkle manifest and suffix arrays against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from lamina.llm import alignment
from tests.llm.test_llm import ODD, docs_of, long_text

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def bytes_of_a():
    """Bytes of A's ids, from the rank file of the same vocabulary."""
    import base64

    lines = (line.split() for line in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))
    return {int(i): base64.b64decode(t) for t, i in lines}


def aligned(texts):
    """Columns of every text, by whole texts and quadratic loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, known = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), bytes_of_a()
    a.encode_special_tokens = True
    of_b = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    rows, held = [], defaultdict(set)
    for doc, text in enumerate(texts):
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bx, by = [known[i] for i in x], [of_b(b.id_to_piece(i)) for i in y]
        if text and not b"".join(bx) == b"".join(by) == (" " + text).encode():
            x = y = bx = by = []
        ends = [{sum(map(len, side[: k + 1])) for k in range(len(side))} for side in (bx, by)] if len(x) < 500 else [set(__import__("itertools").accumulate(map(len, side))) for side in (bx, by)]
        both = sorted(ends[0] & ends[1]) if x else []
        groups, i, j, at_x, at_y = [], 0, 0, 0, 0
        for end in both:
            group = [], []
            while at_x < end:
                group[0].append(x[i])
                at_x += len(bx[i])
                i += 1
            while at_y < end:
                group[1].append(y[j])
                at_y += len(by[j])
                j += 1
            groups.append(group)
        links = [(p, q) for g, h in groups for p in g for q in h]
        for pair in links:
            held[pair].add(doc)
        rows.append((len(x), len(y), groups, links))
    most = Counter()
    for (p, _), docs in held.items():
        most[p] = max(most[p], len(docs))
    out = []
    for n_a, n_b, groups, links in rows:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(len(held[p]) == most[p[0]] for p in links), sum(len(held[p]) for p in links), text))
    return out


@pytest.mark.parametrize("hot", [alignment.HOT, 3, 0])
def test_alignment_is_that_of_whole_texts(spark, hot):
    r = random.Random(5)
    parts = ["a", "e", "the", "ing", " ", "  ", "▁", "\n", "é", "中文", "😀", "\x00", "<s>", "</s>", "<|endoftext|>", "9", ".", "aaaa", " ", " ", "\x1c", "\t", "don't", "ı́", "ﬁ", "<0x41>", "Ünï"]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(250)] + ["the same"] * 20 + ["a" * 3000, " " * 100, "中" * 300, long_text(9)]
    rows = alignment.align_tokens(docs_of(spark, texts), A, B, hot=hot).collect()
    want = aligned(texts)
    assert len(rows) == len(texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in rows}
    for doc, expected in enumerate(want):
        assert got[doc] == expected, texts[doc]
    assert sum(w[2] > 0 for w in want) > 150 and any(t and w[2] == 0 for t, w in zip(texts, want, strict=True))


def test_words_that_are_forgotten_are_encoded_again(monkeypatch):
    monkeypatch.setattr(alignment, "MEMORY", 40)
    r = random.Random(6)
    both = alignment.Aligner(A, B)
    texts = [" ".join(r.choice(["the", "of", f"w{r.randrange(500)}", "x\t", "", "é "]) for _ in range(20)) or "a" for _ in range(60)]
    for text in texts:
        words = both.words(" " + text)
        assert words == both._cut(" " + text) and "".join(words) == " " + text
        known = both.interned(set(words))
        assert [both.names[k] for w in words for k in known[w]] == both.groups(text)


def test_alignment_of_odd_tables(spark):
    assert alignment.align_tokens(docs_of(spark, []), A, B).collect() == []
    rows = alignment.align_tokens(docs_of(spark, [(7, "a word"), (7, "a word"), (7, "other"), (None, "a word"), (None, None)]), A, B).collect()
    assert Counter(r["doc_id"] for r in rows) == {7: 3, None: 2}
    assert {r["count_sum"] for r in rows if r["groups"] and r["n_a"] == 2} == {6}  # two links in three documents each
    assert [tuple(r)[1:] for r in rows if not r["groups"]] == [(0, 0, 0, 0, 0, 0, "")]


def test_alignment_query(spark):
    from lamina.llm.queries import QUERIES

    rows = QUERIES["op12_token_alignment"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {d["doc_id"]: w for d, w in zip(docs, aligned([d["text"] for d in docs]), strict=True)}
    assert len(rows) == len(docs)
    for r in rows:
        *numbers, text = want[r["doc_id"]]
        assert tuple(r)[1:] == (*numbers, hashlib.sha256(text.encode()).hexdigest() if text else "")
