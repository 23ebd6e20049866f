"""Controlled damage to texts, on token arrays, with draws from hashes. All native expressions."""

from __future__ import annotations

from array import array
from math import erf, sqrt

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.draws import below, order_key, unit
from lamina.functions.ordering import small_batches
from lamina.functions.text import edit_budget, tokens

WORD = r"\p{L}(?:[\p{L}\p{M}]|['’](?=\p{L}))*"

#: Cumulative chances (of 10^6) of span lengths 0, 1, 2, ... by a Poisson law of mean 5.
_POISSON = (6738, 40428, 124652, 265026, 440493, 615961, 762183, 866628, 931906, 968172, 986305, 994547, 997981, 999302, 999774, 999931)


def _span(draw: Column, n: Column, least: int) -> Column:
    """min(n, max(least, Poisson(5))) of a draw below 10^6."""
    k = F.lit(len(_POISSON))
    for i in reversed(range(len(_POISSON))):
        k = F.when(draw < _POISSON[i], i).otherwise(k)
    return F.least(n, F.greatest(F.lit(least), k)).cast("int")


def _deletion(df: DataFrame, key: tuple) -> DataFrame:
    w, n = F.col("__w"), F.col("__n")
    df = df.withColumn("__d", below(1_000_000, "deletion-length", *key)).withColumn("__k", _span(F.col("__d"), n, 1))
    df = df.withColumn("__a", below(F.greatest(n - F.col("__k") + 1, F.lit(1)), "deletion-start", *key).cast("int"))
    out = F.concat(F.slice(w, F.lit(1), F.col("__a")), F.slice(w, F.col("__a") + F.col("__k") + 1, n))
    return df.withColumn("__c", F.when((n > F.col("__k")) & (n > 1), out))


def _repetition(df: DataFrame, key: tuple) -> DataFrame:
    w, n = F.col("__w"), F.col("__n")
    df = df.withColumn("__d", below(1_000_000, "repetition-length", *key)).withColumn("__k", _span(F.col("__d"), n, 1))
    df = df.withColumn("__b", below(F.greatest(n - F.col("__k") + 1, F.lit(1)), "repetition-source", *key).cast("int")).withColumn("__a", below(F.greatest(n, F.lit(1)), "repetition-start", *key).cast("int"))
    out = F.concat(F.slice(w, F.lit(1), F.col("__a")), F.slice(w, F.col("__b") + 1, F.col("__k")), F.slice(w, F.col("__a") + 1, n))
    return df.withColumn("__c", F.when(n > 0, out))


def _shuffle(df: DataFrame, key: tuple) -> DataFrame:
    w, n = F.col("__w"), F.col("__n")
    df = df.withColumn("__d", below(1_000_000, "shuffle-length", *key)).withColumn("__k", _span(F.col("__d"), n, 2))
    df = df.withColumn("__a", below(F.greatest(n - F.col("__k") + 1, F.lit(1)), "shuffle-start", *key).cast("int"))
    df = df.withColumn("__s", F.slice(w, F.col("__a") + 1, F.col("__k")))
    mixed = F.array_sort(F.transform("__s", lambda x, i: F.struct(order_key("shuffle", i, *key).alias("k"), x.alias("w"))))
    out = F.concat(F.slice(w, F.lit(1), F.col("__a")), F.transform(mixed, lambda x: x["w"]), F.slice(w, F.col("__a") + F.col("__k") + 1, n))
    return df.withColumn("__c", F.when(n > 1, out))


def _swap(df: DataFrame, key: tuple) -> DataFrame:
    w, n, a = F.col("__w"), F.col("__n"), F.col("__a")
    df = df.withColumn("__a", below(F.greatest(n - 1, F.lit(1)), "swap", *key).cast("int"))
    out = F.concat(F.slice(w, F.lit(1), a), F.reverse(F.slice(w, a + 1, F.lit(2))), F.slice(w, a + 3, n))
    return df.withColumn("__c", F.when(n > 1, out))


def _typo(df: DataFrame, key: tuple) -> DataFrame:
    long_ = F.filter(F.transform("__w", lambda x, i: F.struct(i.alias("i"), x.alias("w"))), lambda x: x["w"].rlike(r"\p{L}{4}"))
    df = df.withColumn("__l", long_).withColumn("__p", F.get("__l", below(F.greatest(F.size("__l"), F.lit(1)), "typo-word", *key).cast("int")))
    word, at, kind = F.col("__p.w"), F.col("__a"), F.col("__d")
    df = df.withColumn("__a", (below(F.greatest(F.length(word) - 1, F.lit(1)), "typo-place", *key) + 1).cast("int")).withColumn("__d", below(3, "typo-kind", *key))
    head, tail = F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.length(word))
    one, two = F.substring(word, at, F.lit(1)), F.substring(word, at + 1, F.lit(1))
    new = F.when(kind == 0, F.concat(head, tail)).when(kind == 1, F.concat(head, one, one, tail)).otherwise(F.concat(head, two, one, F.substring(word, at + 2, F.length(word))))
    i = F.col("__p.i")
    out = F.concat(F.slice("__w", F.lit(1), i), F.array(new), F.slice("__w", i + 2, F.col("__n")))
    return df.withColumn("__c", F.when(F.size("__l") > 0, out))


#: deletion: a span of words goes (not all). repetition: a copy of a span stands before another place.
#: shuffle: a span's words in another order. swap: two neighbours exchanged. typo: one letter of a word
#: of four letters or more deleted, doubled or exchanged with the next.
EDITS = {"deletion": _deletion, "repetition": _repetition, "shuffle": _shuffle, "swap": _swap, "typo": _typo}


def edited(df: DataFrame, edit: str, *key, text_col: str = "text", name: str = "edited", words: str | None = None) -> DataFrame:
    """df with the edited text, words joined by single spaces; null where the edit changes nothing or
    can't be done. Draws come from hashes of key (columns or values). Steps are columns of their own, so
    each is computed once. `words` names a column with the text's `tokens`, where several edits share it."""
    if edit not in EDITS:
        raise ValueError(f"unknown edit {edit!r}")
    out = EDITS[edit](df.withColumn("__w", F.col(words) if words else tokens(text_col)).withColumn("__n", F.size("__w")), key)
    # words have no white space and aren't empty, so texts differ where the words do
    return out.withColumn(name, F.when(F.col("__c") != F.col("__w"), F.array_join("__c", " "))).select(*[c for c in df.columns if c != name], name)


def clusters(word: Column) -> Column:
    """A word's characters as they are read: with their marks and joined parts, flags and syllables whole."""
    return F.regexp_extract_all(word, F.lit(r"\X"), F.lit(0))


def grapheme_typo(df: DataFrame, *key, text_col: str = "text", name: str = "edited") -> DataFrame:
    """df with a typing error in one word: a letter deleted, doubled, put before another one (drawn from the text's own letters)
    or exchanged with the next letter of its word (the last one with the letter before). Letters are whole clusters. The word is drawn
    from those of four letters or more, else from those of two, else from those of one. Words are joined by single spaces; null where
    there is no letter or nothing changes."""
    is_letter = lambda c: c.rlike(r"\A\p{L}")
    out = df.withColumn("__w", F.transform(tokens(F.coalesce(F.col(text_col), F.lit(""))), clusters))
    places = lambda w: F.filter(F.transform(w, lambda c, i: F.when(is_letter(c), i)), lambda i: i.isNotNull())
    out = out.withColumn("__n", F.transform("__w", lambda w: F.size(F.filter(w, is_letter))))
    out = out.withColumn("__least", F.when(F.exists("__n", lambda n: n >= 4), 4).when(F.exists("__n", lambda n: n >= 2), 2).otherwise(1))
    out = out.withColumn("__own", F.filter(F.transform("__n", lambda n, i: F.when(n >= F.col("__least"), i)), lambda i: i.isNotNull())).withColumn("__letters", F.filter(F.flatten("__w"), is_letter))
    some = lambda c, what: F.get(c, below(F.greatest(F.size(c), F.lit(1)), what, *key).cast("int"))
    out = out.withColumn("__at", some(F.col("__own"), "grapheme-word")).withColumn("__c", F.get("__w", F.col("__at"))).withColumn("__p", places(F.col("__c")))
    out = out.withColumn("__k", below(F.greatest(F.size("__p"), F.lit(1)), "grapheme-place", *key).cast("int")).withColumn("__new", some(F.col("__letters"), "grapheme-letter"))
    i, c = F.get("__p", F.col("__k")), F.col("__c")
    j = F.coalesce(F.get("__p", F.col("__k") + 1), F.get("__p", F.greatest(F.col("__k") - 1, F.lit(0))))
    out = out.withColumns({"__i": i, "__j": j, "__kind": below(4, "grapheme-kind", *key)})
    a, b, kind = F.col("__i"), F.col("__j"), F.col("__kind")
    head, tail, one = F.slice(c, F.lit(1), a), F.slice(c, a + 2, F.size(c)), F.array(F.get(c, a))
    moved = F.transform(c, lambda x, n: F.when(n == a, F.get(c, b)).when(n == b, F.get(c, a)).otherwise(x))
    word = F.when(kind == 0, F.concat(head, tail)).when(kind == 1, F.concat(head, one, one, tail)).when(kind == 2, F.concat(head, F.array("__new"), one, tail)).otherwise(moved)
    join = lambda ws: F.array_join(F.filter(ws, lambda w: w != ""), " ")
    out = out.withColumn("__new_word", F.array_join(word, "")).withColumn("__words", F.transform("__w", lambda w: F.array_join(w, "")))
    made = join(F.transform("__words", lambda w, n: F.when(n == F.col("__at"), F.col("__new_word")).otherwise(w)))
    out = out.withColumn("__made", made)
    return out.select(*[x for x in df.columns if x != name], F.when(F.col("__made") != join(F.col("__words")), F.col("__made")).alias(name))


#: Edits of one text at most.
MOST_EDITS = 5


def count_chances(most: int) -> list[float]:
    """Chances of 1, ..., most edits by a normal law of mean (1 + most) / 2 and deviation (most - 1) / 6 of which
    only draws from 1 to most count, rounded (halves up)."""
    if most == 1:
        return [1.0]
    mean, deviation = (1 + most) / 2, (most - 1) / 6
    below_ = lambda x: erf((min(max(x, 1.0), float(most)) - mean) / deviation / sqrt(2)) / 2
    whole = below_(most) - below_(1)
    return [(below_(k + 0.5) - below_(k - 0.5)) / whole for k in range(1, most + 1)]


def edit_count(most: Column, *key) -> Column:
    """A number of edits from 1 to `most` (MOST_EDITS at most) by the law of `count_chances`, drawn from one
    uniform number by its cumulative chances."""
    draw, out = unit("edits", *key), F.lit(None).cast("int")
    for m in range(1, MOST_EDITS + 1):
        upto, pick = 0.0, F.lit(m)
        steps = []
        for k, chance in enumerate(count_chances(m), 1):
            upto += chance
            steps.append((k, upto))
        for k, top in reversed(steps[:-1]):
            pick = F.when(draw < top, k).otherwise(pick)
        out = F.when(most == m, pick).otherwise(out)
    return out.cast("int")


def drawn_edit_count(text: Column | str, *key) -> Column:
    """A number of edits from 1 to what the text can bear, each equally likely."""
    return (1 + below(edit_budget(text), "edit-count", *key)).cast("int")


#: Texts whose words are Python objects at once.
SPANS_ROWS = 64


def word_spans(text: Column | str) -> Column:
    """Words of letters, with marks and inner apostrophes, as an array of struct(start, end, word); places
    are code points from 0, `end` is after the word. No expression has the places of all matches in linear
    time, so this is an Arrow function. It writes places and words to flat columns, SPANS_ROWS texts at a time, and
    the session's Arrow batches are cut: a Python object for each word would take some 2 GB in a worker."""
    small_batches(SparkSession.active())
    find = regex.compile(WORD).finditer
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("word", pa.string())])

    def some(texts: pa.Array) -> pa.Array:
        starts, ends, words, upto = array("i"), array("i"), [], array("i", [0])
        for text in texts:
            for m in find(text.as_py() or ""):
                starts.append(m.start())
                ends.append(m.end())
                words.append(m[0])
            upto.append(len(words))
        values = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(words, pa.string())], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), values, mask=texts.is_null())

    @F.arrow_udf("array<struct<start:int,end:int,word:string>>")
    def spans(texts: pa.Array) -> pa.Array:
        out = [some(texts.slice(at, SPANS_ROWS)) for at in range(0, len(texts), SPANS_ROWS)]
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(kind))

    return spans(text if isinstance(text, Column) else F.col(text))


def focused(spans: Column, start: Column, end: Column, radius: Column | int = 0) -> Column:
    """Of the words (a column that `word_spans` made before) those that overlap the focus from start to end, with `radius`
    words more on either side; the nearest word where none overlaps (of equals the first); all words without
    a focus (both null)."""
    low, high = F.greatest(F.coalesce(start, F.lit(0)), F.lit(0)), F.greatest(F.coalesce(end, start, F.lit(0)), F.lit(0))
    low, high = F.least(low, high), F.greatest(low, high)
    marked = F.transform(spans, lambda s, i: F.struct(((s["end"] > low) & (s["start"] < high)).alias("hit"), F.abs(s["start"] + s["end"] - low - high).alias("off"), i.alias("at")))
    hits = F.transform(F.filter(marked, lambda m: m["hit"]), lambda m: m["at"])
    nearest = F.array_min(F.transform(marked, lambda m: F.struct(m["off"], m["at"])))["at"]
    first, last = F.coalesce(F.array_min(hits), nearest), F.coalesce(F.array_max(hits), nearest)
    r = F.greatest(radius if isinstance(radius, Column) else F.lit(radius), F.lit(0))
    some = F.filter(spans, lambda s, i: (i >= first - r) & (i <= last + r))
    return F.when(start.isNull() & end.isNull(), spans).otherwise(some)


def replaced(text: Column, spans: Column) -> Column:
    """text with new words at some places: spans is an array of struct(start, end, word), places from 0 in the text as
    it is, without overlaps, in any order. Later places are replaced first, so the others stay where they are."""
    late = F.reverse(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["word"].alias("word")))))
    return F.aggregate(late, text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), s["word"], F.substring(t, s["end"] + 1, F.length(t))))


def case_like(word: Column, model: Column) -> Column:
    """word in the case of another: all capitals (of more than one letter), a first capital, or as it is."""
    return F.when((model == F.upper(model)) & (model != F.lower(model)) & (F.length(model) > 1), F.upper(word)).when(F.left(model, F.lit(1)) != F.lower(F.left(model, F.lit(1))), F.concat(F.upper(F.left(word, F.lit(1))), F.substring(word, F.lit(2), F.length(word)))).otherwise(word)
