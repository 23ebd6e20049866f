"""Feature bundles of word forms (`V;IND;PRS;3;SG`) as bit sets, and what is compared of them.

A bundle's tags of the fixed table are bits of two numbers, all others an array in order; so marked dimensions are masks and
a similarity is three bit counts, within expressions. Nulls are bundles without tags; repeated tags count once, case doesn't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags by dimension (fixed values).
DIMENSIONS = {
    "part_of_speech": ("ADJ", "ADP", "ADV", "ART", "AUX", "CONJ", "DET", "INTJ", "N", "NUM", "PART", "PRO", "PRON", "PROPN", "V"),
    "person": ("1", "2", "3"),
    "number": ("SG", "PL", "DU", "TRI", "PAUC", "GRPL"),
    "gender": ("MASC", "FEM", "NEUT", "COM"),
    "tense": ("PRS", "PST", "FUT", "NPST", "RPST", "REMPST", "IMMEDPST", "HODPST", "REMFUT", "IMMEDFUT", "HODFUT"),
    "mood": ("ADM", "COND", "IMP", "IND", "INT", "JUS", "NEC", "OPT", "POT", "PURP", "SBJV", "SUBJ"),
    "aspect": ("HAB", "IPFV", "ITER", "PFV", "PRF", "PROG", "PROSP"),
    "voice": ("ACT", "ANTIP", "CAUS", "MID", "PASS", "RECP", "REFL"),
    "polarity": ("NEG", "POS"),
    "finite": ("FIN",),
    "nonfinite": ("GER", "INF", "NFIN", "PTCP", "SUP", "V.CVB", "V.GER", "V.INF", "V.MSDR", "V.PTCP"),
}
#: A tag in a bundle's text (fixed value): a name, or a person's digit that stands alone.
TAG = r"[A-Z][A-Z0-9_.-]*|(?<![A-Z0-9])[123](?![A-Z0-9])"
#: Points of a tag that both have, that only the present form has, that only the other one has (fixed values).
SHARED, LOST, GAINED = 5, -6, -2

AGREEMENT = ("person", "number", "gender")
_TAGS = [t for tags in DIMENSIONS.values() for t in tags]
_WIDTH = 60  # bits of a number
_WORDS = -(-len(_TAGS) // _WIDTH)


def _word(k: int) -> str:
    return f"b{k}"


def _mask(dimensions, k: int) -> Column:
    """The kth number's bits of some dimensions."""
    places = [i - k * _WIDTH for i, t in enumerate(_TAGS) if i // _WIDTH == k and any(t in DIMENSIONS[d] for d in dimensions)]
    return F.lit(sum(1 << p for p in places)).cast("long")


def tags(features: Column) -> Column:
    """The distinct tags of a bundle's text, in the order in which they come."""
    return F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(features, F.lit(""))), F.lit(TAG), 0))


def bundle(features: Column) -> Column:
    """struct of the numbers that hold the table's tags, `rest` (other tags in order) and `roots` (a number: parts of speech that a
    tag begins with up to its first dot)."""
    table = F.array(*[F.lit(t) for t in _TAGS])
    speech = F.array(*[F.lit(t) for t in DIMENSIONS["part_of_speech"]])
    found = tags(features)
    bit = lambda place, k: F.when(place.between(k * _WIDTH + 1, (k + 1) * _WIDTH), F.call_function("shiftleft", F.lit(1).cast("long"), (place - 1 - k * _WIDTH).cast("int"))).otherwise(F.lit(0).cast("long"))
    bits = lambda places, k: F.aggregate(places, F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(bit(p, k)))
    known = F.transform(found, lambda t: F.array_position(table, t))
    roots = F.transform(found, lambda t: F.array_position(speech, F.substring_index(t, ".", 1)))
    rest = F.array_sort(F.filter(found, lambda t: ~F.array_contains(table, t)))
    return F.struct(*[bits(known, k).alias(_word(k)) for k in range(_WORDS)], rest.alias("rest"), bits(roots, 0).alias("roots"))


def has_any(b: Column, *dimensions: str) -> Column:
    """Whether a bundle marks one of the dimensions."""
    return reduce(lambda x, y: x | y, [b[_word(k)].bitwiseAND(_mask(dimensions, k)) != 0 for k in range(_WORDS)])


def marked(b: Column, dimension: str) -> Column:
    """A bundle's tags of one dimension, joined by `+` in the table's order; null for none."""
    found = [F.when(b[_word(i // _WIDTH)].bitwiseAND(F.lit(1 << i % _WIDTH).cast("long")) != 0, F.lit(t)) for i, t in enumerate(_TAGS) if t in DIMENSIONS[dimension]]
    return F.nullif(F.concat_ws("+", *found), F.lit(""))


def part_of_speech(b: Column) -> Column:
    """The part of speech; where a bundle has several, the table's first. Null for none."""
    return F.coalesce(*[F.when(b["roots"].bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(t)) for i, t in enumerate(DIMENSIONS["part_of_speech"])])


def finite_verb(b: Column) -> Column:
    """A verb or auxiliary with a mark of finiteness, person, number, tense or mood, and no mark of a form that isn't finite
    (a tag that goes on behind such a mark, as V.PTCP.PRS does, is one)."""
    longer = F.exists(b["rest"], lambda t: t.rlike(r"^V\.(PTCP|CVB|INF|GER|MSDR)"))
    verb = part_of_speech(b).isin("V", "AUX")
    return F.coalesce(verb, F.lit(False)) & ~has_any(b, "nonfinite") & ~longer & has_any(b, "finite", "person", "number", "tense", "mood")


def agreement(b: Column) -> Column:
    """struct of the bundle's bits of person, number and gender: equal for forms that agree alike."""
    return F.struct(*[b[_word(k)].bitwiseAND(_mask(AGREEMENT, k)).alias(_word(k)) for k in range(_WORDS)])


def same_marked(current: Column, other: Column, *dimensions: str) -> Column:
    """Whether other has the same tags in each dimension that current marks."""
    same = lambda d: reduce(lambda x, y: x & y, [current[_word(k)].bitwiseXOR(other[_word(k)]).bitwiseAND(_mask([d], k)) == 0 for k in range(_WORDS)])
    return reduce(lambda x, y: x & y, [~has_any(current, d) | same(d) for d in dimensions], F.lit(True))


def similarity(current: Column, other: Column, *ignored: str) -> Column:
    """5 for each tag of both, -6 for one of current alone, -2 for one of other alone; ignored dimensions don't count."""
    both, lost, gained = [], [], []
    for k in range(_WORDS):
        core = F.bitwise_not(_mask(ignored, k)) if ignored else F.lit(-1).cast("long")
        x, y = current[_word(k)].bitwiseAND(core), other[_word(k)].bitwiseAND(core)
        both.append(F.bit_count(x.bitwiseAND(y)))
        lost.append(F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
        gained.append(F.bit_count(y.bitwiseAND(F.bitwise_not(x))))
    both.append(F.size(F.array_intersect(current["rest"], other["rest"])))
    lost.append(F.size(F.array_except(current["rest"], other["rest"])))
    gained.append(F.size(F.array_except(other["rest"], current["rest"])))
    total = lambda parts: reduce(lambda x, y: x + y, parts)
    return SHARED * total(both) + LOST * total(lost) + GAINED * total(gained)
