"""Text functions as Spark columns. All stay in the JVM; lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 code points that Unicode text splitting takes for white space (fixed values).
WHITE_CLASS = r"\x09-\x0d\x1c-\x20\x85\xa0  -     　"
WHITE = f"[{WHITE_CLASS}]+"
#: A run of white space that isn't one plain space already: the first character isn't one, or more follow. Letters and
#: signs of ASCII are told off by the first range alone, before the class.
UNEVEN = f"[\\x00-\\x1f\\x7f-\\x{{10ffff}}&&[{WHITE_CLASS}]][{WHITE_CLASS}]*|\\x20[{WHITE_CLASS}]+"
EDGES = f"^[{WHITE_CLASS}]+|[{WHITE_CLASS}]+$"
THINK = r"(?is)<think>.*?</think>"

#: Names that mean one of the supported languages (fixed values).
LANGUAGES = {"en": "eng", "english": "eng", "eng": "eng", "de": "deu", "german": "deu", "deu": "deu", "da": "dan", "danish": "dan", "dan": "dan", "fi": "fin", "finnish": "fin", "fin": "fin", "fr": "fra", "french": "fra", "fra": "fra", "es": "spa", "spanish": "spa", "spa": "spa", "sv": "swe", "swedish": "swe", "swe": "swe"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalized(text: Column | str) -> Column:
    """Every run of white space as one space, none at the ends. Null stays null. Only runs that change are
    replaced: a replacement for each word costs many times as much as the search."""
    return F.btrim(F.regexp_replace(_c(text), UNEVEN, " "))


def cleaned(text: Column | str) -> Column:
    """Without white space at the ends; null is empty."""
    return F.regexp_replace(F.coalesce(_c(text), F.lit("")), EDGES, "")


def tokens(text: Column | str) -> Column:
    """Words between white space; none for an empty text, which is split to one empty word."""
    return F.array_remove(F.split(normalized(F.coalesce(_c(text), F.lit(""))), " "), "")


def token_count(text: Column | str) -> Column:
    return F.size(tokens(text))


def length_difference(a: Column | str, b: Column | str) -> Column:
    """|a - b| by the greater length, 1 at least."""
    x, y = F.length(_c(a)), F.length(_c(b))
    return F.abs(x - y) / F.greatest(x, y, F.lit(1))


def slug(text: Column | str, most: int = 40) -> Column:
    t = F.regexp_replace(_c(text), r"[^A-Za-z0-9._-]+", "-")
    t = F.regexp_replace(t, r"^[-._]+|[-._]+$", "")
    return F.when(t == "", "value").otherwise(F.left(t, F.lit(most)))


def shortened(text: Column | str, most: int, mark: str = "\n\n[TRUNCATED]") -> Column:
    """The first `most` characters and a mark, if there are more; most <= 0 leaves texts whole."""
    t = _c(text)
    return t if most <= 0 else F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit(mark))).otherwise(t)


def joined(context: Column | str, continuation: Column | str) -> Column:
    """Context and continuation with a space between, but none before closing punctuation."""
    a, b = cleaned(context), cleaned(continuation)
    tight = F.left(b, F.lit(1)).isin(*".,!?;:'\")]")
    return F.when(a == "", b).when(b == "", a).when(tight, F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))


def without_thought(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), THINK, "")


def judge_score(raw: Column | str, low: float = 1.0, high: float = 5.0) -> Column:
    """The score in a judge's answer, clamped to [low, high]; null if there is none.

    The answer, without a code fence and thoughts, is a JSON object with "score", or its outermost
    braces are; else a number that follows the word score and a colon or equals sign counts.
    """
    t = F.regexp_replace(cleaned(raw), r"(?is)^```(?:json)?\s*(.*?)\s*```$", "$1")
    t = cleaned(without_thought(t))
    inner = F.replace(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit("\n"), F.lit(""))
    whole = F.try_parse_json(t)
    object_ = F.when(F.schema_of_variant(whole).startswith("OBJECT"), whole).otherwise(F.try_parse_json(inner))
    is_object = F.coalesce(F.schema_of_variant(object_).startswith("OBJECT"), F.lit(False))
    by_json = F.try_variant_get(object_, "$.score", "string").try_cast("double")
    label = F.regexp_extract(without_thought(F.coalesce(_c(raw), F.lit(""))), r"""(?i)(?:"?score"?|\bscore\b)\s*[:=]\s*"?(-?[0-9]+(?:\.[0-9]+)?)""", 1)
    score = F.when(is_object, by_json).otherwise(label.try_cast("double"))
    return F.when(finite(score), F.least(F.greatest(score, F.lit(low)), F.lit(high)))


def rating(raw: Column | str, form: str = "any") -> Column:
    """The whole number from 1 to 5 after RESULT (in brackets or not, with or without a colon; form "result")
    or after "Rating:" ("rating"), outside thoughts; null if none. "any" takes the first form that is there."""
    t = without_thought(F.coalesce(_c(raw), F.lit("")))
    forms = {"result": r"(?i)(?:\[\s*RESULT\s*\]|\bRESULT\b)\s*:?\s*([1-5])\b", "rating": r"(?i)\bRating\s*:\s*([1-5])\b"}
    found = [F.regexp_extract(t, pattern, 1).try_cast("int") for name, pattern in forms.items() if form in (name, "any")]
    return F.coalesce(*found)


def yes_no(raw: Column | str) -> Column:
    """Yes, No or INVALID: after the last </think>, the last line if it is one of them, else the last of
    them that stands alone."""
    t = cleaned(F.element_at(F.split(cleaned(raw), "</think>", -1), -1))
    t = cleaned(F.regexp_replace(t, r"(?s)<think>.*?</think>", ""))
    lines = F.filter(F.transform(F.split(t, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: cleaned(x)), lambda x: x != "")
    last = F.lower(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")))
    alone = F.initcap(F.try_element_at(F.regexp_extract_all(t, F.lit(r"(?i)\b(yes|no)\b"), F.lit(1)), F.lit(-1)))
    return F.when(last.rlike(r"^yes[.!]?$"), "Yes").when(last.rlike(r"^no[.!]?$"), "No").otherwise(F.coalesce(alone, F.lit("INVALID")))


def language_code(name: Column | str) -> Column:
    """Three-letter code of a supported language name, by its first part if the whole is unknown; else null."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    key = F.lower(cleaned(name))
    return F.coalesce(F.try_element_at(table, key), F.try_element_at(table, F.split(key, "[-_]")[0]))


def genre(doc_id: Column | str) -> Column:
    """What a document id has before its first hyphen."""
    return F.split_part(_c(doc_id), F.lit("-"), F.lit(1))


def finite(x: Column | str) -> Column:
    x = _c(x).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def finite_or_null(x: Column | str) -> Column:
    return F.when(finite(x), _c(x).cast("double"))


def number(text: Column | str) -> Column:
    """A finite number in a text, else null."""
    return finite_or_null(F.trim(_c(text)).try_cast("double"))


def assessment(raw: Column | str) -> Column:
    """What a filter's JSON answer says: missing, malformed, inconsistent, passed or failed."""
    v = F.try_parse_json(_c(raw))
    decision = F.try_variant_get(v, "$.decision", "string")
    flag_kind = F.schema_of_variant(F.try_variant_get(v, "$.passes", "variant"))
    flag = F.try_variant_get(v, "$.passes", "boolean")
    well = F.coalesce(decision.isin("PASS", "FAIL") & (flag_kind == "BOOLEAN"), F.lit(False))
    return F.when(_c(raw).isNull(), "missing").when(~well, "malformed").when((decision == "PASS") != flag, "inconsistent").when(flag, "passed").otherwise("failed")


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def yes_probability(yes: Column | str, no: Column | str) -> Column:
    """The share of Yes by the logits of the two answers."""
    return sigmoid(_c(yes) - _c(no))


def higher_is_better(value: Column | str, kind: str) -> Column:
    """A score whose higher values are better: an error score is negated, a perplexity becomes minus its
    logarithm; scores and mean log likelihoods stay."""
    x = _c(value).cast("double")
    kinds = {"score": x, "log_likelihood": x, "error": -x, "perplexity": F.when(x > 0, -F.log(x))}
    if kind not in kinds:
        raise ValueError(f"unknown kind of score {kind!r}")
    return kinds[kind]


def edit_budget(text: Column | str, per: int = 500, most: int = 5) -> Column:
    """Edits that a text can bear: one for each `per` characters, 1 to `most`."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.length(_c(text)) / per))).cast("int")
