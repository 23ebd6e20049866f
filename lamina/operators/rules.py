"""Rules of text damage as a table function: rows joined laterally with what each rule makes of them.

A rule is a function of a text that may give nothing, give the text back, or raise. None of these ends a job: each is a row with its
fault, so a rule that raises leaves all other rules' and rows' results as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("all", "first_success", "random_success")
#: Faults of a rule that doesn't raise (fixed values); for one that does it is the exception's type.
EMPTY, UNCHANGED = "empty_output", "unchanged_output"


@dataclass(frozen=True)
class Rule:
    """A rule of some languages (None: all). `change` gives the changed text."""

    name: str
    change: Callable[[str], str | None]
    languages: tuple[str, ...] | None = None

    def result(self, text: str) -> tuple[str | None, str | None]:
        """The changed text and what is wrong."""
        try:
            out = self.change(text)
        except Exception as e:
            return None, type(e).__name__
        if not isinstance(out, str) or not out.strip():
            return None, EMPTY
        return (None, UNCHANGED) if " ".join(out.split()) == " ".join(text.split()) else (out, None)


def chosen_rules(rules: Sequence[Rule], language: str | None) -> list[Rule]:
    """The rules of a language, in their order; without a language those of all languages."""
    return [r for r in rules if r.languages is None or language in r.languages]


def rule_results(rows: DataFrame, rules: Sequence[Rule], text: Column, language: Column | None = None, key: Column | None = None, mode: str = "all") -> DataFrame:
    """rows with place (from 0, in the order of trial), rule, output and fault, one row for each rule that was tried.

    mode: all rules of the row's language; in their order up to the first that changes the text; or so in an order
    drawn by `key`. fault is null where the rule changed the text, else empty_output, unchanged_output (but for white space) or
    the type of what it raised. A null text is tried as an empty one. A row without a rule for its language has no result.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("rules have names of their own")
    if mode == "random_success" and key is None:
        raise ValueError("a drawn order needs a key")
    known = tuple(rules)

    class Tried:
        def eval(self, text, language, key):
            own = chosen_rules(known, language)
            if mode == "random_success":
                own.sort(key=lambda r: hashlib.md5(f"rule:{key}:{r.name}".encode()).hexdigest())
            for place, rule in enumerate(own):
                out, fault = rule.result(text or "")
                yield place, rule.name, out, fault
                if fault is None and mode != "all":
                    return

    tried = F.udtf(Tried, returnType="place int, rule string, output string, fault string")
    none = F.lit(None).cast("string")
    given = (text, none if language is None else language, none if key is None else key.cast("string"))
    names = [f"__{n}" for n in ("text", "language", "key")]
    asked = rows.withColumns(dict(zip(names, given, strict=True)))
    return asked.lateralJoin(tried(*[F.col(n).outer() for n in names])).drop(*names)


def rule_failures(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, rule and fault with n: how often a rule failed in which way."""
    return results.where("fault is not null").groupBy(*(by or []), "rule", "fault").agg(F.count("*").alias("n"))


def rule_picks(rows: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """rows with rule and output of the first success (null: none), n_tried and n_failed; one row each."""
    best = results.groupBy(key).agg(F.min(F.when(F.col("fault").isNull(), F.struct("place", "rule", "output"))).alias("__b"), F.count("*").alias("n_tried"), F.count("fault").alias("n_failed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(best, key, "left").select(*rows.columns, F.col("__b.rule").alias("rule"), F.col("__b.output").alias("output"), zero("n_tried"), zero("n_failed"))
