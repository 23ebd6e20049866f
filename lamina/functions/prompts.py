"""Prompts: specifications with declared variables, rubrics by task and aspect, rendering."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
KEYS = {"schema_version", "id", "version", "description", "required_variables", "messages", "metadata"}


class PromptError(ValueError):
    """A prompt's specification breaks a rule."""


@dataclass(frozen=True)
class Prompt:
    id: str
    version: str
    variables: tuple[str, ...]
    messages: tuple[tuple[str, str], ...]
    metadata: dict = field(default_factory=dict)

    def rendered(self, values: dict[str, Column | str]) -> Column:
        """The messages as an array of struct(role, content), each variable's column in its places. The values
        are exactly the declared variables; {{ and }} in a template are braces."""
        if set(values) != set(self.variables):
            raise PromptError(f"the prompt {self.id} has the variables {sorted(self.variables)}, not {sorted(values)}")

        def content(template: str) -> Column:
            parts = []
            for literal, name, _, _ in Formatter().parse(template):
                parts += [F.lit(literal)] if literal else []
                if name is not None:
                    v = values[name]
                    parts.append(F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("")))
            return F.concat(*parts) if parts else F.lit("")

        return F.array(*[F.struct(F.lit(role).alias("role"), content(text).alias("content")) for role, text in self.messages])


def _once(pairs: list[tuple]) -> dict:
    out: dict = {}
    for k, v in pairs:
        if k in out:
            raise PromptError(f"the key {k!r} is there twice")
        out[k] = v
    return out


def fields_of(template: str) -> set[str]:
    """Variables of a template: plain names only."""
    out = set()
    try:
        for _, name, spec, conversion in Formatter().parse(template):
            if name is None:
                continue
            if not name.isidentifier() or spec or conversion:
                raise PromptError(f"no plain variable: {name!r}")
            out.add(name)
    except ValueError as e:
        if isinstance(e, PromptError):
            raise
        raise PromptError(str(e)) from e
    return out


def read_prompt(text: str, schema_version: int = 1) -> Prompt:
    """A specification in JSON: no key twice and none unknown, an id and a version, messages with known roles, and
    as declared variables exactly those that the templates have."""
    try:
        doc = json.loads(text, object_pairs_hook=_once)
    except json.JSONDecodeError as e:
        raise PromptError(f"no JSON: {e}") from e
    if not isinstance(doc, dict) or set(doc) - KEYS:
        raise PromptError("a prompt is an object with known keys")
    if doc.get("schema_version") != schema_version:
        raise PromptError(f"the schema version is to be {schema_version}")
    for k in ("id", "version"):
        if not isinstance(doc.get(k), str) or not doc[k].strip():
            raise PromptError(f"{k} is to be a text")
    declared, messages = doc.get("required_variables"), doc.get("messages")
    if not isinstance(declared, list) or not all(isinstance(v, str) and v for v in declared) or len(set(declared)) != len(declared):
        raise PromptError("required_variables is to be a list of distinct names")
    if not isinstance(messages, list) or not messages:
        raise PromptError("messages is to be a list")
    found: set[str] = set()
    for m in messages:
        if not isinstance(m, dict) or set(m) != {"role", "content"} or m["role"] not in ROLES or not isinstance(m["content"], str):
            raise PromptError("a message has a known role and a content")
        found |= fields_of(m["content"])
    if found != set(declared):
        raise PromptError(f"declared variables {sorted(declared)}, those of the templates {sorted(found)}")
    return Prompt(doc["id"], doc["version"], tuple(declared), tuple((m["role"], m["content"]) for m in messages), doc.get("metadata") or {})


def load_prompt(spark: SparkSession, root: str, name: str) -> Prompt:
    """A specification in a file below root; a name that leads out of it is refused."""
    if name.startswith("/") or ".." in name.split("/"):
        raise PromptError(f"{name!r} isn't below the folder of prompts")
    return read_prompt(spark.read.text(f"{root}/{name}", wholetext=True).first()[0])


def rubrics(rows: DataFrame, task: str, aspect: str, mapping: dict[tuple[str, str], str], known: list[str], default: str) -> Column:
    """The name of the rubric for a task and an aspect (case and outer white space don't matter): the one that the
    pair is mapped to, if it is known; else the aspect's own, if known; else the default."""
    norm = lambda c: F.nullif(F.lower(F.trim(F.col(c).cast("string"))), F.lit(""))
    mapped = F.lit(None).cast("string")
    if pairs := {k: v for k, v in mapping.items() if v in known}:
        table = F.create_map(*[F.lit(x) for (t, a), v in pairs.items() for x in (f"{t.lower()}\x00{a.lower()}", v)])
        mapped = F.try_element_at(table, F.concat(norm(task), F.lit("\x00"), norm(aspect)))
    own = F.when(norm(aspect).isin([k.lower() for k in known]), norm(aspect)) if known else F.lit(None).cast("string")
    return F.coalesce(mapped, own, F.lit(default))


def rubric_text(criteria: list[tuple[str, str]]) -> str:
    return "\n".join(f"{i}. {name}: {text}" for i, (name, text) in enumerate(criteria, 1))


def with_overrides(table: DataFrame, overrides: DataFrame, on: list[str], value: str) -> DataFrame:
    """A table of prompts in which overrides (on, value) replace the value of their task and aspect; overrides of
    others are added."""
    new = overrides.select(*on, F.col(value).alias("__new"))
    return table.join(new, on, "full").withColumn(value, F.coalesce("__new", value)).select(*table.columns)
