"""What generators answer: final texts out of completions, repaired JSON objects, response envelopes.

All are column expressions: where an answer's parts begin and end is found by patterns, and objects are read as variants.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Why a completion gives no text (fixed values).
EMPTY, ONLY_THOUGHT, UNREADABLE, CUT, ABORTED = "empty_output", "reasoning_only", "unparseable_output", "truncated_output", "engine_abort"
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRING = r'"(?:[^"\\\x00-\x1f]|\\.)*+"'


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{_SPACE}++|{_SPACE}+\z", "")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """What body makes of a value, which stands in the plan once however often body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _inside(text: Column, fence: str) -> Column:
    """What a fence around all of a text holds, the text where there is none."""
    return _once(text, lambda t: F.when(t.rlike(fence), _trimmed(F.regexp_extract(t, fence, 1))).otherwise(t))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("none"))


def completion(raw: Column, content: Column, finish: Column, thinking: bool = False) -> Column:
    """A struct of a model's completion: text (its final text), reason (why there is none), edits (a map of counts),
    edits_reported and cut (the text is whole, what follows it isn't).

    raw is all that the model wrote, content its final part where the engine tells them apart, finish why it
    stopped. What follows the first end of a thought counts, unless an object or a fence begins the answer and no thought is due; a
    fence around it goes; of a JSON object the field "text", even if the object is cut after that as its first field.
    reason: empty_output, reasoning_only, unparseable_output, truncated_output or engine_abort. Null raw and
    content are an empty output.
    """
    due = F.lit(thinking) | ~raw.rlike(rf"\A{_SPACE}*(?:\{{|```)")
    closed = due & F.contains(raw, F.lit("</think>"))
    thought = due & (F.lit(thinking) | F.contains(raw, F.lit("<think>"))) & ~closed & content.isNull()
    answer = F.coalesce(content, F.when(closed, F.get(F.split(raw, "</think>", 2), F.lit(1))).otherwise(raw))
    answer = _inside(_trimmed(answer), r"(?s)\A```(?:json|text)?\s*\n?(.*)```\z")
    asked = F.struct(answer.alias("answer"), F.coalesce(thought, F.lit(False)).alias("thought"), (raw.isNull() & content.isNull()).alias("nothing"), finish.alias("finish"))
    return _once(asked, lambda a: _once(_object_parts(a["answer"]), lambda o: _judged(a, o)))


def _object_parts(answer: Column) -> Column:
    """Whether an answer is an object, its text, and its counts with whether they are numbers."""
    first = F.try_parse_json(F.nullif(F.regexp_extract(answer, rf'\A\{{\s*"text"\s*:\s*({_STRING})', 1), F.lit("")))
    whole = F.from_json(answer, "text variant, applied_edits variant")  # what follows the object is not read

    def parts(w: Column) -> Column:
        value = F.coalesce(F.when(_kind(w["text"]) != "none", w["text"]), first)
        return F.struct(F.coalesce(F.startswith(answer, F.lit("{")), F.lit(False)).alias("is_object"), value.alias("value"), F.try_variant_get(w["applied_edits"], "$", "map<string,variant>").alias("counts"))

    def read(p: Column) -> Column:
        held = F.when(p["is_object"] & (_kind(p["value"]) == "STRING"), F.try_variant_get(p["value"], "$", "string"))
        whole_numbers = F.coalesce(F.forall(F.map_values(p["counts"]), lambda v: F.schema_of_variant(v) == "BIGINT"), F.lit(False))
        numbers = F.when(whole_numbers, F.transform_values(p["counts"], lambda _, v: F.try_variant_get(v, "$", "bigint")))
        return F.struct(p["is_object"].alias("is_object"), held.alias("held"), numbers.alias("numbers"))

    return _once(_once(whole, parts), read)


def _judged(a: Column, o: Column) -> Column:
    """The completion's struct, by the first reason that there is."""
    none = F.lit(None).cast("map<string,bigint>")
    text = F.when(o["is_object"], o["held"]).otherwise(a["answer"])
    reason = F.when(a["nothing"], EMPTY).when(a["thought"], ONLY_THOUGHT).when(o["is_object"] & o["held"].isNull(), UNREADABLE)
    reason = reason.when((a["finish"] == "length") & ~o["is_object"], CUT).when(a["finish"].isin("abort", "error"), ABORTED)
    kept = reason.isNull() & F.coalesce(o["held"].isNotNull() & F.forall(F.map_values(o["numbers"]), lambda n: n >= 0), F.lit(False))
    return F.struct(
        F.when(reason.isNotNull(), "").otherwise(text).alias("text"), F.when(reason.isNotNull(), reason).when(_trimmed(text) == "", EMPTY).alias("reason"), F.when(kept, o["numbers"]).otherwise(none).alias("edits"),
        kept.alias("edits_reported"), F.coalesce(reason.isNull() & o["is_object"] & (a["finish"] == "length"), F.lit(False)).alias("cut"),
    )


def _named_value(body: Column, field: str, fields: tuple[str, ...]) -> Column:
    """A field's value by its name alone, up to the next name, null without the name. Bare quotes, line breaks and unknown escapes in
    it are escaped first, so that what is left is read as one JSON string."""
    names = "|".join(map(re.escape, fields))
    pattern = rf'(?s)\A.*"{re.escape(field)}"\s*:(.*?)(?:"(?:{names})"\s*:.*)?\z'
    value = _trimmed(F.regexp_replace(_trimmed(F.regexp_extract(body, pattern, 1)), r",\z", ""))
    value = F.regexp_replace(value, r'(?s)\A"?(.*?)"?\z', "$1")
    value = F.regexp_replace(value, r'\\(?!u[0-9a-fA-F]{4}|["\\/bfnrt])(?<!\\\\)', r"\\\\")
    value = F.regexp_replace(value, r'(?<!\\)"', r'\\"')
    value = F.replace(F.replace(F.replace(value, F.lit("\n"), F.lit(r"\n")), F.lit("\r"), F.lit(r"\r")), F.lit("\t"), F.lit(r"\t"))
    found = F.try_parse_json(F.concat(F.lit('"'), value, F.lit('"')))
    return F.when(body.rlike(pattern), found)


def repaired_object(raw: Column, fields: tuple[str, ...] = ("prompt_sentence", "text")) -> Column:
    """A struct of the given string fields of a model's answer, and reason (no_object, missing_field, not_a_string, empty_field; null
    if all are there).

    Read is the first of these that is an object: the answer without thoughts and fence; the part from its first to its last brace;
    that part with a closing brace where it has none; else the fields' values are taken by their names.
    """

    def braced(text: Column) -> Column:
        start, end = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
        ends = F.contains(text, F.lit("}")) & (end > start)
        part = F.when(ends, F.substring(text, start, end - start + 1)).otherwise(_trimmed(F.substring(text, start, F.length(text))))
        return F.struct(text.alias("text"), (start > 0).alias("begins"), ends.alias("ends"), part.alias("part"))

    def read(p: Column) -> Column:
        as_object = lambda t: _once(F.try_parse_json(t), lambda v: F.when(F.startswith(_kind(v), F.lit("OBJECT")), v))
        closed = F.when(p["begins"], F.when(p["ends"], p["part"]).otherwise(F.concat(p["part"], F.lit("}"))))
        body = F.substring(p["part"], F.lit(2), F.length(p["part"]) - F.when(p["ends"], 2).otherwise(1))
        return F.struct(F.coalesce(as_object(p["text"]), as_object(closed)).alias("object"), body.alias("body"), p["begins"].alias("begins"))

    def values(r: Column) -> Column:
        own = lambda f: F.when(r["object"].isNotNull(), F.try_variant_get(r["object"], f"$['{f}']", "variant")).otherwise(_named_value(r["body"], f, fields))
        return F.struct((r["object"].isNull() & ~r["begins"]).alias("__no_object"), *[own(f).alias(f) for f in fields])

    def checked(v: Column) -> Column:
        kinds = F.array(*[_kind(v[f]) for f in fields])
        out = {f: _trimmed(F.when(_kind(v[f]) == "STRING", F.try_variant_get(v[f], "$", "string"))) for f in fields}
        return F.struct(v["__no_object"].alias("__no_object"), kinds.alias("__kinds"), *[c.alias(f) for f, c in out.items()])

    def judged(c: Column) -> Column:
        reason = F.when(c["__no_object"], "no_object").when(F.array_contains(c["__kinds"], "none"), "missing_field").when(F.exists(c["__kinds"], lambda k: k != "STRING"), "not_a_string")
        reason = reason.when(F.exists(F.array(*[c[f] for f in fields]), lambda x: x == ""), "empty_field")
        return F.struct(*[F.when(reason.isNull(), c[f]).alias(f) for f in fields], reason.alias("reason"))

    text = _inside(_trimmed(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?is)<think>.*?</think>", "")), r"(?s)\A```(?:json|JSON)?\s*(.*?)\s*```\z")
    return _once(_once(_once(_once(_once(text, braced), read), values), checked), judged)


def _strings(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def response_text(response: Column | str) -> Column:
    """The text of a batch service's response in JSON, null if none is found: a string field "text" or
    "output_text"; the parts of all candidates, or the text contents of all outputs, one after another; a string
    field "content" or "message"."""
    v = F.try_parse_json(F.col(response) if isinstance(response, str) else response)
    is_text = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", _strings(v, path, "string"))
    candidates = _strings(v, "$.candidates", "array<struct<content:struct<parts:array<struct<text:string>>>>>")
    none = F.array().cast("array<struct<text:string>>")
    parts = F.flatten(F.transform(candidates, lambda c: F.coalesce(c["content"]["parts"], none)))
    google = F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), "")
    outputs = _strings(v, "$.output", "array<struct<content:array<struct<type:string,text:string>>>>")
    blank = F.array().cast("array<struct<type:string,text:string>>")
    contents = F.filter(F.flatten(F.transform(outputs, lambda o: F.coalesce(o["content"], blank))), lambda c: c["type"].isin("output_text", "text"))
    some = F.when(F.exists(parts, lambda p: p["text"].isNotNull()), google)
    return F.coalesce(is_text("$.text"), is_text("$.output_text"), some, F.try_element_at(contents, F.lit(1))["text"], is_text("$.content"), is_text("$.message"))


def response_key(row: Column | str) -> Column:
    """The request's key in a response row: key or custom_id, else that of its metadata or request."""
    v = F.try_parse_json(F.col(row) if isinstance(row, str) else row)
    paths = ("$.key", "$.custom_id", "$.metadata.key", "$.request.key")
    return F.coalesce(*[F.nullif(_strings(v, p, "string"), F.lit("")) for p in paths])


def request_number(custom_id: Column | str) -> Column:
    """N of "doc-N", null for anything else."""
    return F.regexp_extract(F.col(custom_id) if isinstance(custom_id, str) else custom_id, r"^doc-([0-9]+)$", 1).try_cast("long")
