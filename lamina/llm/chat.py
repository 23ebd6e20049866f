"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are the context, and its text
alone is trainable. Turns that follow the last reply stay in a closing example with nothing to train,
so the output holds every turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """A text in which no control string can begin: & is &amp; and <| is &lt;|. `unescaped` undoes it."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&#10;"))


def _role_back(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def chat_examples(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """Examples of conversations given as rows of conv_id, turn, role and text.

    Returns conv_id, example (from 0), formatted, loss_start (code points before the trainable text)
    and loss_chars (its length; 0 in a closing example). Turns stand in order of turn, then role and
    text; null turns come first; null texts and roles are empty; repeated rows stay. Rows without a
    conversation id form one conversation of their own. Other columns of turns don't matter.
    """
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    talks = talks.withColumns({"n": F.size("turns"), "marked": F.transform("turns", lambda t: F.concat(F.lit(START), _role(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END)))})
    replies = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("turns", i)["role"] == assistant)
    ends = F.when(F.coalesce(F.try_element_at(replies, F.lit(-1)) == F.col("n"), F.lit(False)), replies).otherwise(F.concat(replies, F.array("n")))
    each = talks.withColumn("replies", ends).select("conv_id", "turns", "marked", F.posexplode("replies").alias("example", "end"))
    last = F.element_at("turns", F.col("end"))
    trained = last["role"] == assistant
    formatted = F.array_join(F.slice("marked", F.lit(1), F.col("end")), "")
    out = each.select("conv_id", "example", formatted.alias("formatted"), F.when(trained, F.length(escaped(last["text"]))).otherwise(0).alias("loss_chars"))
    return out.select("conv_id", "example", "formatted", F.when(F.col("loss_chars") >= 0, F.length("formatted") - len(END) - F.col("loss_chars")).alias("loss_start"), "loss_chars")


def read_turns(formatted: Column | str) -> Column:
    """The turns of a formatted example, as an array of struct(role, text)."""
    f = F.col(formatted) if isinstance(formatted, str) else formatted
    parts = F.split(F.substring(f, F.lit(1), F.length(f) - len(END)), r"<\|im_end\|>\n<\|im_start\|>", -1)
    parts = F.transform(parts, lambda p, i: F.when(i == 0, F.substring(p, F.lit(len(START) + 1), F.length(p))).otherwise(p))
    return F.transform(parts, lambda p: F.struct(_role_back(F.substring_index(p, "\n", 1)).alias("role"), unescaped(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text")))


def read_loss(formatted: str = "formatted", start: str = "loss_start", chars: str = "loss_chars") -> Column:
    """The trainable text of an example, unescaped."""
    return unescaped(F.substring(F.col(formatted), F.col(start) + 1, F.col(chars)))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """What `chat_examples` wrote, read back: one row for each conversation with n_turns, turns_sha256,
    loss_chars, loss_sha256 and formatted_chars (of all its examples). The longest example, which has
    all turns, gives them; the loss of all examples stands in their order."""
    loss = F.struct("example", read_loss().alias("text"))
    by = examples.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("formatted"), F.sort_array(F.collect_list(loss)).alias("loss"), F.sum(F.length("formatted")).alias("formatted_chars"))
    out = by.select("conv_id", "formatted_chars", read_turns("formatted").alias("turns"), F.array_join(F.transform("loss", lambda x: x["text"]), "").alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))
