"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, the reply alone
is trainable. A conversation that does not end with the assistant gives one more example of all its turns
with nothing to train, so that no turn is lost.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts, control strings of
this and other templates are broken by ``^`` after their first character and ``^`` itself is doubled; in roles a
line break is ``^n``. Both are undone exactly by ``unescape``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the control strings of common chat templates
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")

_AFTER = {f: "|".join("".join("\\" + c if not c.isalnum() else c for c in s[1:]) for s in CONTROL if s[0] == f) for f in "<["}
_FIRST = "|".join(f"(?:\\{f}(?={rest}))" for f, rest in _AFTER.items())
TURN = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("^"), F.lit("^^"))
    return F.regexp_replace(doubled, _FIRST, "$0^")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("^n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\^(\^?)", "$1")


def unescape_role(role: Column) -> Column:
    # a doubled sign first, so that only a single one before n is a line break
    return F.regexp_replace(F.regexp_replace(role, r"(?<!\^)((?:\^\^)*)\^n", "$1\n"), r"\^(\^?)", "$1")


def expand(rows: DataFrame) -> DataFrame:
    """(conv_id, example, target, formatted, loss_start, loss_end) from ``rows`` (conv_id, turn, role, text).

    ``example`` counts from 0, ``target`` is the position of the trainable turn (null in a closing example without one);
    the trainable code points are [loss_start, loss_end) of ``formatted``, the reply's text without its marks.
    Null roles and texts are empty; rows that share a turn number stand by role, then text; repeated rows are turns of
    their own; rows without conv_id are one conversation. The contexts of a conversation of n turns hold its text about n / 2 times: that is what the format asks for.
    """
    # the texts are escaped row by row, before the turns meet
    kinds = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    marked = kinds.select(
        "conv_id", F.struct(F.col("turn").cast("long").alias("turn"), "role", "text", escape(F.col("text")).alias("body"), F.concat(F.lit("<|im_start|>"), escape_role(F.col("role")), F.lit("\n")).alias("head")).alias("t")
    )
    convs = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit("<|im_end|>\n")))
    convs = convs.select("conv_id", "turns", whole.alias("whole"))
    n = F.size("turns")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("turns", i)["role"] == "assistant")
    closing = F.when(F.element_at("turns", -1)["role"] == "assistant", F.array().cast("array<int>")).otherwise(F.array(-n))
    targets = convs.select("turns", "whole", "conv_id", F.posexplode(F.concat(replies, closing)).alias("example", "at"))
    formatted = F.array_join(F.slice("whole", 1, F.abs("at")), "")
    body = F.char_length(F.element_at("turns", F.abs("at"))["body"])
    out = targets.select("conv_id", "example", F.when(F.col("at") > 0, F.col("at") - 1).alias("target"), formatted.alias("formatted"), body.alias("body"))
    end = F.char_length("formatted")
    shut = len("<|im_end|>\n")
    return out.select(
        "conv_id", "example", "target", "formatted",
        F.when(F.col("target").isNull(), end).otherwise(end - shut - F.col("body")).alias("loss_start"),
        F.when(F.col("target").isNull(), end).otherwise(end - shut).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted example."""
    roles = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescape_role(r).alias("role"), unescape(t).alias("text")))


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    return unescape(F.substring(formatted, start + 1, end - start))


def digests(examples: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples), read back from the examples alone."""
    loss = loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))
    parts = examples.select("conv_id", "example", "formatted", F.struct("example", loss.alias("loss")).alias("part"))
    whole = parts.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("last"), F.sort_array(F.collect_list("part")).alias("parts"),
        F.sum(F.char_length("formatted").cast("long")).alias("formatted_chars"), F.count(F.lit(1)).alias("n_examples"),
    )
    turns = whole.withColumn("turns", read_turns(F.col("last"))).withColumn("loss", F.array_join(F.transform("parts", lambda p: p["loss"]), ""))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples",
    )
