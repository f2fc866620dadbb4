"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the turns before it are the
context and only the reply is trainable. A turn is written as

    <|role|>
    text</s>

with a line break after the end mark. Control strings inside texts and roles
are broken up by a backslash, and backslashes are doubled, so a text can
neither end its turn nor open one, and is read back unchanged.

A conversation is one row while it is formatted. Its examples are made one row
each from the turns up to the reply: no row holds more than one conversation,
although all examples of a conversation add up to more than it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, OPENED, CLOSE = "<|", "|>\n", "</s>\n"
TRAINABLE = "assistant"


def escape(text: Column) -> Column:
    r"""Double backslashes, and break up ``<|``, ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]`` after their first character."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(F.regexp_replace(doubled, r"<(\||/?s>)", r"<\\$1"), r"\[(/?INST\])", r"[\\$1")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"([\\|<\[])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turns): the formatted turns of each conversation in order."""
    filled = rows.select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"),
    )
    whole = filled.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    head = lambda r: F.concat(F.lit(OPEN), escape_role(r["role"]), F.lit(OPENED))
    turns = F.transform("rows", lambda r: F.struct(
        F.concat(head(r), escape(r["text"]), F.lit(CLOSE)).alias("whole"), F.length(head(r)).alias("head"), (r["role"] == TRAINABLE).alias("reply"),
    ))
    return whole.select("conv_id", turns.alias("turns"))


def examples(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_length, last): one row per assistant turn.

    ``loss_start`` and ``loss_length`` mark the trainable characters of
    ``text`` (0-based, in code points). Turns after the last reply, and
    conversations without one, go to a last example with an empty mask, so
    ``last`` rows together hold all turns. Rows are ordered by turn, ties by
    role and text; repeated rows are repeated turns; a null turn comes first; a
    null role or text counts as empty; rows with a null conversation form one.
    Other columns are ignored. An empty table gives no row.
    """
    ready = formatted(rows, conversation, turn, role, text)
    replies = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.get("turns", i - 1)["reply"] | (i == F.size("turns")))
    cut = ready.select("conv_id", "turns", F.posexplode(replies).alias("_example", "_upto"))
    final = F.get("turns", F.col("_upto") - 1)
    joined = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("_upto")), lambda t: t["whole"]), "")
    made = cut.select(
        "conv_id", F.col("_example").alias("example"), joined.alias("text"), final.alias("_final"), (F.col("_upto") == F.size("turns")).alias("last"),
    )
    inside = F.length("_final.whole") - F.col("_final.head") - len(CLOSE)
    return made.select(
        "conv_id", "example", "text",
        (F.length("text") - F.length("_final.whole") + F.col("_final.head")).alias("loss_start"),
        F.when(F.col("_final.reply"), inside).otherwise(0).alias("loss_length"), "last",
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    parts = F.filter(F.split(text, CLOSE), lambda p: p != "")
    shape = r"(?s)^<\|((?:[^|\\]++|\\.)*+)\|>\n(.*)$"
    return F.transform(parts, lambda p: F.struct(
        unescape(F.regexp_extract(p, shape, 1)).alias("role"), unescape(F.regexp_extract(p, shape, 2)).alias("text"),
    ))


def read_loss(text: Column, start: Column, length: Column) -> Column:
    """The trainable text of an example."""
    return unescape(F.substring(text, start + 1, length))


def read_back(made: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted_chars) from the examples: all turns, and all trainable text in order."""
    loss = F.struct("example", read_loss(F.col("text"), F.col("loss_start"), F.col("loss_length")).alias("text"))
    whole = made.groupBy("conv_id").agg(
        F.max(F.when(F.col("last"), F.col("text"))).alias("_text"), F.sort_array(F.collect_list(loss)).alias("_loss"),
        F.sum(F.length("text")).cast("bigint").alias("formatted_chars"),
    )
    return whole.select("conv_id", read_turns(F.col("_text")).alias("turns"), F.array_join(F.transform("_loss", lambda x: x["text"]), "").alias("loss"), "formatted_chars")
