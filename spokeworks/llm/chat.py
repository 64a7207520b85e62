"""Chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the
context, and only that reply is trainable. Only column functions are used.

A turn reads `<|im_start|>ROLE\\nTEXT<|im_end|>\\n`. In roles and texts a backslash
is doubled and `<|` becomes `<\\|`, so the marks occur nowhere else, and a line
break in a role becomes `\\n`; both are undone exactly when reading back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "<|im_start|>"
END = "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|\|)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # Marks cannot occur in escaped text, so they can stand in for what must wait.
    steps = [("\\\\", "<|b|>"), ("\\n", "\n"), ("<\\|", "<|p|>"), ("<|b|>", "\\"), ("<|p|>", "<|")]
    for old, new in steps:
        role = F.replace(role, F.lit(old), F.lit(new))
    return role


def expand_targets(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant"
) -> DataFrame:
    """(conv, example, text, loss_start, loss_chars): one row per reply, and one for a rest without reply.

    `loss_start` (0-based, in code points) and `loss_chars` bound the trainable
    part, which is the reply's escaped text. Turns after the last reply, or a
    conversation without any, end in one more row that holds all turns and
    trains nothing (`loss_chars` is null), so no turn is lost.

    Turns are ordered by turn, then role and text; null turns come first.
    Null roles and texts are empty. Rows without conversation id are one
    conversation. Repeated rows are repeated turns. Other columns are not
    looked at. An example is one row, as a trainer needs it; its text grows
    with the turns before it.
    """
    piece_role = F.coalesce(F.col(role), F.lit(""))
    piece_text = F.coalesce(F.col(text), F.lit(""))
    rows = turns.select(F.col(conv_id).alias("conv"), F.struct(F.col(turn).alias("turn"), piece_role.alias("role"), piece_text.alias("text")).alias("t"))
    grouped = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    parts = F.transform(
        "t",
        lambda t: F.struct(
            F.concat(head(t), escape(t["text"]), F.lit(END + "\n")).alias("piece"),
            F.length(head(t)).alias("head"),
            F.length(escape(t["text"])).alias("size"),
            (t["role"] == target).alias("reply"),
        ),
    )
    last = F.size("p")
    # The place of every reply, and the end if it is none.
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: F.get(F.col("p.reply"), i - 1) | (i == last))
    examples = grouped.select("conv", parts.alias("p")).select("conv", "p", F.posexplode(ends).alias("example", "n"))
    own = F.get(F.col("p"), F.col("n") - 1)
    before = F.array_join(F.slice(F.col("p.piece"), F.lit(1), F.col("n") - 1), "")
    built = examples.select("conv", "example", before.alias("before"), own.alias("own"))
    reply = F.col("own.reply")
    return built.select(
        F.col("conv").alias(conv_id),
        F.col("example"),
        F.concat("before", F.col("own.piece")).alias("text"),
        F.when(reply, F.length("before") + F.col("own.head")).cast("bigint").alias("loss_start"),
        F.when(reply, F.col("own.size")).cast("bigint").alias("loss_chars"),
    )


def read_turns(text: Column) -> Column:
    """Turns of a formatted text as array<struct<role, text>>."""
    # The text begins with a mark and ends with the end mark and a line break.
    segments = F.slice(F.split(text, r"<\|im_start\|>"), 2, 1 << 30)
    return F.transform(
        segments,
        lambda s: F.struct(
            unescape_role(F.substring_index(s, "\n", 1)).alias("role"),
            unescape(F.substr(s, F.instr(s, F.lit("\n")) + 1, F.length(s) - F.instr(s, F.lit("\n")) - len(END) - 1)).alias("text"),
        ),
    )


def digest_examples(examples: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Read each conversation's examples back: turns from the last one, trained text from all."""
    loss = F.substr("text", (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int"))
    light = examples.select(
        F.col(conv_id).alias("conv"),
        "example",
        F.length("text").alias("chars"),
        F.when(F.col("loss_chars").isNotNull(), unescape(loss)).alias("loss"),
        "text",
    )
    whole = light.groupBy("conv").agg(
        F.max_by("text", "example").alias("text"),
        F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
    )
    loss_text = F.array_join(F.col("losses.loss"), "")
    read = whole.select("conv", read_turns(F.col("text")).alias("turns"), loss_text.alias("loss"), "formatted_chars")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("conv").alias(conv_id),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )
