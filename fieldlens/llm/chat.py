"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as
context, and only its own reply trainable.  Turns after the last reply, or of a
conversation without one, make an example in which nothing is trainable, so a
conversation can be read back whole from its longest example.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, CLOSE, ROLE, TEXT = "<s>", "</s>", "[INST]", "[/INST]"
#: Stands for a control string in a text, with the number of that string behind it; 0 is the mark itself.
MARK = "␛"
CONTROL = (MARK, OPEN, CLOSE, ROLE, TEXT)
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """``text`` without control strings; the mark goes first, so that every mark is followed by its number."""
    return reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(f"{MARK}{x[0]}")), enumerate(CONTROL), text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(f"{MARK}{x[0]}"), F.lit(x[1])), reversed([*enumerate(CONTROL)]), text)


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN + ROLE), escape(role), F.lit(TEXT))


def examples(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row an example: conv_id, example (number of its last turn), text, loss_start, loss_end.

    The trainable part is text[loss_start:loss_end], in code points, still
    escaped; it is empty where nothing is trainable.  Turns are ordered by
    number, null first, then role, then text; repeated rows are turns of their
    own.  Null roles and texts count as empty; a null conversation id is a
    conversation.  Other columns are left out.  An empty table gives no example.
    """
    turn = F.struct(
        F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    turns = df.select(F.col(f"`{conv_col}`").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    written = turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(_head(t.role).alias("head"), escape(t.text).alias("body"), (t.role == TRAINED_ROLE).alias("trained"))).alias("turns"),
    )
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | F.element_at("turns", i).trained)
    one = written.select("conv_id", "turns", F.explode(ends).alias("example")).select(
        "conv_id", "example", F.element_at("turns", F.col("example")).alias("last"),
        F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("example")), lambda t: F.concat(t.head, t.body, F.lit(CLOSE))), "").alias("text"),
    )
    end = F.length("text") - len(CLOSE)
    return one.select(
        "conv_id", "example", "text",
        (end - F.when(F.col("last.trained"), F.length("last.body")).otherwise(0)).alias("loss_start"), end.alias("loss_end"),
    )


def turns_of(text: Column) -> Column:
    """The turns (role, text) that a formatted text was made from."""
    parts = F.split(text, CLOSE)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def read(part: Column) -> Column:
        role = F.substring_index(F.substr(part, F.lit(len(OPEN + ROLE) + 1)), TEXT, 1)
        body = F.substr(part, F.lit(len(OPEN + ROLE + TEXT) + 1) + F.length(role))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, read)


def digests(formatted: DataFrame) -> DataFrame:
    """What the examples hold, read back from their texts and loss spans, a row a conversation."""
    loss = unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    whole = formatted.select("conv_id", "example", "text", loss.alias("loss")).groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    read = whole.select("conv_id", turns_of(F.col("text")).alias("turns"), F.array_join(F.col("losses.loss"), "").alias("loss"), "formatted_chars")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
