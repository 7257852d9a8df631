"""Chat formatting: every assistant turn becomes an example with all earlier turns as context and only it trainable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of the template.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    """No mark is left in the text: one backslash more stands between ``<`` and ``|`` than before."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def examples(conversations: DataFrame) -> DataFrame:
    """Examples of each conversation: ``conv_id``, ``example`` (0, 1, ...), ``last``, ``text``, and the code points
    ``loss_start`` to ``loss_end`` (exclusive) that are trained on.

    Turns go by ``turn`` (nulls first), ties by role, then text; null roles and texts count as empty; a null
    ``conv_id`` is a conversation of its own. Every assistant turn gives an example that ends with it. If the last turn is none, it gives
    one more, with nothing to train on, so that no turn is lost. An empty table gives an empty result. A
    conversation is put together in one row, as every example of it holds all that precedes; its examples are made one by one.
    """
    c = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    c = c.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    ends = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (F.get("turns", i)["role"] == TRAINED) | (i == F.size("turns") - 1))
    head = lambda t: F.concat(F.lit(START), escaped(t["role"]), F.lit(SEP))
    whole = lambda t: F.concat(head(t), escaped(t["text"]), F.lit(END + "\n"))
    c = c.select("conv_id", "turns", F.transform("turns", whole).alias("parts"), F.posexplode(ends).alias("example", "k"))
    turn = F.get("turns", F.col("k"))
    c = c.select(
        "conv_id", "example", (F.col("k") == F.size("turns") - 1).alias("last"), turn.alias("turn"),
        F.array_join(F.slice("parts", 1, F.col("k")), "").alias("context"), F.get("parts", F.col("k")).alias("part"),
    )
    start = F.length("context") + F.length(head(F.col("turn")))
    trained = F.col("turn.role") == TRAINED
    return c.select(
        "conv_id", "example", "last", F.concat("context", "part").alias("text"), F.when(trained, start).alias("loss_start"),
        F.when(trained, F.length("context") + F.length("part") - len(END + "\n")).alias("loss_end"),
    )


def turns_of(text: Column) -> Column:
    """Role and text of each turn of an example's text."""
    pieces = F.filter(F.split(text, r"<\|im_start\|>"), lambda p: p != "")
    role = lambda p: unescaped(F.substring_index(p, SEP, 1))
    rest = lambda p: F.substring_index(p, SEP, -1)
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), unescaped(F.substring_index(rest(p), END, 1)).alias("text")))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples: the counts and digests of its turns and of what is trained on."""
    loss = F.coalesce(unescaped(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))), F.lit(""))
    turns = F.when(F.col("last"), turns_of(F.col("text")))
    e = formatted.select("conv_id", "example", loss.alias("loss"), F.length("text").cast("long").alias("chars"), turns.alias("turns"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    e = e.select("conv_id", "chars", F.struct("example", "loss").alias("e"), F.size("turns").cast("long").alias("n"), F.sha2(joined.cast("binary"), 256).alias("sha"))
    e = e.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sort_array(F.collect_list("e")).alias("es"), F.sum("chars").alias("formatted_chars"))
    text = F.array_join(F.col("es.loss"), "")
    e = e.withColumn("loss", text)
    return e.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
