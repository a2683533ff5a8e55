"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Each assistant turn becomes an example of its own: all turns before it as context, and its text alone
to be trained on. A conversation that doesn't end with an assistant turn gets one more example
without a target, so that no turn is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|turn|>", "</s>"
#: Strings that a text must not bring into the output: those of this template and of some others. None is part of another, and none begins as it or another ends.
CONTROL = (START, END, "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESCAPE = "␛"
#: What stands for the escape sign, for a newline within a role, and for each control string.
_CODES = tuple((c, ESCAPE + chr(ord("a") + i)) for i, c in enumerate((ESCAPE, *CONTROL)))
_NEWLINE = ("\n", ESCAPE + "z")


def _replaced(column: Column, pairs) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, column)


def escape(column: Column) -> Column:
    """The escape sign first, so that every sign in the outcome begins a code."""
    return _replaced(column, _CODES)


def unescape(column: Column) -> Column:
    """A code's letter can't be taken for another's: signs are undone last."""
    return _replaced(column, [(b, a) for a, b in reversed(_CODES)])


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_length, n_turns) from `turns` (conv_id, turn, role, text).

    Turns go by number, null first, ties by role and text. Null roles and texts count as empty. Rows
    that repeat a turn are turns of their own; rows without conv_id are one conversation. loss_start and
    loss_length (code points of `text`, from 0) mark the escaped reply; 0 and 0 where there is no target.
    Prefixes are made as the examples stream out: a task holds one conversation and one example at a time, so texts may be very
    long, but a conversation with its longest example must fit. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.select("conv_id", said.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    role = lambda t: _replaced(escape(t["role"]), [_NEWLINE])
    shown = F.transform("t", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(START), role(t), F.lit("\n")).alias("head"), escape(t["text"]).alias("body")))
    convs = convs.select("conv_id", shown.alias("t"))
    at = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (F.element_at("t", i)["role"] == "assistant") | (i == F.size("t")))
    convs = convs.select("conv_id", "t", F.explode(at).alias("example"))
    text = F.array_join(F.transform(F.slice("t", F.lit(1), F.col("example")), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    last = F.element_at("t", F.col("example"))
    taught = last["role"] == "assistant"
    out = convs.select("conv_id", "example", text.alias("text"), F.length(last["body"]).alias("n"), taught.alias("taught"), F.size("t").alias("n_turns"))
    start = F.length("text") - len(END) - F.col("n")
    return out.select("conv_id", "example", "text", F.when(F.col("taught"), start).otherwise(0).alias("loss_start"), F.when(F.col("taught"), F.col("n")).otherwise(0).alias("loss_length"), "n_turns")


def turns_of(text: Column) -> Column:
    """array<struct<role, text>> read back from an example's text."""
    pieces = F.filter(F.split(text, END), lambda p: p != "")
    own = lambda p: F.substring(p, len(START) + 1, 2**31 - 1)
    head = lambda p: F.substring_index(own(p), "\n", 1)
    return F.transform(pieces, lambda p: F.struct(unescape(_replaced(head(p), [(_NEWLINE[1], _NEWLINE[0])])).alias("role"), unescape(F.substr(own(p), F.length(head(p)) + 2)).alias("text")))


def digests(shown: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, from the examples alone: the longest holds all its turns, and each gives its target.

    Rows without conv_id are one conversation. A conversation without an assistant's turn has a loss of no characters; null and empty
    texts were made empty by examples(), and are read back so. A conversation must fit in a task. An empty table gives an empty result; columns of other names are ignored.
    """
    loss = unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_length")))
    own = shown.select("conv_id", "example", "n_turns", F.length("text").cast("long").alias("chars"), F.struct("example", loss.alias("loss")).alias("loss"), F.when(F.col("example") == F.col("n_turns"), F.col("text")).alias("whole"))
    by = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("loss")).alias("loss"), F.sum("chars").alias("formatted_chars"), F.max("whole").alias("whole"))
    by = by.select("conv_id", turns_of(F.col("whole")).alias("t"), F.array_join(F.col("loss.loss"), "").alias("loss"), "formatted_chars")
    said = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
