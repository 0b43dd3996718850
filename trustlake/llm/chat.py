"""Chat formatting with Spark expressions only.

Turns are collected per conversation as structs and sorted; positions where the role differs from that before begin a block, the turns
from one such position to the next are gathered by slices of the array, and the blocks are concatenated:

    <s>role[INST] text [/INST][INST] text of the next turn of the same role [/INST]</s><s>other role[INST] ...

A control string inside a text or role gets a backslash after its first character (`<\\/s>`), and one that has backslashes there gets
one more, so no text holds a control string and `unescape` takes out exactly what was put in.  Every step is linear in the turns.

The loss mask comes as segments, pieces of the formatted string in order, each with a label that says whether a model learns from it;
joined, they are the formatted string.  Only the texts of the learned role have the label, control strings never.

A conversation becomes one row, as its formatted string does: a row of result is the least that a task has to hold.

Defined results: a null text or role is empty; rows of one turn number (repeated ones too) are all kept, ordered by role, then text; null
turn numbers come first; null conversation ids are one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE, BEGIN, END = "<s>", "</s>", "[INST] ", " [/INST]"
#: Control strings, with the backslashes that an escaped one has after its first character.
PLAIN = r"(<)(\\*/?s>)|(\[)(\\*/?INST\])"
ESCAPED = r"(<)\\(\\*/?s>)|(\[)\\(\\*/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$3$2$4")


def chat_format(rows: DataFrame, learned: str = "assistant") -> DataFrame:
    """conv_id, formatted, n_blocks, segments (array of label, text) of each conversation; rows: conv_id, turn, role, text.

    learned: the role whose texts are under the loss mask."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    role = lambda i: F.col("turns")[i]["role"]
    first = lambda i: (i == 0) | (role(i) != role(F.greatest(i - 1, F.lit(0))))
    talks = talks.withColumn("begins", F.filter(F.sequence(F.lit(0), F.size("turns") - 1), first))
    until = lambda k: F.coalesce(F.get("begins", k + 1), F.size("turns"))
    texts = lambda i, k: F.transform(F.slice("turns", i + 1, until(k) - i), lambda t: escape(t["text"]))
    block = lambda i, k: F.struct(escape(role(i)).alias("role"), (role(i) == learned).alias("label"), texts(i, k).alias("texts"))
    talks = talks.select("conv_id", F.transform("begins", block).alias("blocks"))

    piece = lambda label, text: F.struct(label.alias("label"), text.alias("text"))
    head = lambda b, j: F.when(j == 0, F.concat(F.lit(OPEN), b["role"], F.lit(BEGIN))).otherwise(END + BEGIN)
    turns = lambda b: F.flatten(F.transform(b["texts"], lambda t, j: F.array(piece(F.lit(False), head(b, j)), piece(b["label"], t))))
    made = F.flatten(F.transform("blocks", lambda b: F.concat(turns(b), F.array(piece(F.lit(False), F.lit(END + CLOSE))))))
    talks = talks.select("conv_id", F.size("blocks").cast("long").alias("n_blocks"), made.alias("segments"))
    return talks.select("conv_id", F.array_join(F.col("segments")["text"], "").alias("formatted"), "n_blocks", "segments")


def chat_read(formatted: Column) -> Column:
    """The turns (array of role, text) that a formatted string was made of, in order; merged ones are told apart again."""
    quoted = lambda x: rf"\Q{x}\E"

    def turns(b: Column) -> Column:
        head = F.substring_index(b, BEGIN, 1)
        role = unescape(F.substring(head, 1 + len(OPEN), 1 << 30))
        body = F.substring(b, F.length(head) + 1 + len(BEGIN), F.length(b) - F.length(head) - len(BEGIN) - len(END))
        return F.transform(F.split(body, quoted(END + BEGIN)), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.filter(F.split(formatted, quoted(CLOSE)), lambda b: b != ""), turns))


def learned_texts(segments: Column) -> Column:
    """The texts under the loss mask, as they were given, in order."""
    return F.transform(F.filter(segments, lambda s: s["label"]), lambda s: unescape(s["text"]))
