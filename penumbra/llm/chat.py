"""Chat formatting with Spark expressions: turns of a conversation become one marked, reversible text.

The template: each run of turns with the same role is `### <role>: <text><+><text></turn>` and a line end, where `<+>` stands between the
turns of a run. In roles and texts, backslash, `<` and `#` are written \\b, \\l and \\h (in roles `:` also, as \\c), so no text can hold a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, COLON, NEXT, END = "### ", ": ", "<+>", "</turn>\n"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def escape(text: Column) -> Column:
    for char, code in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for char, code in (("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Returns (conv_id, formatted, loss array<struct<start,length>>) from rows (conv_id, turn, role, text).

    loss holds the spans of assistant texts, in code points from 0. Turns go by turn, then role, then text; a null
    turn comes first, null role or text is empty, repeated rows are turns of their own. Other columns are ignored; a null conv_id is one
    conversation; an empty table gives no rows. A conversation is one output value, so its turns meet in one task by nature.
    """
    grouped = (
        turns.select(F.col("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
        .groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    )

    def head(t: Column, i: Column) -> Column:
        before = F.get(F.col("turns"), i - 1)["role"]
        opened = F.concat(F.lit(START), escape_role(t["role"]), F.lit(COLON))
        return F.when(i == 0, opened).when(before == t["role"], F.lit(NEXT)).otherwise(F.concat(F.lit(END), opened))

    pieces = F.transform("turns", lambda t, i: F.struct(head(t, i).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("learn")))
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))

    def step(acc: Column, p: Column) -> Column:
        start, length = acc["at"] + F.length(p["head"]), F.length(p["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        return F.struct((start + length).alias("at"), F.when(p["learn"], F.concat(acc["loss"], span)).otherwise(acc["loss"]).alias("loss"))

    return grouped.withColumn("pieces", pieces).select(
        "conv_id",
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), ""), F.lit(END)).alias("formatted"),
        F.aggregate("pieces", nothing, step)["loss"].alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted text, as array<struct<role,text>>."""
    blocks = F.split(formatted, END, -1)

    def turns(block: Column) -> Column:
        rest = F.substr(block, F.lit(len(START) + 1))
        role = F.substring_index(rest, COLON, 1)
        texts = F.split(F.substr(rest, F.length(role) + len(COLON) + 1), r"<\+>", -1)
        return F.transform(texts, lambda x: F.struct(unescape_role(role).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return unescape(F.array_join(F.transform(loss, lambda s: F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))), ""))
