"""Chat formatting with typed content parts, in native DataFrame functions only.

A message is a row (conversation, turn, role, parts); a part is a struct (type, text, ref, units) of type text,
image, audio or document. A visitor flattens the parts in order: text is escaped, any other part becomes its
placeholder, and its reference and expanded token count are recorded as an attachment.

Template of a turn: ``<|turn|>ROLE<|text|>BODY<|end|>`` and a line feed. In roles and texts every "<" and "[" gets a
backslash after it, and backslashes are doubled, so ``unescape`` gives back every text exactly. As each control string
begins with "<" or "[" and has no backslash, none can stand in a text, nor come about where parts meet.

Defined results: null text, role or parts count as empty; an unknown type counts as a document; a null unit count
is 1; turns with the same number are ordered by role, then by rendered text; null turns come first; a null
conversation id is a conversation of its own; an empty table gives an empty table; other columns are ignored; texts
of any length are kept whole.

A conversation may be long: turns are first joined in blocks of ``BLOCK`` turn numbers, spread over tasks, and only
one row for each block meets in the last aggregation. A conversation is one result row, so it must fit a task; so must
the rows of one conversation with one turn number, or without, which meet in one block.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Expanded tokens for each unit: an image tile, a second of audio, a page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
#: Control strings that no text may hold once it is formatted: our own, and those of common chat templates.
CONTROLS = (TURN, TEXT, END, *PLACEHOLDERS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

PARTS = "array<struct<type:string,text:string,ref:string,units:int>>"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), r"([<\[])", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def _kind(part: Column) -> Column:
    t = part["type"]
    return F.when(t.isin("text", *PLACEHOLDERS), t).otherwise(F.lit("document"))


def _by_kind(part: Column, values: dict) -> Column:
    out = F.lit(values["document"])
    for k in ("image", "audio"):
        out = F.when(_kind(part) == k, F.lit(values[k])).otherwise(out)
    return out


def format_conversations(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", loss_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One row for each conversation: id, n_turns, formatted, spans, attachments, expanded_tokens.

    ``spans`` has one struct for each turn, in order: role, offset and length of the body inside the turn's own
    segment of ``formatted`` (in code points), and whether the body is under the loss mask. ``attachments`` has, in
    order, turn, type, ref and expanded tokens of every part that is not text.
    """
    parts = F.coalesce(F.col(f"`{parts_col}`").cast(PARTS), F.array().cast(PARTS))
    parts = F.filter(parts, lambda p: p.isNotNull())
    shown = F.transform(parts, lambda p: F.when(_kind(p) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(_by_kind(p, PLACEHOLDERS)))
    head = F.concat(F.lit(TURN), escape(F.coalesce(F.col(f"`{role_col}`"), F.lit(""))), F.lit(TEXT))
    turn = F.col(f"`{turn_col}`").cast("long")
    rows = messages.select(
        F.col(f"`{conv_col}`").alias("conv"),
        turn.alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
        head.alias("head"),
        F.array_join(shown, "").alias("body"),
        F.transform(
            F.filter(parts, lambda p: _kind(p) != "text"),
            lambda p: F.struct(turn.alias("turn"), _kind(p).alias("type"), p["ref"].alias("ref"), (F.greatest(F.coalesce(p["units"], F.lit(1)), F.lit(0)).cast("long") * _by_kind(p, UNIT_TOKENS)).alias("tokens")),
        ).alias("attached"),
    )
    span = F.struct(F.col("role"), F.length("head").alias("offset"), F.length("body").alias("length"), F.col("role").isin(*loss_roles).alias("loss"))
    blocks = (
        rows.select("conv", F.floor(F.col("turn") / BLOCK).alias("block"), F.struct("turn", "role", F.concat("head", "body", F.lit(END + "\n")).alias("shown"), span.alias("span"), "attached").alias("t"))
        .groupBy("conv", "block")
        .agg(F.array_sort(F.collect_list("t")).alias("ts"))
        .select("conv", F.struct("block", F.array_join("ts.shown", "").alias("shown"), F.col("ts.span").alias("spans"), F.flatten("ts.attached").alias("attached")).alias("b"))
    )
    return (
        blocks.groupBy("conv")
        .agg(F.sort_array(F.collect_list("b")).alias("bs"))
        .select(
            F.col("conv").alias(conv_col),
            F.size(F.flatten("bs.spans")).cast("long").alias("n_turns"),
            F.array_join("bs.shown", "").alias("formatted"),
            F.flatten("bs.spans").alias("spans"),
            F.flatten("bs.attached").alias("attachments"),
            F.aggregate(F.flatten("bs.attached"), F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
        )
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns`` array<struct<role, text, under_loss>>, parsed from ``formatted`` alone but for the mask.

    under_loss is the unescaped text that the turn's span masks (null outside the mask); texts with placeholders keep
    them as they stand.
    """
    segments = F.split("formatted", re.escape(TURN))
    segments = F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0)))
    parsed = F.zip_with(
        segments,
        "spans",
        lambda s, m: F.struct(
            unescape(F.substring_index(s, TEXT, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(s, TEXT, -1), END, 1)).alias("text"),
            F.when(m["loss"], unescape(F.substring(s, m["offset"] + 1 - len(TURN), m["length"]))).alias("under_loss"),
        ),
    )
    return formatted.withColumn("turns", parsed)
