"""Chat formatting with Spark expressions only.

Each conversation's turn rows are collected and sorted as structs, neighbours of
one role are merged into one block, and the blocks are concatenated:

    <|start|>role<|text|>first text<|next|>second text<|end|>

``<|next|>`` stands where turns of one role were merged, so every turn can be
read back. In roles and texts ``&`` and ``<`` become ``&amp;`` and ``&lt;``, so
no marker can come from a text, and unescaping gives the text back.

Defined results: a null text or role is empty; rows with one turn number are
ordered by role, then text; repeated rows are kept; null turns come first; a
null conv_id is a conversation of its own; extra columns are ignored; an empty
table gives an empty table. A conversation is one output value and so is built
in one place, after map-side collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"
#: The role whose texts are trained on.
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_conversations(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, formatted, loss_spans: [start, stop) code points of the texts of ``loss_role``."""
    rows = turns.select(
        "conv_id",
        F.struct(
            "turn",
            escape(F.coalesce("role", F.lit(""))).alias("role"),
            escape(F.coalesce("text", F.lit(""))).alias("text"),
        ).alias("row"),
    )
    sorted_rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    same_as_last = lambda x, i: (i > 0) & (F.get("rows", i - 1)["role"] == x["role"])
    opened = sorted_rows.select(
        "conv_id",
        F.transform(
            "rows",
            lambda x, i: F.struct(
                x["role"].alias("role"),
                x["text"].alias("text"),
                F.when(same_as_last(x, i), F.lit(NEXT))
                .otherwise(F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), x["role"], F.lit(TEXT)))
                .alias("before"),
            ),
        ).alias("rows"),
    )
    placed = F.aggregate(
        "rows",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["before"]) + F.length(x["text"])).alias("at"),
            F.when(
                x["role"] == loss_role,
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(x["before"])).alias("start"),
                            (acc["at"] + F.length(x["before"]) + F.length(x["text"])).alias("stop"),
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    joined = F.concat(F.array_join(F.transform("rows", lambda x: F.concat(x["before"], x["text"])), ""), F.lit(END))
    return opened.select("conv_id", joined.alias("formatted"), placed.alias("loss_spans"))


def parse_formatted(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) and loss_text, read back from ``formatted`` and ``loss_spans``."""
    blocks = F.filter(F.split("formatted", r"<\|start\|>", -1), lambda b: b != "")
    role = lambda b: unescape(F.substring_index(b, TEXT, 1))
    body = lambda b: F.split(F.substring_index(F.substring_index(b, END, 1), TEXT, -1), r"<\|next\|>", -1)
    turns = F.flatten(
        F.transform(blocks, lambda b: F.transform(body(b), lambda t: F.struct(role(b).alias("role"), unescape(t).alias("text"))))
    )
    loss = F.array_join(
        F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"]))), ""
    )
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted")


def digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation: what op2 returns."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parse_formatted(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
