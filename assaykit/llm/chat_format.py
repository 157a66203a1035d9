"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted, adjacent turns of one role are
merged into one block, and the pieces are concatenated:

    <|im_start|>role<|im_sep|>text<|im_turn|>text<|im_end|><|im_start|>...

A control string inside a role or text is escaped by one backslash after its
first character; backslashes that already stand there get one more. Removing
one backslash gives back the text, so the output is read back without loss,
turn by turn. The loss mask covers the texts of one role (the assistant's).

Defined results: a null text or role is empty; turns of one number are ordered
by role and text, repeated rows all stay, a null turn number comes first; a
conversation with a null id is a conversation of its own; an empty table gives
no rows. A conversation is one row of the result, so it must fit a row; rows
are collected in part before the shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import col

START, SEP, TURN, END = "<|im_start|>", "<|im_sep|>", "<|im_turn|>", "<|im_end|>"

#: What must not stand in a text as it is: the marks above and those of common templates.
CONTROL = (START, SEP, TURN, END, "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")


def _tails(first: str) -> str:
    return "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == first)


_ESCAPE = rf"(?:(<)(\\*+)(?={_tails('<')}))|(?:(\[)(\\*+)(?={_tails('[')}))"
_UNESCAPE = rf"(?:(<)\\(\\*+)(?={_tails('<')}))|(?:(\[)\\(\\*+)(?={_tails('[')}))"


def escape(c: Column) -> Column:
    """No control string is left in the result; ``unescape`` gives back the text."""
    return F.regexp_replace(c, _ESCAPE, r"$1$3\\$2$4")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _UNESCAPE, "$1$2$3$4")


def format_chats(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``loss_spans``.

    A span (block, start, length) is the text of one turn of ``loss_role``:
    ``start`` and ``length`` are code points within the block, which is what
    follows the block's start mark. Spans relative to blocks are read in one
    pass over the text, however many turns a conversation has.
    """
    rows = turns.select(
        col(conv_id).alias("conv_id"),
        F.struct(col(turn).alias("turn"), F.coalesce(col(role).cast("string"), F.lit("")).alias("role"),
                 F.coalesce(col(text).cast("string"), F.lit("")).alias("text")).alias("t"))
    # Sorting by the plain values, then carrying the escaped ones.
    rows = rows.select("conv_id", F.struct("t.turn", "t.role", "t.text", escape(F.col("t.role")).alias("safe_role"),
                                           escape(F.col("t.text")).alias("safe_text")).alias("t"))
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select(
        "conv_id", F.expr("transform(turns, x -> struct(x.role AS role, x.safe_role AS head, x.safe_text AS body))")
        .alias("turns"))
    merged = sorted_.withColumn("parts", F.expr(f"""
        transform(turns, (x, i) -> struct(
            i = 0 OR get(turns, i - 1).role != x.role AS opens,
            concat(if(i = 0 OR get(turns, i - 1).role != x.role,
                      concat('{START}', x.head, '{SEP}'), '{TURN}'), x.body,
                   if(i = size(turns) - 1 OR get(turns, i + 1).role != x.role, '{END}', '')) AS piece,
            x.role = '{loss_role.replace("'", "")}' AS loss,
            length(x.head) AS head, length(x.body) AS body))"""))
    spans = F.expr(f"""
        aggregate(parts, struct(-1 AS block, 0 AS at, cast(array() AS array<struct<block:int,start:int,length:int>>) AS spans),
            (a, p) -> struct(
                if(p.opens, a.block + 1, a.block) AS block,
                if(p.opens, p.head + {len(SEP)}, a.at + {len(TURN)}) + p.body AS at,
                if(p.loss, concat(a.spans, array(struct(
                    if(p.opens, a.block + 1, a.block) AS block,
                    if(p.opens, p.head + {len(SEP)}, a.at + {len(TURN)}) AS start,
                    p.body AS length))), a.spans) AS spans),
            a -> a.spans)""")
    return merged.select("conv_id", F.expr("array_join(transform(parts, p -> p.piece), '')").alias("formatted"),
                         spans.alias("loss_spans"))


def _split(text: str, mark: str) -> str:
    quoted = mark.replace("|", "\\\\|")
    return f"split({text}, '{quoted}', -1)"


def read_chats(chats: DataFrame) -> DataFrame:
    """``chats`` with ``turns`` (role, text), read back from the formatted text, and ``loss_texts``."""
    blocks = chats.withColumn("blocks", F.expr(f"slice({_split('formatted', START)}, 2, 2147483647)"))
    turns = F.expr(f"""flatten(transform(blocks, b -> transform(
        {_split(f"replace(substr(b, instr(b, '{SEP}') + {len(SEP)}), '{END}', '')", TURN)},
        x -> struct(substring_index(b, '{SEP}', 1) AS role, x AS text))))""")
    plain = F.transform(turns, lambda x: F.struct(unescape(x["role"]).alias("role"), unescape(x["text"]).alias("text")))
    masked = F.transform(F.col("loss_spans"), lambda s: unescape(
        F.substring(F.get(F.col("blocks"), s["block"]), s["start"] + 1, s["length"])))
    return blocks.withColumns({"turns": plain, "loss_texts": masked}).drop("blocks")
