"""Conversations from reply trees, formatted with a loss mask.

Paths. Parents are followed by pointer doubling: self-join k of the table (message, ancestor 2**k above) with itself gives
the table for k + 1, and carries the sum of scores on the way. So a tree of depth d takes log2(d) joins, not d. Leaves
are the messages that nobody answers; each leaf is a branch, ranked in its conversation by the sum of its scores. The
chosen leaves then collect their ancestors by the same tables, highest power first: every ancestor comes up once.
Only ids move until a path is complete; texts join at the end.

Format. <s>, then for each turn: [INST] text [/INST] of a user, text</s> of an assistant, <<SYS>>text<</SYS>> of the system,
and <|turn|role|>text<|/turn|> of any other role. Control strings inside a text get a backslash after their first character,
backslashes are doubled; so no text holds a control string and the format can be read back exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources import scratch
from .columns import own

# The control strings of the format.
BEGIN, END = "<s>", "</s>"
USER, USER_END = "[INST] ", " [/INST]"
SYSTEM, SYSTEM_END = "<<SYS>>", "<</SYS>>"
OTHER, OTHER_MID, OTHER_END = "<|turn|", "|>", "<|/turn|>"
CONTROLS = (BEGIN, END, "[INST]", "[/INST]", SYSTEM, SYSTEM_END, OTHER, OTHER_END)
CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
ESCAPED = re.compile(r"\\(\\?)")

FORMATTED = "none boolean, conv long, leaf long, rank int, score double, text string, loss array<struct<start:int,stop:int>>"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(role, text) pairs as one string, and the code points of it that a loss counts: the assistant's texts."""
    parts, at, loss = [BEGIN], len(BEGIN), []
    for role, text in turns:
        body = escape(text)
        if role == "user":
            piece = USER + body + USER_END
        elif role == "assistant":
            piece = body + END
            loss.append((at, at + len(body)))
        elif role == "system":
            piece = SYSTEM + body + SYSTEM_END
        else:
            # A role is a text too; its own closing bar would end it early.
            piece = OTHER + escape(role).replace("|", "\\|") + OTHER_MID + body + OTHER_END
        parts.append(piece)
        at += len(piece)
    return "".join(parts), loss


def read_turns(text: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted string."""
    if not text.startswith(BEGIN):
        raise ValueError("no beginning of a conversation")
    at, out = len(BEGIN), []
    while at < len(text):
        if text.startswith(USER, at):
            role, begin, close = "user", at + len(USER), USER_END
        elif text.startswith(SYSTEM, at):
            role, begin, close = "system", at + len(SYSTEM), SYSTEM_END
        elif text.startswith(OTHER, at):
            mid = re.compile(r"(?:[^\\|]|\\.)*", re.S).match(text, at + len(OTHER)).end()
            role, begin, close = re.sub(r"\\(.?)", lambda m: m[1], text[at + len(OTHER) : mid], flags=re.S), mid + len(OTHER_MID), OTHER_END
        else:
            role, begin, close = "assistant", at, END
        stop = text.find(close, begin)
        if stop < 0:
            raise ValueError(f"a turn at {at} has no end")
        out.append((role, unescape(text[begin:stop])))
        at = stop + len(close)
    return out


def reply_tree(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table of turns as messages of a tree, each the answer to the turn before.

    Turns that tie are taken in the order of role and text; null turns come first.
    """
    order = Window.partitionBy("none", "conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    named = rows.select(own(conv_col).isNull().alias("none"), F.coalesce(own(conv_col).cast("long"), F.lit(0)).alias("conv"), own(turn_col).alias("turn"), F.coalesce(own(role_col), F.lit("")).alias("role"), F.coalesce(own(text_col), F.lit("")).alias("text"))
    numbered = named.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("none", "conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def format_branches(messages: DataFrame, top: int | None = None) -> DataFrame:
    """The branches of each conversation's reply tree, best first, each formatted as one conversation.

    messages: none boolean (true for the conversation without an id), conv long, node long (unique in its conversation),
    parent long, role, text, score. Returns FORMATTED: text and the spans of it under the loss mask, code points counted
    from 0. top: so many branches of each conversation; None, all. Ranks follow falling scores, ties the smaller leaf.

    A message whose parent is null or absent is a root. Null role and text count as empty, a null score as 0. Of rows
    that share a node the one with the least (parent, role, text) stays. Parents that form a circle raise ValueError.
    No messages give no rows.
    """
    key, node = ["none", "conv"], ["none", "conv", "node"]
    row = F.min(F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    # Ids and scores apart from the texts: the tree is walked on the first, small table.
    whole = scratch.save(messages.groupBy(*node).agg(row.alias("m")).select(*node, "m.*"), "messages")
    ids = whole.select(*node, "parent", "score")
    parents = ids.select("none", "conv", F.col("node").alias("parent"), F.lit(True).alias("there")).distinct()
    step = ids.join(parents, [*key, "parent"], "left").select(*node, F.when(F.col("there"), F.col("parent")).alias("up"), "score", F.lit(1).alias("depth"))
    step, total = scratch.save(step, "step"), ids.count()
    # Only messages that haven't reached their root take part in the next join.
    rooted, powers, active = step.where("up is null"), [], step.where("up is not null")
    while not active.isEmpty():
        if 1 << len(powers) > 2 * total:
            raise ValueError("parents form a circle")
        powers.append(active)
        high = active.union(rooted).select(*key, F.col("node").alias("up"), F.col("up").alias("over"), F.col("score").alias("more"), F.col("depth").alias("deeper"))
        step = scratch.save(active.join(high, [*key, "up"]).select(*node, F.col("over").alias("up"), (F.col("score") + F.col("more")).alias("score"), (F.col("depth") + F.col("deeper")).alias("depth")), "power")
        rooted, active = rooted.union(step.where("up is null")), step.where("up is not null")
    answered = ids.select(*key, F.col("parent").alias("node")).distinct()
    leaves = rooted.join(answered, node, "left_anti").select(*key, F.col("node").alias("leaf"), "score", "depth")
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "leaf")
    leaves = leaves.withColumn("rank", F.row_number().over(order))
    leaves = leaves if top is None else leaves.where(F.col("rank") <= top)
    on_path = leaves.select(*key, "leaf", "rank", "score", F.col("leaf").alias("node"), "depth")
    for k in range(len(powers) - 1, -1, -1):
        jump = powers[k].select(*node, "up")
        on_path = on_path.union(on_path.join(jump, node).select(*key, "leaf", "rank", "score", F.col("up").alias("node"), F.col("depth") - (1 << k)))
        on_path = scratch.save(on_path, "paths")
    turns = on_path.join(whole.select(*node, "role", "text"), node).groupBy(*key, "leaf", "rank", "score").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    return turns.select(*key, "leaf", "rank", "score", "turns").mapInArrow(_format, FORMATTED)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for b in batches:
        done = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in b["turns"].to_pylist()]
        loss = [[{"start": a, "stop": z} for a, z in spans] for _, spans in done]
        yield pa.RecordBatch.from_arrays([*(b[c] for c in ("none", "conv", "leaf", "rank", "score")), pa.array([x for x, _ in done], pa.string()), pa.array(loss, kind)], names=["none", "conv", "leaf", "rank", "score", "text", "loss"])


def chat_format(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table of turns formatted: (conv_id, text, loss), one row for each conversation.

    Rows without a conversation id are one conversation, of null id. Repeated rows are turns like others. Null roles and
    texts count as empty. Other columns of rows are not read; an empty table gives an empty table.
    """
    out = format_branches(reply_tree(rows, conv_col, turn_col, role_col, text_col))
    return out.select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), "text", "loss")
