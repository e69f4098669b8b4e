"""Chats in reply order: quoted passages are linked to the messages they come from, then taken out.

A line is quoted at the level of the number of ``>`` marks it begins with (blanks may stand
between them). A quoted passage is a quoted line that is not blank; it is normalised (lower
case, single blanks) and named by two 64-bit hashes. Its original is the first message of the
conversation that says it unquoted. A message replies to the original of its quotes: those of
the lowest level decide, then the most characters, then the later turn. A message without a
linked quote starts a thread. Threads are found by following replies with doubled steps, so
a chain of n replies takes log n rounds; a conversation is never gathered into one row or task.

The reply order of a conversation is (thread_turn, turn): a parent comes before its replies
and threads stand together. A line that only announces a quote ("... wrote:", ending so and
directly followed by a quoted line) goes with it.

Defined cases: a null text is an empty message; a null conv_id or turn is never linked;
rows repeated with equal columns are all kept and linked alike; a quote of the message
itself or of a later one is no link; an empty table gives an empty result; other columns are
kept unless their names are those of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm.corpus import written

_ADDED = ["thread_turn", "depth", "parent_turn", "content", "n_quoted", "n_linked"]
_ROW = ["__row_a", "__row_b"]
_MARKS = r"^[ \t]*((?:>[ \t]*)*)"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _MARKS, "")), r"\s+", " "))


def unquoted(text: Column) -> Column:
    """The text without quoted lines and the lines that announce them."""
    lines = F.split(text, "\r?\n")
    announces = lambda x, i: F.rtrim(x).endswith("wrote:") & (level(F.coalesce(F.get(lines, i + 1), F.lit(""))) > 0)
    return F.btrim(F.array_join(F.filter(lines, lambda x, i: (level(x) == 0) & ~announces(x, i)), "\n"), F.lit("\n"))


def _linked(rows: DataFrame) -> DataFrame:
    """row_a, row_b, parent_turn, n_linked for every message with a linked quote."""
    lines = rows.select("conv_id", "turn", *_ROW, F.explode(F.split("text", "\r?\n")).alias("line")).select("conv_id", "turn", *_ROW, level(F.col("line")).alias("level"), normalised(F.col("line")).alias("said"))
    said = lines.where("said <> ''").select("conv_id", "turn", *_ROW, "level", F.length("said").alias("size"), F.xxhash64("said").alias("said_a"), F.xxhash64("said", F.lit(1)).alias("said_b"))
    key = ["conv_id", "said_a", "said_b"]
    quoted = said.where("level > 0")
    # own lines count only where the conversation quotes anything: the first one that says each
    wanted = quoted.select(*key).distinct()
    first = said.where("level = 0").join(wanted, key, "left_semi").groupBy(*key).agg(F.min("turn").alias("original"))
    met = quoted.join(first, key).where("original < turn")
    by_original = met.groupBy(*_ROW, "level", "original").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    best = F.max_by("original", F.struct(-F.col("level"), F.col("size"), F.col("original")))
    return by_original.groupBy(*_ROW).agg(best.alias("parent_turn"), F.sum("n").alias("n_linked"))


def _threads(replies: DataFrame) -> DataFrame:
    """conv_id, turn, top, depth for the (conv_id, turn, parent) replies; the top itself is no reply."""
    step = 0
    now = written(replies.select("conv_id", "turn", F.col("parent").alias("top"), F.lit(1).alias("depth")), "replies_0")
    while True:
        above = now.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        step += 1
        moved = now.join(above, ["conv_id", "top"], "left")
        moved = written(moved.select("conv_id", "turn", F.coalesce("next", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), f"replies_{step}")
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now


def threaded(messages: DataFrame) -> DataFrame:
    """Every row with its thread, depth and parent, and ``content`` without quotes in place of ``text``."""
    kept = [c for c in messages.columns if c not in _ADDED]
    rows = messages.select(*kept).withColumns({"__row_a": F.xxhash64("conv_id", "turn", "role", "text"), "__row_b": F.xxhash64("text", "role", F.lit(1), "turn", "conv_id")})
    links = written(_linked(rows.select("conv_id", "turn", "text", *_ROW)), "links")
    rows = rows.join(links, _ROW, "left").drop(*_ROW)
    # one parent for a turn, also where rows repeat it with other texts: the earliest
    replies = rows.where("parent_turn is not null").groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("parent"))
    tops = _threads(replies)
    lines = F.split(F.coalesce("text", F.lit("")), "\r?\n")
    out = rows.join(tops.withColumnsRenamed({"top": "__top", "depth": "__depth"}), ["conv_id", "turn"], "left").withColumns(
        {
            "thread_turn": F.coalesce("__top", "turn"),
            "depth": F.coalesce("__depth", F.lit(0)).cast("int"),
            "content": F.coalesce(unquoted(F.col("text")), F.lit("")),
            "n_quoted": F.size(F.filter(lines, lambda x: (level(x) > 0) & (normalised(x) != ""))).cast("int"),
            "n_linked": F.coalesce("n_linked", F.lit(0)).cast("int"),
        }
    )
    return out.select(*[c for c in kept if c != "text"], *_ADDED)
