"""Chat formatting with the perspective rotated: each participant in turn is the assistant.

A conversation is cut into blocks of ``block`` consecutive turn numbers, and a block into parts of at most ``block``
messages in order, so that one of any length, and turns that repeat any number of times, spread over
tasks; the parts of a perspective, in order, are its whole dialogue.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import send_if_small, table

START, END = "<|im_start|>", "<|im_end|>"
#: How the marks' beginning is written where it stands in a text or a role, so that neither can forge a message.
MARK, ESCAPED = "<|im_", "<|\u200bim_"


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit(MARK), F.lit(ESCAPED))


def rotate(turns: DataFrame, block: int = 256, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, perspective, part, piece, n_messages, n_trained, text, mask): a row for each participant and part.

    Participants are the roles of a conversation other than ``system``; a null role is the participant
    ``unknown``. In a perspective its own messages come from ``assistant``, those of others from ``user`` with
    their name, system messages from ``system``. ``mask`` lists the trained spans, ``start:end`` in
    characters of ``text`` (content and end mark of the perspective's own messages), joined by commas.
    ``part`` is the first turn number that the block may hold, ``piece`` numbers the block's parts from 0. A null turn counts
    as -1 and comes first. Equal turns are in the order of a hash of role and text. A null text is
    empty; a null conversation is one of its own; a conversation of system messages only gives no row. Where a text
    or role has the beginning of a mark, a zero-width space goes into it; line breaks in a name become spaces. Other columns
    are ignored. The names of a conversation's participants are joined to its parts, so each part is written once for each.
    """
    role = _plain(F.coalesce(F.col(role_col), F.lit("unknown")))
    text = _plain(F.coalesce(F.col(text_col), F.lit("")))
    rows = turns.select(
        F.struct(F.col(conv_col).alias("conv_id")).alias("conv"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"), F.regexp_replace(role, r"[\r\n]+", " ").alias("role"), text.alias("text")
    )
    rows = rows.withColumn("mark", F.md5(F.concat("role", F.lit("\n"), "text"))).withColumn("part", F.floor(F.col("turn") / block).cast("long") * block)
    # Blocks that fit one part need no places; the list of the others tells the rows apart without shuffling texts.
    full = send_if_small(rows.groupBy("conv", "part").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("conv", "part"), "large-blocks")
    message = F.struct("turn", "mark", "role", "text")
    once = rows.join(full, ["conv", "part"], "left_anti").select("conv", "part", F.lit(0).cast("long").alias("piece"), F.array(message).alias("messages"))
    # Places in a large block, in two levels: messages before a cell (a turn and leading digits of the mark), then inside the cell.
    digits = max(1, math.ceil(math.log(turns.count() / 1024 + 1, 16)))
    cell = ["conv", "part", "turn", "cell"]
    alike = rows.join(full, ["conv", "part"], "left_semi").withColumn("cell", F.substring("mark", 1, digits)).groupBy(*cell, "mark", "role", "text").agg(F.count("*").alias("k"))
    sums = alike.groupBy(*cell).agg(F.sum("k").alias("k"))
    before = W.partitionBy("conv", "part").orderBy("turn", "cell").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*cell, F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy(*cell).orderBy("mark", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    placed = alike.withColumn("at", F.coalesce(F.sum("k").over(inside), F.lit(0))).join(starts, cell).withColumn("at", F.col("at") + F.col("start"))
    # Rows that repeat all columns are one row so far; each part gets as many as it holds.
    low, high = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("k") - 1) / block)
    cut = placed.select("conv", "part", "turn", "mark", "role", "text", "at", "k", F.explode(F.sequence(low, high)).alias("piece"))
    times = F.least(F.col("at") + F.col("k"), (F.col("piece") + 1) * block) - F.greatest("at", F.col("piece") * block)
    many = cut.select("conv", "part", "piece", F.array_repeat(message, times.cast("int")).alias("messages"))
    parts = once.unionByName(many).groupBy("conv", "part", "piece").agg(F.array_sort(F.flatten(F.collect_list("messages"))).alias("messages"))
    people = send_if_small(rows.filter("role <> 'system'").select("conv", F.col("role").alias("perspective")).distinct(), "participants")
    seen = parts.join(people, "conv")

    def piece(m):
        own = m["role"] == F.col("perspective")
        who = F.when(own, F.lit("assistant")).when(m["role"] == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), m["role"]))
        head = F.concat(F.lit(START), who, F.lit("\n"))
        body = F.concat(m["text"], F.lit(END))
        return F.struct(own.alias("own"), F.char_length(head).alias("head"), F.char_length(body).alias("body"), F.concat(head, body, F.lit("\n")).alias("text"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(a, p):
        low = a["at"] + p["head"]
        span = F.concat(low.cast("string"), F.lit(":"), (low + p["body"]).cast("string"))
        return F.struct((low + p["body"] + 1).alias("at"), F.when(p["own"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    shown = seen.select("conv.conv_id", "perspective", "part", "piece", F.transform("messages", piece).alias("pieces"))
    shown = shown.withColumn("spans", F.aggregate("pieces", start, add)["spans"])
    return shown.select(
        "conv_id", "perspective", "part", F.col("piece").cast("long").alias("piece"), F.size("pieces").cast("long").alias("n_messages"), F.size("spans").cast("long").alias("n_trained"),
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"), F.array_join("spans", ",").alias("mask"),
    )


def op3_perspective_rotation(spark, sf_dir):
    return rotate(table(spark, sf_dir, "conversations"))


OP3_SQL = r"""
WITH r AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, regexp_replace(replace(coalesce(role, 'unknown'), '<|im_', '<|' || chr(8203) || 'im_'), '[\r\n]+', ' ', 'g') AS role,
         replace(coalesce(text, ''), '<|im_', '<|' || chr(8203) || 'im_') AS text FROM conversations
), q AS (
  SELECT *, md5(role || chr(10) || text) AS mark, CAST(floor(turn / 256) AS BIGINT) * 256 AS part FROM r
), n AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, mark, role, text) - 1) // 256 AS piece FROM q
), p AS (
  SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role <> 'system'
), m AS (
  SELECT n.*, p.perspective, n.role = p.perspective AS own,
         '<|im_start|>' || CASE WHEN n.role = p.perspective THEN 'assistant' WHEN n.role = 'system' THEN 'system' ELSE 'user name=' || n.role END || chr(10) AS head,
         text || '<|im_end|>' AS body
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part, piece ORDER BY turn, mark, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS low FROM m
)
SELECT conv_id, perspective, part, CAST(piece AS BIGINT) AS piece, count(*) AS n_messages, count(*) FILTER (own) AS n_trained,
       string_agg(head || body || chr(10), '' ORDER BY low) AS text,
       coalesce(string_agg(CAST(low AS BIGINT) || ':' || CAST(low + length(body) AS BIGINT), ',' ORDER BY low) FILTER (own), '') AS mask
FROM o GROUP BY conv_id, perspective, part, piece
"""
