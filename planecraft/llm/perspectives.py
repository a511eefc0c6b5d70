"""Chat formatting: multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and all others as named users; the system's turns stay the
system's. A rendering is a row for each turn: its text, its place in the whole
rendered dialogue, and the part of it on which a loss is taken (the content and end
mark of the assistant's turns). Laid end to end in order, a perspective's rows are the
dialogue. A turn is a row of its own so that no dialogue, however long, is gathered
in one place; running lengths are summed in blocks of turns for the same reason.

Defined results: a null role is the participant `unknown`, a null text is empty.
Turns are ordered by turn (null first), role and text; equal rows are rendered each.
A conversation of system turns alone has no participant and gives no rows; a null
conv_id is a conversation. An empty table gives an empty result; columns other than
conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks round a turn, the role that is no participant, and the turns of a block."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    system: str = "system"
    block: int = 1024


def rotate(conversations: DataFrame, how: Template = Template()) -> DataFrame:
    """(conv_id, perspective, turn, position, role, rendered, char_start, char_end, loss_start, loss_end); the loss range is empty in turns of others."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("content"))
    people = turns.where(F.col("speaker") != how.system).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    both = turns.join(people, turns["conv_id"].eqNullSafe(people["conv_id"])).drop(people["conv_id"])
    own, system = F.col("speaker") == F.col("perspective"), F.col("speaker") == how.system
    role = F.when(own, "assistant").when(system, how.system).otherwise("user")
    head = F.when(own | system, F.concat(F.lit(how.open), role, F.lit("\n"))).otherwise(F.concat(F.lit(how.open), F.lit("user name="), F.col("speaker"), F.lit("\n")))
    rows = both.select("conv_id", "perspective", "turn", "speaker", "content", role.alias("role"), own.alias("own"), head.alias("head")).withColumn("rendered", F.concat("head", "content", F.lit(how.close)))
    rows = rows.withColumn("size", F.length("rendered").cast("long")).withColumn("block", F.coalesce(F.floor(F.col("turn") / how.block), F.lit(-(1 << 62))))
    order = [F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("content")]
    inside = Window.partitionBy("conv_id", "perspective", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("nth", F.count("*").over(inside))
    blocks = rows.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("sum"), F.count("*").alias("turns"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"), F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns_before"))
    rows = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    start = F.col("offset") + F.col("before")
    end = start + F.col("size")
    return rows.select(
        "conv_id",
        "perspective",
        "turn",
        (F.col("turns_before") + F.col("nth")).alias("position"),
        "role",
        "rendered",
        start.alias("char_start"),
        end.alias("char_end"),
        F.when(F.col("own"), start + F.length("head")).otherwise(end).alias("loss_start"),
        end.alias("loss_end"),
    )


ROTATE_SQL = """
WITH turns AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS content FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
drawn AS (
  SELECT t.conv_id, p.perspective, t.turn, t.speaker, t.content,
         CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
         '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || speaker END || chr(10) AS head
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
sized AS (SELECT *, head || content || '<|im_end|>' || chr(10) AS rendered FROM drawn),
placed AS (
  SELECT *, CAST(sum(length(rendered)) OVER w AS BIGINT) AS char_end, row_number() OVER w - 1 AS position
  FROM sized WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, turn, position, role, rendered, char_end - length(rendered) AS char_start, char_end,
       CASE WHEN role = 'assistant' THEN char_end - length(rendered) + length(head) ELSE char_end END AS loss_start, char_end AS loss_end
FROM placed
"""
