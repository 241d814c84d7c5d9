"""Chat formatting by multi-party perspective rotation, with DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that participant as ``assistant`` and the others as
named users; the mask covers what the assistant says. Turns of a context role (``system``) stay what they are and have no
perspective of their own. The rendering is a row per conversation, perspective and turn, so a conversation of any length is never
gathered into one value; ``start`` is where the turn begins in the perspective's text, which is the contents in order of position.

Each turn is rendered as ``<|im_start|>role name=speaker`` (no name for the assistant and for context), a newline, the text,
``<|im_end|>`` and a newline. ``mask_start`` and ``mask_end`` bound the characters to be learned from, text and end mark of the
assistant's turns; they are null for all other turns.

Order: turn (null first), then role, then text; position counts from 0. Null text is rendered as empty; a null speaker is the
participant ``unknown``; rows with a null conversation are one conversation of their own. Repeated rows are repeated turns.
Conversations without participants (context alone) and empty tables give no rows. Further columns are ignored. The id may be of any
type that casts to a string. Names and texts are rendered as they are, also where they hold the marks themselves: offsets, not marks,
bound the turns.

Positions and starts are prefix sums in two levels: within blocks of BLOCK turn numbers, and over the blocks, so that a long
conversation is spread over tasks. The turns of one number are one window, which streams and spills. A conversation of n turns
and k speakers gives n * k rows, as every perspective has all turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
CONTEXT = ("system",)


def rotate(turns: DataFrame, speaker: str = "role", context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """conv_id, perspective, position, turn, role, name, content, start, mask_start, mask_end."""
    said = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(1 << 62))).alias("block"),
    )
    # a null conversation is joined and windowed like any other
    said = said.withColumns({"conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "none": F.col("conv_id").isNull()})
    people = said.where(~F.col("speaker").isin(*context)).select("conv", "none", F.col("speaker").alias("perspective")).distinct()
    rows = said.join(people, ["conv", "none"])
    mine, aside = F.col("speaker") == F.col("perspective"), F.col("speaker").isin(*context)
    head = F.when(mine, F.lit("<|im_start|>assistant\n")).when(aside, F.concat(F.lit("<|im_start|>"), "speaker", F.lit("\n"))).otherwise(F.concat(F.lit("<|im_start|>user name="), "speaker", F.lit("\n")))
    rows = rows.withColumns(
        {
            "role": F.when(mine, F.lit("assistant")).when(aside, F.col("speaker")).otherwise(F.lit("user")),
            "name": F.when(~mine & ~aside, F.col("speaker")),
            "head": F.length(head),
            "content": F.concat(head, "text", F.lit("<|im_end|>\n")),
        }
    )
    rows = rows.withColumn("size", F.length("content").cast("long"))
    group = ["conv", "none", "perspective"]
    blocks = rows.groupBy(*group, "block").agg(F.count("*").alias("rows"), F.sum("size").alias("chars"))
    earlier = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*group, "block", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars_before"))
    inside = Window.partitionBy(*group, "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")
    rows = rows.withColumns({"at": F.row_number().over(inside) - 1, "upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.join(blocks, [*group, "block"])
    start = F.col("chars_before") + F.col("upto") - F.col("size")
    return rows.select(
        "conv_id",
        "perspective",
        (F.col("rows_before") + F.col("at")).cast("long").alias("position"),
        "turn",
        "role",
        "name",
        "content",
        start.alias("start"),
        F.when(F.col("role") == "assistant", start + F.col("head")).alias("mask_start"),
        F.when(F.col("role") == "assistant", start + F.col("size") - 1).alias("mask_end"),
    )


#: The same rows in DuckDB SQL.
SQL = """
WITH said AS (
    SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), people AS (
    SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'
), rows AS (
    SELECT s.conv_id, p.perspective, s.turn, s.speaker, s.text,
        CASE WHEN s.speaker = p.perspective THEN 'assistant' WHEN s.speaker = 'system' THEN 'system' ELSE 'user' END AS role,
        CASE WHEN s.speaker <> p.perspective AND s.speaker <> 'system' THEN s.speaker END AS name
    FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), headed AS (
    SELECT *, '<|im_start|>' || role || CASE WHEN name IS NULL THEN '' ELSE ' name=' || name END || chr(10) AS head FROM rows
), sized AS (
    SELECT *, head || text || '<|im_end|>' || chr(10) AS content FROM headed
), placed AS (
    SELECT *, row_number() OVER w - 1 AS position,
        sum(length(content)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING) - length(content) AS start
    FROM sized WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text)
)
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, role, name, content, CAST(start AS BIGINT) AS start,
    CASE WHEN role = 'assistant' THEN CAST(start + length(head) AS BIGINT) END AS mask_start,
    CASE WHEN role = 'assistant' THEN CAST(start + length(content) - 1 AS BIGINT) END AS mask_end
FROM placed
"""
