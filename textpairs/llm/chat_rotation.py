"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the whole dialogue is rendered once with that speaker as
``assistant`` and all others as named users; only the assistant's contents are trained on.  The result has a row
for each (conversation, perspective, turn): the rendered piece, its place in the rendering, the place
of its content, and the mask.  Concatenating the pieces of a perspective in the order of ``start`` gives the rendering.

Offsets are running sums in two levels (blocks of ``BLOCK`` turns, then turns in a block), and the join
of turns with participants is salted, so a conversation that holds a third of all turns is spread over many tasks.

Defined cases: ``system`` turns are rendered as such and are no participant, so a conversation of
them alone gives no rows; a null speaker is ``unknown``; a null text is empty; a null conversation id is one conversation; a
null turn comes first; equal turns are ordered by speaker, then text; repeated rows are rendered again; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
SALTS = 32
SYSTEM = "system"


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, perspective, turn, role, rendered, start, content_start, content_length, loss_mask``."""
    t = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    people = t.filter(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    people = people.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = t.withColumn("salt", F.pmod(F.xxhash64("turn", "text"), F.lit(SALTS)).cast("int")).alias("t")
    p = people.alias("p")
    views = salted.join(p, F.col("t.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("t.salt") == F.col("p.salt"))).select("t.conv_id", "p.perspective", "t.turn", "t.block", "t.speaker", "t.text")
    mine = F.col("speaker") == F.col("perspective")
    views = views.withColumn("role", F.when(F.col("speaker") == SYSTEM, SYSTEM).when(mine, "assistant").otherwise("user"))
    head = F.concat(F.lit("<|im_start|>"), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(""), F.lit("\n"))
    views = views.withColumn("head", F.length(head)).withColumn("rendered", F.concat(head, F.col("text"), F.lit("<|im_end|>\n")))
    views = views.withColumn("size", F.length("rendered").cast("long"))

    key = ["conv_id", "perspective"]
    blocks = views.groupBy(*key, "block").agg(F.sum("size").alias("all"))
    before = F.sum("all").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("size").over(Window.partitionBy(*key, "block").orderBy(F.asc_nulls_first("turn"), "speaker", "text").rowsBetween(Window.unboundedPreceding, -1))
    views = views.withColumn("inside", F.coalesce(inside, F.lit(0)))
    views = views.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    start = F.col("base") + F.col("inside")
    return views.select(
        "conv_id", "perspective", "turn", "role", "rendered", start.alias("start"), (start + F.col("head")).alias("content_start"),
        F.length("text").cast("long").alias("content_length"), (F.col("role") == "assistant").cast("int").alias("loss_mask"),
    )


def op6_chat_rotation(spark, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
v AS (SELECT t.conv_id, p.perspective, t.turn, t.speaker, t.text,
             CASE WHEN t.speaker = 'system' THEN 'system' WHEN t.speaker = p.perspective THEN 'assistant' ELSE 'user' END AS role
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM v),
r AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM h),
s AS (SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM r)
SELECT conv_id, perspective, turn, role, rendered, start, start + length(head) AS content_start,
       CAST(length(text) AS BIGINT) AS content_length, CAST(role = 'assistant' AS INTEGER) AS loss_mask
FROM s
"""
