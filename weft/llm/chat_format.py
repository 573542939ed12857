"""Chat formatting by rotating the perspective among all parties of a dialogue.

For every participant (each distinct role but the system's), the whole dialogue is rendered with that
speaker as the assistant and every other as a named user; system turns stay system turns in every
perspective. The loss mask is on the assistant's words and the end mark after them, never on headers.

One row a turn and perspective, with the turn's place in the rendered dialogue in code points: its
rows in order, joined, are the dialogue. A dialogue of any length is thus never in one row. The places
are running sums, found without bringing a dialogue together: the lengths of blocks of 256 turn numbers
are summed first, then running sums over a dialogue's blocks and over a block's turns are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import OWN, table, without

#: Turn numbers in a block of the running sums.
BLOCK = 256
SYSTEM = "system"
ROLE, TEXT, BLK = f"{OWN}role", f"{OWN}text", f"{OWN}block"
OUTPUTS = ["perspective", "speaker", "rendered", "start", "content_start", "end", "masked"]


def rotate(turns: DataFrame) -> DataFrame:
    """One row for each turn and perspective of turns (conv_id, turn, role, text), other columns passing through.

    Added (and replaced where they exist): perspective (the role that speaks as the assistant), speaker
    (the rendered name), rendered (header, text and end mark), start and end (code points in the rendered
    dialogue, end exclusive), content_start (where the text begins), masked (true if the span from
    content_start to end takes part in the loss). A null role counts as 'unknown', a null text as empty.
    A dialogue with system turns only has no participant and gives no row. Turns are ordered by turn
    (null first), then role, then text; repeated turns all stay, in any order as they are equal. A null
    conv_id is a dialogue of its own. An empty table gives an empty result.
    """
    turns = without(turns, OUTPUTS).withColumn(ROLE, F.coalesce("role", F.lit("unknown"))).withColumn(TEXT, F.coalesce("text", F.lit("")))
    parties = turns.where(F.col(ROLE) != SYSTEM).select(F.col("conv_id").alias(f"{OWN}conv"), F.col(ROLE).alias("perspective")).distinct()
    rows = turns.join(parties, F.col("conv_id").eqNullSafe(F.col(f"{OWN}conv"))).drop(f"{OWN}conv")
    speaker = F.when(F.col(ROLE) == SYSTEM, SYSTEM).when(F.col(ROLE) == F.col("perspective"), "assistant").otherwise(F.concat(F.lit("user name="), ROLE))
    rows = (
        rows.withColumn("speaker", speaker)
        .withColumn("rendered", F.concat(F.lit("<|"), "speaker", F.lit("|>\n"), TEXT, F.lit("<|end|>\n")))
        .withColumn(BLK, F.floor(F.coalesce("turn", F.lit(0)) / BLOCK))
        .withColumn(f"{OWN}len", F.length("rendered").cast("long"))
    )
    key = ["conv_id", "perspective"]
    blocks = rows.groupBy(*key, BLK).agg(F.sum(f"{OWN}len").alias(f"{OWN}sum"))
    earlier = Window.partitionBy(*key).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias(f"{OWN}c"),
        F.col("perspective").alias(f"{OWN}p"),
        F.col(BLK).alias(f"{OWN}b"),
        F.coalesce(F.sum(f"{OWN}sum").over(earlier), F.lit(0)).alias(f"{OWN}base"),
    )
    within = Window.partitionBy(*key, BLK).orderBy(F.col("turn").asc_nulls_first(), ROLE, TEXT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(f"{OWN}len").over(within))
    same = F.col("conv_id").eqNullSafe(F.col(f"{OWN}c")) & (F.col("perspective") == F.col(f"{OWN}p")) & (F.col(BLK) == F.col(f"{OWN}b"))
    rows = rows.join(blocks, same).withColumn("end", F.col("end") + F.col(f"{OWN}base"))
    return (
        rows.withColumn("start", F.col("end") - F.col(f"{OWN}len"))
        .withColumn("content_start", F.col("start") + F.length("speaker") + 5)
        .withColumn("masked", F.col(ROLE) == F.col("perspective"))
        .select([f"`{c}`" for c in turns.columns if c not in (ROLE, TEXT)] + OUTPUTS)
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", *OUTPUTS)


OP8_SQL = """
WITH t AS (SELECT conv_id, turn, role, coalesce(role, 'unknown') AS r, coalesce(text, '') AS x FROM conversations),
p AS (SELECT DISTINCT conv_id, r AS perspective FROM t WHERE r <> 'system'),
s AS (SELECT t.*, perspective, CASE WHEN r = 'system' THEN 'system' WHEN r = perspective THEN 'assistant' ELSE 'user name=' || r END AS speaker
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
g AS (SELECT *, '<|' || speaker || '|>' || chr(10) || x || '<|end|>' || chr(10) AS rendered FROM s),
e AS (SELECT *, sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, r, x ROWS UNBOUNDED PRECEDING)::bigint AS "end" FROM g)
SELECT conv_id, turn, role, perspective, speaker, rendered, ("end" - length(rendered))::bigint AS start,
       ("end" - length(rendered) + length(speaker) + 5)::bigint AS content_start, "end", r = perspective AS masked FROM e"""
