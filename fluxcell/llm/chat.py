"""Chat formatting: every participant's perspective of a dialogue, with loss masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxcell.llm.common import running, table


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """One row for each conversation, perspective and turn of ``turns(conv_id, turn, role, text)``.

    For every participant (distinct role) the dialogue is rendered with that speaker as the
    assistant and all others as named users:

        <|assistant|>\\n{text}<|end|>\\n         its own turns; the mask covers {text}<|end|>
        <|user:{name}|>\\n{text}<|end|>\\n       the others'; no mask

    ``rendered`` is the turn's piece; in the whole rendering, which is the pieces of a
    (conv_id, perspective) joined by ``seq``, it takes code points char_start to char_end
    (exclusive), of which mask_start to mask_end are trained on (an empty range at char_start where nothing is). A
    dialogue stays in pieces so that one of any length is never gathered in a row or task; ``seq``
    and the places are prefix sums over range partitions.

    Turns are ordered by turn (null first), role, text; a repeated row counts once. Null role is
    the participant ``unknown``, null text is empty, ``<|`` in a text or name becomes ``< |`` so
    that neither can imitate a marker. Rows without conv_id belong to no dialogue. An empty table
    gives no rows. Other columns are left behind.
    """
    safe = lambda c: F.regexp_replace(c, r"<\|", "< |")
    said = (
        turns.where("conv_id is not null")
        .select(
            "conv_id",
            "turn",
            safe(F.coalesce("role", F.lit("unknown"))).alias("speaker"),
            safe(F.coalesce("text", F.lit(""))).alias("text"),
        )
        .distinct()
    )
    who = said.select("conv_id", F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), "speaker", F.lit("|>\n")))
    seen = said.join(who, "conv_id").select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        "text",
        F.length(head).cast("long").alias("head"),
        F.concat(head, "text", F.lit("<|end|>\n")).alias("rendered"),
    )
    seen = seen.withColumns({"n": F.length("rendered").cast("long"), "one": F.lit(1).cast("long")})
    seen = running(
        seen, ["conv_id", "perspective"], ["turn", "speaker", "text"], {"char_start": "n", "seq": "one"}, "chat"
    )
    end = F.col("char_start") + F.col("n")
    return seen.select(
        "conv_id",
        "perspective",
        "seq",
        "speaker",
        "rendered",
        "char_start",
        end.alias("char_end"),
        F.when(own, F.col("char_start") + F.col("head")).otherwise(F.col("char_start")).alias("mask_start"),
        F.when(own, end - 1).otherwise(F.col("char_start")).alias("mask_end"),
    )


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


OP9_SQL = """
WITH said AS (
  SELECT DISTINCT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), who AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said
), headed AS (
  SELECT conv_id, perspective, turn, speaker, text,
         CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user:' || speaker || '|>' || chr(10) END AS head
  FROM said JOIN who USING (conv_id)
), pieces AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM headed
), placed AS (
  SELECT *, row_number() OVER o - 1 AS seq, (sum(length(rendered)) OVER o)::BIGINT AS char_end FROM pieces
  WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, perspective, seq, speaker, rendered, char_end - length(rendered) AS char_start, char_end,
       char_end - length(rendered) + CASE WHEN speaker = perspective THEN length(head) ELSE 0 END AS mask_start,
       CASE WHEN speaker = perspective THEN char_end - 1 ELSE char_end - length(rendered) END AS mask_end
FROM placed
"""
