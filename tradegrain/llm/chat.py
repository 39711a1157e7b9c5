"""Multi-party perspective rotation of dialogues.

Every participant of a conversation gets the whole dialogue once, with their own turns as the assistant and the
others as named users. Only the assistant's words and end marker bear loss. A rendering is a sequence of
segments with their place in it, so a conversation of any length stays spread over many tasks; segments in
order of ``start`` joined together are the rendered text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradegrain.llm.common import all_equal

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
# Turns whose speaker is one of these belong to nobody and are shown to everyone as they are.
CONTEXT_SPEAKERS = ("system",)
UNNAMED = "unknown"
STRETCH = 256  # neighbouring turns numbered by one task


def _plain(text: Column) -> Column:
    """Text that cannot open or close a segment: a space follows the ``<`` of every marker."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate_perspectives(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Segments of every rendering: conv_id, participant, turn, position, role, name, segment, start, n_chars,
    loss_start, loss_chars.

    ``position`` counts the turns of the rendering from 0 and ``start`` is the segment's first character in it.
    ``loss_start`` and ``loss_chars`` give the span of the segment that bears loss, in characters of the
    rendering; both are null where nothing does. A null speaker is the participant ``unknown``, a null text is
    empty, turns are ordered by turn number (null first), then speaker, then text. Repeated rows are turns of
    their own. A null conversation id is a conversation. Conversations of context turns only have no
    participant and no rendering. Other columns are not carried.
    """
    told = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(speaker_col), F.lit(UNNAMED)).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("said"),
    )
    cast = (
        told.filter(~F.col("speaker").isin(*CONTEXT_SPEAKERS))
        .groupBy("conv_id", "speaker")
        .agg(F.count(F.lit(1)).alias("own_turns"))
        .select(F.col("conv_id").alias("c"), F.col("speaker").alias("participant"))
    )
    own = F.col("speaker") == F.col("participant")
    context = F.col("speaker").isin(*CONTEXT_SPEAKERS)
    role = F.when(own, "assistant").when(context, F.col("speaker")).otherwise("user")
    name = F.when(~own & ~context, F.col("speaker"))
    # Names stand on the header line, so line breaks in them become spaces.
    shown = F.regexp_replace(_plain(name), r"[\r\n]", " ")
    header = F.concat(F.lit(OPEN), "role", F.coalesce(F.concat(F.lit(" name="), shown), F.lit("")), F.lit("\n"))
    body = F.concat(_plain(F.col("said")), F.lit(CLOSE))
    seen = (
        told.join(cast, told["conv_id"].eqNullSafe(cast["c"]))
        .select("conv_id", "participant", "turn", "speaker", "said", role.alias("role"), name.alias("name"))
        .withColumn("header_chars", F.length(header))
        .withColumn("segment", F.concat(header, body))
        .withColumn("n_chars", F.length("segment").cast("long"))
    )
    # A conversation of any length is laid out by stretches of turn numbers: sums per stretch give each its offset.
    seen = seen.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    keys = ["conv_id", "participant", "stretch"]
    sums = seen.groupBy(*keys).agg(F.sum("n_chars").alias("chars"), F.count(F.lit(1)).alias("turns"))
    before = W.partitionBy("conv_id", "participant").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns_before"),
    )
    inside = W.partitionBy(*keys).orderBy("turn", "speaker", "said")
    placed = seen.withColumns(
        {
            "local": F.coalesce(F.sum("n_chars").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "index": F.row_number().over(inside) - 1,
        }
    )
    joined = placed.join(offsets, all_equal(placed, offsets, keys)).select(
        placed["*"], offsets["chars_before"], offsets["turns_before"]
    )
    start = F.col("chars_before") + F.col("local")
    speaks = F.col("role") == "assistant"
    return joined.select(
        "conv_id",
        "participant",
        "turn",
        (F.col("turns_before") + F.col("index")).cast("long").alias("position"),
        "role",
        "name",
        "segment",
        start.cast("long").alias("start"),
        "n_chars",
        F.when(speaks, start + F.col("header_chars")).cast("long").alias("loss_start"),
        # The line break after the end marker is layout, not learned.
        F.when(speaks, F.col("n_chars") - F.col("header_chars") - 1).cast("long").alias("loss_chars"),
    )
